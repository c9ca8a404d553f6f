"""Secret scans: credential patterns, and weak candidates that are reported only with their complements.

Base patterns (assign, access, hex) report every match on its own. Weak candidates (outside base spans) of three parts,
access identifiers, secrets and endpoints, are too common to report alone. They are interval-joined
within scopes: two parts belong together when at most ``scope`` code points lie between their spans.
A weak identifier or secret is reported when a part of the other of these two kinds (a base access key
or hex or assigned secret counts) lies in its scope apart from it; an endpoint when both others do.

DataFrame functions only. Where matches lie follows from splitting a text at them: the lengths of the
pieces between and of the matches add up. The interval join deals every span to the buckets of ``scope``
code points that it or its margin touches, so it is an equi-join on (document, bucket) and a text with
many candidates is spread by bucket.

Offsets are code points, ends exclusive. Defined cases: a null text is empty; rows with equal doc_id and
text share their links, other rows stand alone; a null doc_id is a document; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

# The base patterns and what a match must have.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: As `AKIA[A-Z0-9]+` of 18 characters and `[0-9a-f]+` of 16: the runs are maximal, so both forms match alike.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
LEAST_ASSIGNED = 12
KINDS = ("assign", "access", "hex", "weak_id", "weak_secret", "endpoint")
#: Weak parts: an upper-case identifier with a digit, a long mixed token, a host with a path or port.
WEAK_ID = r"\b(?=[A-Z0-9]*[0-9])[A-Z][A-Z0-9]{11,31}\b"
WEAK_SECRET = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_-]*[0-9])(?=[a-z0-9+/_-]*[A-Z])[A-Za-z0-9+/_-]{20,}={0,2}"
ENDPOINT = r"(?i)\b(?:https?|postgres|mysql|redis|amqp|s3)://[^\s\"'<>]+"


def spans(text: Column, pattern: str, kind: int, keep: tuple[int, int] | None = None) -> Column:
    """(start, end, kind) of all matches; ``keep``: a group and its least length."""
    re = F.lit(pattern)
    found = F.regexp_extract_all(text, re, F.lit(0))
    between = F.split(text, pattern, -1)
    good = F.transform(found, lambda _: F.lit(True))
    if keep:
        good = F.transform(F.regexp_extract_all(text, re, F.lit(keep[0])), lambda x: F.length(x) >= keep[1])
    each = F.arrays_zip(
        F.transform(found, lambda x: F.length(x)).alias("n"),
        F.transform(F.slice(between, 1, F.size(found)), lambda x: F.length(x)).alias("gap"),
        good.alias("good"),
    )
    placed = _placed(each)
    out = F.transform(
        F.filter(placed, lambda m: m["good"]),
        lambda m: F.struct((m["end"] - m["n"]).alias("start"), m["end"].alias("end"), F.lit(kind).alias("kind")),
    )
    return F.when(F.rlike(text, re), out).otherwise(F.expr("CAST(array() AS array<struct<start: int, end: int, kind: int>>)"))


def _bound(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once however often the body names it, in lambdas too."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _placed(each: Column) -> Column:
    """``end, n, good`` of every match from the lengths of gaps and matches.

    Appending to an array copies it, so running sums are taken in pieces of about the square root of all matches,
    and then over the pieces: 32,000 matches copy some 6 million numbers and not a billion.
    """
    empty = F.expr("CAST(array() AS array<struct<end: int, n: int, good: boolean>>)")
    cut = lambda x: F.transform(
        F.sequence(F.lit(0), F.floor((F.size(x["all"]) - 1) / x["width"]).cast("int")), lambda k: F.slice(x["all"], k * x["width"] + 1, x["width"])
    )
    pieces = _bound(each, lambda own: _bound(F.struct(own.alias("all"), F.ceil(F.sqrt(F.size(own))).cast("int").alias("width")), cut))
    inner = F.transform(
        pieces,
        lambda piece: F.aggregate(
            piece,
            F.struct(F.lit(0).alias("at"), empty.alias("out")),
            lambda acc, m: F.struct(
                (acc["at"] + m["gap"] + m["n"]).alias("at"),
                F.concat(
                    acc["out"], F.array(F.struct((acc["at"] + m["gap"] + m["n"]).alias("end"), m["n"].alias("n"), m["good"].alias("good")))
                ).alias("out"),
            ),
        ),
    )
    whole = F.expr("CAST(array() AS array<array<struct<end: int, n: int, good: boolean>>>)")
    return F.aggregate(
        inner,
        F.struct(F.lit(0).alias("at"), whole.alias("out")),
        lambda acc, piece: F.struct(
            (acc["at"] + piece["at"]).alias("at"),
            F.concat(
                acc["out"],
                F.array(
                    F.transform(
                        piece["out"], lambda m: F.struct((m["end"] + acc["at"]).alias("end"), m["n"].alias("n"), m["good"].alias("good"))
                    )
                ),
            ).alias("out"),
        ),
        lambda acc: F.flatten(acc["out"]),
    )


def candidates(docs: DataFrame) -> DataFrame:
    """``doc_id, th, base, weak``: the base spans in order and all that match a weak pattern, for each row."""
    text = F.col("text")
    base = F.concat(spans(text, ASSIGN, 0, (2, LEAST_ASSIGNED)), spans(text, ACCESS, 1), spans(text, HEX, 2))
    weak = F.concat(spans(text, WEAK_ID, 3), spans(text, WEAK_SECRET, 4), spans(text, ENDPOINT, 5))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.select(
        "doc_id",
        F.xxhash64("doc_id", "text").alias("th"),
        F.array_sort(F.transform(base, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))).alias("base"),
        weak.alias("weak"),
    )


def linked(found: DataFrame, scope: int) -> DataFrame:
    """``doc_id, th, extra``: the weak spans of each document that lie apart from base ones and have their complements within ``scope``."""
    some = found.where("size(weak) > 0").dropDuplicates(["doc_id", "th"])
    slim = lambda a: F.transform(a, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    part = F.when(F.col("kind").isin(1, 3), 0).when(F.col("kind") == 5, 2).otherwise(1)
    every = some.select("doc_id", "th", F.explode(F.concat(slim(F.col("base")), slim(F.col("weak")))).alias("s")).select(
        "doc_id", "th", "s.*"
    )
    every = every.withColumn("part", part)
    # weak spans over a base one go; both sides meet in the buckets of ``scope`` code points that they touch
    touched = F.explode(F.expr(f"sequence(start div {scope}, (end - 1) div {scope})"))
    base = every.where("kind < 3").select(
        F.col("doc_id").alias("d"), F.col("th").alias("t"), F.col("start").alias("start2"), F.col("end").alias("end2"), touched.alias("bucket2")
    )
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")) & (F.col("bucket") == F.col("bucket2"))
    met = every.where("kind >= 3").withColumn("bucket", touched).join(base, same & (F.col("start") < F.col("end2")) & (F.col("start2") < F.col("end")), "left")
    keys = ["doc_id", "th", "start", "end", "kind", "part"]
    weak = met.groupBy(*keys).agg(F.max("start2").alias("over")).where("over IS NULL").select(*keys)
    left = weak.select(
        *keys, F.explode(F.expr(f"sequence((start - {scope}) div {scope} - 1, (end + {scope}) div {scope})")).alias("bucket")
    )
    right = every.where("kind < 3").select(*keys).union(weak.where("part < 2")).select(
        F.col("doc_id").alias("d"), F.col("th").alias("t"), F.col("start").alias("start2"), F.col("end").alias("end2"),
        F.col("part").alias("part2"), F.explode(F.expr(f"sequence(start div {scope}, end div {scope})")).alias("bucket2"),
    )
    near = left.join(
        right,
        same
        & (F.col("start2") <= F.col("end") + scope)
        & (F.col("start") <= F.col("end2") + scope)
        & ((F.col("start2") >= F.col("end")) | (F.col("start") >= F.col("end2")))
        & (F.col("part") != F.col("part2")),
    )
    met = near.groupBy("doc_id", "th", "start", "end", "kind").agg(F.bit_or(F.col("part2") + 1).alias("met"))
    # an identifier needs a secret, a secret an identifier, an endpoint both
    good = met.where((F.col("kind") < 5) | (F.col("met") == 3))
    return good.groupBy("doc_id", "th").agg(F.collect_list(F.struct("start", "kind", "end")).alias("extra"))


def scan(docs: DataFrame, scope: int = 200) -> DataFrame:
    """``doc_id, base, spans``: arrays of (start, kind number, end) in order, the base ones and all that are reported."""
    found = stored(candidates(docs), "secrets")
    more = linked(found, scope).select(F.col("doc_id").alias("d"), F.col("th").alias("t"), "extra")
    out = found.join(more, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")), "left")
    extra = F.coalesce("extra", F.expr("CAST(array() AS array<struct<start: int, kind: int, end: int>>)"))
    return out.select("doc_id", "base", F.array_sort(F.concat("base", extra)).alias("spans"))


def listed(spans_: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(
            spans_,
            lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def digests(scanned: DataFrame) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans``."""
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return scanned.select(
        "doc_id",
        n(0).alias("n_assign"),
        n(1).alias("n_access"),
        n(2).alias("n_hex"),
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )

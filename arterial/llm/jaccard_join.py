"""N-gram Jaccard join: a size-aware join of shingle sets.

Equal sets are collapsed first, so copies cost one row. Small sets ("light") enumerate all their
subsets of the sizes an intersection can have; two small sets that may link share such a subset.
Larger sets ("heavy") post the shingles of their prefix in inverted lists that are then scanned: in
any fixed order of the shingles, sets with a Jaccard similarity of t or more share one of the first
n - ceil(t*n) + 1 ones. The order puts frequent shingles last (a matter of speed only), which keeps
common lines and passages out of the lists. The boundary between both kinds is where enumerating
would cost more than scanning (see :func:`boundary`): a subset costs one key, a posting as many as the list
holds that it meets on average, which is measured over all texts.

Postings travel packed, by buckets of their hash; a task sends one posting for each key it met in several
documents, so a key in a third of all documents adds an entry for each task and not for each document.

A list is never expanded into all its pairs. First each member meets the leading set of its task or of
the list: the one of which most postings met others, as the common original of near copies does. Exact checks of these pairs give links and components. Only lists of three or more where
such a pair lies in two components go on, and there all pairs from different components are compared
(long lists in several tasks), so nothing that could join two components is left out, and a group of n near copies costs n checks and not
n * n. Before texts are fetched, parity bitmaps (a bit for each element and a size near the set's) bound
the difference of two sets from below: each element in one set alone changes one bit. What they drop
can't be a link.

Defined cases: a null or wordless text has the empty set, which links with nothing; a text of fewer
words than a shingle has its whole word sequence as its only one; a null doc_id takes no part and
has a null component; rows with the same doc_id are one node; other columns are ignored.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesops import U, buffers, by_bucket, grouped, mix, pack, pieces, row_shingles, trimmed, unpack
from .common import components, discard, stored

#: A shingle in this many documents of one task or more is put last in the order.
FREQUENT_IN_TASK = 4
#: At most this many frequent shingles are sent to all tasks (8 bytes each).
FREQUENT_MOST = 500_000
#: Members of a leader's group checked by one task.
GROUP = 256
#: At most this many document ids are broadcast.
BROADCAST_IDS = 1_000_000
#: Members of a list that one task compares with the whole list.
PART = 2048
#: Keys of a set by which a pair that meets in several lists is told once.
LEAST_KEYS = 16
#: Bytes of a bucket of postings.
BUCKET_BYTES = 4 << 20
#: Texts are cut into slices of about this many bytes.
SLICE = 1 << 20


def needed(n: int, percent: int) -> int:
    """The least intersection a set of ``n`` shingles needs with any set it may link with."""
    return -(-percent * n // 100)


def subsets(n: int, percent: int) -> int:
    return sum(comb(n, c) for c in range(needed(n, percent), n + 1))


def boundary(percent: int, scan_cost: float, most: int = 16) -> int:
    """The largest size up to which enumerating subsets costs no more than scanning prefix lists of ``scan_cost`` entries."""
    n = 0
    while n < most and subsets(n + 1, percent) <= scan_cost * (n + 1 - needed(n + 1, percent) + 1):
        n += 1
    return n


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """For each row its doc_id, set size, fingerprint of 128 bits and parity bitmap (kind 1); and shingles with the number of
    documents in which one task met them, if that is ``FREQUENT_IN_TASK`` or more (kind 0); and what its postings would
    scan in the lists of a slice, with their number (kind 2)."""

    def work(batches):
        seen: list[np.ndarray] = []
        for batch in pieces(batches, "text", SLICE):
            h, place = row_shingles(*buffers(batch.column("text")), width)
            rows = batch.num_rows
            n, f1, f2 = np.zeros(rows, np.int64), np.zeros(rows, U), np.zeros(rows, U)
            distinct = []
            for r in range(rows):
                s = _distinct(h[place[r] : place[r + 1]])
                distinct.append(s)
                n[r] = len(s)
            flat = np.concatenate(distinct)
            some = np.flatnonzero(n)
            if len(some):
                first = (np.cumsum(n) - n)[some]
                f1[some] = np.add.reduceat(mix(flat), first)
                f2[some] = np.add.reduceat(mix(flat * U(0x9E3779B97F4A7C15) + U(1)), first)
            bits = pa.array([parity(s) for s in distinct], pa.binary())
            yield _kinds(1, batch.column("doc_id"), n, f1.view(np.int64), f2.view(np.int64), bits)
            seen.append(flat)
            if len(seen) >= 16:
                yield from _counts(seen)
                seen = []
        if seen:
            yield from _counts(seen)

    return stored(docs.mapInArrow(trimmed(work), "kind int, a long, b long, c long, d long, e binary"), "sets")


def _distinct(h: np.ndarray) -> np.ndarray:
    s = np.sort(h)
    return s[np.concatenate(([True], s[1:] != s[:-1]))] if len(s) > 1 else s


def parity(s: np.ndarray) -> bytes:
    """The parity bitmap of a set: as many bits as the next power of two from the size on, 64 at least."""
    size = max(64, 1 << (len(s) - 1).bit_length()) if len(s) else 64
    return np.packbits(np.bincount((s >> U(7)).astype(np.int64) & (size - 1), minlength=size) & 1, bitorder="little").tobytes()


def least_difference(a: bytes, b: bytes) -> int:
    """A lower bound of the symmetric difference of two sets from their bitmaps; the larger one is folded."""
    x, y = int.from_bytes(a, "little"), int.from_bytes(b, "little")
    n, m = len(a) * 8, len(b) * 8
    while n > m:
        n //= 2
        x = (x >> n) ^ (x & ((1 << n) - 1))
    while m > n:
        m //= 2
        y = (y >> m) ^ (y & ((1 << m) - 1))
    return (x ^ y).bit_count()


def _alike(pairs: DataFrame, bits: DataFrame, percent: int) -> DataFrame:
    """The rows of ``pairs(a, b)`` that their bitmaps (``bits(doc_id, n, bits)``) don't rule out."""
    a, b = (bits.select(F.col("doc_id").alias(x), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}")) for x in "ab")

    def work(batches):
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("n_a", "n_b", "bits_a", "bits_b"))
            # intersection over union is percent / 100 or more where 100 * (n_a + n_b - d) >= percent * (n_a + n_b + d)
            keep = [(100 - percent) * (n + m) >= (100 + percent) * least_difference(x, y) for n, m, x, y in zip(*columns, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(a, "a").join(b, "b").mapInArrow(work, "a long, b long").distinct()


def _across(mixed: DataFrame, percent: int, limit: int) -> DataFrame:
    """Pairs (a < b) of members of one list that lie in different components and may link by size and bitmap.

    Near copies meet in many lists. A pair is told at the least key that both have among their ``LEAST_KEYS``
    smallest ones; without such a key at each list where it meets, and so are pairs of small sets, which
    count at subsets only.
    """
    least = mixed.groupBy("doc_id").agg(F.slice(F.sort_array(F.collect_set("key")), 1, LEAST_KEYS).alias("least"))
    mixed = mixed.join(least, "doc_id")
    parts = (F.col("rows") / PART).cast("long") + 1
    dealt = mixed.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).withColumn(
        "own", F.pmod(F.xxhash64("doc_id"), parts) == F.col("part")
    )

    def compare(key: int, size: np.ndarray, doc: np.ndarray, component: np.ndarray, own: np.ndarray, bits: list[bytes], least: list[set]):
        # sets within the size bound have bitmaps of one length or of two next to each other
        length = np.fromiter(map(len, bits), np.int64, len(bits))
        for n in np.unique(length).tolist():
            for m in (n, 2 * n):
                left, right = np.flatnonzero(length == n), np.flatnonzero(length == m)
                folded = [np.bitwise_xor.reduce(np.frombuffer(bits[j], "<u8").reshape(-1, n // 8), axis=0) for j in right.tolist()]
                if not folded:
                    continue
                folded = np.stack(folded)
                for i in left.tolist() if m == n else right.tolist():
                    if own[i]:
                        with_, rows = (right, folded) if m == n else (left, None)
                        yield from near(key, i, with_, rows, size, doc, component, bits, n, m == n, least)

    def near(key, i, other, rows, size, doc, component, bits, n, ordered, least):
        small, large = np.minimum(size[other], size[i]), np.maximum(size[other], size[i])
        ok = (component[other] != component[i]) & (percent * large <= 100 * small)
        if ordered:
            ok &= doc[other] > doc[i]
        if not key & 1:
            ok &= large > limit
        at = np.flatnonzero(ok)
        if not len(at):
            return
        if rows is None:
            rows = np.stack([np.frombuffer(bits[j], "<u8") for j in other[at].tolist()])
        else:
            rows = rows[at]
        mine = np.bitwise_xor.reduce(np.frombuffer(bits[i], "<u8").reshape(-1, n // 8), axis=0)
        d = np.bitwise_count(rows ^ mine).sum(axis=1, dtype=np.int64)
        at = other[at[(100 - percent) * (size[other[at]] + size[i]) >= (100 + percent) * d]]
        here = [max(size[j], size[i]) <= limit or min(least[i] & least[j], default=key) == key for j in at.tolist()]
        at = at[np.array(here, bool)]
        if len(at):
            yield np.minimum(doc[at], doc[i]), np.maximum(doc[at], doc[i])

    def work(batches):
        held, at = [], None
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("key", "part", "size", "doc_id", "component", "own", "bits", "least")), strict=True)
            for key, part, *row in rows:
                if at != (key, part) and held:
                    yield pairs(at[0], held)
                    held = []
                at = (key, part)
                held.append(row)
        if held:
            yield pairs(at[0], held)

    def pairs(key: int, held: list) -> pa.RecordBatch:
        *columns, bits, least = zip(*held, strict=True)
        found = list(compare(key, *map(np.array, columns), bits, [set(x) for x in least]))
        a, b = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
        return pa.record_batch({"a": pa.array(a), "b": pa.array(b)})

    dealt = dealt.repartition("key", "part").sortWithinPartitions("key", "part")
    return dealt.mapInArrow(trimmed(work), "a long, b long").distinct()


def _kinds(kind: int, a, b: np.ndarray, c: np.ndarray | None = None, d: np.ndarray | None = None, e: pa.Array | None = None) -> pa.RecordBatch:
    columns = {x: pa.nulls(len(b), pa.int64()) if v is None else pa.array(v) if isinstance(v, np.ndarray) else v for x, v in zip("abcd", (a, b, c, d), strict=True)}
    columns["e"] = pa.nulls(len(b), pa.binary()) if e is None else e
    return pa.record_batch({"kind": pa.array(np.full(len(b), kind, np.int32))} | columns)


def _counts(seen: list[np.ndarray]):
    value = np.concatenate(seen)
    value.sort()
    first = np.flatnonzero(np.concatenate(([True], value[1:] != value[:-1]))) if len(value) else np.zeros(0, np.int64)
    n = np.diff(np.append(first, len(value)))
    keep = n >= FREQUENT_IN_TASK
    yield _kinds(0, value[first[keep]].view(np.int64), n[keep])
    yield _kinds(2, np.array([(n * n).sum()], np.int64), np.array([n.sum()], np.int64))


def _scan_cost(sets: DataFrame) -> float:
    """The entries of the list that a posting meets on average."""
    scanned, postings = sets.where("kind = 2").agg(F.sum("a"), F.sum("b")).first()
    return scanned / postings if postings else 1.0


def _frequent(sets: DataFrame) -> np.ndarray:
    """The most frequent shingles, in the order of their hashes."""
    found = sets.where("kind = 0").groupBy("a").agg(F.sum("b").alias("n")).orderBy(F.desc("n"), "a").limit(FREQUENT_MOST)
    return np.sort(np.array([r[0] for r in found.select("a").collect()], np.int64).view(U))


def _keys(h: np.ndarray, late: np.ndarray, masks: dict[int, np.ndarray], often: np.ndarray, percent: int) -> tuple[int, np.ndarray]:
    """Size of a document's set and what it posts; the lowest bit tells a subset's key from a shingle."""
    s = _distinct(h)
    n = len(s)
    if not n:
        return 0, s
    subset = mix(masks[n] @ mix(s)) | U(1) if n in masks else s[:0]
    if late.any():
        mark = often[np.minimum(np.searchsorted(often, s), len(often) - 1)] == s
        s = np.concatenate((s[~mark], s[mark]))
    return n, np.concatenate((s[: n - needed(n, percent) + 1] & ~U(1), subset))


MEMBERS = "bucket long, kind int, blob binary, key long, size long, doc_id long, size_a long, a long"


def _members(key: np.ndarray, size: np.ndarray, doc: np.ndarray, size_a: np.ndarray, a: np.ndarray) -> pa.RecordBatch:
    """Members of lists with the leading set they meet."""
    n = len(key)
    columns = {"key": key.view(np.int64), "size": size, "doc_id": doc, "size_a": size_a, "a": a}
    head = {"bucket": pa.array(doc & 0xFFFF), "kind": pa.array(np.ones(n, np.int32)), "blob": pa.nulls(n, pa.binary())}
    return pa.record_batch(head | {c: pa.array(v.astype(np.int64)) for c, v in columns.items()})


def _lists(key: np.ndarray, score: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order by (key, score, doc), where each list begins in it, and the lists' lengths."""
    order = np.lexsort((doc, score, key))
    k = key[order]
    first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.zeros(0, np.int64)
    return order, first, np.diff(np.append(first, len(k)))


def _scores(key: np.ndarray, row: np.ndarray, count: np.ndarray) -> np.ndarray:
    """For each row how many of a thousand of its postings met no other row's."""
    _, back, times = np.unique(key, return_inverse=True, return_counts=True)
    alone = np.bincount(row, weights=times[back] == 1, minlength=len(count))
    return np.round(1000 * alone / np.maximum(count, 1)).astype(np.int64)


def _led(key: np.ndarray, size: np.ndarray, doc: np.ndarray, order: np.ndarray, first: np.ndarray, length: np.ndarray) -> pa.RecordBatch:
    """All members of lists longer than one but the leading ones."""
    keep = np.repeat(length > 1, length)
    keep[first] = False
    lead = order[np.repeat(first, length)][keep]
    own = order[keep]
    return _members(key[own], size[own], doc[own], size[lead], doc[lead])


def _post(docs: DataFrame, width: int, percent: int, limit: int, frequent: np.ndarray, buckets: int) -> DataFrame:
    """The members of all lists with several: ``key, size, doc_id, size_a, a`` (the leading set's size and document)."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def work(batches):
        often = shared.value
        filter_bits = np.zeros(1 << 20, bool)
        filter_bits[(often >> U(44)).astype(np.int64)] = True
        masks = {n: _subset_masks(n, percent) for n in range(1, limit + 1)}
        for batch in pieces(batches, "text", 2 * SLICE):
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            sizes, keys = [], []
            for piece in pieces([batch], "text", SLICE):
                h, place = row_shingles(*buffers(piece.column("text")), width)
                late = np.zeros(len(h), bool)
                maybe = np.flatnonzero(filter_bits[(h >> U(44)).astype(np.int64)])
                if len(maybe) and len(often):
                    near = np.minimum(np.searchsorted(often, h[maybe]), len(often) - 1)
                    late[maybe] = often[near] == h[maybe]
                for r in range(piece.num_rows):
                    own = slice(place[r], place[r + 1])
                    n, k = _keys(h[own], late[own], masks, often, percent)
                    sizes.append(n)
                    keys.append(k)
            count = np.fromiter(map(len, keys), np.int64, len(keys))
            key = np.concatenate(keys)
            size, doc = np.repeat(np.array(sizes, np.int64), count), np.repeat(ids, count)
            if not len(key):
                continue
            row = np.repeat(np.arange(len(ids)), count)
            score = _scores(key, row, count)
            order, first, length = _lists(key, score[row], doc)
            yield _led(key, size, doc, order, first, length)
            lead = np.sort(order[first])  # documents in their order
            out: list[tuple[int, bytes]] = []
            for k, own in grouped((key[lead] % U(buckets)).astype(np.int64)):
                at_ = lead[own]
                docs_, local = np.unique(row[at_], return_inverse=True)
                step = np.diff(local, prepend=0).astype("<u4")
                n = np.array(sizes)[docs_].astype("<u4")
                out.append((k, pack(ids[docs_].view("<u8"), n, score[docs_].astype("<u2"), key[at_], step)))
            bucket, blob = zip(*out, strict=True)
            nulls = {c: pa.nulls(len(out), pa.int64()) for c in ("key", "size", "doc_id", "size_a", "a")}
            yield pa.record_batch(
                {"bucket": pa.array(bucket, pa.int64()), "kind": pa.array(np.zeros(len(out), np.int32)), "blob": pa.array(blob, pa.binary())} | nulls
            )

    def gather(blobs):
        columns = []
        for blob in blobs:
            ids, n, score, key, step = unpack(blob)
            local = np.cumsum(step.astype(np.int64))
            columns.append((key, n.astype(np.int64)[local], score[local], ids.view(np.int64)[local]))
        key, size, score, doc = (np.concatenate(x) for x in zip(*columns, strict=True))
        yield _led(key, size, doc, *_lists(key, score, doc))

    def collect(batches):
        yield from by_bucket(batches, gather)

    n = max(buckets, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = docs.where("doc_id IS NOT NULL").mapInArrow(trimmed(work), MEMBERS).repartition(n, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(trimmed(collect), MEMBERS).select("key", "size", "doc_id", "size_a", "a")


def _subset_masks(n: int, percent: int) -> np.ndarray:
    """0/1 rows, one for each subset of a size that an intersection can have."""
    bits = (np.arange(1 << n)[:, None] >> np.arange(n)) & 1
    return bits[bits.sum(axis=1) >= needed(n, percent)].astype(U)


def _checked(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """A stored table of the rows of ``pairs(a, b)`` whose texts link: each group of one ``a`` is split into tasks of ``GROUP``."""
    size = pairs.groupBy("a").agg((F.count(F.lit(1)) / GROUP).cast("long").alias("parts"))
    dealt = pairs.join(size, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts") + 1).alias("part"))
    need = dealt.select(F.col("b").alias("doc_id"), "a", "part", F.lit(1).alias("role")).union(
        dealt.select(F.col("a").alias("doc_id"), "a", "part", F.lit(0).alias("role")).distinct()
    )
    need = stored(need, "need")
    ids = stored(need.select("doc_id").distinct(), "ids")
    # a few ids (8 bytes each) are sent to the texts; beyond that both are shuffled
    some = docs.join(F.broadcast(ids), "doc_id", "left_semi") if ids.count() <= BROADCAST_IDS else docs
    texts = need.join(some, "doc_id")

    def work(batches):
        lead, own = None, []
        for batch in pieces(batches, "text", SLICE):
            h, place = row_shingles(*buffers(batch.column("text")), width)
            a, b = [], []
            columns = (batch.column(c).to_pylist() for c in ("a", "part", "role", "doc_id"))
            for r, (first, part, role, doc) in enumerate(zip(*columns, strict=True)):
                s = np.unique(h[place[r] : place[r + 1]])
                if not role:
                    own = [*own, s] if lead == (first, part) else [s]
                    lead = (first, part)
                    continue
                for x in own if lead == (first, part) else []:
                    both = len(np.intersect1d(x, s, assume_unique=True))
                    if both and 100 * both >= percent * (len(x) + len(s) - both):
                        a.append(first)
                        b.append(doc)
                        break
            yield pa.record_batch({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    links = texts.repartition("a", "part").sortWithinPartitions("a", "part", "role").mapInArrow(trimmed(work), "a long, b long").distinct()
    links = stored(links, "links")
    discard(need, ids)
    return links


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for each row of ``docs(doc_id, text)``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets = _sets(docs, width)
    limit = boundary(percent, _scan_cost(sets))
    frequent = _frequent(sets)
    rows = sets.where("kind = 1").select(F.col("a").alias("doc_id"), F.col("b").alias("n"), F.col("c").alias("f1"), F.col("d").alias("f2"), F.col("e").alias("bits"))
    known = rows.where("n > 0 AND doc_id IS NOT NULL")
    reps = known.groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    copies = known.join(reps.where("copies > 1"), ["f1", "f2"]).where("doc_id <> rep").select(F.col("doc_id").alias("copy"), "rep").distinct()
    copies = stored(copies, "copies")

    shingles = known.agg(F.sum("n")).first()[0] or 0
    buckets = 1 + shingles * (100 - percent + 1) // 100 * 16 // BUCKET_BYTES
    members = _post(docs, width, percent, limit, frequent, int(buckets))
    lead = copies.select(F.col("copy").alias("copy_a"), F.col("rep").alias("rep_a"))
    members = members.join(copies, F.col("doc_id") == F.col("copy"), "left").join(lead, F.col("a") == F.col("copy_a"), "left")
    members = members.select("key", "size", F.coalesce("rep", "doc_id").alias("doc_id"), "size_a", F.coalesce("rep_a", "a").alias("a"))
    members = stored(members.where("doc_id <> a"), "members")

    bits = known.select("doc_id", "n", "bits").join(copies, F.col("doc_id") == F.col("copy"), "left_anti")
    near = f"{percent} * greatest(size, size_a) <= 100 * least(size, size_a)"
    enumerated = f"(key & 1 = 1 OR greatest(size, size_a) > {limit})"
    met = members.groupBy("a", F.col("doc_id").alias("b")).agg(F.max(F.expr(f"{near} AND {enumerated}")).alias("check"))
    met = stored(met, "met")
    check = stored(_alike(met.where("check").select("a", "b"), bits, percent), "check")
    links = _checked(check, docs, width, percent)
    discard(check)
    found = components(links)
    first = stored(found, "classes")
    discard(found)

    at_a, at_b = (first.select(F.col("node").alias(f"node_{x}"), F.col("component").alias(f"component_{x}")) for x in "ab")
    of_a, of_b = F.coalesce("component_a", "a"), F.coalesce("component_b", "b")
    apart = (
        met.join(at_a, F.col("a") == F.col("node_a"), "left").join(at_b, F.col("b") == F.col("node_b"), "left").where(of_a != of_b)
    )
    apart = stored(apart.select(F.col("a").alias("a"), F.col("b").alias("doc_id"), F.lit(True).alias("apart")), "apart")
    marked = members.join(apart, ["a", "doc_id"], "left")
    keys = marked.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.max("apart").alias("apart")).where("rows > 1 AND apart")
    keys = stored(keys.select("key", "rows"), "keys")
    mixed = members.join(keys, "key")
    mixed = mixed.select("key", "rows", "size", "doc_id").union(mixed.select("key", "rows", "size_a", "a")).distinct()
    mixed = mixed.join(first, F.col("doc_id") == F.col("node"), "left")
    mixed = stored(mixed.select("key", "rows", "size", "doc_id", F.coalesce("component", "doc_id").alias("component")), "mixed")
    rest = _across(mixed.join(bits.select("doc_id", "bits"), "doc_id"), percent, limit)
    done = met.where("check").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = stored(rest.join(done, ["a", "b"], "left_anti"), "rest")
    discard(members, met, first, apart, keys, mixed)
    more = _checked(rest, docs, width, percent)
    joined = components(links.union(more))
    discard(rest, links, more, copies)

    classes = reps.join(joined, F.col("rep") == F.col("node"), "left").select(
        "f1", "f2", F.coalesce("component", "rep").alias("component_id")
    )
    keyed = known.join(classes, ["f1", "f2"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = rows.where("n = 0 OR doc_id IS NULL").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).alias("component_id")
    )
    return keyed.union(alone)

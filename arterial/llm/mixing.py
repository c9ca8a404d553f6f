"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Sources in code-point order (null last) weigh 1, 2, 3, 1, 2, 3, ... and share all words; no target
exceeds ``most`` times its source, and what that leaves over goes to the others by weight. A source
is taken in complete epochs first. For the fraction that remains, each document draws the exponential
key -ln(u) / w, with u from a hash of its id and w its quality weight; documents are sorted by key
within their source, and those are taken whose prefix sum of sizes stays within the budget, the last
one when that comes nearer.

Keys are sorted in ranges over (source, key), so a source with a third of all rows lies in many tasks;
prefix sums are taken within a range and then across ranges, from one row for each source and range.
The table of sources (one row each) is the only one that is ordered as a whole.

Defined cases: size is the number of words, 0 for a null or wordless text, of which nothing is ever
taken; null is a source; null doc_ids and repeated rows are documents of their own, ties in the key
ordered by id and size; a null or non-positive weight counts as 1; other columns are kept out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bytesops import buffers, pieces, trimmed, word_spans
from .common import stored

WEIGHTS = (1, 2, 3)


def sized(docs: DataFrame, keep: tuple[str, ...] = ("doc_id", "source")) -> DataFrame:
    """Columns ``keep`` of ``docs`` with ``size``, the number of words of ``text`` (counted in the bytes)."""

    def work(batches):
        for batch in pieces(batches, "text"):
            _, _, row = word_spans(*buffers(batch.column("text")))
            own = {c: batch.column(c) for c in keep}
            yield pa.record_batch(own | {"size": pa.array(np.bincount(row, minlength=batch.num_rows).astype(np.int64))})

    schema = docs.select(*keep).schema.add("size", "long")
    return docs.select(*keep, "text").mapInArrow(trimmed(work), schema)


def unit(doc_id: str = "doc_id", seed: str = "mix") -> Column:
    """A number in (0, 1) from 52 bits of the id's MD5."""
    h = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))), 1, 13), 16, 10)
    return (h.cast("long") + 0.5) / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``: shares of the total, held at ``most`` times the size.

    Sources are met in the order in which a rising level (words for each unit of weight) fills them;
    a source is full when the level at its turn still exceeds what it can hold for its weight.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")).cast("long")
    s = sizes.withColumn("w", weight).withColumn("room", F.col("source_size") * most)
    order = Window.orderBy(F.col("room") / F.col("w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.partitionBy()
    s = (
        s.withColumn("total", F.sum("source_size").over(all_rows))
        .withColumn("left_w", F.sum("w").over(all_rows) - F.coalesce(F.sum("w").over(before), F.lit(0)))
        .withColumn("left", F.col("total") - F.coalesce(F.sum("room").over(before), F.lit(0)))
        .withColumn("full", F.col("left") * F.col("w") > F.col("room") * F.col("left_w"))
    )
    s = s.withColumn("turn", F.row_number().over(order))
    level = F.min(F.when(~F.col("full"), F.struct("turn", "left", "left_w"))).over(all_rows)
    s = s.withColumn("level", level)
    target = F.when(F.col("full") | F.col("level").isNull(), F.col("room").cast("double")).otherwise(
        (F.col("level.left") * F.col("w")) / F.col("level.left_w")
    )
    return s.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, weight: Column | None = None, weights: tuple[int, ...] = WEIGHTS, most: int = 3, seed: str = "mix") -> DataFrame:
    """``doc_id, source, size, source_size, target, taken`` for each row of ``docs(doc_id, source, size)``.

    ``size`` as :func:`sized` counts it; ``weight``: a column over ``docs``, the quality weight.
    """
    w = F.lit(1.0) if weight is None else F.coalesce(F.when(weight > 0, weight.cast("double")), F.lit(1.0))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    narrow = docs.select("doc_id", "source", F.coalesce("size", F.lit(0)).cast("long").alias("size"), (-F.log(unit(seed=seed)) / w).alias("key"))
    order = [F.col("source").asc_nulls_first(), F.col("key"), F.col("doc_id"), F.col("size")]
    dealt = narrow.repartitionByRange(n, *order).sortWithinPartitions(*order)
    dealt = dealt.withColumn("part", F.shiftrightunsigned(F.monotonically_increasing_id(), 33).cast("int"))
    dealt = stored(dealt.mapInArrow(trimmed(_running), "doc_id long, source string, size long, part int, upto long"), "mix")

    pieces = dealt.groupBy("source", "part").agg(F.sum("size").alias("held"))
    by_source = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("earlier", F.coalesce(F.sum("held").over(by_source), F.lit(0)))
    sizes = pieces.groupBy("source").agg(F.sum("held").alias("source_size"))
    known = pieces.withColumnRenamed("source", "s").join(
        source_targets(sizes, weights, most).withColumnRenamed("source", "t"), F.col("s").eqNullSafe(F.col("t"))
    )
    known = known.select("s", F.col("part").alias("p"), "earlier", "source_size", "target")
    out = dealt.join(known, F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p")))
    epochs = F.least(F.floor(F.col("target") / F.greatest("source_size", F.lit(1))), F.lit(most)).cast("long")
    rest = F.col("target") - epochs * F.col("source_size")
    extra = (F.col("earlier") + F.col("upto") - F.col("size") / 2 <= rest) & (epochs < most)
    taken = F.col("size") * (epochs + F.when(extra, 1).otherwise(0))
    return out.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def _running(batches):
    """The prefix sum of sizes within each source of a sorted partition, each row's own size included."""
    held, total = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        source, size = batch.column("source"), batch.column("size").to_numpy()
        code = source.dictionary_encode().indices.fill_null(-1).to_numpy()
        first = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
        upto = np.cumsum(size)
        before = (upto - size)[first]  # what earlier sources hold; less what the first one brings along
        if held == (source[0].as_py(),):
            before[0] -= total
        upto -= np.repeat(before, np.diff(np.append(first, len(code))))
        held, total = (source[-1].as_py(),), int(upto[-1])
        yield pa.record_batch(
            {
                "doc_id": pc.cast(batch.column("doc_id"), pa.int64()),
                "source": pc.cast(batch.column("source"), pa.string()),
                "size": batch.column("size"),
                "part": batch.column("part"),
                "upto": pa.array(upto.astype(np.int64)),
            }
        )

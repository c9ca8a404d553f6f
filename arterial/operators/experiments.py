"""Workloads and their evaluation: synthetic metrics, samples of queries, comparison of runs.

Random decisions come from a hash of a seed and the arc's id, so reruns and retried tasks agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def uniform(seed: str, key: str) -> Column:
    """A number in [0, 1) for each key, by MD5."""
    return F.expr(f"CAST(conv(substr(md5(concat('{seed}:', {key})), 1, 13), 16, 10) AS BIGINT) / 4503599627370496.0D")


def scaled_metric(arcs: DataFrame, factor: float, slow: tuple[float, float], fast: tuple[float, float], seed: str) -> DataFrame:
    """Weights times ``factor`` (cut off) with a probability that goes linearly from ``slow`` to ``fast`` (speed, probability).

    ``arcs`` have ``dist``; the speed is dist / weight. Arcs of weight 0 stay.
    """
    (v0, p0), (v1, p1) = slow, fast
    share = F.expr(f"(least(greatest(dist / weight, {v0}D), {v1}D) - {v0}D) / ({v1}D - {v0}D)")
    p = F.lit(p0) + share * F.lit(p1 - p0)
    hit = (F.col("weight") > 0) & (uniform(seed, "arc_id") < p)
    return arcs.withColumn("weight", F.when(hit, F.floor(F.col("weight") * factor)).otherwise(F.col("weight")).cast("long"))


def congested(arcs: DataFrame, v_min: float, probability: float, speed: float, seed: str) -> DataFrame:
    """Arcs faster than ``v_min`` (dist / weight) drop to ``speed`` with a probability."""
    hit = F.expr(f"weight > 0 AND dist / weight > {v_min}D") & (uniform(seed, "arc_id") < probability)
    return arcs.withColumn("weight", F.when(hit, F.floor(F.col("dist") / speed)).otherwise(F.col("weight")).cast("long"))


def first_beyond(settled: DataFrame, limit: int) -> DataFrame:
    """Of ``source, node, dist``: for each source the first node settled at ``limit`` or later, as ``source, target, dist``."""
    far = settled.where(F.col("dist") >= limit)
    return far.groupBy("source").agg(F.min(F.struct("dist", "node")).alias("m")).select("source", F.col("m.node").alias("target"), "m.dist")


def ball(settled: DataFrame, size: int) -> DataFrame:
    """The ``size`` nodes nearest to each source, ties by node."""
    nth = F.row_number().over(Window.partitionBy("source").orderBy("dist", "node"))
    return settled.select("source", "node", "dist").withColumn("nth", nth).where(F.col("nth") <= size).drop("nth")


def uniform_trips(spark: SparkSession, nodes: DataFrame, count: int, seed: str) -> DataFrame:
    """``qid, source, target``: ``count`` pairs of the dense nodes 0, 1, ..., drawn independently."""
    n = nodes.count()
    at = lambda what: F.floor(uniform(f"{seed}-{what}", "id") * n).cast("long")
    return spark.range(count).select(F.col("id").alias("qid"), at("source").alias("source"), at("target").alias("target"))


def timed(trips: DataFrame, seed: str, period: int) -> DataFrame:
    """``trips`` with a ``departure`` drawn from the period."""
    return trips.withColumn("departure", F.floor(uniform(f"{seed}-departure", "qid") * period).cast("long"))


def drawn_from_balls(balls: DataFrame, count: int, seed: str) -> DataFrame:
    """Of ``balls(source, node)``: ``count`` nodes of each ball as origins and as many as targets (``ball, role, node``), drawn without repetition."""
    key = "concat(source, '-', node)"
    out = None
    for role in ("origin", "target"):
        nth = F.row_number().over(Window.partitionBy("source").orderBy(F.expr(f"md5(concat('{seed}-{role}:', {key}))"), "node"))
        part = balls.withColumn("nth", nth).where(F.col("nth") <= count).select(F.col("source").alias("ball"), F.lit(role).alias("role"), "node")
        out = part if out is None else out.union(part)
    return out


def checked(found: DataFrame, truth: DataFrame, key: list[str], value: str) -> DataFrame:
    """``found`` with ``agrees``: whether ``value`` equals the ground truth's, nulls included."""
    known = truth.select(*key, F.col(value).alias("__truth"))
    return found.join(known, key, "left").withColumn("agrees", F.col(value).eqNullSafe(F.col("__truth"))).drop("__truth")


def compared_runs(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """One row: number, mean difference and mean, least and greatest ratio of ``value`` in two runs that share keys."""
    both = a.select(*key, F.col("value").alias("x")).join(b.select(*key, F.col("value").alias("y")), key)
    ratio = F.when(F.col("y") != 0, F.col("x") / F.col("y"))
    return both.agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("x") - F.col("y")).alias("difference"), F.avg(ratio).alias("ratio"), F.min(ratio).alias("low"), F.max(ratio).alias("high"))


def relative_delays(bounds: DataFrame) -> DataFrame:
    """One row of delay statistics over ``bounds(low, high)`` of functions; constant ones count in ``n`` and ``mean`` only."""
    delay = (F.col("high") - F.col("low")) / F.col("low")
    changing = F.when(F.col("high") > F.col("low"), delay)
    return bounds.where("low > 0").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("high") == F.col("low")).alias("n_constant"),
        F.avg(delay).alias("mean"),
        F.avg(changing).alias("changing_mean"),
        ((F.sum("high") - F.sum("low")) / F.sum("low")).alias("total"),
        F.percentile(changing, 0.5).alias("median"),
    )

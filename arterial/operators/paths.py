"""Path statistics and quality checks over ``path(qid, pos, node)`` rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cumulative(path: DataFrame, arcs: DataFrame) -> DataFrame:
    """``path`` with ``cum``: the distance from the start, the cheapest of parallel arcs each."""
    step = Window.partitionBy("qid").orderBy("pos")
    cheapest = arcs.groupBy(F.col("tail").alias("before"), F.col("head").alias("node")).agg(F.min("weight").alias("weight"))
    out = path.withColumn("before", F.lag("node").over(step)).join(cheapest, ["before", "node"], "left")
    return out.select("qid", "pos", "node", F.sum(F.coalesce("weight", F.lit(0))).over(step).alias("cum"))


def minimal_intervals(rows: DataFrame) -> DataFrame:
    """Of ``qid, a, b`` (half-open): the distinct intervals that hold no other one.

    Sorted by start (longer first among equals), an interval holds another when some later one ends no
    later: a running minimum from the right tells, without comparing pairs.
    """
    later = Window.partitionBy("qid").orderBy("a", F.desc("b")).rowsBetween(1, Window.unboundedFollowing)
    out = rows.select("qid", "a", "b").distinct().withColumn("least", F.min("b").over(later))
    return out.where("least IS NULL OR least > b").drop("least")


def violating(cumulated: DataFrame, shortest: DataFrame, eps: float) -> DataFrame:
    """Minimal subpaths longer than (1 + eps) times the shortest distance between their ends (``shortest(source, target, dist)``)."""
    a = cumulated.select("qid", F.col("pos").alias("a"), F.col("node").alias("source"), F.col("cum").alias("c1"))
    b = cumulated.select("qid", F.col("pos").alias("b"), F.col("node").alias("target"), F.col("cum").alias("c2"))
    both = a.join(b, "qid").where("a < b").join(shortest, ["source", "target"])
    bad = both.where(F.expr(f"c2 - c1 - dist > floor(dist * {eps}D)"))
    return minimal_intervals(bad.select("qid", "a", "b"))


def stretch(cumulated: DataFrame, shortest: DataFrame) -> DataFrame:
    """``qid, worst``: the greatest ratio of a subpath's length to the shortest distance between its ends."""
    a = cumulated.select("qid", F.col("pos").alias("a"), F.col("node").alias("source"), F.col("cum").alias("c1"))
    b = cumulated.select("qid", F.col("pos").alias("b"), F.col("node").alias("target"), F.col("cum").alias("c2"))
    both = a.join(b, "qid").where("a < b").join(shortest, ["source", "target"]).where("dist > 0")
    return both.groupBy("qid").agg(F.max((F.col("c2") - F.col("c1")) / F.col("dist")).alias("worst"))

"""Lower bounds for goal-directed search: landmarks, metrics for ranges of the day, and merging of metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def landmark_bounds(pairs: DataFrame, landmarks: DataFrame) -> DataFrame:
    """``source, target, bound`` for ``pairs`` from ``landmarks(landmark, node, d_from, d_to)`` by the triangle inequality."""
    v = landmarks.select("landmark", F.col("node").alias("source"), F.col("d_from").alias("f_v"), F.col("d_to").alias("t_v"))
    t = landmarks.select("landmark", F.col("node").alias("target"), F.col("d_from").alias("f_t"), F.col("d_to").alias("t_t"))
    met = pairs.join(v, "source").join(t, ["target", "landmark"])
    bound = F.greatest(F.col("f_t") - F.col("f_v"), F.col("t_v") - F.col("t_t"), F.lit(0))
    return met.groupBy("source", "target").agg(F.max(bound).alias("bound"))


def day_ranges(spark: SparkSession) -> DataFrame:
    """``start, length`` in milliseconds: every half hour from 06:00 to 22:00, for 1, 2, 4 and 8 hours within the day."""
    return spark.sql(
        "SELECT CAST(s * 1800000 AS BIGINT) AS start, CAST(l * 3600000 AS BIGINT) AS length FROM (SELECT explode(sequence(12, 44)) AS s) "
        "LATERAL VIEW explode(array(1, 2, 4, 8)) AS l WHERE s * 1800000 + l * 3600000 <= 86400000"
    )


def merge_metrics(metrics: DataFrame, k: int) -> list[list[int]]:
    """Groups of ``metrics(metric, arc_id, weight)``: the two whose weights differ least (squared) merge into their minimum until ``k`` are left.

    The pairwise sums are one aggregation for each merge; the driver sees a row for each pair of metrics.
    """
    groups = {int(r[0]): [int(r[0])] for r in metrics.select("metric").distinct().collect()}
    while len(groups) > k:
        a = metrics.select(F.col("metric").alias("m"), "arc_id", F.col("weight").alias("w"))
        b = metrics.select(F.col("metric").alias("m2"), "arc_id", F.col("weight").alias("w2"))
        cost = a.join(b, "arc_id").where("m < m2").groupBy("m", "m2").agg(F.sum((F.col("w") - F.col("w2")) * (F.col("w") - F.col("w2"))).alias("cost"))
        first, second = cost.orderBy("cost", "m", "m2").limit(1).collect()[0][:2]
        groups[first] += groups.pop(second)
        metrics = metrics.withColumn("metric", F.when(F.col("metric") == second, first).otherwise(F.col("metric"))).groupBy("metric", "arc_id").agg(F.min("weight").alias("weight"))
    return sorted(sorted(g) for g in groups.values())


def farthest_landmarks(arcs: DataFrame, k: int, start: int) -> DataFrame:
    """``nth, node, gap``: each landmark is the node farthest from all before (the first one: from ``start``), ties by node.

    One search and one ordering for each; the driver sees the chosen nodes.
    """
    from . import search

    spark = arcs.sparkSession
    rows: list[tuple[int, int, int]] = []
    nearest = None
    source = start
    for nth in range(1, k + 1):
        found = search.one_to_all(arcs, spark.createDataFrame([(source,)], "source long")).select("node", "dist")
        if nth == 2 or nearest is None:
            nearest = found
        else:
            nearest = nearest.union(found).groupBy("node").agg(F.min("dist").alias("dist"))
        source, gap = nearest.orderBy(F.desc("dist"), "node").limit(1).collect()[0]
        rows.append((nth, source, gap))
    return spark.createDataFrame(rows, "nth int, node long, gap long")

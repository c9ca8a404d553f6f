"""A road graph over the driver's tables: parts are the nodes of a grid that is 50 wide."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH = 50


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def node_count(spark: SparkSession, sf_dir: str) -> int:
    return table(spark, sf_dir, "part").count()


def arcs(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    """``arc_id, tail, head, weight``: four directions with weights from the part's size.

    ``spread``: dealt over all tasks first, for work that takes long on each arc of a small file.
    """
    n = node_count(spark, sf_dir)
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("v"), F.col("p_size").cast("long").alias("s"))
    if spread:
        p = p.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "v")
    across, down = "v % 50 <> 49 AND v + 1 < {n}", "v + 50 < {n}"
    made = [
        (across, "v", "v + 1", "1 + s", 0),
        (across, "v + 1", "v", "1 + (s * 7) % 50", 1),
        (down, "v", "v + 50", "1 + (s * 3) % 50", 2),
        (down, "v + 50", "v", "1 + (s * 11) % 50", 3),
    ]
    # one scan: each part gives an array of its arcs
    each = [
        F.when(F.expr(ok.format(n=n)), F.struct(F.expr(f"v * 4 + {k}").alias("arc_id"), F.expr(a).alias("tail"), F.expr(b).alias("head"), F.expr(w).alias("weight")))
        for ok, a, b, w, k in made
    ]
    return p.select(F.explode(F.array_compact(F.array(*each))).alias("a")).select("a.*")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``node, x, y``: grid coordinates."""
    return table(spark, sf_dir, "part").selectExpr("p_partkey AS node", f"p_partkey % {WIDTH} AS x", f"p_partkey div {WIDTH} AS y")


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``qid, source, target``: a query for each supplier, from one node for each nation."""
    n = node_count(spark, sf_dir)
    return table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS qid", f"CAST(s_nationkey * 7 % {n} AS BIGINT) AS source", f"s_suppkey * 19 % {n} AS target")


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``arc_id, tail, head, weight, ttf``: hourly travel times, scaled by how busy the hour is among the events."""
    hours = table(spark, sf_dir, "events").groupBy(F.hour("ts").alias("h")).agg(F.count(F.lit(1)).alias("c"))
    # at most 24 rows
    busy = hours.agg(F.sort_array(F.collect_list(F.struct("h", "c"))).alias("busy"), F.max("c").alias("top"))
    out = arcs(spark, sf_dir, spread=True).crossJoin(F.broadcast(busy))
    ttf = F.expr("transform(busy, x -> named_struct('dep', CAST(x.h AS BIGINT) * 3600000, 'tt', weight * 10 * (50 + x.c * 100 div top)))")
    return out.select("arc_id", "tail", "head", "weight", ttf.alias("ttf"))

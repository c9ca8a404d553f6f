"""Speed estimates of the links that vehicles cross, from sparse positions along their known link sequence.

Between two successive positions a vehicle spends its time on the links in proportion to their free-flow
times. A link's speed is the covered length over that time. Its quality is the covered share of the link
times the link's share of the distance between both positions. The first link's entry is extended
backwards at its speed.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Links (vehicle, seq, link_id, length_mm, limit_kmh) and positions (vehicle, seq, ts_ms, link_seq, fraction).
OUT = "vehicle long, link_id long, entered_ms long, quality double, speed_kmh double"


def free_flow_ms(length_mm: float, limit_kmh: float) -> float:
    return length_mm * 3.6 / limit_kmh


def estimate(links: list[tuple[int, float, float]], traces: list[tuple[float, int, float]]) -> list[tuple[int, int, float, float]]:
    """(link id, entered, quality, km/h) for ``links`` (id, length, limit) and ``traces`` (time, place in links, fraction)."""
    if not links or not traces:
        raise ValueError("no links given" if not links else "no traces given")
    if any(b[0] < a[0] or (b[1], b[2]) < (a[1], a[2]) for a, b in zip(traces, traces[1:], strict=False)):
        raise ValueError("positions must follow the links in time")
    time = [0.0] * len(links)
    covered = [0.0] * len(links)
    quality = [0.0] * len(links)
    entered: list[float | None] = [None] * len(links)
    for (t0, i0, f0), (t1, i1, f1) in zip(traces, traces[1:], strict=False):
        part = [(i, (f1 if i == i1 else 1.0) - (f0 if i == i0 else 0.0)) for i in range(i0, i1 + 1)]
        part = [(i, p) for i, p in part if p > 0]
        free = sum(p * free_flow_ms(*links[i][1:]) for i, p in part)
        way = sum(p * links[i][1] for i, p in part)
        at = t0
        for i, p in part:
            spent = (t1 - t0) * p * free_flow_ms(*links[i][1:]) / free
            if entered[i] is None:
                start = f0 if i == i0 else 0.0
                entered[i] = at - (spent * start / p if start else 0.0)
            time[i] += spent
            covered[i] += p * links[i][1]
            quality[i] += p * (p * links[i][1] / way)
            at += spent
    return [
        (links[i][0], int(entered[i]), quality[i], covered[i] * 3.6 / time[i]) for i in range(len(links)) if entered[i] is not None and time[i] > 0
    ]


def estimates(links: DataFrame, traces: DataFrame) -> DataFrame:
    """Estimates for all vehicles; one group for each vehicle's trip. Trips without links or positions give no rows."""

    def work(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(left) and len(right):
            left, right = left.sort_values("seq"), right.sort_values(["ts_ms", "link_seq", "fraction"])
            place = {s: i for i, s in enumerate(left["seq"].tolist())}
            known = list(zip(left["link_id"].tolist(), left["length_mm"].tolist(), left["limit_kmh"].tolist(), strict=True))
            positions = [(t, place[s], f) for t, s, f in zip(right["ts_ms"].tolist(), right["link_seq"].tolist(), right["fraction"].tolist(), strict=True)]
            rows = [(key[0], *r) for r in estimate(known, positions)]
        return pd.DataFrame(rows, columns=["vehicle", "link_id", "entered_ms", "quality", "speed_kmh"])

    return links.groupBy("vehicle").cogroup(traces.groupBy("vehicle")).applyInPandas(work, OUT)


def latest_updates(updates: DataFrame) -> DataFrame:
    """Of ``updates(arc_id, weight, seq)`` the last for each arc; a null weight blocks the arc."""
    return updates.groupBy("arc_id").agg(F.max(F.struct("seq", "weight")).alias("u")).select("arc_id", "u.weight", F.lit(True).alias("updated"))


def updated_metric(arcs: DataFrame, updates: DataFrame, infinity: int) -> DataFrame:
    """``arcs`` with the weights of the last updates; unknown arcs in the updates are ignored."""
    last = latest_updates(updates).withColumnRenamed("weight", "new")
    weight = F.when(F.col("updated"), F.coalesce("new", F.lit(infinity))).otherwise(F.col("weight"))
    return arcs.join(last, "arc_id", "left").withColumn("weight", weight.cast("long")).drop("new", "updated")


def metric_at(spark, table: str, version: int | None) -> DataFrame:
    """The metric after micro-batch ``version`` (None: the base): the base with the last change of each arc up to then."""
    base = spark.read.parquet(f"{table}/base")
    if version is None:
        return base
    changes = spark.read.parquet(f"{table}/changes").where(F.col("batch") <= version)
    return updated_metric(base, changes.select("arc_id", "weight", F.struct("batch", "seq").alias("seq")), 2147483647)


def apply_stream(updates: DataFrame, table: str, checkpoint: str, publish):
    """A streaming query that adds the last change of each arc in each micro-batch to ``table`` and calls ``publish(version, frame)``.

    A batch writes only what it changes, in a partition of its own that a repeated batch overwrites, so a restart is
    safe and a batch costs as much as it holds. ``table/base`` holds the metric without changes.
    """

    def each(batch: DataFrame, number: int) -> None:
        last = batch.groupBy("arc_id").agg(F.max(F.struct("seq", "weight")).alias("u")).select("arc_id", "u.seq", "u.weight")
        last.write.mode("overwrite").parquet(f"{table}/changes/batch={number}")
        publish(number, metric_at(batch.sparkSession, table, number))

    return updates.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()


def windowed_speeds(events: DataFrame, width: str = "15 minutes", late: str = "30 minutes") -> DataFrame:
    """``start, arc_id, n, mean`` of ``events(ts, arc_id, speed)`` in windows of time; rows later than ``late`` after the newest go.

    On a stream the windows are state that the watermark closes; on a table all rows count.
    """
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    out = timed.groupBy(F.window("ts", width).alias("w"), "arc_id").agg(F.count(F.lit(1)).alias("n"), F.avg("speed").alias("mean"))
    return out.select(F.col("w.start").alias("start"), "arc_id", "n", "mean")

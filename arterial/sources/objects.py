"""Objects of several tables in one folder, the vectors of time-dependent graphs, and exports as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def save(folder: str, **tables: DataFrame) -> None:
    """Each table of an object in a folder of its name."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def load(spark: SparkSession, folder: str, *names: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{folder}/{name}") for name in names]


def save_graph(folder: str, arcs: DataFrame, *metrics: str) -> None:
    """The ends of ``arcs`` and each metric as a table of its own, by arc id."""
    save(folder, ends=arcs.select("arc_id", "tail", "head"), **{m: arcs.select("arc_id", F.col(m).alias("value")) for m in metrics})


def load_graph(spark: SparkSession, folder: str, metric: str) -> DataFrame:
    """``arc_id, tail, head, weight`` with a chosen metric as weight."""
    ends, values = load(spark, folder, "ends", metric)
    return ends.join(values.withColumnRenamed("value", "weight"), "arc_id")


def arcs_of_lists(lists: DataFrame) -> DataFrame:
    """``arc_id, tail, head, weight`` of ``lists(node, links)``, an array of (head, weight) for each node; ids rise by node and place."""
    from ..operators.graph import dense_ids

    each = lists.select(F.col("node").alias("tail"), F.posexplode("links").alias("pos", "l")).select("tail", "pos", "l.head", "l.weight")
    each = each.withColumn("key", F.struct("tail", "pos"))
    ids = dense_ids(each.select("key"), "key", "arc_id", lead="key.tail")
    return each.join(ids, "key").select("arc_id", "tail", "head", "weight")


def function_vectors(arcs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``arc_id, first_ipp, n``, ``i, dep, tt``): where each arc's points start, and all points in the order of arcs.

    The last point at the period repeats the first one and is left out.
    """
    from ..operators.graph import first_out

    points = F.expr("IF(size(ttf) > 1, slice(ttf, 1, size(ttf) - 1), ttf)")
    own = arcs.select("arc_id", points.alias("points"))
    each = own.select(F.col("arc_id").alias("tail"), F.posexplode("points").alias("pos", "p"))
    firsts = first_out(each, own.select(F.col("arc_id").alias("node")))
    firsts = firsts.select(F.col("node").alias("arc_id"), F.col("first_out").alias("first_ipp"), F.col("degree").alias("n"))
    at = each.join(firsts.select(F.col("arc_id").alias("tail"), "first_ipp"), "tail")
    return firsts, at.select((F.col("first_ipp") + F.col("pos")).alias("i"), "p.dep", "p.tt")


def functions_of_vectors(arcs: DataFrame, firsts: DataFrame, points: DataFrame, seconds: bool = False) -> DataFrame:
    """``arcs`` with ``ttf`` in normal form from the vectors of :func:`function_vectors`; ``seconds``: as doubles in seconds.

    A point belongs to the last arc that starts at or before it; points and starts meet in blocks of points.
    """
    from ..functions import plf

    owner = firsts.where("n > 0").select("arc_id", F.explode(F.expr("sequence(first_ipp, first_ipp + n - 1)")).alias("i"))
    own = owner.join(points, "i").groupBy("arc_id").agg(F.sort_array(F.collect_list(F.struct("dep", "tt"))).alias("ttf"))
    own = own.withColumn("ttf", F.expr(plf.normalized("ttf")))
    if seconds:
        own = own.withColumn("ttf", F.expr("transform(ttf, p -> named_struct('dep', p.dep / 1000D, 'tt', p.tt / 1000D))"))
    return arcs.drop("ttf").join(own, "arc_id")


def little_endian(number: str, size: int = 4) -> str:
    """The bytes of a whole number as hexadecimal text, lowest first."""
    text = f"lpad(hex({number}), {2 * size}, '0')"
    return "concat(" + ", ".join(f"substr({text}, {2 * (size - k) - 1}, 2)" for k in range(size)) + ")"


def binary_graph(first_out: DataFrame, arcs: DataFrame, firsts: DataFrame, points: DataFrame) -> DataFrame:
    """``section, i, bytes`` (hexadecimal) of a binary time-dependent graph: nodes, then arcs with their first points, then points.

    ``first_out(node, first_out)``, ``arcs(arc_id, head)``, and the vectors of :func:`function_vectors`. In order of
    section and i the bytes follow a header of five 32-bit numbers (2, nodes, arcs, points, period).
    """
    nodes = first_out.select(F.lit(0).alias("section"), F.col("node").alias("i"), F.expr(little_endian("first_out")).alias("bytes"))
    heads = arcs.join(firsts, "arc_id").select(F.lit(1).alias("section"), F.col("arc_id").alias("i"), F.expr(f"concat({little_endian('head')}, {little_endian('first_ipp')})").alias("bytes"))
    ipps = points.select(F.lit(2).alias("section"), "i", F.expr(f"concat({little_endian('dep')}, {little_endian('tt')})").alias("bytes"))
    return nodes.union(heads).union(ipps)


def demands(trips: DataFrame) -> DataFrame:
    """``qid, source, target, departure, arrival, rank`` of timed queries with a known arrival, times in hundredths as doubles."""
    known = trips.where("arrival IS NOT NULL")
    return known.select("qid", "source", "target", (F.col("departure") / 100).alias("departure"), (F.col("arrival") / 100).alias("arrival"), "rank")


def reports(rows: DataFrame, key: str) -> DataFrame:
    """``key`` and one JSON object with all other columns; nulls are left out."""
    return rows.select(key, F.to_json(F.struct(*[c for c in rows.columns if c != key])).alias("report"))


def svg_lines(arcs: DataFrame, nodes: DataFrame, width: Column, colour: Column) -> DataFrame:
    """``arc_id, svg``: a line for each arc between the places of ``nodes(node, x, y)``; one of each pair of opposite arcs."""
    a = nodes.select(F.col("node").alias("tail"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    b = nodes.select(F.col("node").alias("head"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    once = arcs.where("tail < head").join(a, "tail").join(b, "head")
    attribute = lambda name, c: F.concat(F.lit(f' {name}="'), c.cast("string"), F.lit('"'))
    line = F.concat(F.lit("<line"), *[attribute(c, F.col(c)) for c in ("x1", "y1", "x2", "y2")], attribute("stroke", colour), attribute("stroke-width", width), F.lit("/>"))
    return once.select("arc_id", line.alias("svg"))

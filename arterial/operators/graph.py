"""Graph transforms over arcs (arc_id, tail, head, weight), as DataFrame operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import INFINITY


def reversed_arcs(arcs: DataFrame) -> DataFrame:
    """The transpose; arc ids stay."""
    return arcs.select("arc_id", F.col("head").alias("tail"), F.col("tail").alias("head"), *[c for c in arcs.columns if c not in ("arc_id", "tail", "head")])


def sliced(df: DataFrame, lead: str, parts: int | None = None) -> Column:
    """The slice (from 0) that holds each value of ``lead``: about equal counts, rising values, nulls in the first.

    Boundaries are approximate quantiles, one aggregation that sends a few numbers to the driver. They
    enter the plan as literals, so an order over all rows becomes one for each slice plus offsets.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / parts for i in range(1, parts)]
    cuts = df.agg(F.percentile_approx(lead, shares or [0.5], 10_000)).first()[0] if parts > 1 else None
    cuts = sorted(set(cuts or []))
    if not cuts:
        return F.lit(0)
    return F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col(lead)))


def _offsets(sliced_rows: DataFrame, total: Column) -> DataFrame:
    """``slice, offset``: the sum of ``total`` over the slices before. One row for each slice, so the window is small."""
    sums = sliced_rows.groupBy("slice").agg(total.alias("sum"))
    before = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    return F.broadcast(sums.select("slice", F.coalesce(F.sum("sum").over(before), F.lit(0)).cast("long").alias("offset")))


def first_out(arcs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, degree, first_out``: number of arcs of all smaller nodes, summed within slices of nodes and over them."""
    degrees = nodes.select("node").join(arcs.groupBy(F.col("tail").alias("node")).count(), "node", "left")
    rows = degrees.select("node", F.coalesce("count", F.lit(0)).alias("degree"), sliced(nodes, "node").alias("slice"))
    before = Window.partitionBy("slice").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumn("own", F.coalesce(F.sum("degree").over(before), F.lit(0))).join(_offsets(rows, F.sum("degree")), "slice")
    return out.select("node", "degree", (F.col("own") + F.col("offset")).cast("long").alias("first_out"))


def permuted(arcs: DataFrame, order: DataFrame, keep: Column | None = None) -> DataFrame:
    """Arcs between ranks by ``order(node, rank)``; ``keep``: a predicate on the new ``tail`` and ``head``."""
    a = order.select(F.col("node").alias("tail"), F.col("rank").alias("rank_tail"))
    b = order.select(F.col("node").alias("head"), F.col("rank").alias("rank_head"))
    rest = [c for c in arcs.columns if c not in ("arc_id", "tail", "head")]
    out = arcs.join(a, "tail").join(b, "head").select("arc_id", F.col("rank_tail").alias("tail"), F.col("rank_head").alias("head"), *rest)
    return out if keep is None else out.where(keep)


def split_by_rank(arcs: DataFrame) -> DataFrame:
    """Arcs between ranks with ``up``: those to a higher rank; the others are turned around."""
    return arcs.select("arc_id", F.least("tail", "head").alias("tail"), F.greatest("tail", "head").alias("head"), "weight", (F.col("tail") < F.col("head")).alias("up"))


def unified(arcs: DataFrame) -> DataFrame:
    """Parallel arcs all get their least weight."""
    return arcs.withColumn("weight", F.min("weight").over(Window.partitionBy("tail", "head")))


def merged(arcs: DataFrame) -> DataFrame:
    """One arc of the least weight for each pair of nodes, loops dropped; the smallest id among the cheapest stays."""
    return arcs.where("tail <> head").groupBy("tail", "head").agg(F.min(F.struct("weight", "arc_id")).alias("m")).select("m.arc_id", "tail", "head", "m.weight")


def line_graph(arcs: DataFrame, forbidden: DataFrame | None = None, turn_cost: Column | None = None, u_turns: bool = False) -> DataFrame:
    """Turns ``from_arc, to_arc, weight``: nodes are arcs, the weight is the first arc's plus the turn's cost.

    ``forbidden(from_arc, to_arc)`` turns are left out, and U-turns unless ``u_turns``. ``turn_cost`` may
    use ``tail`` (of the first arc), ``via`` and ``end``.
    """
    a = arcs.select(F.col("arc_id").alias("from_arc"), "tail", F.col("head").alias("via"), "weight")
    b = arcs.select(F.col("arc_id").alias("to_arc"), F.col("tail").alias("via"), F.col("head").alias("end"))
    turns = a.join(b, "via")
    if not u_turns:
        turns = turns.where("tail <> end")
    if forbidden is not None:
        turns = turns.join(forbidden, ["from_arc", "to_arc"], "left_anti")
    cost = F.lit(0) if turn_cost is None else turn_cost
    return turns.select("from_arc", "to_arc", (F.col("weight") + cost).alias("weight"))


def blocked(arcs: DataFrame, category: Column, mask: int) -> DataFrame:
    """Arcs of a category in ``mask`` get an infinite weight."""
    return arcs.withColumn("weight", F.when(category.bitwiseAND(F.lit(mask)) != 0, F.lit(INFINITY).cast("long")).otherwise(F.col("weight")))


def finite(arcs: DataFrame) -> DataFrame:
    return arcs.where(F.col("weight") < INFINITY)


def arcs_between(arcs: DataFrame, pairs: DataFrame) -> DataFrame:
    """All parallel arcs for each of ``pairs(tail, head)``."""
    return pairs.join(arcs, ["tail", "head"])


def dense_ids(keys: DataFrame, column: str, name: str = "dense_id", lead: str | None = None) -> DataFrame:
    """``column`` and its rank among the distinct values, from 0.

    ``lead``: the number that leads the order where ``column`` is a struct. Rows are ordered within slices.
    """
    own = keys.select(column).distinct()
    lead = lead or column
    rows = own.withColumn("slice", sliced(keys, lead))
    nth = F.row_number().over(Window.partitionBy("slice").orderBy(column))
    out = rows.withColumn("nth", nth).join(_offsets(rows, F.count(F.lit(1))), "slice")
    return out.select(column, (F.col("nth") - 1 + F.col("offset")).cast("long").alias(name))


def floor_ids(dense: DataFrame, probes: DataFrame, key: str, probe: str, name: str = "dense_id") -> DataFrame:
    """For each of ``probes`` the dense id of the greatest key at or below it: an as-of join in sorted slices.

    A probe before its slice's first key takes the last id of the slices before.
    """
    both = dense.select(F.col(key).alias("__k"), F.col(name).alias("__d"), F.lit(0).alias("__p")).union(
        probes.select(F.col(probe).alias("__k"), F.lit(None).cast("long").alias("__d"), F.lit(1).alias("__p")).distinct()
    )
    rows = both.withColumn("slice", sliced(both, "__k"))
    seen = Window.partitionBy("slice").orderBy("__k", "__p").rowsBetween(Window.unboundedPreceding, 0)
    tops = rows.groupBy("slice").agg(F.max("__d").alias("top"))
    earlier = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = F.broadcast(tops.select("slice", F.max("top").over(earlier).alias("carried")))
    out = rows.withColumn("__f", F.last("__d", ignorenulls=True).over(seen)).where("__p = 1").join(carried, "slice")
    return out.select(F.col("__k").alias(probe), F.coalesce("__f", "carried").alias(f"floor_{name}"))


def induced(arcs: DataFrame, nodes: DataFrame, inside: Column) -> DataFrame:
    """The subgraph of the nodes that are ``inside`` (a predicate on ``nodes``), with dense new ids."""
    ids = dense_ids(nodes.where(inside), "node", "rank")
    return permuted(arcs, ids)


def symmetric_degrees(arcs: DataFrame) -> DataFrame:
    """``node, degree``: distinct neighbours in either direction."""
    both = arcs.select(F.col("tail").alias("node"), F.col("head").alias("other")).union(arcs.select("head", "tail")).where("node <> other").distinct()
    return both.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def inverted(order: DataFrame) -> DataFrame:
    """``node, rank`` of the inverse permutation."""
    return order.select(F.col("rank").alias("node"), F.col("node").alias("rank"))


def unknown_share(rows: DataFrame, nodes: DataFrame, arcs: DataFrame) -> DataFrame:
    """For ``rows(tail, head)``: how many there are, and of how many both nodes and the arc are known."""
    a = nodes.select(F.col("node").alias("tail"), F.lit(1).alias("a"))
    b = nodes.select(F.col("node").alias("head"), F.lit(1).alias("b"))
    c = arcs.select("tail", "head", F.lit(1).alias("c")).distinct()
    out = rows.join(a, "tail", "left").join(b, "head", "left").join(c, ["tail", "head"], "left")
    return out.agg(F.count(F.lit(1)).alias("n"), F.count(F.expr("a + b")).alias("known_nodes"), F.count("c").alias("known_arcs"))


def compared(left: DataFrame, right: DataFrame) -> DataFrame:
    """Of two vectors ``(i, value)``: places in which they differ and the first of these."""
    both = left.withColumnRenamed("value", "l").join(right.withColumnRenamed("value", "r"), "i", "full_outer").where(~F.col("l").eqNullSafe(F.col("r")))
    return both.agg(F.count(F.lit(1)).alias("n_different"), F.min("i").alias("first_different"))


def function_line_graph(arcs: DataFrame, forbidden: DataFrame | None, cost: Column, u_turns: bool = False) -> DataFrame:
    """:func:`line_graph` of arcs with ``ttf``: ``from_arc, to_arc, ttf``, the turn's ``cost`` added to every point."""
    turns = line_graph(arcs.withColumn("weight", F.lit(0).cast("long")), forbidden, cost, u_turns)
    own = arcs.select(F.col("arc_id").alias("from_arc"), "ttf")
    return turns.join(own, "from_arc").select("from_arc", "to_arc", F.expr("transform(ttf, p -> named_struct('dep', p.dep, 'tt', p.tt + weight))").alias("ttf"))


def arcs_of_links(arcs: DataFrame, probes: DataFrame) -> DataFrame:
    """``probes(link_id, from_ref)`` with ``arc_id``, the arc of a foreign link in a direction (null: unknown); ``arcs`` carry both."""
    return probes.join(arcs.select("link_id", "from_ref", "arc_id"), ["link_id", "from_ref"], "left")


def links_of_arcs(arcs: DataFrame, probes: DataFrame) -> DataFrame:
    """``probes(arc_id)`` with ``link_id`` and ``from_ref``."""
    return probes.join(arcs.select("arc_id", "link_id", "from_ref"), "arc_id")

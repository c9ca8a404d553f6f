"""The registered road-network queries over the driver's tables, each beside the DuckDB SQL with its result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import plf
from ..operators import cells, graph, hierarchy, neighbours, paths, potentials, search
from ..schema import INFINITY, PERIOD
from ..streaming import link_speed
from . import road
from .storage import storer

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


_ARCS = """
p AS (SELECT p_partkey AS v, CAST(p_size AS BIGINT) AS s FROM part), c AS (SELECT count(*) AS n FROM part),
arcs AS (
  SELECT v * 4 AS arc_id, v AS tail, v + 1 AS head, 1 + s AS weight FROM p, c WHERE v % 50 <> 49 AND v + 1 < n
  UNION ALL SELECT v * 4 + 1, v + 1, v, 1 + (s * 7) % 50 FROM p, c WHERE v % 50 <> 49 AND v + 1 < n
  UNION ALL SELECT v * 4 + 2, v, v + 50, 1 + (s * 3) % 50 FROM p, c WHERE v + 50 < n
  UNION ALL SELECT v * 4 + 3, v + 50, v, 1 + (s * 11) % 50 FROM p, c WHERE v + 50 < n)
"""
_TRIPS = "trips AS (SELECT s_suppkey AS qid, CAST(s_nationkey * 7 % n AS BIGINT) AS source, s_suppkey * 19 % n AS target FROM supplier, c)"
_PATHS = """
sp(source, node, dist) USING KEY (source, node) AS (
  SELECT DISTINCT source, source, CAST(0 AS BIGINT) FROM starts
  UNION
  SELECT sp.source, a.head, min(sp.dist + a.weight) FROM sp JOIN arcs a ON a.tail = sp.node
  LEFT JOIN recurring.sp r ON r.node = a.head AND r.source = sp.source
  WHERE r.dist IS NULL OR sp.dist + a.weight < r.dist GROUP BY sp.source, a.head)
"""
_FROM_ZERO = f"WITH RECURSIVE {_ARCS}, starts AS (SELECT CAST(0 AS BIGINT) AS source), {_PATHS}"
_FROM_TRIPS = f"WITH RECURSIVE {_ARCS}, {_TRIPS}, starts AS (SELECT source FROM trips), {_PATHS}"
_PROFILES = f"""
WITH {_ARCS},
hours AS (SELECT hour(ts) AS h, count(*) AS c FROM events GROUP BY 1), top AS (SELECT max(c) AS top FROM hours),
raw AS (SELECT arc_id, weight, h * CAST(3600000 AS BIGINT) AS dep, weight * 10 * (50 + c * 100 // top) AS tt FROM arcs, hours, top),
first AS (SELECT arc_id, weight, arg_min(tt, dep) AS tt, min(dep) AS dep FROM raw GROUP BY arc_id, weight),
ipps AS (
  SELECT arc_id, weight, dep, tt FROM raw
  UNION ALL SELECT arc_id, weight, 0, tt FROM first WHERE dep > 0
  UNION ALL SELECT arc_id, weight, 86400000, tt FROM first),
segments AS (
  SELECT arc_id, weight, dep AS d1, tt AS t1, lead(dep) OVER w AS d2, lead(tt) OVER w AS t2 FROM ipps WINDOW w AS (PARTITION BY arc_id ORDER BY dep))
"""
_AT = "CASE WHEN d1 = {x} THEN t1 ELSE d1 + t1 + ({x} - d1) * ((d2 + t2) - (d1 + t1)) // (d2 - d1) - {x} END"


_SEGMENTS = "seg AS (SELECT s.arc_id, tail, head, d1, t1, d2, t2 FROM segments s JOIN arcs USING (arc_id) WHERE d2 IS NOT NULL)"
_TIMED = f"WITH RECURSIVE {_PROFILES.strip()[5:]}, {_SEGMENTS}"
_STEP = "(" + _AT.format(x="(ta.t % 86400000)") + ")"


def _arrivals(step: str = _STEP, kind: str = "BIGINT") -> str:
    """Earliest arrivals (no overtaking) from ``tstarts(source, departure)``; ``step``: the travel time of the arc ``g`` at ``ta.t``."""
    return f"""ta(source, departure, node, t) USING KEY (source, departure, node) AS (
  SELECT DISTINCT source, departure, source, CAST(departure AS {kind}) FROM tstarts
  UNION
  SELECT ta.source, ta.departure, g.head, min(CAST(ta.t + {step} AS {kind})) FROM ta JOIN seg g ON g.tail = ta.node AND d1 <= ta.t % 86400000 AND ta.t % 86400000 < d2
  LEFT JOIN recurring.ta r ON r.node = g.head AND r.source = ta.source AND r.departure = ta.departure
  WHERE r.t IS NULL OR ta.t + {step} < r.t GROUP BY ta.source, ta.departure, g.head)"""


_AT_EIGHT = "tstarts AS (SELECT CAST(0 AS BIGINT) AS source, CAST(28800000 AS BIGINT) AS departure)"


def _normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return road.profiles(spark, sf_dir).withColumn("ttf", F.expr(plf.normalized("ttf")))


def _zero(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.col("id").alias("source"))


def _rounded(c: str) -> str:
    return f"round({c}, 9)"


# graph transforms


@_query(f"WITH {_ARCS} SELECT * FROM arcs")
def road_arcs(spark, sf_dir):
    return road.arcs(spark, sf_dir)


@_query(f"WITH {_ARCS} SELECT arc_id, head AS tail, tail AS head, weight FROM arcs")
def transpose(spark, sf_dir):
    return graph.reversed_arcs(road.arcs(spark, sf_dir))


@_query(f"""WITH {_ARCS}, d AS (SELECT v AS node, count(arc_id) AS degree FROM p LEFT JOIN arcs ON tail = v GROUP BY v)
SELECT node, degree, CAST(coalesce(sum(degree) OVER (ORDER BY node ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_out FROM d""")
def degrees_to_first_out(spark, sf_dir):
    return graph.first_out(road.arcs(spark, sf_dir), road.nodes(spark, sf_dir))


def _order(spark, sf_dir):
    """A permutation: nodes by column, then row."""
    ids = graph.dense_ids(road.nodes(spark, sf_dir).select(F.struct("x", "y", "node").alias("key")), "key", "rank", "key.x")
    return ids.select("key.node", "rank")


_ORDER = "ord AS (SELECT v AS node, row_number() OVER (ORDER BY v % 50, v // 50) - 1 AS rank FROM p)"


@_query(f"WITH {_ARCS}, {_ORDER} SELECT arc_id, a.rank AS tail, b.rank AS head, weight FROM arcs JOIN ord a ON a.node = tail JOIN ord b ON b.node = head")
def permute(spark, sf_dir):
    return graph.permuted(road.arcs(spark, sf_dir), _order(spark, sf_dir))


@_query(f"""WITH {_ARCS}, {_ORDER} SELECT arc_id, a.rank AS tail, b.rank AS head, weight FROM arcs JOIN ord a ON a.node = tail
JOIN ord b ON b.node = head WHERE a.rank % 3 <> 0 AND b.rank > 10""")
def permute_filtered(spark, sf_dir):
    return graph.permuted(road.arcs(spark, sf_dir), _order(spark, sf_dir), F.expr("tail % 3 <> 0 AND head > 10"))


@_query(f"""WITH {_ARCS}, {_ORDER} SELECT arc_id, least(a.rank, b.rank) AS tail, greatest(a.rank, b.rank) AS head, weight, a.rank < b.rank AS up
FROM arcs JOIN ord a ON a.node = tail JOIN ord b ON b.node = head""")
def ch_split(spark, sf_dir):
    return graph.split_by_rank(graph.permuted(road.arcs(spark, sf_dir), _order(spark, sf_dir)))


def _multi(spark, sf_dir):
    """A multigraph: an arc for each order line from part to supplier's node."""
    n = road.node_count(spark, sf_dir)
    return road.table(spark, sf_dir, "lineitem").selectExpr(
        "l_partkey AS tail", f"l_suppkey * 19 % {n} AS head", "CAST(l_quantity AS BIGINT) AS weight"
    )


_MULTI = "WITH c AS (SELECT count(*) AS n FROM part), m AS (SELECT l_partkey AS tail, l_suppkey * 19 % n AS head, CAST(l_quantity AS BIGINT) AS weight FROM lineitem, c)"


@_query(f"{_MULTI} SELECT tail, head, min(weight) OVER (PARTITION BY tail, head) AS weight FROM m")
def unify_parallel_edges(spark, sf_dir):
    return graph.unified(_multi(spark, sf_dir))


@_query(f"{_MULTI} SELECT m.tail, m.head, weight FROM m JOIN (SELECT DISTINCT l_partkey AS tail, l_suppkey * 19 % n AS head FROM lineitem, c WHERE l_linenumber = 1) q USING (tail, head)")
def edge_indices(spark, sf_dir):
    n = road.node_count(spark, sf_dir)
    pairs = road.table(spark, sf_dir, "lineitem").where("l_linenumber = 1").selectExpr("l_partkey AS tail", f"l_suppkey * 19 % {n} AS head").distinct()
    return graph.arcs_between(_multi(spark, sf_dir), pairs)


@_query(f"""WITH {_ARCS} SELECT a.arc_id AS from_arc, b.arc_id AS to_arc, a.weight + CASE WHEN b.head - b.tail = a.head - a.tail THEN 0 ELSE 5 END AS weight
FROM arcs a JOIN arcs b ON a.head = b.tail WHERE a.tail <> b.head AND NOT (a.arc_id % 7 = 3 AND b.arc_id % 5 = 1)""")
def line_graph(spark, sf_dir):
    arcs = road.arcs(spark, sf_dir)
    a = arcs.where("arc_id % 7 = 3").select(F.col("arc_id").alias("from_arc"), F.col("head").alias("via"))
    b = arcs.where("arc_id % 5 = 1").select(F.col("arc_id").alias("to_arc"), F.col("tail").alias("via"))
    straight = F.when(F.expr("end - via = via - tail"), 0).otherwise(5)
    return graph.line_graph(arcs, a.join(b, "via").select("from_arc", "to_arc"), straight)


@_query(f"""WITH {_ARCS} SELECT a.arc_id AS from_arc, b.arc_id AS to_arc, a.weight + CASE WHEN a.tail = b.head THEN 100 ELSE 0 END AS weight
FROM arcs a JOIN arcs b ON a.head = b.tail""")
def line_graph_u_turn_cost(spark, sf_dir):
    return graph.line_graph(road.arcs(spark, sf_dir), turn_cost=F.when(F.expr("tail = end"), 100).otherwise(0), u_turns=True)


@_query(f"WITH {_ARCS} SELECT arc_id, tail, head, weight FROM arcs WHERE arc_id % 8 & 2 = 0")
def blocked_arcs(spark, sf_dir):
    return graph.finite(graph.blocked(road.arcs(spark, sf_dir), F.expr("arc_id % 8"), 2))


@_query(f"""WITH {_ARCS}, i AS (SELECT v AS node, row_number() OVER (ORDER BY v) - 1 AS rank FROM p WHERE v % 50 BETWEEN 5 AND 20 AND v // 50 BETWEEN 1 AND 30)
SELECT arc_id, a.rank AS tail, b.rank AS head, weight FROM arcs JOIN i a ON a.node = tail JOIN i b ON b.node = head""")
def subgraph_bbox(spark, sf_dir):
    return graph.induced(road.arcs(spark, sf_dir), road.nodes(spark, sf_dir), F.expr("x BETWEEN 5 AND 20 AND y BETWEEN 1 AND 30"))


@_query("SELECT o_custkey AS key, dense_rank() OVER (ORDER BY o_custkey) - 1 AS dense_id FROM (SELECT DISTINCT o_custkey FROM orders)")
def dense_id_map(spark, sf_dir):
    return graph.dense_ids(road.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key")), "key")


@_query("""WITH d AS (SELECT o_custkey * 3 AS key, dense_rank() OVER (ORDER BY o_custkey) - 1 AS dense_id FROM (SELECT DISTINCT o_custkey FROM orders)),
q AS (SELECT DISTINCT event_id AS probe FROM events)
SELECT q.probe, d.dense_id AS floor_dense_id FROM q ASOF LEFT JOIN d ON q.probe >= d.key""")
def dense_id_floor(spark, sf_dir):
    d = graph.dense_ids(road.table(spark, sf_dir, "orders").selectExpr("o_custkey * 3 AS key"), "key")
    return graph.floor_ids(d, road.table(spark, sf_dir, "events").select(F.col("event_id").alias("probe")), "key", "probe")


@_query(f"WITH {_ARCS} SELECT tail AS node, count(DISTINCT head) AS degree FROM (SELECT tail, head FROM arcs UNION SELECT head, tail FROM arcs) GROUP BY tail")
def symmetric_degree(spark, sf_dir):
    return graph.symmetric_degrees(road.arcs(spark, sf_dir))


@_query(f"WITH {_ARCS}, {_ORDER} SELECT rank AS node, node AS rank FROM ord")
def invert_order(spark, sf_dir):
    return graph.inverted(_order(spark, sf_dir))


@_query(f"""WITH {_ARCS}, e AS (SELECT event_id % (n + 50) AS tail, event_id % (n + 50) + CASE WHEN event_id % 3 = 0 THEN 1 ELSE 50 END AS head FROM events, c)
SELECT count(*) AS n, count(*) FILTER (a.v IS NOT NULL AND b.v IS NOT NULL) AS known_nodes, count(x.tail) AS known_arcs
FROM e LEFT JOIN p a ON a.v = e.tail LEFT JOIN p b ON b.v = e.head LEFT JOIN arcs x ON x.tail = e.tail AND x.head = e.head""")
def osm_id_check(spark, sf_dir):
    n = road.node_count(spark, sf_dir)
    rows = road.table(spark, sf_dir, "events").selectExpr(f"event_id % {n + 50} AS tail", f"event_id % {n + 50} + IF(event_id % 3 = 0, 1, 50) AS head")
    return graph.unknown_share(rows, road.nodes(spark, sf_dir), road.arcs(spark, sf_dir))


@_query(f"""WITH {_ARCS}, b AS (SELECT arc_id, CASE WHEN arc_id % 97 = 5 THEN weight + 1 ELSE weight END AS w FROM arcs)
SELECT count(*) AS n_different, min(arc_id) AS first_different FROM arcs JOIN b USING (arc_id) WHERE weight <> w""")
def compare_vector(spark, sf_dir):
    a = road.arcs(spark, sf_dir).select(F.col("arc_id").alias("i"), F.col("weight").alias("value"))
    return graph.compared(a, a.withColumn("value", F.expr("IF(i % 97 = 5, value + 1, value)")))


@_query(f"WITH {_ARCS} SELECT min(weight) AS low, max(weight) AS high, round(avg(weight), 6) AS mean, count(*) AS n FROM arcs")
def describe_speeds(spark, sf_dir):
    return road.arcs(spark, sf_dir).agg(F.min("weight").alias("low"), F.max("weight").alias("high"), F.round(F.avg("weight"), 6).alias("mean"), F.count(F.lit(1)).alias("n"))


# travel-time functions


@_query(f"{_PROFILES}, x AS (SELECT *, arc_id * 7919000 % 86400000 AS x FROM segments) SELECT arc_id, {_AT.format(x='x')} AS tt FROM x WHERE d1 <= x AND x < d2")
def plf_eval(spark, sf_dir):
    return _normal(spark, sf_dir).selectExpr("arc_id", f"{plf.value_at('ttf', 'arc_id * 7919000')} AS tt")


@_query(f"{_PROFILES} SELECT arc_id, min(tt) AS low, max(tt) AS high FROM ipps GROUP BY arc_id")
def plf_bounds(spark, sf_dir):
    return _normal(spark, sf_dir).selectExpr("arc_id", f"{plf.least('ttf')} AS low", f"{plf.most('ttf')} AS high")


def _range_sql(take: str) -> str:
    s, e = "(arc_id * 3600000 % 86400000)", "((arc_id * 3600000 + 10000000) % 86400000)"
    ends = " UNION ALL ".join(f"SELECT arc_id, {_AT.format(x=x)} AS tt FROM segments WHERE d1 <= {x} AND {x} < d2" for x in (s, e))
    inside = f"CASE WHEN {s} <= {e} THEN dep BETWEEN {s} AND {e} ELSE dep >= {s} OR dep <= {e} END"
    return f"{_PROFILES} SELECT arc_id, {take}(tt) AS extreme FROM (SELECT arc_id, tt FROM ipps WHERE {inside} UNION ALL {ends}) GROUP BY arc_id"


@_query(_range_sql("min"))
def plf_lower_bound_in_range(spark, sf_dir):
    out = _normal(spark, sf_dir).selectExpr("arc_id", "ttf", f"arc_id * 3600000 % {PERIOD} AS s", f"(arc_id * 3600000 + 10000000) % {PERIOD} AS e")
    return out.selectExpr("arc_id", f"{plf.extreme_in_range('ttf', 's', 'e')} AS extreme")


@_query(_range_sql("max"))
def plf_upper_bound_in_range(spark, sf_dir):
    out = _normal(spark, sf_dir).selectExpr("arc_id", "ttf", f"arc_id * 3600000 % {PERIOD} AS s", f"(arc_id * 3600000 + 10000000) % {PERIOD} AS e")
    return out.selectExpr("arc_id", f"{plf.extreme_in_range('ttf', 's', 'e', 'array_max')} AS extreme")


@_query(f"{_PROFILES} SELECT arc_id, round(min((t2 - t1) / (d2 - d1)), 9) AS least, round(max((t2 - t1) / (d2 - d1)), 9) AS most FROM segments WHERE d2 IS NOT NULL GROUP BY arc_id")
def plf_slopes(spark, sf_dir):
    low, high = plf.slope_extremes("ttf")
    return _normal(spark, sf_dir).selectExpr("arc_id", f"{_rounded(low)} AS least", f"{_rounded(high)} AS most")


@_query(f"""{_PROFILES} SELECT arc_id, CAST(sum((t1 + t2) * greatest(0, least(d2, 36000000) - greatest(d1, 25200000))) AS BIGINT) // 2 // 10800000 AS mean
FROM segments WHERE d2 IS NOT NULL GROUP BY arc_id""")
def plf_average(spark, sf_dir):
    return _normal(spark, sf_dir).selectExpr("arc_id", f"{plf.average('ttf', '25200000L', '36000000L')} AS mean")


def _live(spark, sf_dir):
    out = _normal(spark, sf_dir)
    return out.selectExpr("arc_id", "ttf", "IF(arc_id % 3 = 0, weight * 2000, NULL) AS live", "30000000L AS soon", "29000000L + arc_id * 977 % 3000000 AS t")


# one pass over the segments: of each arc the value at t and the one at soon
_LIVE = f"""{_PROFILES},
a AS (SELECT arc_id, CASE WHEN arc_id % 3 = 0 THEN weight * 2000 END AS live, 30000000 AS soon, 29000000 + arc_id * 977 % 3000000 AS t FROM arcs),
now AS (
  SELECT arc_id, any_value(live) AS live, any_value(soon) AS soon, any_value(t) AS t,
    max({_AT.format(x='t')}) FILTER (d1 <= t AND t < d2) AS pred, max({_AT.format(x='soon')}) FILTER (d1 <= soon AND soon < d2) AS at_soon
  FROM (SELECT s.*, live, soon, t FROM segments s JOIN a USING (arc_id) WHERE d2 IS NOT NULL) GROUP BY arc_id)
"""


@_query(f"""{_LIVE} SELECT arc_id, CASE WHEN live IS NULL THEN pred WHEN t < soon THEN live
WHEN at_soon < live THEN greatest(greatest(live + soon - t, 0), pred) ELSE least(live + t - soon, pred) END AS tt FROM now""")
def live_eval(spark, sf_dir):
    return _live(spark, sf_dir).selectExpr("arc_id", f"{plf.live_value('ttf', 'live', 'soon', 't')} AS tt")


@_query(f"""{_LIVE} SELECT arc_id, CASE WHEN live IS NULL OR t >= soon THEN pred ELSE greatest(pred, least(live, at_soon + soon - t)) END AS tt
FROM now""")
def pessimistic_live_eval(spark, sf_dir):
    return _live(spark, sf_dir).selectExpr("arc_id", f"{plf.pessimistic_value('ttf', 'live', 'soon', 't')} AS tt")


@_query(f"{_PROFILES} SELECT arc_id, bool_and(d1 + t1 <= d2 + t2) AS fifo FROM segments WHERE d2 IS NOT NULL GROUP BY arc_id")
def plf_is_fifo(spark, sf_dir):
    pairs = "zip_with(slice(ttf, 1, size(ttf) - 1), slice(ttf, 2, size(ttf) - 1), (a, b) -> a.dep + a.tt <= b.dep + b.tt)"
    return _normal(spark, sf_dir).selectExpr("arc_id", f"forall({pairs}, x -> x) AS fifo")


@_query("SELECT CAST(s.s * 1800000 AS BIGINT) AS start, CAST(l.l * 3600000 AS BIGINT) AS length FROM range(12, 45) s(s), (VALUES (1), (2), (4), (8)) l(l) WHERE s.s * 1800000 + l.l * 3600000 <= 86400000")
def day_ranges(spark, sf_dir):
    return potentials.day_ranges(spark)


# searches


@_query(f"{_FROM_ZERO} SELECT node, dist FROM sp")
def dijkstra_one_to_all(spark, sf_dir):
    return search.one_to_all(road.arcs(spark, sf_dir), _zero(spark)).select("node", "dist")


@_query(f"{_FROM_TRIPS} SELECT qid, t.source, t.target, sp.dist FROM trips t LEFT JOIN sp ON sp.source = t.source AND sp.node = t.target")
def dijkstra_trips(spark, sf_dir):
    return search.distances(road.arcs(spark, sf_dir), road.trips(spark, sf_dir)).select("qid", "source", "target", "dist")


@_query(ORACLE["dijkstra_trips"])
def bidirectional_dijkstra(spark, sf_dir):
    return search.distances(road.arcs(spark, sf_dir), road.trips(spark, sf_dir), two_sided=True).select("qid", "source", "target", "dist")


@_query(f"""{_FROM_ZERO}, n AS (SELECT node, dist, row_number() OVER (ORDER BY dist, node) AS nth FROM sp)
SELECT CAST(log2(nth) AS INT) AS rank, node, dist FROM n WHERE nth & (nth - 1) = 0""")
def dijkstra_ranks(spark, sf_dir):
    return search.ranks(search.one_to_all(road.arcs(spark, sf_dir), _zero(spark))).select("rank", "node", "dist")


@_query(f"""{_FROM_ZERO} SELECT a.head AS node, min(sp.dist + a.weight) AS best, any_value(g.dist) AS dist
FROM sp JOIN arcs a ON a.tail = sp.node JOIN sp g ON g.node = a.head GROUP BY a.head""")
def relax_once(spark, sf_dir):
    """The least label each node gets from its in-arcs: at the fixpoint it is the distance (but for the source)."""
    d = search.one_to_all(road.arcs(spark, sf_dir), _zero(spark)).select("node", "dist")
    a = road.arcs(spark, sf_dir)
    best = d.join(a, d["node"] == a["tail"]).groupBy(F.col("head").alias("node")).agg(F.min(F.col("dist") + F.col("weight")).alias("best"))
    return best.join(d, "node")


@_query(f"{_TIMED}, {_AT_EIGHT}, {_arrivals()} SELECT source, departure, node, t - departure AS travel_time FROM ta")
def td_dijkstra(spark, sf_dir):
    starts = _zero(spark).withColumn("departure", F.lit(28_800_000).cast("long"))
    return search.earliest_arrivals(_normal(spark, sf_dir), starts, PERIOD)


# hierarchies and labels


def _labelled(spark, sf_dir):
    arcs = road.arcs(spark, sf_dir)
    own, weights = hierarchy.build(arcs, road.nodes(spark, sf_dir))
    trips = road.trips(spark, sf_dir)
    out = hierarchy.labels(spark, own, weights[0], trips.select(F.col("source").alias("node")))
    into = hierarchy.labels(spark, own, weights[1], trips.select(F.col("target").alias("node")))
    return trips, out, into


@_query(ORACLE["dijkstra_trips"])
def hub_label_trips(spark, sf_dir):
    return hierarchy.label_distances(*_labelled(spark, sf_dir)).select("qid", "source", "target", "dist")


@_query(f"{_FROM_TRIPS} SELECT s.source, t.target, sp.dist FROM (SELECT DISTINCT source FROM trips) s, (SELECT DISTINCT target FROM trips) t JOIN sp ON sp.source = s.source AND sp.node = t.target")
def many_to_many(spark, sf_dir):
    own = cells.build(road.arcs(spark, sf_dir), road.nodes(spark, sf_dir), storer(spark))
    trips = road.trips(spark, sf_dir)
    out = cells.labels(own, trips.select(F.col("source").alias("node")), "up")
    into = cells.labels(own, trips.select(F.col("target").alias("node")), "down")
    # the label join meets every source with every target on their hubs
    a = out.select(F.col("node").alias("source"), "hub", F.col("dist").alias("d1"))
    b = into.select(F.col("node").alias("target"), "hub", F.col("dist").alias("d2"))
    return a.join(b, "hub").groupBy("source", "target").agg(F.min(F.col("d1") + F.col("d2")).alias("dist"))


_NEAREST = f"""{_FROM_TRIPS}, m AS (SELECT s.source, t.target, sp.dist FROM (SELECT DISTINCT source FROM trips) s, (SELECT DISTINCT target FROM trips) t
JOIN sp ON sp.source = s.source AND sp.node = t.target),
n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY dist, target) AS place FROM m) SELECT source, target, dist, place FROM n WHERE place <= 4"""


@_query(_NEAREST)
def nearest_neighbors(spark, sf_dir):
    """A source meets only the four nearest targets of each hub."""
    _, out, into = _labelled(spark, sf_dir)
    return neighbours.by_buckets(out, into, 4)


@_query(f"{_FROM_TRIPS} SELECT count(*) AS n, count(sp.dist) AS reachable, CAST(sum(sp.dist) AS BIGINT) AS total FROM trips t LEFT JOIN sp ON sp.source = t.source AND sp.node = t.target")
def perfect_customization_trips(spark, sf_dir):
    own = cells.perfect(cells.build(road.arcs(spark, sf_dir), road.nodes(spark, sf_dir), storer(spark)))
    found = cells.trip_distances(own, road.trips(spark, sf_dir))
    return found.agg(F.count(F.lit(1)).alias("n"), F.count("dist").alias("reachable"), F.sum("dist").alias("total"))


# an order of the grid by dissection: the finest lines first, by the lowest bit of a coordinate counted from 1
_LEVEL = "greatest(({x} + 1) & -({x} + 1), ({y} + 1) & -({y} + 1))"


def _grid_order(spark, sf_dir):
    keyed = road.nodes(spark, sf_dir).select(F.struct(F.expr(_LEVEL.format(x="x", y="y")).alias("level"), "node").alias("key"))
    return graph.dense_ids(keyed, "key", "rank", "key.level").select("key.node", "rank")


def _grid_hierarchy(spark, sf_dir):
    return hierarchy.build(road.arcs(spark, sf_dir), road.nodes(spark, sf_dir), _grid_order(spark, sf_dir))


def _through_lower(name: str, a: str, b: str) -> str:
    """Least weights from (or, with ends swapped, to) each rank over lower ones only."""
    return f"""{name}(s, v, d) USING KEY (s, v) AS (
  SELECT rank, rank, CAST(0 AS BIGINT) FROM ord
  UNION
  SELECT {name}.s, r.{b}, min({name}.d + r.w) FROM {name} JOIN r ON r.{a} = {name}.v AND r.{b} < {name}.s LEFT JOIN recurring.{name} k ON k.s = {name}.s AND k.v = r.{b}
  WHERE k.d IS NULL OR {name}.d + r.w < k.d GROUP BY {name}.s, r.{b})"""


_CHORDAL = f"""WITH RECURSIVE {_ARCS}, ord AS (SELECT v AS node, row_number() OVER (ORDER BY {_LEVEL.format(x='(v % 50)', y='(v // 50)')}, v) - 1 AS rank FROM p),
r AS (SELECT a.rank AS t, b.rank AS h, min(weight) AS w FROM arcs JOIN ord a ON a.node = tail JOIN ord b ON b.node = head WHERE tail <> head GROUP BY 1, 2),
{_through_lower('go', 't', 'h')}, {_through_lower('come', 'h', 't')},
chordal AS (SELECT tail, head, u.up, w.down FROM (SELECT go.s AS tail, r.h AS head, min(go.d + r.w) AS up FROM go JOIN r ON r.t = go.v WHERE r.h > go.s GROUP BY 1, 2) u
  FULL JOIN (SELECT come.s AS tail, r.t AS head, min(come.d + r.w) AS down FROM come JOIN r ON r.h = come.v WHERE r.t > come.s GROUP BY 1, 2) w USING (tail, head)),
tree AS (SELECT tail AS node, min(head) AS parent FROM chordal GROUP BY tail)"""


@_query(f"{_CHORDAL} SELECT tail, head, up, down FROM chordal")
def cch_arcs(spark, sf_dir):
    return cells.build(road.arcs(spark, sf_dir), road.nodes(spark, sf_dir), storer(spark), _grid_order(spark, sf_dir)).chordal()


@_query(f"{_CHORDAL} SELECT node, parent FROM tree")
def elimination_tree(spark, sf_dir):
    return hierarchy.elimination_tree(cch_arcs(spark, sf_dir))


@_query(f"""{_CHORDAL}, kids AS (SELECT parent, count(*) AS n FROM tree GROUP BY parent),
cells(v, cell, level) AS (
  SELECT rank, rank, CAST(0 AS BIGINT) FROM ord WHERE rank NOT IN (SELECT node FROM tree)
  UNION ALL
  SELECT t.node, CASE WHEN n = 1 THEN cell ELSE t.node END, CASE WHEN n = 1 THEN level ELSE level + 1 END FROM cells JOIN tree t ON t.parent = v JOIN kids k ON k.parent = v)
SELECT node, cell, level FROM cells JOIN ord ON rank = v""")
def separator_cells(spark, sf_dir):
    own, _ = _grid_hierarchy(spark, sf_dir)
    return spark.createDataFrame(hierarchy.separator_cells(own), "node long, cell long, level long")


# potentials


def _landmark_sql() -> str:
    from_, to = _PATHS, _PATHS.replace("sp(", "rp(").replace("sp.", "rp.").replace("recurring.sp", "recurring.rp").replace("FROM sp", "FROM rp").replace("a.head", "a.tail").replace("ON a.tail = rp.node", "ON a.head = rp.node")
    return f"""WITH RECURSIVE {_ARCS}, {_TRIPS}, starts AS (SELECT unnest([0, 49, n - 1]) AS source FROM c), {from_}, {to},
lm AS (SELECT sp.source AS landmark, sp.node, sp.dist AS f, rp.dist AS t FROM sp JOIN rp ON rp.source = sp.source AND rp.node = sp.node)
SELECT q.source, q.target, max(greatest(b.f - a.f, a.t - b.t, 0)) AS bound FROM (SELECT DISTINCT source, target FROM trips) q
JOIN lm a ON a.node = q.source JOIN lm b ON b.node = q.target AND b.landmark = a.landmark GROUP BY q.source, q.target"""


@_query(_landmark_sql())
def landmark_bounds(spark, sf_dir):
    n = road.node_count(spark, sf_dir)
    arcs = road.arcs(spark, sf_dir)
    marks = spark.createDataFrame([(0,), (49,), (n - 1,)], "source long")
    f = search.one_to_all(arcs, marks).select(F.col("source").alias("landmark"), "node", F.col("dist").alias("d_from"))
    t = search.one_to_all(graph.reversed_arcs(arcs), marks).select(F.col("source").alias("landmark"), "node", F.col("dist").alias("d_to"))
    pairs = road.trips(spark, sf_dir).select("source", "target").distinct()
    return potentials.landmark_bounds(pairs, f.join(t, ["landmark", "node"]))


def _merging_sql() -> str:
    """Three merges, each of the two metrics whose weights differ least."""
    steps = [f"{_PROFILES}, x AS (SELECT s.*, i, i * 14400000 AS x FROM segments s, range(0, 6) r(i)), m0 AS (SELECT CAST(i AS INT) AS metric, arc_id, {_AT.format(x='x')} AS weight FROM x WHERE d1 <= x AND x < d2), g0 AS (SELECT DISTINCT metric, metric AS merged FROM m0)"]
    for k in range(3):
        steps.append(f"""c{k} AS (SELECT a.metric AS m, b.metric AS m2 FROM m{k} a JOIN m{k} b ON a.arc_id = b.arc_id AND a.metric < b.metric GROUP BY ALL
  ORDER BY sum((a.weight - b.weight) * (a.weight - b.weight)), 1, 2 LIMIT 1),
m{k + 1} AS (SELECT CASE WHEN metric = m2 THEN m ELSE metric END AS metric, arc_id, min(weight) AS weight FROM m{k}, c{k} GROUP BY ALL),
g{k + 1} AS (SELECT metric, CASE WHEN merged = m2 THEN m ELSE merged END AS merged FROM g{k}, c{k})""")
    return ", ".join(steps) + " SELECT min(metric) OVER (PARTITION BY merged) AS merged, metric FROM g3"


@_query(_merging_sql())
def metric_merging(spark, sf_dir):
    p = _normal(spark, sf_dir)
    each = p.select("arc_id", F.posexplode(F.expr(f"transform(sequence(0, 5), i -> {plf.value_at('ttf', 'CAST(i AS BIGINT) * 14400000')})")).alias("metric", "weight"))
    groups = potentials.merge_metrics(each.select("metric", "arc_id", "weight"), 3)
    return spark.createDataFrame([(g[0], m) for g in groups for m in g], "merged int, metric int")


# paths


def _walks(spark, sf_dir):
    """A walk for each order: down the grid and right again from the customer's node."""
    n = road.node_count(spark, sf_dir)
    o = road.table(spark, sf_dir, "orders").selectExpr("o_orderkey AS qid", f"o_custkey % {n} AS v", "o_orderkey")
    steps = o.select("qid", "v", F.explode(F.expr("sequence(0, 11)")).alias("pos"))
    node = F.expr("v + 50L * ((pos + 1) div 2) + pos div 2 - IF(pos % 4 = 3, 1, 0)")
    return steps.select("qid", "pos", node.alias("node")).where(F.col("node") < n)


_WALKS = """walks AS (SELECT o_orderkey AS qid, pos, o_custkey % n + 50 * ((pos + 1) // 2) + pos // 2 - CASE WHEN pos % 4 = 3 THEN 1 ELSE 0 END AS node
FROM orders, c, range(0, 12) r(pos) WHERE o_custkey % n + 50 * ((pos + 1) // 2) + pos // 2 - CASE WHEN pos % 4 = 3 THEN 1 ELSE 0 END < n)"""


@_query(f"""WITH {_ARCS}, {_WALKS}, s AS (SELECT qid, pos, node, lag(node) OVER (PARTITION BY qid ORDER BY pos) AS before FROM walks)
SELECT qid, CAST(pos AS INT) AS pos, s.node, CAST(sum(coalesce(weight, 0)) OVER (PARTITION BY qid ORDER BY pos) AS BIGINT) AS cum
FROM s LEFT JOIN arcs ON tail = before AND head = s.node""")
def path_dists(spark, sf_dir):
    return paths.cumulative(_walks(spark, sf_dir), road.arcs(spark, sf_dir))


_INTERVALS = "SELECT l_orderkey AS qid, l_partkey % 40 AS a, l_partkey % 40 + 1 + CAST(l_quantity AS BIGINT) AS b FROM lineitem"


@_query(f"""WITH i AS (SELECT DISTINCT * FROM ({_INTERVALS})) SELECT qid, a, b FROM i x
WHERE NOT EXISTS (SELECT 1 FROM i y WHERE y.qid = x.qid AND y.a >= x.a AND y.b <= x.b AND (y.a <> x.a OR y.b <> x.b))""")
def filter_covered(spark, sf_dir):
    rows = road.table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS qid", "l_partkey % 40 AS a", "l_partkey % 40 + 1 + CAST(l_quantity AS BIGINT) AS b")
    return paths.minimal_intervals(rows)


# sources, statistics and streams


@_query("""WITH b AS (SELECT user_id AS key, (epoch_ms(ts) // 900000) % 96 AS bucket, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2)
SELECT * FROM b WHERE n >= 3""")
def gps_day_buckets(spark, sf_dir):
    from ..sources.files import day_buckets

    rows = road.table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), "value")
    # halves are told at the product, as the SQL's round does
    return day_buckets(rows).withColumn("mean", F.round(F.col("mean") * 1_000_000) / 1_000_000)


@_query(f"""WITH {_ARCS}, e AS (SELECT arc_id, tail, head, weight * 100 AS dist FROM arcs),
s AS (SELECT tail, head, arg_max(speed, seq) AS speed FROM (SELECT a.tail, a.head, event_id AS seq, 5 + event_id % 90 AS speed FROM events, c JOIN arcs a ON a.arc_id = event_id % (4 * n)) GROUP BY 1, 2)
SELECT arc_id, 3600 * dist // speed AS live_tt FROM e JOIN s USING (tail, head)""")
def live_import(spark, sf_dir):
    from ..sources.files import live_times

    n = road.node_count(spark, sf_dir)
    arcs = road.arcs(spark, sf_dir).withColumn("dist", F.col("weight") * 100)
    e = road.table(spark, sf_dir, "events").selectExpr(f"event_id % {4 * n} AS arc_id", "event_id AS seq", "5 + event_id % 90 AS speed")
    return live_times(e.join(arcs.select("arc_id", "tail", "head"), "arc_id"), arcs)


@_query(f"""WITH {_ARCS}, u AS (SELECT event_id % (4 * n) AS arc_id, arg_max(CASE WHEN event_id % 10 = 0 THEN {INFINITY} ELSE 1 + event_id % 60 END, event_id) AS w FROM events, c GROUP BY 1)
SELECT arc_id, tail, head, CAST(coalesce(u.w, weight) AS BIGINT) AS weight FROM arcs LEFT JOIN u USING (arc_id)""")
def live_customization(spark, sf_dir):
    n = road.node_count(spark, sf_dir)
    e = road.table(spark, sf_dir, "events").selectExpr(f"event_id % {4 * n} AS arc_id", "event_id AS seq", "IF(event_id % 10 = 0, NULL, 1 + event_id % 60) AS weight")
    return link_speed.updated_metric(road.arcs(spark, sf_dir), e, INFINITY)


@_query()
def link_speed_estimates(spark, sf_dir):
    """A trip for each user along as many links as they have events."""
    e = road.table(spark, sf_dir, "events").select(F.col("user_id").alias("vehicle"), "event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), "value")
    nth = F.row_number().over(Window.partitionBy("vehicle").orderBy("ms", "event_id")) - 1
    e = e.withColumn("seq", nth.cast("long"))
    links = e.selectExpr("vehicle", "seq", "event_id AS link_id", "CAST(10000 + event_id % 50000 AS DOUBLE) AS length_mm", "CAST(30 + event_id % 100 AS DOUBLE) AS limit_kmh")
    traces = e.selectExpr("vehicle", "seq", "CAST(ms AS DOUBLE) + seq AS ts_ms", "seq AS link_seq", "(event_id % 10) / 10.0D AS fraction")
    return link_speed.estimates(links, traces)


@_query("""SELECT user_id AS vehicle, count(*) AS n, CAST(min(value) * 1000 AS BIGINT) AS low, CAST(max(value) * 1000 AS BIGINT) AS high FROM events GROUP BY user_id""")
def describe_query_stats(spark, sf_dir):
    e = road.table(spark, sf_dir, "events")
    return e.groupBy(F.col("user_id").alias("vehicle")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.min("value") * 1000).cast("long").alias("low"), F.round(F.max("value") * 1000).cast("long").alias("high")
    )

"""Queries that must not gather the graph, and their operators on small random graphs."""

import datetime
import random
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from arterial.functions import plf
from arterial.operators import alternatives, catchup, cells, contraction, experiments, hierarchy, lazy, paths, search, td
from arterial.plans import extended, queries, served, timed  # noqa: F401
from arterial.plans.storage import storer
from arterial.schema import INFINITY

from .test_oracles import SF, plain


def refuse(*_, **__):
    raise AssertionError("the graph was gathered")


def same_as_sql(spark, name):
    with duckdb.connect() as con:
        for p in Path(SF).glob("*.parquet"):
            con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
        found = con.execute(queries.ORACLE[name])
        columns = [d[0] for d in found.description]
        want = plain(found.fetchall(), columns)
    df = queries.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    assert plain(df.collect(), df.columns) == want


@pytest.fixture(scope="module")
def few_arcs(spark):
    rng = random.Random(3)
    rows = [(i, rng.randrange(60), rng.randrange(60), rng.choice((0, 0, 1, 4, 9))) for i in range(150)]
    return spark.createDataFrame(rows, "arc_id long, tail long, head long, weight long")


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_balls_and_first_beyond_equal_whole_searches(spark, few_arcs):
    sources = spark.range(0, 60, 7).selectExpr("id AS source")
    whole = search.one_to_all(few_arcs, sources).select("source", "node", "dist")
    near = search.balls(few_arcs, sources, 9, storer(spark))
    assert rows(experiments.ball(near, 9).select("source", "node", "dist")) == rows(experiments.ball(whole, 9).select("source", "node", "dist"))
    for limit in (3, 8, 13):
        assert rows(experiments.first_beyond(search.until(few_arcs, sources, limit, storer(spark)), limit)) == rows(experiments.first_beyond(whole, limit))


@pytest.mark.parametrize("name", ["ball_draws", "nearest_ball", "first_beyond"])
def test_near_nodes_without_the_graph(spark, monkeypatch, name):
    monkeypatch.setattr(search, "collect", refuse)
    same_as_sql(spark, name)


@pytest.mark.parametrize(("name", "costly"), [("fewest_points", "fewest"), ("float_live_values", "evaluate_live")])
def test_equal_functions_are_worked_on_once(spark, monkeypatch, name, costly):
    """All arcs of a weight share a function: a task works on each once, not on each arc."""
    frames, seen = [], []
    monkeypatch.setattr(type(spark.range(1)), "mapInPandas", lambda df, work, kind: frames.append((df.toPandas(), work)))
    queries.QUERIES[name](spark, SF)
    monkeypatch.undo()
    own = getattr(plf, costly)
    monkeypatch.setattr(plf, costly, lambda *a: (seen.append(a), own(*a))[1])
    ((frame, work),) = frames
    for c in ("dep", "tt"):
        frame[c] = frame[c].map(np.asarray)
    n = sum(map(len, work(iter([frame[:400], frame[400:]]))))
    assert n in (len(frame), 6 * len(frame)) and len(seen) == len({(tuple(d), tuple(t)) for d, t in zip(frame["dep"], frame["tt"], strict=True)}) < len(frame)


@pytest.mark.parametrize("name", ["float_td_dijkstra", "live_td_dijkstra", "pessimistic_live_td_dijkstra"])
def test_arrivals_by_cells(spark, monkeypatch, name):
    """Cells of 37 nodes, so that labels cross their borders in both directions."""
    for module in (search, td):
        monkeypatch.setattr(module, "collect", refuse)
    own = search.by_cells
    monkeypatch.setattr(td, "by_cells", lambda a, s, f, store, size, *more: own(a, s, f, store, 37, *more))
    same_as_sql(spark, name)


def test_profile_samples_without_the_graph(spark, monkeypatch):
    monkeypatch.setattr(td, "collect", refuse)
    same_as_sql(spark, "profile_samples")


def test_profiles_in_regions(spark, monkeypatch):
    """Pairs without a path and of one node too; equal to profiles on the whole graph."""
    arcs = queries._normal(spark, SF).where("tail < 100 AND head < 100 AND tail % 50 <> 6 AND head % 50 <> 6").cache()
    pairs = spark.createDataFrame([(0, 53), (7, 7), (3, 8)], "source long, target long")
    whole = rows(td.profiles(arcs, pairs))
    monkeypatch.setattr(td, "collect", refuse)
    assert rows(td.profiles(arcs, pairs, store=storer(spark))) == whole


def test_bucket_means_whatever_the_order(spark, tmp_path):
    """32 values of two decimals: a mean may end in half of the sixth decimal, which a sum of doubles misses."""
    rng = random.Random(5)
    groups = [[rng.randrange(20_000) for _ in range(32)] for _ in range(400)]
    halves = {k: (sum(cents) * 10_000 // 16 + 1) // 2 / 1_000_000 for k, cents in enumerate(groups)}
    at = datetime.datetime(2024, 1, 1, 8)
    for turn in (1, -1):
        events = [(k, at, c / 100) for k, cents in enumerate(groups) for c in sorted(cents)[::turn]]
        events += [(1000, at, None)] * 3 + [(1001, at, v) for v in (1e300, 2e300, 3e300)] + [(1002, at, v) for v in (1.0, 2.0, float("nan"))]
        folder = tmp_path / str(turn)
        spark.createDataFrame(events, "user_id long, ts timestamp, value double").coalesce(1).write.parquet(str(folder / "events.parquet"))
        found = {r["key"]: (r["bucket"], r["n"], r["mean"]) for r in queries.QUERIES["gps_day_buckets"](spark, str(folder)).collect()}
        assert found.pop(1000)[1:] == (3, None) and found.pop(1001)[2] == pytest.approx(2e300) and np.isnan(found.pop(1002)[2])
        assert {k: v[2] for k, v in found.items()} == halves
        assert {v[1] for v in found.values()} == {32}


def small_cells(monkeypatch, size=37):
    """No hierarchy on the driver, and cells so small that there are several rounds."""
    monkeypatch.setattr(hierarchy, "build", refuse)
    monkeypatch.setattr(cells, "LEAF", size)


@pytest.mark.parametrize("size", [9, 37, 4000])
@pytest.mark.parametrize("given", [False, True])
def test_cells_give_the_hierarchy_and_its_labels(spark, few_arcs, size, given):
    """By the dissection and by a random order, which leaves most for the last round."""
    rng = np.random.default_rng(size)
    nodes = spark.createDataFrame([(v, float(v % 8), float(v // 8)) for v in range(60)], "node long, x double, y double")
    order = spark.createDataFrame(list(zip(range(60), rng.permutation(60).tolist(), strict=True)), "node long, rank long") if given else None
    own = cells.build(few_arcs, nodes, storer(spark), order, size)
    p = few_arcs.toPandas()
    tail, head, weight = (p[c].to_numpy() for c in ("tail", "head", "weight"))
    ranks = own.order.orderBy("rank").toPandas()
    assert ranks["rank"].tolist() == list(range(60))
    one = hierarchy.Hierarchy(ranks["node"].to_numpy(), tail, head)
    weights = one.customize(tail, head, weight)
    plain_ = lambda df: sorted(map(str, df.collect()))
    assert plain_(own.chordal()) == plain_(hierarchy.chordal_arcs(spark, one, weights))
    for side, w in zip(("up", "down"), weights, strict=True):
        assert rows(cells.labels(own, nodes, side)) == rows(hierarchy.labels(spark, one, w, nodes))


@pytest.mark.parametrize("size", [9, 37, 4000])
def test_perfect_and_directed_in_cells(spark, few_arcs, size):
    """The same arcs and weights as on the driver."""
    nodes = spark.createDataFrame([(v, float(v % 8), float(v // 8)) for v in range(60)], "node long, x double, y double")
    own = cells.build(few_arcs, nodes, storer(spark), None, size)
    p = few_arcs.toPandas()
    tail, head, weight = (p[c].to_numpy() for c in ("tail", "head", "weight"))
    one = hierarchy.Hierarchy(own.order.orderBy("rank").toPandas()["node"].to_numpy(), tail, head)
    weights = one.customize(tail, head, weight)
    finite = lambda side: {(a, b): w for a, arcs in enumerate(side) for b, w in arcs.items() if w < INFINITY}
    table = lambda found, side: {(r["tail"], r["head"]): r[side] for r in found.chordal().where(f"{side} IS NOT NULL").collect()}
    for found, want in ((cells.perfect(own), one.perfect(*weights)), (cells.customized_directed(own, few_arcs), hierarchy.customize_directed(one, hierarchy.finite_arcs([weights]), tail, head, weight))):
        assert [table(found, "up"), table(found, "down")] == [finite(w) for w in want]


@pytest.mark.parametrize("name", ["cch_arcs", "elimination_tree", "respecting_weights", "many_to_many", "perfect_customization_trips", "directed_customization_trips", "cch_paths", "potential_paths", "depth_first_trips"])
def test_hierarchies_in_cells(spark, monkeypatch, name):
    small_cells(monkeypatch)
    same_as_sql(spark, name)


def test_smooth_bounds_in_cells(spark, monkeypatch):
    """No graph, no hierarchy; cells of 97 nodes, so that labels cross their borders in both directions."""
    for module in (search, td, catchup):
        monkeypatch.setattr(module, "collect", refuse)
    monkeypatch.setattr(hierarchy, "build", refuse)
    own = search.by_cells
    for module in (catchup, td):
        monkeypatch.setattr(module, "by_cells", lambda a, s, f, store, size, *more, **named: own(a, s, f, store, 97, *more, **named))
    same_as_sql(spark, "smooth_bound_trips")


@pytest.mark.parametrize("size", [9, 4000])
def test_path_lengths_in_cells(spark, few_arcs, size):
    """Weights of 0, trips without a path and of one node too; the same as by the lists of nodes on the driver's hierarchy."""
    nodes = spark.createDataFrame([(v, float(v % 8), float(v // 8)) for v in range(60)], "node long, x double, y double")
    trips = spark.range(40).selectExpr("id AS qid", "id * 7 % 20 AS source", "id * 11 % 60 AS target")
    found = rows(cells.path_lengths(cells.build(few_arcs, nodes, storer(spark), None, size), trips, few_arcs).where("dist IS NOT NULL").select("qid", "dist"))
    own, weights = hierarchy.build(few_arcs, nodes)
    assert found == rows(hierarchy.paths(spark, own, weights, trips).select("qid", "dist"))
    walk = lazy.unpacked_paths(spark, own, weights, hierarchy.lower_neighbours(own), trips).select("qid", F.posexplode("path").alias("pos", "node"))
    assert found == rows(paths.cumulative(walk, few_arcs).groupBy("qid").agg(F.max("cum").alias("dist")))


@pytest.mark.parametrize("how", ["blocking", "fixing"])
def test_traffic_around_sources(spark, monkeypatch, how):
    """Bounds that grow from 12; trips without a path and of one node, parallel arcs, live weights below the smooth ones; equal to answers on the whole graph."""
    rng = random.Random(8)
    grid = [(v, w) for v in range(100) for w in (v + 1, v - 1, v + 10, v - 10) if 0 <= w < 100]
    made = [(i, a, b, w, rng.choice((w, w, 3 * w, max(0, w - 1)))) for i, (a, b) in enumerate([*grid, *grid[::9]]) if b != 55 for w in [rng.randrange(10)]]
    arcs = spark.createDataFrame(made, "arc_id long, tail long, head long, weight long, live long").cache()
    trips = spark.createDataFrame([(q, q % 6 * 7, q * 31 % 100) for q in range(30)] + [(30, 3, 55), (31, 55, 55)], "qid long, source long, target long")
    whole = rows(alternatives.traffic_aware(arcs, trips, "live", 0.2, how, None))
    monkeypatch.setattr(alternatives, "_shared", refuse)
    own = alternatives.by_cells
    monkeypatch.setattr(alternatives, "by_cells", lambda a, s, f, store, **named: own(a, s, f, store, 60, **named))
    assert rows(alternatives._around(arcs, trips, "live", 0.2, how, None, storer(spark), 12)) == whole


def test_traffic_without_the_graph(spark, monkeypatch):
    whole = alternatives.traffic_aware
    before = rows(whole(queries_arcs(spark), extended._nation_trips(spark, SF), "live", 0.2, "blocking", None).selectExpr("qid", "live_dist", "size(path)", "done"))
    monkeypatch.setattr(alternatives, "_shared", refuse)
    assert rows(queries.QUERIES["traffic_path_blocking"](spark, SF)) == before


def queries_arcs(spark):
    return extended.road.arcs(spark, SF).withColumn("live", F.expr("weight * IF(arc_id % 5 = 0, 3, 1)"))


@pytest.mark.parametrize("size", [9, 4000])
def test_depth_first_in_cells(spark, few_arcs, size):
    """Several trees, one of a lone node; each subtree in one piece with its root last, and the same chordal arcs."""
    nodes = spark.createDataFrame([(v, float(v % 8), float(v // 8)) for v in range(61)], "node long, x double, y double")
    own = cells.build(few_arcs.where("tail <> 17 AND head <> 17"), nodes, storer(spark), None, size)
    turned = cells.depth_first(own)
    new = {r["node"]: r["rank"] for r in turned.collect()}
    assert sorted(new.values()) == list(range(61))
    node = {r["rank"]: r["node"] for r in own.order.collect()}
    parent = {}
    for a, b in own.chordal().select("tail", "head").collect():
        parent[a] = min(b, parent.get(a, b))
    below = {v: {v} for v in node}
    for v in sorted(parent):
        below[parent[v]] |= below[v]
    for v, under in below.items():
        places = sorted(new[node[u]] for u in under)
        assert places == list(range(new[node[v]] - len(under) + 1, new[node[v]] + 1))
    again = cells.reordered(own, few_arcs.where("tail <> 17 AND head <> 17"), turned)
    named = lambda c, names: sorted((*sorted((names[a], names[b])),) for a, b in c.chordal().select("tail", "head").collect())
    assert named(own, node) == named(again, {r: v for v, r in new.items()})


@pytest.mark.parametrize("size", [9, 4000])
def test_overlay_in_cells(spark, few_arcs, size):
    """Weights of 0, loops and parallel arcs; distances among the kept nodes stay, and no other node is left."""
    nodes = spark.createDataFrame([(v, float(v % 8), float(v // 8)) for v in range(60)], "node long, x double, y double")
    found = contraction.overlay(few_arcs, nodes, "node % 3 > 0", storer(spark), size).selectExpr("tail * 100 + head AS arc_id", "*")
    assert found.where("tail % 3 > 0 OR head % 3 > 0").isEmpty()
    sources = spark.range(0, 60, 3).selectExpr("id AS source")
    some = lambda arcs: rows(search.one_to_all(arcs, sources).where("node % 3 = 0").select("source", "node", "dist"))
    assert some(found) == some(few_arcs)


def test_overlay_without_the_graph(spark, monkeypatch):
    for refused in ("collect", "one_to_all"):
        monkeypatch.setattr(search, refused, refuse)
    monkeypatch.setattr(served, "_vectors", refuse)
    monkeypatch.setattr(cells, "LEAF", 300)
    same_as_sql(spark, "overlay_distances")


@pytest.mark.parametrize("size", [9, 4000])
def test_potentials_in_cells(spark, monkeypatch, few_arcs, size):
    """Weights of 0, trips without a path and of one node too; equal to plain searches."""
    nodes = spark.createDataFrame([(v, float(v % 8), float(v // 8)) for v in range(61)], "node long, x double, y double")
    trips = spark.range(41).selectExpr("id AS qid", "id * 7 % 20 AS source", "IF(id = 40, 60, id * 11 % 60) AS target")
    whole = rows(search.distances(few_arcs, trips).select("qid", "dist").where("dist IS NOT NULL"))
    own = cells.build(few_arcs, nodes, storer(spark), None, size)
    found = lazy.distances_in_cells(few_arcs, own, trips, 25)
    assert found.count() == 41
    assert rows(found.select("qid", "dist").where("dist IS NOT NULL")) == whole


def test_astar_without_the_graph(spark, monkeypatch):
    for module in (search, lazy):
        monkeypatch.setattr(module, "collect", refuse)
    small_cells(monkeypatch, 300)
    same_as_sql(spark, "astar_trips")


@pytest.mark.parametrize(("how", "size"), [("average", 9), ("symmetric", 4000)])
def test_both_sides_in_cells(spark, few_arcs, how, size):
    """Weights of 0, trips without a path and of one node too, several blocks to a cell; equal to plain searches."""
    nodes = spark.createDataFrame([(v, float(v % 8), float(v // 8)) for v in range(61)], "node long, x double, y double")
    trips = spark.range(41).selectExpr("id AS qid", "id * 7 % 20 AS source", "IF(id = 40, 60, id * 11 % 60) AS target")
    whole = rows(search.distances(few_arcs, trips).select("qid", "dist").where("dist IS NOT NULL"))
    own = cells.build(few_arcs, nodes, storer(spark), None, size)
    found = lazy.two_sided_in_cells(few_arcs, own, trips, how, 25, 10)
    assert found.count() == 41
    assert rows(found.select("qid", "dist").where("dist IS NOT NULL")) == whole
    assert lazy.two_sided_in_cells(few_arcs, own, trips.where("qid = 40"), how).first()["dist"] is None


@pytest.mark.parametrize("name", ["average_potential_trips", "symmetric_potential_trips"])
def test_both_sides_without_the_graph(spark, monkeypatch, name):
    """Cells and blocks so small that trips cross many of them."""
    for module in (search, lazy):
        monkeypatch.setattr(module, "collect", refuse)
    small_cells(monkeypatch, 300)
    own = lazy.two_sided_in_cells
    monkeypatch.setattr(lazy, "two_sided_in_cells", lambda a, o, t, how: own(a, o, t, how, 97, 60))
    same_as_sql(spark, name)

"""Golden cases and cross-checks between independent ways to the same result."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from arterial.functions import plf
from arterial.operators import graph, hierarchy, paths, potentials, search
from arterial.plans import queries, road
from arterial.schema import INFINITY
from arterial.sources import files
from arterial.streaming import link_speed

SF = "/root/testdata/sf0.001"
SIX = [(0, 2, 10), (0, 1, 1), (1, 3, 2), (2, 1, 1), (2, 3, 3), (2, 4, 1), (3, 0, 7), (3, 4, 2)]


def frame(spark, arcs):
    return spark.createDataFrame([(i, *a) for i, a in enumerate(arcs)], "arc_id long, tail long, head long, weight long")


def trips(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "qid long, source long, target long")


@pytest.mark.parametrize("two_sided", [False, True])
def test_six_nodes(spark, two_sided):
    want = {(0, 1): 1, (0, 3): 3, (3, 0): 7, (0, 4): 5, (4, 0): None, (2, 2): 0, (0, 5): None}
    got = search.distances(frame(spark, SIX), trips(spark, list(want)), two_sided)
    assert {(r.source, r.target): r.dist for r in got.collect()} == want


def test_stop_rule_of_the_two_sided_search(spark):
    arcs = [(0, 1, 4), (0, 3, 7), (0, 4, 13), (1, 2, 4), (2, 4, 4), (3, 4, 7)]
    assert search.distances(frame(spark, arcs), trips(spark, [(0, 4)]), True).first().dist == 12
    out = search.Graph(*(np.array(x) for x in zip(*arcs, strict=True)), np.arange(len(arcs)))
    assert search.bidirectional(out.lists(), out.transposed().lists(), 0, 4, cap=11) is None
    assert search.bidirectional(out.lists(), out.transposed().lists(), 0, 4, cap=12) == 12


def test_transpose_and_first_out(spark):
    a = graph.reversed_arcs(frame(spark, SIX)).orderBy("tail", "arc_id").collect()
    assert [r.weight for r in a if r.tail in (0, 1)] == [7, 1, 1]
    nodes = spark.range(6).select(F.col("id").alias("node"))
    got = [r.first_out for r in graph.first_out(frame(spark, SIX), nodes).orderBy("node").collect()]
    assert got == [0, 2, 3, 6, 8, 8]


def test_integer_functions(spark):
    points = list(zip([0, 5, 9, 14, 17, 20, 24], [1, 1, 3, 2, 4, 1, 1], strict=True))
    df = spark.createDataFrame([(points,)], "ttf array<struct<dep: long, tt: long>>")
    at = [0, 6, 7, 8, 10, 11, 12, 13, 15, 16, 18, 19, 23, 24]
    row = df.selectExpr(*[f"{plf.value_at('ttf', f'{t}L', 24)} AS v{t}" for t in at]).first()
    assert list(row) == [1, 1, 2, 2, 2, 2, 2, 2, 2, 3, 3, 2, 1, 1]
    assert [search.value(*map(list, zip(*points, strict=True)), t % 24) for t in at] == list(row)
    one = spark.createDataFrame([([(5, 7)],), ([(5, 7), (9, 8)],), ([(0, 3), (24, 3)],)], "ttf array<struct<dep: long, tt: long>>")
    got = [[tuple(p) for p in r[0]] for r in one.selectExpr(plf.normalized("ttf", 24)).collect()]
    assert got == [[(0, 7)], [(0, 7), (5, 7), (9, 8), (24, 7)], [(0, 3), (24, 3)]]


def test_range_and_average(spark):
    points = list(zip([0, 5, 14, 20, 24], [2, 1, 2, 1, 2], strict=True))
    df = spark.createDataFrame([(points,)], "ttf array<struct<dep: long, tt: long>>")
    low = plf.extreme_in_range("ttf", "6L", "13L", period=24)
    wrap = plf.extreme_in_range("ttf", "21L", "4L", "array_max", 24)
    assert df.selectExpr(low, wrap).first()[:] == (1, 2)
    assert df.selectExpr(plf.average("ttf", "0L", "24L")).first()[0] == 1
    flat = spark.createDataFrame([([(0, 9)],)], "ttf array<struct<dep: long, tt: long>>")
    assert flat.selectExpr(plf.average("ttf", "0L", "24L"), plf.value_at("ttf", "7L", 24)).first()[:] == (9, 9)


def test_float_functions_against_sampling():
    rng = np.random.default_rng(1)
    for _ in range(50):
        f, g = ((np.array([0.0, *np.sort(rng.uniform(1, 99, 4)), 100.0]), None) for _ in range(2))
        f, g = ((d[0], rng.uniform(1, 9, 5)) for d in (f, g))
        f, g = ((d, plf.fifo(d, np.append(v, v[0]))) for d, v in (f, g))
        f, g = ((d, np.append(v[:-1], v[0])) for d, v in (f, g))
        t = rng.uniform(0, 100, 200)
        h = plf.link(f, g, 100.0)
        own = plf.evaluate(*f, t, 100.0)
        assert np.allclose(plf.evaluate(*h, t, 100.0), own + plf.evaluate(*g, t + own, 100.0), atol=1e-6)
        m, better = plf.merge(f, g, 100.0)
        a, b = plf.evaluate(*f, t, 100.0), plf.evaluate(*g, t, 100.0)
        assert np.allclose(plf.evaluate(*m, t, 100.0), np.minimum(a, b), atol=1e-6)
        flags = np.array([x[1] for x in better])[np.searchsorted([x[0] for x in better], t, "right") - 1]
        assert (np.where(flags, a, b) <= np.minimum(a, b) + 1e-5).all()
        s = plf.simplify(*f, 1.0)
        assert np.abs(np.interp(t, *s) - a).max() <= 1.0 + 1e-9


def test_float_link_of_constant_with_three_points():
    dep, _ = plf.link((np.array([0.0]), np.array([110.0])), (np.array([0.0, 60.0, 100.0]), np.array([10.0, 15.0, 10.0])), 100.0)
    assert len(dep) == 4


@pytest.mark.parametrize(
    "given,kept",
    [([(0, 1)], [(0, 1)]), ([(1, 3), (1, 2), (2, 3), (0, 3)], [(1, 2), (2, 3)]), ([(0, 1), (0, 2)], [(0, 1)]), ([(1, 2), (0, 2)], [(1, 2)]), ([(0, 1), (1, 2)], [(0, 1), (1, 2)])],
)
def test_minimal_intervals(spark, given, kept):
    rows = spark.createDataFrame([(7, *x) for x in given], "qid long, a long, b long")
    assert sorted((r.a, r.b) for r in paths.minimal_intervals(rows).collect()) == kept


LIMITS = [(1, 10000, 100), (2, 10000, 50), (3, 10000, 100)]
THREE = [(1, 10000, 80), (2, 30000, 80), (3, 10000, 80)]


@pytest.mark.parametrize(
    "links,traces,want",
    [
        ([(1, 10000, 50)], [(100000, 0, 0.1), (101000, 0, 0.9)], [(1, 99875, 0.8, 28.8)]),
        ([(1, 10000, 80), (2, 30000, 80)], [(100000, 0, 0.5), (101000, 1, 0.5)], [(1, 99750, 0.125, 72), (2, 100250, 0.375, 72)]),
        (THREE, [(100000, 0, 0.5), (102000, 2, 0.5)], [(1, 99750, 0.0625, 72), (2, 100250, 0.75, 72), (3, 101750, 0.0625, 72)]),
        (THREE, [(100000, 0, 0.5), (100250, 0, 1.0), (102000, 2, 0.5)], [(1, 99750, 0.5, 72), (2, 100250, 30 / 35, 72), (3, 101750, 0.5 * 5 / 35, 72)]),
        (LIMITS, [(100000, 0, 0), (101000, 2, 1)], [(1, 100000, 1 / 3, 144), (2, 100250, 1 / 3, 72), (3, 100750, 1 / 3, 144)]),
        ([(0, 10000, 100), *LIMITS], [(99500, 0, 0), (100000, 1, 0), (101000, 3, 1)], [(0, 99500, 1.0, 72), (1, 100000, 1 / 3, 144), (2, 100250, 1 / 3, 72), (3, 100750, 1 / 3, 144)]),
    ],
)
def test_link_speeds(spark, links, traces, want):
    got = link_speed.estimate(links, traces)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert [x for g in got for x in g[2:]] == pytest.approx([x for w in want for x in w[2:]], abs=1e-6)
    a = spark.createDataFrame([(9, i, *map(float, x[1:]), x[0]) for i, x in enumerate(links)], "vehicle long, seq long, length_mm double, limit_kmh double, link_id long")
    b = spark.createDataFrame([(9, i, float(t), s, float(f)) for i, (t, s, f) in enumerate(traces)], "vehicle long, seq long, ts_ms double, link_seq long, fraction double")
    assert sorted((r.link_id, r.entered_ms) for r in link_speed.estimates(a, b).collect()) == [w[:2] for w in want]


def test_link_speed_errors():
    with pytest.raises(ValueError, match="no links given"):
        link_speed.estimate([], [(0, 0, 0.0)])
    with pytest.raises(ValueError, match="no traces given"):
        link_speed.estimate(LIMITS, [])
    with pytest.raises(ValueError):
        link_speed.estimate(LIMITS, [(5, 1, 0.5), (4, 1, 0.6)])


def test_dense_ids(spark):
    bits = spark.createDataFrame([(x,) for x in (149, 0, 2, 31, 52, 130, 999, 52)], "key long")
    ids = graph.dense_ids(bits, "key")
    assert {r.key: r.dense_id for r in ids.collect()} == {0: 0, 2: 1, 31: 2, 52: 3, 130: 4, 149: 5, 999: 6}
    probes = spark.createDataFrame([(1,), (3,), (-1,), (2000,)], "probe long")
    assert {r.probe: r.floor_dense_id for r in graph.floor_ids(ids, probes, "key", "probe").collect()} == {1: 0, 3: 1, -1: None, 2000: 6}


@pytest.mark.parametrize("seed", range(4))
def test_labels_agree_with_searches_on_random_graphs(seed):
    rng = np.random.default_rng(seed)
    n, m = 40, 130
    tail, head, weight = rng.integers(0, n, m), rng.integers(0, n, m), rng.integers(1, 60, m)
    order = hierarchy.dissection_order(rng.uniform(size=n), rng.uniform(size=n), tail, head)
    assert sorted(order.tolist()) == list(range(n))
    own = hierarchy.Hierarchy(order, tail, head)
    up, down = own.customize(tail, head, weight)
    pruned = own.perfect(up, down)
    out = search.Graph(tail, head, weight, np.arange(m)).lists()
    for s in range(n):
        want = {v: d for v, d, _ in search.settle(out, [(s, 0)])}
        for weights in ((up, down), pruned):
            a = dict(own.label(weights[0], int(own.rank[s])))
            for t in range(n):
                b = dict(own.label(weights[1], int(own.rank[t])))
                got = min((a[h] + b[h] for h in a.keys() & b.keys()), default=None)
                assert got == want.get(t)
    assert all(own.parent[v] == own.upper[v][0] for v in range(n) if own.upper[v])


def test_potentials_keep_searches_exact():
    rng = np.random.default_rng(8)
    tail, head, weight = rng.integers(0, 50, 200), rng.integers(0, 50, 200), rng.integers(1, 30, 200)
    g = search.Graph(tail, head, weight, np.arange(200))
    to = {v: d for v, d, _ in search.settle(g.transposed().lists(), [(7, 0)])}
    plain = {v: d for v, d, _ in search.settle(g.lists(), [(0, 0)])}
    guided = {v: d for v, d, _ in search.settle(g.lists(), [(0, 0)], potential=to.get)}
    assert guided.get(7) == plain.get(7) and len(guided) <= len(plain)


def test_fixpoint_agrees_with_the_kernel(spark, tmp_path):
    arcs = frame(spark, SIX)
    sources = spark.createDataFrame([(0,), (2,)], "source long")
    n = iter(range(1000))

    def store(df):
        path = str(tmp_path / f"r{next(n)}")
        df.write.parquet(path)
        return spark.read.parquet(path)

    a = {tuple(r) for r in search.fixpoint(arcs, sources, store).collect()}
    assert a == {tuple(r) for r in search.one_to_all(arcs, sources).select("source", "node", "dist").collect()}


def test_earliest_arrivals_against_static_weights(spark):
    arcs = road.arcs(spark, SF).withColumn("ttf", F.expr("array(named_struct('dep', 0L, 'tt', weight))"))
    starts = spark.createDataFrame([(0, 5000)], "source long, departure long")
    td = {r.node: r.travel_time for r in search.earliest_arrivals(arcs, starts, 86_400_000).collect()}
    assert td == {r.node: r.dist for r in queries.dijkstra_one_to_all(spark, SF).collect()}


def test_landmarks_never_overestimate(spark):
    both = queries.landmark_bounds(spark, SF).join(queries.dijkstra_trips(spark, SF), ["source", "target"])
    assert both.where("bound > dist").count() == 0 < both.count()


def test_metric_merging(spark):
    rows = [(m, a, w + a) for m, w in enumerate((10, 11, 50, 52, 90)) for a in range(3)]
    df = spark.createDataFrame(rows, "metric int, arc_id long, weight long")
    assert potentials.merge_metrics(df, 3) == [[0, 1], [2, 3], [4]]


def test_violating_subpaths(spark):
    arcs = frame(spark, [(0, 1, 5), (1, 2, 5), (2, 3, 5), (0, 2, 6), (3, 4, 1)])
    walk = spark.createDataFrame([(1, i, i) for i in range(5)], "qid long, pos int, node long")
    cum = paths.cumulative(walk, arcs)
    assert [r.cum for r in cum.orderBy("pos").collect()] == [0, 5, 10, 15, 16]
    pairs = [(s, t) for s in range(5) for t in range(s + 1, 5)]
    shortest = search.distances(arcs, trips(spark, pairs)).select("source", "target", "dist")
    assert [(r.a, r.b) for r in paths.violating(cum, shortest, 0.1).collect()] == [(0, 2)]
    assert paths.stretch(cum, shortest).first().worst == pytest.approx(10 / 6)


def test_updates_and_stream(spark, tmp_path):
    arcs = frame(spark, SIX)
    ups = spark.createDataFrame([(0, 5, 1), (0, None, 2), (3, 9, 1), (99, 1, 1)], "arc_id long, weight long, seq long")
    got = {r.arc_id: r.weight for r in link_speed.updated_metric(arcs, ups, INFINITY).collect()}
    assert got[0] == INFINITY and got[3] == 9 and got[1] == 1 and 99 not in got
    arcs.write.parquet(str(tmp_path / "m" / "base"))
    ups.write.parquet(str(tmp_path / "in"))
    versions = []
    q = link_speed.apply_stream(
        spark.readStream.schema(ups.schema).parquet(str(tmp_path / "in")), str(tmp_path / "m"), str(tmp_path / "c"), lambda v, f: versions.append((v, f.count()))
    )
    q.processAllAvailable()
    q.stop()
    assert versions == [(0, 8)]
    assert {r.arc_id: r.weight for r in link_speed.metric_at(spark, str(tmp_path / "m"), 0).collect()} == got
    assert link_speed.metric_at(spark, str(tmp_path / "m"), None).count() == 8
    assert spark.read.parquet(str(tmp_path / "m" / "changes")).count() == 3


@pytest.mark.parametrize("kind", list(files.ELEMENTS))
def test_vectors(spark, tmp_path, kind):
    values = [0, 1, 2, 100] if kind[0] != "f" else [0.5, -1.25, 3.0]
    (tmp_path / "v").write_bytes(files.encode(values, kind))
    got = files.read_vector(spark, str(tmp_path / "v"), kind).orderBy("i").collect()
    assert [float(r.value) for r in got] == [float(x) for x in values]
    with pytest.raises(ValueError):
        files.decode(b"123", "u32")


def test_text_sources(spark, tmp_path):
    (tmp_path / "g.txt").write_text("3 2 3 86400\n0 1 2 0 5 100 7\n1 2 1 0 9\n")
    got = {(r.tail, r.head): [tuple(p) for p in r.ttf] for r in files.read_text_profiles(spark, str(tmp_path / "g.txt")).collect()}
    assert got == {(0, 1): [(0, 5000), (100_000, 7000)], (1, 2): [(0, 9000)]}
    (tmp_path / "l.tsv").write_text('7\t1\t2\n8\t"\t3\n')
    assert [tuple(r) for r in files.read_tsv(spark, str(tmp_path / "l.tsv"), files.LINK).orderBy("link_id").collect()] == [(7, 1, 2), (8, None, 3)]
    assert files.dimacs_arcs(frame(spark, SIX[:1])).first().value == "a 1 3 10"
    node = spark.createDataFrame([(0, 8.4, 49.0000019)], "node long, lng double, lat double")
    assert files.dimacs_nodes(node).first().value == "v 1 8400000 49000001"



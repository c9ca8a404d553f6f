"""Functions in traffic, structure, alternatives and sources against brute force."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from arterial.functions import plf
from arterial.operators import alternatives, experiments, graph, hierarchy, search, structure, td
from arterial.plans.storage import storer
from arterial.schema import INFINITY
from arterial.sources import files

P = 100.0


def periodic(rng, n=5, low=1, high=9):
    dep = np.array([0.0, *np.sort(rng.uniform(1, 99, n)), 100.0])
    tt = rng.uniform(low, high, n + 1)
    tt = np.append(tt, tt[0])
    # from two rounds on, the end is the start's value again
    for _ in range(3):
        tt = plf.fifo(dep, tt)
        tt[-1] = tt[0] = min(tt[0], tt[-1])
    return dep, tt


def world(seed, n=14, m=45):
    rng = np.random.default_rng(seed)
    tail, head = rng.integers(0, n, m), rng.integers(0, n, m)
    functions = [periodic(rng) for _ in range(m)]
    return rng, tail, head, functions


def float_arrivals(out, functions, source, departure):
    return {v: d - departure for v, d, _ in search.settle(out, [(source, departure)], lambda at, _, p: at + float(plf.evaluate(*functions[p], at, P)))}


@pytest.mark.parametrize("seed", range(3))
def test_profiles_and_function_hierarchies_against_searches(seed):
    rng, tail, head, functions = world(seed)
    g = search.Graph(tail, head, np.zeros(len(tail), np.int64), np.arange(len(tail)))
    out, own = g.lists(), [functions[a] for a in g.arc.tolist()]
    order = hierarchy.dissection_order(rng.uniform(size=14), rng.uniform(size=14), tail, head)
    h = td.FunctionHierarchy(hierarchy.Hierarchy(order, tail, head), tail, head, functions, P)
    for s, t in [(0, 5), (3, 9), (7, 2), (4, 4)]:
        found = td.profile(out, own, range(14), s, t, P)
        for departure in rng.uniform(0, 100, 25):
            want = float_arrivals(out, own, s, departure).get(t)
            got = h.travel_time(s, t, departure)
            if want is None:
                assert found is None and got is None
                continue
            assert got == pytest.approx(want, abs=1e-4)
            f, switches = found
            assert float(plf.evaluate(*f, departure, P)) == pytest.approx(want, abs=1e-4)
            path = [p for at, p in switches if at <= departure][-1]
            at = departure
            for p in path:
                at += float(plf.evaluate(*own[p], at, P))
            assert at - departure == pytest.approx(want, abs=1e-3)
    least = h.bucket_minima(4)
    assert least and all(x[3] >= 0 for x in least)


def ttf_frame(spark, seed=5, n=12, m=40):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(m):
        points = sorted({0, *rng.integers(1, 86_399_999, 4).tolist()})
        rows.append((i, int(rng.integers(0, n)), int(rng.integers(0, n)), 1, [(d, int(rng.integers(100_000, 900_000))) for d in points]))
    df = spark.createDataFrame(rows, "arc_id long, tail long, head long, weight long, ttf array<struct<dep: long, tt: long>>")
    return df.withColumn("ttf", F.expr(plf.normalized("ttf")))


def test_profile_rows(spark):
    arcs = ttf_frame(spark)
    pairs = spark.createDataFrame([(0, 3), (5, 5), (0, 99)], "source long, target long")
    rows = {(r.source, r.target): r for r in td.profiles(arcs, pairs).collect()}
    assert rows[0, 99].dep is None and set(rows[5, 5].tt) == {0.0}
    part = {(r.source, r.target): r for r in td.profiles(arcs, pairs, window=(20_000.0, 30_000.0)).collect()}[0, 3]
    whole = rows[0, 3]
    assert (part.dep[0], part.dep[-1]) == (20_000.0, 30_000.0)
    assert np.allclose(part.tt, np.interp(part.dep, whole.dep, whole.tt), atol=1e-6)
    assert part.switches[0].valid_from == 20_000.0
    assert len(whole.switches) == len({tuple(x.arcs) for x in whole.switches}) or len(whole.switches) > 1


def test_samples_never_beat_the_exact_time(spark):
    arcs = ttf_frame(spark)
    trips = spark.createDataFrame([(i, 0, i, 7_000_000 * i) for i in range(12)], "qid long, source long, target long, departure long")
    sampled = {r.qid: r.travel_time for r in td.sampled(arcs, trips).collect()}
    for r in trips.collect():
        start = spark.createDataFrame([(0, r.departure)], "source long, departure long")
        exact = {x.node: x.travel_time for x in search.earliest_arrivals(arcs, start, 86_400_000).collect()} if r.qid in (1, 4, 7) else None
        if exact is not None:
            assert (sampled[r.qid] is None) == (r.target not in exact)
            assert sampled[r.qid] is None or sampled[r.qid] >= exact[r.target]
    assert sampled[0] == 0


def test_path_times_and_live_arrivals(spark):
    arcs = ttf_frame(spark).where("tail <> head")
    one = arcs.first()
    paths = spark.createDataFrame([(1, 500, [one.arc_id]), (2, 86_400_500, [one.arc_id]), (3, 7, [])], "qid long, departure long, arcs array<long>")
    points = ([p.dep for p in one.ttf], [p.tt for p in one.ttf])
    want = search.value(*points, 500)
    assert {r.qid: r.travel_time for r in td.path_times(arcs, paths).collect()} == {1: want, 2: want, 3: 0}
    starts = spark.createDataFrame([(0, 1000)], "source long, departure long")
    plain = {r.node: r.travel_time for r in search.earliest_arrivals(arcs, starts, 86_400_000).collect()}
    none = arcs.withColumn("live", F.lit(None).cast("long")).withColumn("until", F.lit(None).cast("long"))
    assert {r.node: r.travel_time for r in td.live_arrivals(none, starts).collect()} == plain
    slow = arcs.withColumn("live", F.lit(50_000_000).cast("long")).withColumn("until", F.lit(60_000_000).cast("long"))
    for pessimistic in (False, True):
        live = {r.node: r.travel_time for r in td.live_arrivals(slow, starts, pessimistic=pessimistic).collect()}
        assert set(live) == set(plain) and all(live[v] >= plain[v] for v in plain)


@pytest.mark.parametrize("seed", range(6))
def test_pareto_against_enumeration(spark, seed):
    rng = np.random.default_rng(seed)
    arcs = [(int(a), int(b), int(w), int(c)) for a, b, w, c in zip(rng.integers(0, 6, 14), rng.integers(0, 6, 14), rng.integers(1, 9, 14), rng.integers(1, 9, 14), strict=True)]
    sums = set()

    def walk(v, d, c, seen):
        if v == 5:
            sums.add((d, c))
            return
        for a, b, w, x in arcs:
            if a == v and b not in seen:
                walk(b, d + w, c + x, seen | {b})

    walk(0, 0, 0, {0})
    want = sorted(x for x in sums if not any(y != x and y[0] <= x[0] and y[1] <= x[1] for y in sums))
    g = search.Graph(*(np.array(x) for x in list(zip(*arcs, strict=True))[:3]), np.arange(len(arcs)))
    assert td.pareto_labels(g.lists(), [arcs[i][3] for i in g.arc.tolist()], 0, 5) == want


def test_inverse_crop_and_parts():
    rng = np.random.default_rng(3)
    for _ in range(40):
        f, g = periodic(rng), periodic(rng)
        t = rng.uniform(0, 300, 50)
        assert np.allclose(plf.inverse(*f, t + plf.evaluate(*f, t, P), P), t, atol=1e-6) or np.isclose(np.diff(f[0] + f[1]).min(), 0, atol=1e-9)
        part = plf.crop(*f, 80.0, 150.0, P)
        x = rng.uniform(80, 150, 30)
        assert np.allclose(np.interp(x, *part), plf.evaluate(*f, x, P))
        both = plf.appended(plf.crop(*f, 80.0, 110.0, P), plf.crop(*f, 110.0, 150.0, P))
        assert np.allclose(np.interp(x, *both), plf.evaluate(*f, x, P), atol=1e-6)
        linked = plf.link_part(part, g, P)
        own = plf.evaluate(*f, x, P)
        assert np.allclose(np.interp(x, *linked), own + plf.evaluate(*g, x + own, P), atol=1e-6)
    with pytest.raises(ValueError):
        plf.appended((np.array([0.0, 1.0]), np.array([1.0, 1.0])), (np.array([2.0]), np.array([1.0])))
    assert plf.inverse(np.array([0.0]), np.array([7.0]), 10.0, P) == 3.0


def test_bounds_enclose_and_never_overtake():
    rng = np.random.default_rng(4)
    for _ in range(40):
        f = periodic(rng, 12)
        low, high = plf.bounds(*f, 1.0)
        assert (np.interp(f[0], *low) <= f[1] + 1e-9).all() and (np.interp(f[0], *high) >= f[1] - 1e-9).all()
        for dep, tt in (low, high):
            assert tt[0] == pytest.approx(tt[-1]) and (np.diff(dep + tt) >= -1e-9).all() and len(dep) <= len(f[0])


def test_switch_back_from_live():
    f = (np.array([0.0, 50.0, 100.0]), np.array([10.0, 10.0, 10.0]))
    assert plf.switch_point(*f, 20.0, 30.0, P) == pytest.approx((40.0, 10.0))
    assert plf.switch_point(*f, 4.0, 30.0, P) == pytest.approx((36.0, 10.0))
    assert plf.switch_point(*f, 10.0, 30.0, P) == (30.0, 10.0)
    got = plf.evaluate_live(*f, 20.0, 30.0, np.array([0.0, 30.0, 35.0, 40.0, 70.0]), P)
    assert np.allclose(got, [20, 20, 15, 10, 10])


def test_speeds_to_times():
    dep, tt = plf.from_speeds(np.array([0, 40_000]), np.array([36, 72]), 100, 100_000)
    # 10 m/s until 40 s, then 20 m/s: 100 m take 10 s, from 40 s on 5 s
    assert dict(zip(dep.tolist(), tt.tolist(), strict=True)) == {0: 10_000, 30_000: 10_000, 40_000: 5000, 95_000: 5000, 100_000: 10_000}
    rng = np.random.default_rng(2)
    for _ in range(20):
        at = np.array([0, *sorted(rng.choice(np.arange(1, 100), 5, replace=False).tolist())]) * 1000
        dep, tt = plf.from_speeds(at, rng.integers(5, 130, 6), int(rng.integers(1, 3000)), 100_000)
        assert dep[0] == 0 and dep[-1] == 100_000 and tt[0] == tt[-1] and (np.diff(dep) > 0).all() and (np.diff(dep + tt) >= 0).all()
    with pytest.raises(ValueError):
        plf.from_speeds(np.array([0]), np.array([0]), 10)


def test_slices_keep_the_order(spark):
    for parts in (1, 3, 50):
        df = spark.createDataFrame([(v,) for v in [5, -3, 8, 8, 100, None, 7]], "key long")
        got = {r.key: r.s for r in df.withColumn("s", graph.sliced(df, "key", parts)).collect()}
        values = [v for v in sorted(x for x in got if x is not None)]
        assert [got[v] for v in values] == sorted(got[v] for v in values)
    empty = spark.createDataFrame([], "key long")
    assert graph.dense_ids(empty, "key").count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    n = 60
    arcs = [(rng.randrange(n), rng.randrange(n), 1) for _ in range(45)] + [(i, i + 1, 1) for i in range(20, 40)]
    own = list(range(n))
    for _ in range(n):
        for a, b, _ in arcs:
            own[a] = own[b] = min(own[a], own[b])
    df = spark.createDataFrame([(i, *a) for i, a in enumerate(arcs)], "arc_id long, tail long, head long, weight long")
    nodes = spark.range(n).select(F.col("id").alias("node"))
    got = structure.weak_components(df, nodes, storer(spark))
    assert {r.node: r.component for r in got.collect()} == dict(enumerate(own))
    trips = spark.createDataFrame([(0, 0, 1), (1, 20, 40), (2, 0, 999)], "qid long, source long, target long")
    assert {r.qid: r.possible for r in structure.connected_only(trips, got).collect()} == {0: own[0] == own[1], 1: True, 2: False}


def test_blocks_against_cut_nodes():
    rng = random.Random(1)
    for _ in range(60):
        n = 8
        pairs = {tuple(sorted(rng.sample(range(n), 2))) for _ in range(rng.randrange(3, 14))}
        near = structure.neighbours(n, np.array([a for a, _ in pairs]), np.array([b for _, b in pairs]))
        got = structure.blocks(near)
        covered = [pair for pair in pairs for b in got if set(pair) <= b]
        assert sorted(covered) == sorted(pairs)

        def parts(without):
            left = set(range(n)) - {without}
            count = 0
            while left:
                stack = [left.pop()]
                count += 1
                while stack:
                    for w in near[stack.pop()]:
                        if w in left:
                            left.discard(w)
                            stack.append(w)
            return count

        whole = parts(None)
        cut = {v for v in range(n) if near[v] and parts(v) > whole}
        assert cut == {v for v in range(n) if sum(v in b for b in got) > 1}
        assert sorted(structure.preorder(near, 3)) == list(range(n)) and structure.preorder(near, 3)[0] == 3


def test_core_of_a_triangle_with_a_tail(spark):
    arcs = spark.createDataFrame([(0, 0, 1, 1), (1, 1, 2, 1), (2, 2, 0, 1), (3, 2, 3, 1), (4, 4, 3, 1)], "arc_id long, tail long, head long, weight long")
    nodes = spark.range(6).select(F.col("id").alias("node"))
    got = {r.node: (r.in_core, r.degree, r.bridge) for r in structure.core(spark, arcs, nodes).collect()}
    assert got == {0: (True, 2, 0), 1: (True, 2, 1), 2: (True, 2, 2), 3: (False, 1, 2), 4: (False, 0, 2), 5: (False, 0, None)}


def both_ways(arcs):
    g = search.Graph(*(np.array(x) for x in zip(*arcs, strict=True)), np.arange(len(arcs)))
    out = g.lists()
    back = [[] for _ in out]
    for v, x in enumerate(out):
        for head, _, p in x:
            back[head].append((v, p))
    return g, out, back


def test_forbidden_sequences():
    _, out, _ = both_ways([(0, 1, 1), (1, 0, 1)])
    plain = lambda d, w, _: d + w
    assert alternatives.avoiding(out, plain, alternatives.Forbidden([[0, 1]]), 0, 1) is None
    assert alternatives.avoiding(out, plain, alternatives.Forbidden([[0, 1, 0]]), 0, 1) == (1, [0, 1])
    assert alternatives.avoiding(out, plain, alternatives.Forbidden([[0, 1, 0]]), 1, 0) == (1, [1, 0])


@pytest.mark.parametrize("seed", range(8))
def test_avoiding_against_enumeration(seed):
    rng = random.Random(seed)
    n = 6
    arcs = [(a, b, rng.randrange(1, 9)) for a, b in itertools.permutations(range(n), 2) if rng.random() < 0.55]
    _, out, _ = both_ways([*arcs, (n - 1, n - 1, 99)])
    weight = {(a, b): w for a, b, w in arcs}
    bad = [rng.sample(range(n), rng.randrange(2, 4)) for _ in range(5)]
    walks = [(0, [0])]
    best = None
    for _ in range(7):
        step = []
        for d, w in walks:
            for (a, b), x in weight.items():
                if a == w[-1] and not any((w + [b])[-len(p) :] == p for p in bad):
                    step.append((d + x, [*w, b]))
        best = min([best] * (best is not None) + [d for d, w in step if w[-1] == n - 1], default=None)
        walks = sorted(step)[:3000]
    plain = lambda d, w, _: d + w
    got = alternatives.avoiding(out, plain, alternatives.Forbidden(bad), 0, n - 1)
    assert (got and got[0]) == best
    heuristic = alternatives.avoiding_detours(out, plain, bad, 0, n - 1)
    assert heuristic is None or heuristic[0] >= got[0]


def grid(seed, w=7):
    rng = random.Random(seed)
    arcs = []
    for v in range(w * w):
        for to in ([v + 1] if v % w < w - 1 else []) + ([v + w] if v + w < w * w else []):
            arcs += [(v, to, rng.randrange(5, 30)), (to, v, rng.randrange(5, 30))]
    return arcs


def test_traffic_aware_paths(spark):
    arcs = grid(1)
    g, out, _ = both_ways(arcs)
    smooth = g.weight.tolist()
    rng = random.Random(2)
    live = [w * rng.choice([1, 1, 4]) for w in smooth]
    own = alternatives.Traffic(out, smooth, live)
    label, path, rounds, done = own.blocked(0, 48, 0.1, None)
    assert done and rounds >= 1 and not own.bad(path, 0.1) and own.along(path, smooth=False)[-1] == label
    free = alternatives.shortest(out, 0, 48, own.step)
    known = alternatives.shortest(out, 0, 48, own.known)
    assert free[0] <= label <= own.label(known[1])
    fixed, ok = own.fixed(free[1], 0.1, None)
    assert ok and not own.bad(fixed, 0.1) and own.along(fixed, smooth=False)[-1] >= free[0]
    df = spark.createDataFrame([(i, *a, live[g.arc.tolist().index(i)]) for i, a in enumerate(arcs)], "arc_id long, tail long, head long, weight long, live long")
    trips = spark.createDataFrame([(1, 0, 48), (2, 0, 999)], "qid long, source long, target long")
    rows = alternatives.traffic_aware(df, trips, "live", 0.1, limit_ms=None).collect()
    assert [(r.qid, r.live_dist, r.path, r.done) for r in rows] == [(1, label, path, True)]
    with pytest.raises(ValueError):
        alternatives.traffic_aware(df, trips, "live", 0.1, "none")
    # the same search with times of day: constant functions give the same path
    timed = alternatives.Traffic(out, smooth, live, lambda at, _, p: at + live[p])
    assert timed.blocked(0, 48, 0.1, None, start=1000)[:2] == (label + 1000, path)


def test_violations_are_minimal():
    _, out, _ = both_ways([(0, 1, 5), (1, 2, 5), (2, 3, 5), (0, 2, 6), (3, 4, 1)])
    own = alternatives.Traffic(out, [5, 6, 5, 5, 1], [1] * 5)
    assert own.bad([0, 1, 2, 3, 4], 0.1) == [(0, 2)]
    assert own.fixed([0, 1, 2, 3, 4], 0.1) == ([0, 2, 3, 4], True)
    _, round_trip, _ = both_ways([(0, 1, 5), (1, 0, 5), (1, 2, 5)])
    assert (0, 2) in alternatives.Traffic(round_trip, [5, 5, 5], [1] * 3).bad([0, 1, 0, 1, 2], 0.1)


@pytest.mark.parametrize("seed", range(4))
def test_penalty_paths(seed):
    arcs = grid(seed)
    g, out, back = both_ways(arcs)
    weight = g.weight.tolist()
    found = alternatives.penalty_paths(out, back, weight, 0, 48)
    base, first = alternatives.shortest(out, 0, 48)
    known = {(a, b) for a, b, _ in arcs}
    used = set(zip(first, first[1:], strict=False))
    cost = {(a, b): w for a, b, w in arcs}
    assert 0 < len(found) <= 5
    for path in found:
        steps = list(zip(path, path[1:], strict=False))
        assert (path[0], path[-1]) == (0, 48) and set(steps) <= known
        length = sum(cost[x] for x in steps)
        assert length >= base and sum(cost[x] for x in steps if x not in used) > length // 5
        used |= set(steps)
    total, average, decisions = alternatives.graph_statistics(out, weight, [first, *found])
    assert total >= 1 and average >= 1 and decisions >= 1
    assert alternatives.graph_statistics(out, weight, [first]) == pytest.approx((1.0, 1.0, 0))


def test_live_rows_and_incidents(spark, tmp_path):
    rows = spark.createDataFrame([(1, 5, 1000, 1), (1, 7, 2000, 2), (1, 9, 86_400_000, 3), (2, INFINITY, 90_000_000, 4)], "arc_id long, weight long, duration long, seq long")
    assert [tuple(r) for r in files.live_triples(rows, 50).collect()] == [(1, 7, 2050)]
    assert tuple(files.live_counters(rows, INFINITY).first()) == (4, 1, 2, 2, 1)
    (tmp_path / "i.csv").write_text("from;to;speed;distance;duration\n0;1;36;100;5\n0;1;0;100;9999999\n7;8;1;1;1\n")
    arcs = spark.createDataFrame([(4, 0, 1, 9), (3, 0, 1, 9)], "arc_id long, tail long, head long, weight long")
    got = files.incidents(files.read_incidents(spark, str(tmp_path / "i.csv")), arcs, INFINITY).orderBy("duration").collect()
    assert [tuple(r) for r in got] == [(3, 10_000, 5000), (3, INFINITY, (1 << 32) - 1)]


def test_speed_smoothing(spark):
    rng = random.Random(3)
    speeds = [rng.randrange(0, 120) for _ in range(288)]
    calm = [max(5, max(speeds) if i >= 276 or i < 60 else x) for i, x in enumerate(speeds)]
    mean = [min(80, sum(calm[(i + o) % 288] for o in range(-3, 4)) // 7) for i in range(288)]
    want = [(i * 300_000, x) for i, x in enumerate(mean) if i == 0 or mean[i - 1] != x]
    df = spark.createDataFrame([(1, 500, speeds, 80)], "arc_id long, length long, speeds array<long>, v_max long")
    made = files.smoothed_speeds(df)
    assert [tuple(p) for p in made.first().profile] == want
    ttf = files.speed_functions(made).first().ttf
    assert (ttf[0].dep, ttf[-1].dep) == (0, 86_400_000) and ttf[0].tt == ttf[-1].tt
    lines = spark.createDataFrame([(1, "5,6,1,2,3"), (2, "5,6,4,5,6"), (3, "7,8,9,9,9")], "seq long, value string")
    assert [tuple(r) for r in files.scrubbed_speeds(lines).collect()] == [(5, 6, [4, 5, 6])]
    assert files.scrubbed_speeds(lines, skip=1).first().speeds == [5, 6]


def test_text_sinks(spark):
    arcs = spark.createDataFrame([(0, 1, 2, [(0, 1230), (700, 5), (1000, 10)])], "arc_id long, tail long, head long, ttf array<struct<dep: long, tt: long>>")
    assert files.profile_lines(arcs).first().value == "1 2 3 0 12.3 7 0.05 10 0.1"
    lines = spark.createDataFrame([("3 2 4 86400",), ("0 1 2 0 5.25 100 7",)], "value string")
    assert [r.value for r in files.upscaled(lines).collect()] == ["3 2 4 864000", "0 1 2 0 52.5 1000 70"]


def test_road_graph(spark):
    nodes = spark.createDataFrame([(10, 4_900_000, 800_000), (20, 4_900_100, 800_000), (30, 4_900_100, 800_100), (40, 9_000_000, 800_000)], "node_id long, lat long, lng long")
    links = spark.createDataFrame([(7, 10, 20), (5, 20, 30), (9, 10, 40), (6, 10, 30)], "link_id long, ref_node long, nonref_node long")
    nav = spark.createDataFrame([(7, "B", 1), (5, "T", 2), (9, "F", 1)], "link_id long, direction string, road_class int")
    arcs, kept = files.road_graph(nodes, links, nav, (4_800_000, 5_000_000, 700_000, 900_000), "10.0D")
    got = [(r.arc_id, r.tail, r.head, r.link_id, r.from_ref) for r in arcs.orderBy("arc_id").collect()]
    assert got == [(0, 0, 1, 7, True), (1, 1, 0, 7, False), (2, 2, 1, 5, False)]
    assert [r.weight for r in arcs.orderBy("arc_id").collect()][0] == pytest.approx(11_132, abs=1)
    assert {r.node: r.node_id for r in kept.collect()} == {0: 10, 1: 20, 2: 30}
    assert [(r.tail, r.head, r.link_id, r.direction) for r in files.link_rows(arcs.orderBy("arc_id")).collect()] == [(0, 1, 7, 1), (1, 0, 7, 0), (2, 1, 5, 0)]


def test_live_array(spark):
    speeds = spark.createDataFrame([(0, 1, 40, 1), (0, 1, 36, 2), (5, 6, 9, 3)], "tail long, head long, speed long, seq long")
    arcs = spark.createDataFrame([(3, 0, 1, 100), (2, 0, 1, 50)], "arc_id long, tail long, head long, dist long")
    assert [tuple(r) for r in files.live_array(speeds, arcs).collect()] == [(2, 5000, 3_600_000)]


def test_workloads(spark):
    arcs = spark.range(4000).selectExpr("id AS arc_id", "IF(id % 10 = 0, 0, 10) AS weight", "1000 AS dist")
    out = experiments.scaled_metric(arcs, 2.0, (0.0, 0.25), (200.0, 0.25), "s")
    share = out.where("weight = 20").count() / 3600
    assert 0.2 < share < 0.3 and out.where("arc_id % 10 = 0 AND weight <> 0").count() == 0
    assert experiments.congested(arcs, 50.0, 1.0, 20.0, "s").where("weight = 50").count() == 3600
    settled = spark.createDataFrame([(1, 1, 0), (1, 2, 5), (1, 3, 5), (1, 4, 9)], "source long, node long, dist long")
    assert tuple(experiments.first_beyond(settled, 4).first()) == (1, 2, 5)
    assert sorted(r.node for r in experiments.ball(settled, 3).collect()) == [1, 2, 3]

"""Hierarchies: paths, directed and dated customization, contraction, goal direction."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from arterial.operators import alternatives, contraction, hierarchy, search
from arterial.plans import extended, queries  # noqa: F401
from arterial.schema import INFINITY

SF = "/root/testdata/sf0.001"


def world(seed, n=30, m=90):
    rng = np.random.default_rng(seed)
    tail, head, weight = rng.integers(0, n, m), rng.integers(0, n, m), rng.integers(1, 60, m)
    order = hierarchy.dissection_order(rng.uniform(size=n), rng.uniform(size=n), tail, head)
    g = search.Graph(tail, head, weight, np.arange(m))
    lists = g.lists() + [[] for _ in range(n - g.n)]
    return rng, n, tail, head, weight, order, lists


@pytest.mark.parametrize("seed", range(4))
def test_paths_directed_and_dated(seed):
    rng, n, tail, head, weight, order, out = world(seed)
    own = hierarchy.Hierarchy(order, tail, head)
    weights = own.customize(tail, head, weight)
    lower = hierarchy.lower_neighbours(own)
    cost = {}
    for a, b, w in zip(tail.tolist(), head.tolist(), weight.tolist(), strict=True):
        cost[a, b] = min(w, cost.get((a, b), w))
    kept = hierarchy.finite_arcs([weights])
    directed = hierarchy.customize_directed(own, kept, tail, head, weight)
    assert directed == tuple([{b: w for b, w in x.items() if w < INFINITY} for x in side] for side in weights)
    since = rng.integers(0, 100, len(tail))
    dated = hierarchy.customize_valid(own, tail, head, weight, since)
    assert [[{b: x[0] for b, x in u.items()} for u in side] for side in dated] == [list(side) for side in weights]
    for s in range(n):
        want = {v: d for v, d, _ in search.settle(out, [(s, 0)])}
        for t in range(n):
            found = hierarchy.shortest_path(own, weights, lower, s, t)
            assert (found and found[0]) == want.get(t)
            if found:
                path = found[1]
                assert (path[0], path[-1]) == (s, t) and sum(cost[x] for x in zip(path, path[1:], strict=False)) == found[0]


@pytest.mark.parametrize("seed", range(4))
def test_contraction_and_goal_direction(seed):
    rng, n, tail, head, weight, order, out = world(seed)
    own = contraction.Contraction(order, tail, head, weight)
    back = [[] for _ in out]
    for v, x in enumerate(out):
        for h, w, p in x:
            back[h].append((v, w, p))
    cost = {}
    for a, b, w in zip(tail.tolist(), head.tolist(), weight.tolist(), strict=True):
        cost[a, b] = min(w, cost.get((a, b), w))
    for s in range(n):
        want = {v: d for v, d, _ in search.settle(out, [(s, 0)])}
        a = dict(own.pruned_label(int(own.rank[s]), False))
        for t in range(n):
            b = dict(own.pruned_label(int(own.rank[t]), True))
            assert min((a[h] + b[h] for h in a.keys() & b.keys()), default=None) == want.get(t)
    for low, arcs in enumerate(own.up):
        for high, w in arcs.items():
            path = own.unpack(low, high)
            assert sum(cost[x] for x in zip(path, path[1:], strict=False)) == w
    for s, t in [(0, 9), (3, 3), (5, 20), (11, 2)]:
        to_t = {v: d for v, d, _ in search.settle(back, [(t, 0)])}
        from_s = {v: d for v, d, _ in search.settle(out, [(s, 0)])}
        exact = search.goal_directed(out, back, s, t, to_t, from_s)
        assert exact == from_s.get(t)
        zero = dict.fromkeys(range(n), 0)
        assert search.goal_directed(out, back, s, t, zero, zero) == from_s.get(t)
    part = contraction.Contraction(order, tail, head, weight, count=n // 2)
    assert len(part.overlay) == n and not any(part.up[n // 2 :])


def test_orders_and_cells():
    _, n, tail, head, weight, order, _ = world(7)
    own = hierarchy.Hierarchy(order, tail, head)
    again = hierarchy.Hierarchy(hierarchy.depth_first_order(own), tail, head)
    pairs = lambda h: sorted(tuple(sorted((int(h.order[v]), int(h.order[b])))) for v, u in enumerate(h.upper) for b in u)
    assert pairs(own) == pairs(again)
    cells = hierarchy.separator_cells(own)
    assert sorted(c[0] for c in cells) == list(range(n))
    by_rank = {int(own.rank[v]): (cell, level) for v, cell, level in cells}
    for v, p in enumerate(own.parent.tolist()):
        assert by_rank[v][1] >= (by_rank[p][1] if p >= 0 else 0)


def test_queries_agree(spark):
    want = {r.qid: r.dist for r in queries.QUERIES["dijkstra_trips"](spark, SF).collect()}
    for name in ("cch_paths", "contraction_trips"):
        assert {r.qid: r.dist for r in queries.QUERIES[name](spark, SF).collect()} == want
    a = {r.qid: r for r in queries.QUERIES["traffic_path_blocking"](spark, SF).collect()}
    b = {r.qid: r for r in queries.QUERIES["traffic_smooth_baseline"](spark, SF).collect()}
    assert a.keys() == b.keys() and all(a[q].live_dist <= b[q].live_dist for q in a)


def test_time_dependent_traffic(spark):
    rows = [(0, 0, 1, 10), (1, 1, 2, 10), (2, 0, 2, 15), (3, 2, 3, 5)]
    arcs = spark.createDataFrame(rows, "arc_id long, tail long, head long, weight long").withColumn("ttf", F.expr("array(named_struct('dep', 0L, 'tt', weight * IF(arc_id = 2, 3, 1)))"))
    trips = spark.createDataFrame([(1, 0, 3, 1000), (2, 3, 0, 0)], "qid long, source long, target long, departure long")
    got = {how: [(r.qid, r.live_dist, r.path, r.done) for r in alternatives.td_traffic_aware(arcs, trips, 0.1, how, None).collect()] for how in alternatives.HOW}
    assert got["blocking"] == got["fixing"] == got["smooth"] == [(1, 50, [0, 2, 3], True)]
    assert [x[0] for x in got["detours"]] == [1]
    loose = alternatives.td_traffic_aware(arcs, trips, 0.5, "blocking", None).collect()
    assert [(r.qid, r.live_dist, r.path) for r in loose] == [(1, 25, [0, 1, 2, 3])]

"""Shortcuts known by bounds, parts of functions, chains and fewest points against plain searches and enumeration."""

import itertools
import random

import numpy as np
import pytest

from arterial.functions import bounded, plf
from arterial.operators import hierarchy, search, shortcuts

P = 86_400.0


def day(rng, n=6):
    dep = np.sort(np.array([0, *rng.sample(range(600, 86_000), n)], float))
    tt = np.array([rng.uniform(200, 3000) for _ in dep])
    dep, tt = np.append(dep, P), np.append(tt, 0)
    for _ in range(9):
        tt[[0, -1]] = min(tt[0], tt[-1] or tt[0])
        tt = plf.fifo(dep, tt)
    tt[-1] = tt[0]
    return dep, 100 + 0.8 * tt  # a later departure arrives later


def world(seed, n=14):
    rng = random.Random(seed)
    ends = {(rng.randrange(n), rng.randrange(n)) for _ in range(3 * n)}
    ends = sorted((a, b) for a, b in ends if a != b)
    tail, head = (np.array([e[k] for e in ends], np.int64) for k in (0, 1))
    functions = [day(rng) for _ in ends]
    out = [[] for _ in range(n)]
    for place, (a, b) in enumerate(ends):
        out[a].append((b, 0, place))
    return rng, n, tail, head, functions, out


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("error", (1.0, 200.0))
def test_shortcuts_against_searches(seed, error):
    rng, n, tail, head, functions, out = world(seed)
    order = np.array(rng.sample(range(n), n))
    own = shortcuts.Shortcuts(hierarchy.Hierarchy(order, tail, head), tail, head, functions, P, error, most_points=4)
    step = lambda at, _, p: at + float(plf.evaluate(*functions[p], at, P))
    for s in range(n):
        for departure in (0.0, 30_000.0, 86_000.0):
            true = {v: at - departure for v, at, _ in search.settle(out, [(s, departure)], step)}
            for t in range(n):
                found = own.travel_time(s, t, departure)
                assert (found is None) == (t not in true)
                if found:
                    assert found[0] == pytest.approx(true[t], abs=1e-3)
                    at = departure
                    for p in found[1]:
                        at = step(at, 0, p)
                    assert at - departure == pytest.approx(found[0], abs=1e-6)
        for t in (0, 5, 9):
            f = own.profile(s, t)
            for departure in (0.0, 12_345.0, 50_000.0):
                true = {v: at - departure for v, at, _ in search.settle(out, [(s, departure)], step)}
                assert (f is None) == (t not in true)
                if f:
                    assert float(plf.evaluate(*f, departure, P)) == pytest.approx(true[t], abs=1e-3)
    one = own.unique_paths()
    for (a, b), arc in own.arcs.items():
        dep, tt = own.part(a, b, 0.0, P)
        low, high = (plf.evaluate(*f, dep, P) for f in (arc.known.low, arc.known.high))
        assert (low <= tt + 1e-3).all() and (tt <= high + 1e-3).all()
        cuts = own.switches(a, b)
        paths = {tuple(own.evaluate(a, b, t)[1]) for t in np.linspace(0, P - 1, 97)}
        assert len(paths) <= len(cuts) + 1
        if (a, b) in one:
            assert len(paths) == 1 and not cuts
    assert {(a, b) for a, b, _, _ in own.bounds()} == set(own.arcs)


def test_sources_wrap():
    rows = [(0.0, 4), (10.0, -2), (20.0, 7)]
    assert shortcuts.sources_for(rows, 5.0, 15.0, 24.0) == [(5.0, 10.0, 4), (10.0, 15.0, -2)]
    assert shortcuts.sources_for(rows, 22.0, 30.0, 24.0) == [(22.0, 24.0, 7), (24.0, 30.0, 4)]
    assert shortcuts.sources_for([(0.0, 1)], 3.0, 60.0, 24.0) == [(3.0, 60.0, 1)]
    assert shortcuts.combined([(0.0, 1), (5.0, 2)], [(0.0, 9)], [(0.0, True), (3.0, False), (8.0, True)]) == [(0.0, 1), (3.0, 9), (8.0, 2)]


def test_parts():
    own = bounded.Parts()
    assert own.missing(0.0, 10.0) == [(0.0, 10.0)] and own.periodic(10.0) is None
    own.insert((np.array([2.0, 4.0]), np.array([1.0, 3.0])))
    own.insert((np.array([6.0, 8.0]), np.array([5.0, 5.0])))
    assert own.missing(0.0, 10.0) == [(0.0, 2.0), (4.0, 6.0), (8.0, 10.0)] and own.missing(3.0, 7.0) == [(4.0, 6.0)]
    assert own.on(3.0, 7.0) is None and own.on(3.0, 4.0)[1].tolist() == [2.0, 3.0]
    own.insert((np.array([4.0, 6.0]), np.array([3.0, 5.0])))
    assert own.missing(2.0, 8.0) == [] and own.on(3.0, 7.0)[1].tolist() == [2.0, 5.0, 5.0]


@pytest.mark.parametrize("seed", range(6))
def test_fewest_points_against_enumeration(seed):
    rng = np.random.default_rng(seed)
    dep, tt = np.arange(8.0), rng.uniform(0, 4, 8)
    at, value = plf.fewest(dep, tt, 1.0)
    fits = lambda keep: np.abs(np.interp(dep, dep[keep], tt[keep]) - tt).max() <= 1.0 + 1e-12
    least = min(k for k in range(7) if any(fits([0, *c, 7]) for c in itertools.combinations(range(1, 7), k)))
    assert len(at) == least + 2 and fits(at.astype(int).tolist()) and (value == tt[at.astype(int)]).all()


@pytest.mark.parametrize("seed", range(4))
def test_chains_against_searches(seed):
    rng = random.Random(seed)
    n = 40
    ends = [(v, v + 1) for v in range(n - 1)] + [(rng.randrange(n), rng.randrange(n)) for _ in range(8)]
    ends += [(b, a) for a, b in ends if rng.random() < 0.7]
    tail, head = (np.array([e[k] for e in ends], np.int64) for k in (0, 1))
    g = search.Graph(tail, head, np.array([rng.randrange(1, 9) for _ in ends], np.int64), np.arange(len(ends)))
    out, branching = g.lists(), search.branching(g)
    assert 0 < sum(branching) < n
    for s in range(n):
        true = {v: d for v, d, _ in search.settle(out, [(s, 0)])}
        assert [search.chained(out, branching, s, t) for t in range(n)] == [true.get(t) for t in range(n)]

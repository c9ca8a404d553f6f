"""Registered queries against their SQL, and the new search kernels on small random graphs."""

import datetime
import glob
import random
from pathlib import Path

import duckdb
import numpy as np
import pytest

from arterial.operators import hierarchy, lazy, neighbours
from arterial.operators.search import Graph, settle
from arterial.plans import extended, queries, served, timed  # noqa: F401
from arterial.streaming import link_speed

SF = "/root/testdata/sf0.001"


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    text = lambda x: str(float(x)) if isinstance(x, int | float) and not isinstance(x, bool) else str(x)
    return sorted(tuple(text(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.ORACLE)[::3])
def test_query_equals_its_sql(spark, name):
    with duckdb.connect() as con:
        for p in glob.glob(f"{SF}/*.parquet"):
            con.execute(f"CREATE VIEW {Path(p).stem} AS SELECT * FROM '{p}'")
        found = con.execute(queries.ORACLE[name])
        columns = [d[0] for d in found.description]
        want = plain(found.fetchall(), columns)
    df = queries.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    assert plain(df.collect(), df.columns) == want


def random_graph(seed, n=40):
    rng = random.Random(seed)
    arcs = {(rng.randrange(n), rng.randrange(n)): rng.randrange(1, 30) for _ in range(3 * n)}
    arcs = {(a, b): w for (a, b), w in arcs.items() if a != b and a % 8 and b % 8}  # some nodes have no arcs
    tail, head = (np.array([a[k] for a in arcs], np.int64) for k in (0, 1))
    return Graph(tail, head, np.array(list(arcs.values()), np.int64), np.arange(len(arcs))), tail, head


@pytest.mark.parametrize("seed", range(4))
def test_lazy_distances_searches_and_cells(seed):
    g, tail, head = random_graph(seed)
    n = 40
    weight = np.array([g.weight[np.flatnonzero(g.arc == i)[0]] for i in range(len(tail))])
    rng = np.random.default_rng(seed)
    own = hierarchy.Hierarchy(rng.permutation(n), tail, head)
    weights = own.customize(tail, head, weight)
    out, back = g.lists(), g.transposed().lists()
    out += [[] for _ in range(n - len(out))]
    back += [[] for _ in range(n - len(back))]
    true = {s: {v: d for v, d, _ in settle(out, [(s, 0)])} for s in range(n)}
    ahead, behind = lazy.TargetDistances(own, weights), lazy.TargetDistances(own, weights, back=True)
    lower = hierarchy.lower_neighbours(own)
    cost = {(a, b): w for a, b, w in zip(tail.tolist(), head.tolist(), weight.tolist(), strict=True)}
    table = lazy.TableDistances(own, weights, [3, 5, 11])
    for t in range(0, n, 3):
        ahead.aim(t)
        for s in range(n):
            d = true[s].get(t)
            assert ahead(s) == d
            path = ahead.path(s, lower)
            assert (path is None) == (d is None)
            if path:
                assert (path[0], path[-1]) == (s, t) and sum(cost[x] for x in zip(path, path[1:], strict=False)) == d
            assert lazy.one_sided(out, s, t, ahead) == d
            assert lazy.permuted(ahead, list(range(n))[::-1])(n - 1 - s) == d
            if d is not None and d > 0:
                assert lazy.one_sided(out, s, t, ahead, cap=d - 1) is None
                assert lazy.two_sided(out, back, s, t, ahead, behind.aim(s), cap=d - 1) is None
                assert lazy.two_sided(out, back, s, t, ahead, behind.aim(s), cap=d) == d
            for how in ({}, {"symmetric": True}, {"alternate": True}):
                assert lazy.two_sided(out, back, s, t, ahead, behind.aim(s), **how) == d
    cells = neighbours.Cells(own, weights, list(range(0, n, 2)))
    for s in range(n):
        assert table(s) == [true[s].get(t) for t in (3, 5, 11)]
        assert cells.nearest(s, 5) == sorted((d, v) for v, d in true[s].items() if v % 2 == 0)[:5]


def test_windowed_speeds_on_a_stream(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1, 8)
    minutes = lambda m: at + datetime.timedelta(minutes=m)
    kind = "ts timestamp, arc_id long, speed double"
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    rows = [[(minutes(1), 7, 30.0), (minutes(2), 7, 50.0)], [(minutes(100), 7, 10.0)], [(minutes(3), 7, 90.0), (minutes(101), 7, 20.0)]]
    q = None
    for part in rows:
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if q is None:
            q = link_speed.windowed_speeds(stream).writeStream.outputMode("append").format("memory").queryName("windows").start()
        q.processAllAvailable()
    q.stop()
    # the first window closes once the watermark has passed it; the late row then counts nowhere
    assert [(r.n, r["mean"]) for r in spark.table("windows").collect()] == [(2, 40.0)]

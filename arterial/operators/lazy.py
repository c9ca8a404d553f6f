"""Goal-directed search with exact distances of a hierarchy as potentials, found only where a search asks for them.

A potential is a callable of a node that gives a lower bound of the distance to the target, None where there is no path. Here
the distance of a node is the least over its upward arcs, remembered for every rank on the way, so a search pays for the
part of the hierarchy above the nodes that it meets.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import INFINITY
from . import cells
from .hierarchy import Hierarchy, unpack
from .search import Graph, _dealt, by_cells, collect, settle

Potential = Callable[[int], "int | None"]


class TargetDistances:
    """Distances to one target (or with ``back`` from one source), by node. Unchanged for an equal target."""

    def __init__(self, own: Hierarchy, weights: tuple[list[dict[int, int]], list[dict[int, int]]], back: bool = False):
        self.own, self.weights = own, weights
        self.up, self.down = weights[::-1] if back else weights
        self.target: int | None = None

    def aim(self, target: int) -> TargetDistances:
        if target == self.target:
            return self
        self.target = target
        rank = int(self.own.rank[target])
        self.known: dict[int, int] = {}
        #: The next rank on the way of each rank that goes up first.
        self.next: dict[int, int] = {}
        self.below: dict[int, tuple[int, int]] = {rank: (0, -1)}
        at = rank
        while at >= 0:
            d = self.below.get(at)
            if d is not None:
                for b, w in self.down[at].items():
                    if w < INFINITY and d[0] + w < self.below.get(b, (INFINITY,))[0]:
                        self.below[b] = (d[0] + w, at)
            at = int(self.own.parent[at])
        return self

    def of_rank(self, rank: int) -> int:
        chain = []
        at = rank
        while at >= 0 and at not in self.known:
            chain.append(at)
            at = int(self.own.parent[at])
        for v in reversed(chain):
            best = self.below.get(v, (INFINITY,))[0]
            for b, w in self.up[v].items():
                if w + self.known[b] < best:
                    best = w + self.known[b]
                    self.next[v] = b
            self.known[v] = best
        return self.known[rank]

    def __call__(self, node: int) -> int | None:
        d = self.of_rank(int(self.own.rank[node]))
        return d if d < INFINITY else None

    def path(self, node: int, lower: list[list[int]]) -> list[int] | None:
        """The nodes of a shortest path to the target; only of a search that isn't turned round."""
        if self(node) is None:
            return None
        at = int(self.own.rank[node])
        chain = [at]
        while at in self.next and self.known[at] < self.below.get(at, (INFINITY,))[0]:
            at = self.next[at]
            chain.append(at)
        while self.below[at][1] >= 0:
            at = self.below[at][1]
            chain.append(at)
        ranks = [chain[0]]
        for a, b in zip(chain, chain[1:], strict=False):
            ranks += unpack(self.weights, lower, a, b)[1:]
        return self.own.order[ranks].tolist()


class TableDistances:
    """Distances from any node to many targets at once, from the targets' entries in a bucket for each rank."""

    def __init__(self, own: Hierarchy, weights: tuple[list[dict[int, int]], list[dict[int, int]]], targets: list[int]):
        self.own, self.up = own, weights[0]
        self.targets = targets
        self.buckets: dict[int, list[tuple[int, int]]] = {}
        for i, t in enumerate(targets):
            for hub, d in own.label(weights[1], int(own.rank[t])):
                self.buckets.setdefault(hub, []).append((i, d))

    def __call__(self, node: int) -> list[int | None]:
        best: list[int | None] = [None] * len(self.targets)
        for hub, d in self.own.label(self.up, int(self.own.rank[node])):
            for i, e in self.buckets.get(hub, ()):
                if best[i] is None or d + e < best[i]:
                    best[i] = d + e
        return best


def permuted(potential: Potential, original: list[int]) -> Potential:
    """The potential for a graph whose node i is ``original[i]``."""
    return lambda node: potential(original[node])


def one_sided(out: list, source: int, target: int, potential: Potential, cap: int | None = None) -> int | None:
    """A* distance; with ``cap`` only one of at most that."""
    least = potential(source)
    if least is None or (cap is not None and least > cap):
        return None
    for node, d, _ in settle(out, [(source, 0)], potential=potential):
        if node == target:
            return d if cap is None or d <= cap else None
    return None


def two_sided(
    out: list, back: list, source: int, target: int, ahead: Potential, behind: Potential, symmetric: bool = False, alternate: bool = False, cap: int | None = None, starts: dict[int, int] | None = None
) -> int | None:
    """Distance by two searches. ``ahead`` bounds the way to the target, ``behind`` the way from the source.

    By default both searches use half the difference of the two (costs are doubled, so it stays whole) and stop when
    their keys add up to the best meeting. ``symmetric``: each uses its own and the search stops once a side's key reaches
    the best. ``alternate``: sides take turns instead of the smaller key. Nodes whose bounds exceed the best or ``cap`` are left out.
    ``starts``: nodes that the search from the source has reached already, with their distances; not the target.
    """
    if source == target:
        return 0
    graphs, dist = (out, back), (dict(starts) if starts else {source: 0}, {target: 0})
    best = None if cap is None else cap + 1
    low: dict[int, tuple[int, int] | None] = {}

    def both(v: int) -> tuple[int, int] | None:
        if v not in low:
            a, b = ahead(v), behind(v)
            low[v] = None if a is None or b is None else (a, b)
        return low[v]

    def key(side: int, v: int, d: int) -> int | None:
        p = both(v)
        if p is None or (best is not None and p[0] + p[1] >= best):
            return None
        return d + p[side] if symmetric else 2 * d + (p[0] - p[1]) * (1 - 2 * side)

    queues: tuple[list, list] = ([], [])
    for side, labels in enumerate(dist):
        for v, d in labels.items():
            k = key(side, v, d)
            if k is not None:
                queues[side].append((k, v, d))
        if not queues[side]:
            return None
        heapq.heapify(queues[side])
    turn = 0
    found = False
    while queues[0] and queues[1]:
        if best is not None:
            ks = queues[0][0][0], queues[1][0][0]
            if (max(ks) >= best) if symmetric else (sum(ks) >= 2 * best):
                break
        turn = 1 - turn if alternate else int(queues[1][0] < queues[0][0])
        _, v, d = heapq.heappop(queues[turn])
        if d > dist[turn][v]:
            continue
        for head, weight, _ in graphs[turn][v] if v < len(graphs[turn]) else ():
            t = d + weight
            if t < dist[turn].get(head, t + 1):
                k = key(turn, head, t)
                if k is None:
                    continue
                dist[turn][head] = t
                heapq.heappush(queues[turn], (k, head, t))
                if head in dist[1 - turn] and (best is None or t + dist[1 - turn][head] < best):
                    best, found = t + dist[1 - turn][head], True
    return best if found else None


def distances(arcs: DataFrame, own: Hierarchy, weights: tuple[list, list], trips: DataFrame, how: str = "one_sided", bounds: tuple[list, list] | None = None) -> DataFrame:
    """``trips(qid, source, target)`` with ``dist``. ``how``: one_sided, average, symmetric or alternate.

    ``weights``: a metric of the hierarchy below or equal to that of ``arcs`` (a lower bound for it), so one customization
    serves many metrics. Trips come sorted by target, for which potentials are kept.
    """
    graph: Graph = collect(arcs)
    shared = arcs.sparkSession.sparkContext.broadcast((graph, own, bounds or weights))

    def work(frames):
        g, h, w = shared.value
        out, back = g.lists(), g.transposed().lists()
        ahead, behind = TargetDistances(h, w), TargetDistances(h, w, back=True)
        for frame in frames:
            found = []
            for s, t in zip(frame["source"].tolist(), frame["target"].tolist(), strict=True):
                if how == "one_sided":
                    found.append(one_sided(out, s, t, ahead.aim(t)))
                else:
                    found.append(two_sided(out, back, s, t, ahead.aim(t), behind.aim(s), symmetric=how == "symmetric", alternate=how == "alternate"))
            yield frame.assign(dist=pd.array(found, "Int64"))

    dealt = _dealt(trips.select("qid", "source", "target")).sortWithinPartitions("target", "source")
    return dealt.mapInPandas(work, "qid long, source long, target long, dist long")


def _useful(own: cells.Cells, trips: DataFrame) -> DataFrame | None:
    """``source, node, behind, at``: nodes on shortest paths of ``trips``, their distance from the source and what a label may be there at most; None without any.

    The latter is the greatest over the source's targets of their distance less the rest of the way. Both come from sweeps through
    the hierarchy's cells for all sources at once. The driver sees the sources.
    """
    store = own.store
    sources = sorted(r[0] for r in trips.select("source").distinct().collect())
    if not sources:
        return None
    names = trips.sparkSession.createDataFrame(list(enumerate(sources)), "place int, source long")
    ranks = own.order.select("node", "rank")
    starts = names.join(ranks.withColumnRenamed("node", "source"), "source").selectExpr("rank", "place", "0L AS dist")
    behind = cells.swept(own, starts, len(sources), "up", "down")
    ends = trips.select("source", "target").distinct().join(names, "source").join(ranks.withColumnRenamed("node", "target"), "target").join(behind, "rank")
    ends = store(ends.select("rank", "place", F.expr("d[place]").alias("dist")).where(F.col("dist") < INFINITY))
    far = ends.agg(F.max("dist")).first()[0]
    if far is None:
        return None
    ahead = cells.swept(own, ends.select("rank", "place", (F.lit(far) - F.col("dist")).alias("dist")), len(sources), "down", "up")
    both = behind.join(ahead.withColumnRenamed("d", "e"), "rank").select("rank", F.posexplode(F.arrays_zip("d", "e")).alias("place", "x"))
    useful = store(both.where(f"x.d + x.e <= {far}").select("rank", "place", F.col("x.d").alias("behind"), (F.lit(far) - F.col("x.e")).alias("at")))
    return useful.join(names, "place").join(ranks, "rank").select("source", "node", "behind", "at")


def distances_in_cells(arcs: DataFrame, own: cells.Cells, trips: DataFrame, size: int = 50_000) -> DataFrame:
    """``trips(qid, source, target)`` with ``dist``: one-sided search with potentials, where no memory holds the graph.

    All targets of a source share a search. Its potential at a node is the least over them of the distance to the target less that
    from the source: on a shortest path to any of them it is less than nothing by the way so far. A label goes on only where it
    and the potential don't exceed nothing, and nodes whose two bounds do are left out.
    """
    useful = _useful(own, trips)
    if useful is None:
        return trips.selectExpr("qid", "source", "target", "CAST(NULL AS long) AS dist")
    limits = useful.select("source", F.lit(0).cast("long").alias("departure"), "node", "at")
    begin = trips.select("source").distinct().selectExpr("source", "0L AS departure")
    found = by_cells(arcs.select("tail", "head", "weight"), begin, lambda _: lambda d, w, p: d + w, own.store, size, parts=6, limits=limits)
    return trips.select("qid", "source", "target").join(found.selectExpr("source", "node AS target", "at AS dist"), ["source", "target"], "left").select("qid", "source", "target", "dist")


def two_sided_in_cells(arcs: DataFrame, own: cells.Cells, trips: DataFrame, how: str, size: int = 50_000, block: int = 2_000) -> DataFrame:
    """``trips(qid, source, target)`` with ``dist`` by :func:`two_sided` (``how``: average, symmetric or alternate), where no memory holds the graph.

    Trips of a source share its side, with the bounds of :func:`distances_in_cells`, up to the block of ``block`` neighbouring ids in which the
    target lies; there the side goes on for each trip, and the target's comes to meet it. The source's side searches all cells of ``size``
    ids at once, as the distances that the sweeps gave for nodes behind a border start there too.
    """
    store = own.store
    useful = _useful(own, trips)
    if useful is None:
        return trips.selectExpr("qid", "source", "target", "CAST(NULL AS long) AS dist")
    useful, arcs = store(useful), store(arcs.select("tail", "head", "weight"))
    behind_borders = arcs.where(f"tail div {size} <> head div {size}").select(F.col("head").alias("node")).distinct()
    begin = trips.selectExpr("source", "0L AS departure", "source AS node", "0L AS at").union(useful.join(behind_borders, "node").selectExpr("source", "0L", "node", "behind"))
    limits = useful.selectExpr("source", "0L AS departure", "node", "at")
    found = by_cells(arcs, begin, lambda _: lambda d, w, p: d + w, store, size, parts=6, limits=limits).selectExpr("source", "node", "at AS label")

    near = arcs.withColumn("block", F.expr(f"head div {block}"))
    pairs = store(trips.selectExpr("source", "target AS node", f"target div {block} AS block").distinct())
    # the nodes of a block and those from which an arc leads into it
    places = near.selectExpr("tail AS node", "block").union(near.selectExpr("head AS node", "block")).union(pairs.select("node", "block")).distinct()
    known = useful.join(found, ["source", "node"]).join(places, "node").join(pairs.select("source", "block").distinct(), ["source", "block"])
    columns = ["block", "source", "node", "behind", "at", "label"]
    rows = store(known.select(*columns).union(pairs.selectExpr("block", "source", "node", "-1L", "-1L", "-1L")))

    def work(key, frame: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        ids, at = np.unique(np.concatenate([frame["tail"].to_numpy(np.int64), frame["head"].to_numpy(np.int64), rows["node"].to_numpy(np.int64)]), return_inverse=True)
        tails, heads, nodes = np.split(at, [len(frame), 2 * len(frame)])
        out: list[list] = [[] for _ in ids]
        back: list[list] = [[] for _ in ids]
        for place, (a, b, w) in enumerate(zip(tails.tolist(), heads.tolist(), frame["weight"].tolist(), strict=True)):
            out[a].append((b, w, place))
            back[b].append((a, w, place))
        inside = (ids // block == int(key[0])).tolist()
        made = []
        for source, part in rows.assign(node=nodes).groupby("source"):
            is_trip = part["label"] < 0
            behind, at, label = (dict(zip(part["node"][~is_trip].tolist(), part[c][~is_trip].tolist(), strict=True)) for c in ("behind", "at", "label"))
            starts = {v: d for v, d in label.items() if not inside[v] or ids[v] == source}
            for t in part["node"][is_trip].tolist():
                whole = behind.get(t)
                if ids[t] == source:
                    made.append((source, ids[t], 0))
                elif whole is not None and starts:
                    ahead = lambda v, whole=whole: whole - at[v] if v in at else None
                    d = two_sided(out, back, -1, t, ahead, behind.get, symmetric=how == "symmetric", alternate=how == "alternate", starts=starts)
                    if d is not None:
                        made.append((source, ids[t], d))
        return pd.DataFrame(made, columns=["source", "target", "dist"], dtype="int64")

    met = near.groupBy("block").cogroup(rows.groupBy("block")).applyInPandas(work, "source long, target long, dist long")
    return trips.select("qid", "source", "target").join(met, ["source", "target"], "left").select("qid", "source", "target", "dist")


def target_trees(spark, own: Hierarchy, weights: tuple[list, list], targets: DataFrame) -> DataFrame:
    """``target, node, dist`` of all nodes with a path to each of ``targets(target)``."""
    shared = spark.sparkContext.broadcast((own, weights))

    def work(frames):
        h, w = shared.value
        to = TargetDistances(h, w)
        for frame in frames:
            for t in frame["target"].tolist():
                to.aim(t)
                rows = [(t, v, d) for v in h.order.tolist() if (d := to(v)) is not None]
                yield pd.DataFrame(rows, columns=["target", "node", "dist"]).astype("int64")

    return _dealt(targets.select("target").distinct()).mapInPandas(work, "target long, node long, dist long")


def unpacked_paths(spark, own: Hierarchy, weights: tuple[list, list], lower: list[list[int]], trips: DataFrame) -> DataFrame:
    """``qid, path`` (nodes) of ``trips(qid, source, target)`` from the distances to the target."""
    shared = spark.sparkContext.broadcast((own, weights, lower))

    def work(frames):
        h, w, below = shared.value
        to = TargetDistances(h, w)
        for frame in frames:
            rows = []
            for q, s, t in zip(frame["qid"].tolist(), frame["source"].tolist(), frame["target"].tolist(), strict=True):
                path = to.aim(t).path(s, below)
                if path:
                    rows.append((q, path))
            yield pd.DataFrame(rows, columns=["qid", "path"])

    return trips.select("qid", "source", "target").mapInPandas(work, "qid long, path array<long>")


def tables(spark, own: Hierarchy, weights: tuple[list, list], sources: DataFrame, targets: list[int]) -> DataFrame:
    """``source, target, dist`` between ``sources(source)`` and a list of targets."""
    shared = spark.sparkContext.broadcast(TableDistances(own, weights, targets))

    def work(frames):
        table = shared.value
        for frame in frames:
            rows = [(s, t, d) for s in frame["source"].tolist() for t, d in zip(table.targets, table(s), strict=True) if d is not None]
            yield pd.DataFrame(rows, columns=["source", "target", "dist"]).astype("int64")

    return sources.select("source").distinct().mapInPandas(work, "source long, target long, dist long")

"""Customizable contraction hierarchies as tables: order, chordal arcs, customized weights, labels, and the label join."""

from __future__ import annotations

from collections import OrderedDict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import INFINITY


def dissection_order(x: np.ndarray, y: np.ndarray, tail: np.ndarray, head: np.ndarray) -> np.ndarray:
    """Nodes by rank: halves along the wider axis, the nodes of the lower half that touch the upper one last."""
    out_first: dict[int, list[int]] = {}
    for a, b in zip(np.concatenate([tail, head]).tolist(), np.concatenate([head, tail]).tolist(), strict=True):
        out_first.setdefault(a, []).append(b)
    order: list[int] = []
    stack: list[tuple[str, list[int]]] = [("split", list(range(len(x))))]
    while stack:
        what, own = stack.pop()
        if what == "emit" or len(own) <= 3:
            order.extend(own)
            continue
        members = np.array(own)
        axis = x if np.ptp(x[members]) >= np.ptp(y[members]) else y
        half = np.argsort(axis[members], kind="stable")
        low, high = members[half[: len(own) // 2]].tolist(), set(members[half[len(own) // 2 :]].tolist())
        between = [v for v in low if any(w in high for w in out_first.get(v, ()))]
        cut = set(between)
        stack += [("emit", between), ("split", sorted(high)), ("split", [v for v in low if v not in cut])]
    return np.array(order, np.int64)


class Hierarchy:
    """Chordal arcs between ranks, smaller end first: ``upper[v]`` lists the higher neighbours of v, rising."""

    def __init__(self, order: np.ndarray, tail: np.ndarray, head: np.ndarray):
        n = len(order)
        self.order = order
        self.rank = np.empty(n, np.int64)
        self.rank[order] = np.arange(n)
        above: list[set[int]] = [set() for _ in range(n)]
        for a, b in zip(self.rank[tail].tolist(), self.rank[head].tolist(), strict=True):
            if a != b:
                above[min(a, b)].add(max(a, b))
        for v in range(n):
            if above[v]:
                low = min(above[v])
                above[low] |= above[v] - {low}
        self.upper = [sorted(s) for s in above]
        self.parent = np.array([u[0] if u else -1 for u in self.upper], np.int64)

    def customize(self, tail: np.ndarray, head: np.ndarray, weight: np.ndarray) -> tuple[list[dict[int, int]], list[dict[int, int]]]:
        """Weights upward and downward: the least over all paths through lower nodes."""
        n = len(self.order)
        up: list[dict[int, int]] = [dict.fromkeys(u, INFINITY) for u in self.upper]
        down: list[dict[int, int]] = [dict.fromkeys(u, INFINITY) for u in self.upper]
        for a, b, w in zip(self.rank[tail].tolist(), self.rank[head].tolist(), weight.tolist(), strict=True):
            if a < b:
                up[a][b] = min(up[a][b], w)
            elif b < a:
                down[b][a] = min(down[b][a], w)
        for v in range(n):
            u = self.upper[v]
            for i, a in enumerate(u):
                to_v, from_v = down[v][a], up[v][a]
                for b in u[i + 1 :]:
                    s, t = to_v + up[v][b], down[v][b] + from_v
                    if s < up[a][b]:
                        up[a][b] = s
                    if t < down[a][b]:
                        down[a][b] = t
        return up, down

    def perfect(self, up: list[dict[int, int]], down: list[dict[int, int]]) -> tuple[list[dict[int, int]], list[dict[int, int]]]:
        """Weights made shortest distances from the top on, and only the arcs that didn't improve by it."""
        new_up, new_down = [dict(x) for x in up], [dict(x) for x in down]
        for v in range(len(self.order) - 1, -1, -1):
            u = self.upper[v]
            for i, a in enumerate(u):
                for b in u[i + 1 :]:
                    ab, ba = new_up[a][b], new_down[a][b]
                    new_up[v][b] = min(new_up[v][b], new_up[v][a] + ab)
                    new_up[v][a] = min(new_up[v][a], new_up[v][b] + ba)
                    new_down[v][b] = min(new_down[v][b], ba + new_down[v][a])
                    new_down[v][a] = min(new_down[v][a], ab + new_down[v][b])
        keep = lambda new, old: [{b: w for b, w in x.items() if w == o[b] and w < INFINITY} for x, o in zip(new, old, strict=True)]
        return keep(new_up, up), keep(new_down, down)

    def label(self, weights: list[dict[int, int]], v: int) -> list[tuple[int, int]]:
        """(rank of the hub, distance) over the ancestors of rank ``v``."""
        dist = {v: 0}
        at = v
        while at >= 0:
            d = dist.get(at)
            if d is not None:
                for b, w in weights[at].items():
                    if w < INFINITY and d + w < dist.get(b, d + w + 1):
                        dist[b] = d + w
            at = int(self.parent[at])
        return sorted(dist.items())


#: Arcs that the driver contracts at most: about a kilobyte each, with their chordal arcs.
MOST_ARCS = 5_000_000
#: Hierarchies and metrics of the last graphs, by what they hold: a query on a known graph builds nothing.
_KNOWN: OrderedDict[tuple, tuple] = OrderedDict()
_KEPT = 4


def remembered(key: tuple, make):
    if key not in _KNOWN:
        _KNOWN[key] = make()
        while len(_KNOWN) > 2 * _KEPT:
            _KNOWN.popitem(last=False)
    _KNOWN.move_to_end(key)
    return _KNOWN[key]


def contents(rows: DataFrame, *columns: str) -> tuple:
    """Number of rows and an order-free digest of the columns: 128 bits in two sums."""
    h1, h2 = F.xxhash64(*columns), F.xxhash64(*columns, F.lit(1))
    wide = lambda h: F.sum(h.cast("decimal(20,0)")).cast("string")
    return (*columns, *rows.agg(F.count(F.lit(1)), wide(h1), wide(h2)).first())


def build(arcs: DataFrame, nodes: DataFrame, order: DataFrame | None = None) -> tuple[Hierarchy, tuple[list, list]]:
    """Order, contraction and customization on the driver: they are sequential, and as small as the graph.

    ``order(node, rank)`` is taken as it is; without it nodes are dissected by their coordinates. Contraction depends on the arcs' ends alone, so another metric on known arcs is only customized.
    """
    shape = (contents(arcs, "tail", "head"), contents(nodes, "node", "x", "y") if order is None else contents(order, "node", "rank"))
    if shape[0][2] > MOST_ARCS:
        raise ValueError(f"{shape[0][2]} arcs are too many for the driver's contraction")
    metric = contents(arcs, "tail", "head", "weight")

    def collected():
        p = arcs.select("tail", "head", "weight").toPandas()
        return [p[c].to_numpy(np.int64) for c in ("tail", "head", "weight")]

    def contracted() -> Hierarchy:
        tail, head, _ = collected()
        if order is not None:
            return Hierarchy(order.orderBy("rank").select("node").toPandas()["node"].to_numpy(np.int64), tail, head)
        q = nodes.select("node", "x", "y").orderBy("node").toPandas()
        return Hierarchy(dissection_order(q["x"].to_numpy(float), q["y"].to_numpy(float), tail, head), tail, head)

    own = remembered(shape, contracted)
    return own, remembered((shape, metric), lambda: own.customize(*collected()))


def chordal_arcs(spark: SparkSession, own: Hierarchy, weights: tuple[list, list]) -> DataFrame:
    """``tail, head, up, down``: chordal arcs between ranks with both weights (null: infinite)."""
    up, down = weights
    rows = [(v, b, up[v][b], down[v][b]) for v in range(len(own.order)) for b in own.upper[v]]
    p = pd.DataFrame(rows, columns=["tail", "head", "up", "down"], dtype="int64")
    return spark.createDataFrame(p).selectExpr("tail", "head", f"nullif(up, {INFINITY}) AS up", f"nullif(down, {INFINITY}) AS down")


def elimination_tree(chordal: DataFrame) -> DataFrame:
    """``node, parent``: the lowest upper neighbour."""
    return chordal.groupBy(F.col("tail").alias("node")).agg(F.min("head").alias("parent"))


def labels(spark: SparkSession, own: Hierarchy, weights: list, nodes: DataFrame) -> DataFrame:
    """``node, hub, dist`` for ``nodes(node)``, by a walk over the ancestors in each task."""
    shared = spark.sparkContext.broadcast((own, weights))

    def work(frames):
        h, w = shared.value
        for frame in frames:
            rows = [(v, hub, d) for v in frame["node"].tolist() for hub, d in h.label(w, int(h.rank[v]))]
            yield pd.DataFrame(rows, columns=["node", "hub", "dist"]).astype("int64")

    return nodes.select("node").distinct().mapInPandas(work, "node long, hub long, dist long")


def label_distances(trips: DataFrame, out_labels: DataFrame, in_labels: DataFrame) -> DataFrame:
    """``trips`` with ``dist``: the least sum over common hubs, the lowest hub among the best. A join and a minimum."""
    a = out_labels.select(F.col("node").alias("source"), "hub", F.col("dist").alias("d1"))
    b = in_labels.select(F.col("node").alias("target"), "hub", F.col("dist").alias("d2"))
    pairs = trips.select("source", "target").distinct()
    met = pairs.join(a, "source").join(b, ["target", "hub"]).groupBy("source", "target")
    best = met.agg(F.min(F.struct((F.col("d1") + F.col("d2")).alias("dist"), "hub")).alias("m")).select("source", "target", "m.dist", "m.hub")
    return trips.join(best, ["source", "target"], "left")


def lower_neighbours(own: Hierarchy) -> list[list[int]]:
    out: list[list[int]] = [[] for _ in own.upper]
    for v, u in enumerate(own.upper):
        for a in u:
            out[a].append(v)
    return out


def unpack(weights: tuple[list[dict[int, int]], list[dict[int, int]]], lower: list[list[int]], a: int, b: int) -> list[int]:
    """Ranks on the path that a customized arc stands for: below it lies the triangle whose sides sum up to its weight, or nothing."""
    up, down = weights
    out, stack = [a], [(a, b)]
    while stack:
        x, y = stack.pop()
        low, high = min(x, y), max(x, y)
        w = up[low][high] if x < y else down[low][high]
        via = next((v for v in lower[low] if high in up[v] and down[v].get(x, INFINITY) + up[v].get(y, INFINITY) == w), None)
        if via is None:
            out.append(y)
        else:
            stack += [(via, y), (x, via)]
    return out


def _tree(own: Hierarchy, weights: list[dict[int, int]], v: int) -> dict[int, tuple[int, int]]:
    """(distance, rank before) of the ancestors of ``v``."""
    dist = {v: (0, -1)}
    at = v
    while at >= 0:
        if at in dist:
            d = dist[at][0]
            for b, w in weights[at].items():
                if w < INFINITY and (b not in dist or d + w < dist[b][0]):
                    dist[b] = (d + w, at)
        at = int(own.parent[at])
    return dist


def shortest_path(own: Hierarchy, weights: tuple[list, list], lower: list[list[int]], source: int, target: int) -> tuple[int, list[int]] | None:
    """(distance, nodes): both ancestor walks meet at the best hub, then arcs are unpacked."""
    fw, bw = (_tree(own, w, int(own.rank[v])) for w, v in zip(weights, (source, target), strict=True))
    hub = min(fw.keys() & bw.keys(), key=lambda h: (fw[h][0] + bw[h][0], h), default=None)
    if hub is None:
        return None
    chain = [hub]
    while fw[chain[0]][1] >= 0:
        chain.insert(0, fw[chain[0]][1])
    while bw[chain[-1]][1] >= 0:
        chain.append(bw[chain[-1]][1])
    path = [chain[0]]
    for a, b in zip(chain, chain[1:], strict=False):
        path += unpack(weights, lower, a, b)[1:]
    return fw[hub][0] + bw[hub][0], own.order[path].tolist()


def paths(spark: SparkSession, own: Hierarchy, weights: tuple[list, list], trips: DataFrame) -> DataFrame:
    """``qid, dist, path`` for ``trips(qid, source, target)``; trips without a path give no row."""
    shared = spark.sparkContext.broadcast((own, weights, lower_neighbours(own)))

    def work(frames):
        h, w, lower = shared.value
        for frame in frames:
            rows = []
            for q, s, t in zip(frame["qid"].tolist(), frame["source"].tolist(), frame["target"].tolist(), strict=True):
                found = shortest_path(h, w, lower, s, t)
                if found:
                    rows.append((q, *found))
            yield pd.DataFrame(rows, columns=["qid", "dist", "path"])

    return trips.select("qid", "source", "target").mapInPandas(work, "qid long, dist long, path array<long>")


def customize_directed(own: Hierarchy, kept: tuple[list[set[int]], list[set[int]]], tail: np.ndarray, head: np.ndarray, weight: np.ndarray):
    """Like :meth:`Hierarchy.customize` on arc sets that differ by direction (``finite_arcs``)."""
    up, down = ([dict.fromkeys(sorted(s), INFINITY) for s in side] for side in kept)
    for a, b, w in zip(own.rank[tail].tolist(), own.rank[head].tolist(), weight.tolist(), strict=True):
        side, low, high = (up, a, b) if a < b else (down, b, a)
        if high in side[low]:
            side[low][high] = min(side[low][high], w)
    for v in range(len(own.order)):
        for a, w in down[v].items():
            for b, x in up[v].items():
                side, low, high = (up, a, b) if a < b else (down, b, a)
                if a != b and w + x < side[low].get(high, 0):
                    side[low][high] = w + x
    return up, down


def finite_arcs(metrics: list[tuple[list[dict[int, int]], list[dict[int, int]]]]) -> tuple[list[set[int]], list[set[int]]]:
    """Upward and downward arcs that some customized metric makes finite; all others can go, each direction by itself."""
    sides = zip(*metrics, strict=True)
    up, down = ([{b for w in ws for b, x in w.items() if x < INFINITY} for ws in zip(*side, strict=True)] for side in sides)
    return up, down


def customize_valid(own: Hierarchy, tail: np.ndarray, head: np.ndarray, weight: np.ndarray, since: np.ndarray):
    """Upward and downward (weight, valid from) of each arc: the least weight, and the latest ``since`` on its path (the earliest among equals)."""
    none = (INFINITY, 0)
    up, down = ([dict.fromkeys(u, none) for u in own.upper] for _ in range(2))

    def put(a: int, b: int, x: tuple[int, int]) -> None:
        side, low, high = (up, a, b) if a < b else (down, b, a)
        if a != b and x[0] < INFINITY:
            side[low][high] = min(side[low][high], x)

    for a, b, w, s in zip(own.rank[tail].tolist(), own.rank[head].tolist(), weight.tolist(), since.tolist(), strict=True):
        put(a, b, (w, s))
    for v, u in enumerate(own.upper):
        for a in u:
            for b in u:
                x, y = down[v][a], up[v][b]
                put(a, b, (x[0] + y[0], max(x[1], y[1])))
    return up, down


def separator_cells(own: Hierarchy) -> list[tuple[int, int, int]]:
    """(node, cell, level): chains of the elimination tree, named by their top rank; roots have level 0."""
    children = np.bincount(own.parent[own.parent >= 0], minlength=len(own.parent))
    cell, level = [0] * len(own.parent), [0] * len(own.parent)
    for v in range(len(own.parent) - 1, -1, -1):
        p = int(own.parent[v])
        cell[v], level[v] = (v, 0) if p < 0 else (cell[p], level[p]) if children[p] == 1 else (v, level[p] + 1)
    return [(int(own.order[v]), cell[v], level[v]) for v in range(len(own.parent))]


def depth_first_order(own: Hierarchy) -> np.ndarray:
    """An order with the same chordal arcs in which each subtree of the elimination tree is in one piece, its root last."""
    below: list[list[int]] = [[] for _ in own.parent]
    stack = []
    for v, p in enumerate(own.parent.tolist()):
        (below[p] if p >= 0 else stack).append(v)
    out = []
    while stack:
        v = stack.pop()
        out.append(v)
        stack += below[v]
    return own.order[out[::-1]]


def original_arcs(chordal: DataFrame, arcs: DataFrame, order: DataFrame) -> DataFrame:
    """``tail, head, up, arc_id``: the arcs (both directions, parallel ones too) on each of ``chordal(tail, head)`` between ranks."""
    ranked = arcs.select("arc_id", F.col("tail").alias("from"), F.col("head").alias("to"))
    a = order.select(F.col("node").alias("from"), F.col("rank").alias("a"))
    b = order.select(F.col("node").alias("to"), F.col("rank").alias("b"))
    own = ranked.join(a, "from").join(b, "to").select("arc_id", F.least("a", "b").alias("tail"), F.greatest("a", "b").alias("head"), (F.col("a") < F.col("b")).alias("up"))
    return chordal.select("tail", "head").join(own, ["tail", "head"]).select("tail", "head", "up", "arc_id")


def respecting(chordal: DataFrame, mapping: DataFrame, weights: DataFrame) -> DataFrame:
    """``tail, head, up, down``: the least weight of the original arcs of each chordal arc, null without one."""
    w = mapping.join(weights.select("arc_id", "weight"), "arc_id").groupBy("tail", "head")
    least = w.agg(F.min(F.when(F.col("up"), F.col("weight"))).alias("up"), F.min(F.when(~F.col("up"), F.col("weight"))).alias("down"))
    return chordal.select("tail", "head").join(least, ["tail", "head"], "left")


def top_ranks(own: Hierarchy, most: int) -> tuple[set[int], dict[int, int]]:
    """The ranks above all cells, and the cell (its top rank) of every other: cells are maximal subtrees of at most ``most`` nodes."""
    n = len(own.parent)
    size = [1] * n
    for v in range(n):
        p = int(own.parent[v])
        if p >= 0:
            size[p] += size[v]
    top = {v for v in range(n) if size[v] > most}
    cell: dict[int, int] = {}
    for v in range(n - 1, -1, -1):
        if v not in top:
            p = int(own.parent[v])
            cell[v] = v if p < 0 or p in top else cell[p]
    return top, cell


def customize_in_cells(arcs: DataFrame, own: Hierarchy, most: int = 500) -> tuple[list[dict[int, int]], list[dict[int, int]]]:
    """:meth:`Hierarchy.customize` with one task for each cell; the driver does the separators above them.

    A cell's triangles change arcs inside it and among the separators, of which each task returns its own minimum.
    """
    spark = arcs.sparkSession
    top, cell = top_ranks(own, most)
    names = spark.createDataFrame([(int(own.order[v]), v, cell.get(v, -1)) for v in range(len(own.order))], "node long, rank long, cell long")
    a = names.select(F.col("node").alias("tail"), F.col("rank").alias("a"), F.col("cell").alias("cell_a"))
    b = names.select(F.col("node").alias("head"), F.col("rank").alias("b"), F.col("cell").alias("cell_b"))
    placed = arcs.join(a, "tail").join(b, "head").where("a <> b")
    placed = placed.select("a", "b", "weight", F.when(F.col("a") < F.col("b"), F.col("cell_a")).otherwise(F.col("cell_b")).alias("cell"))
    shared = spark.sparkContext.broadcast(own)

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        h = shared.value
        weight: dict[tuple[int, int], int] = {}
        for x, y, w in zip(frame["a"].tolist(), frame["b"].tolist(), frame["weight"].tolist(), strict=True):
            weight[x, y] = min(w, weight.get((x, y), w))
        name = int(frame["cell"].iloc[0])
        if name >= 0:
            own_ranks = [name]
            children: dict[int, list[int]] = {}
            for v in range(name):
                children.setdefault(int(h.parent[v]), []).append(v)
            for v in own_ranks:
                own_ranks.extend(children.get(v, ()))
            for v in sorted(own_ranks):
                for x in h.upper[v]:
                    to_v = weight.get((x, v))
                    if to_v is None:
                        continue
                    for y in h.upper[v]:
                        from_v = weight.get((v, y))
                        if x != y and from_v is not None and to_v + from_v < weight.get((x, y), to_v + from_v + 1):
                            weight[x, y] = to_v + from_v
        rows = [(x, y, w) for (x, y), w in weight.items()]
        return pd.DataFrame(rows, columns=["a", "b", "weight"]).astype("int64")

    found = placed.groupBy("cell").applyInPandas(work, "a long, b long, weight long").groupBy("a", "b").agg(F.min("weight").alias("weight"))
    up: list[dict[int, int]] = [dict.fromkeys(u, INFINITY) for u in own.upper]
    down: list[dict[int, int]] = [dict.fromkeys(u, INFINITY) for u in own.upper]
    for x, y, w in found.collect():  # as many rows as chordal arcs
        (up if x < y else down)[min(x, y)][max(x, y)] = w
    for v in sorted(top):
        for i, x in enumerate(own.upper[v]):
            for y in own.upper[v][i + 1 :]:
                up[x][y] = min(up[x][y], down[v][x] + up[v][y])
                down[x][y] = min(down[x][y], down[v][y] + up[v][x])
    return up, down


def save(spark: SparkSession, own: Hierarchy, weights: tuple[list, list], folder: str) -> None:
    """The order and the customized chordal arcs as tables; another metric of the same hierarchy may take a folder of its own."""
    order = pd.DataFrame({"rank": np.arange(len(own.order)), "node": own.order})
    spark.createDataFrame(order).write.mode("overwrite").parquet(f"{folder}/order")
    chordal_arcs(spark, own, weights).write.mode("overwrite").parquet(f"{folder}/arcs")


def load(spark: SparkSession, folder: str) -> tuple[Hierarchy, tuple[list, list]]:
    """What :func:`save` wrote, without contraction or customization."""
    order = spark.read.parquet(f"{folder}/order").orderBy("rank").toPandas()["node"].to_numpy(np.int64)
    arcs = spark.read.parquet(f"{folder}/arcs").fillna(INFINITY, ["up", "down"]).orderBy("tail", "head").toPandas()
    low, high = arcs["tail"].to_numpy(np.int64), arcs["head"].to_numpy(np.int64)
    # chordal arcs are closed under contraction, so this only lists them
    own = Hierarchy(order, order[low], order[high])
    up: list[dict[int, int]] = [{} for _ in own.upper]
    down: list[dict[int, int]] = [{} for _ in own.upper]
    for a, b, u, d in zip(low.tolist(), high.tolist(), arcs["up"].tolist(), arcs["down"].tolist(), strict=True):
        up[a][b], down[a][b] = int(u), int(d)
    return own, (up, down)

"""Contraction hierarchies for a given order: shortcuts with witness searches, labels by upward searches."""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cells
from .hierarchy import dissection_order
from .search import check_size


def _witnesses(out: list[dict[int, int]], source: int, without: int, targets: set[int], cap: int) -> dict[int, int]:
    """Distances from ``source`` up to ``cap`` among nodes that remain, ``without`` one of them."""
    dist = {source: 0}
    queue = [(0, source)]
    left = set(targets)
    while queue and left:
        d, v = heapq.heappop(queue)
        if d > dist[v]:
            continue
        left.discard(v)
        for w, x in out[v].items():
            if w != without and d + x <= cap and d + x < dist.get(w, cap + 1):
                dist[w] = d + x
                heapq.heappush(queue, (d + x, w))
    return dist


class Contraction:
    """``up[v]`` and ``down[v]``: weights of arcs from and to higher ranks. ``middle[a, b]``: the rank a shortcut passes."""

    def __init__(self, order: np.ndarray, tail: np.ndarray, head: np.ndarray, weight: np.ndarray, count: int | None = None):
        """``count``: contract only so many of the lowest ranks; arcs among the others are the overlay."""
        n = len(order)
        self.order = order
        self.rank = np.empty(n, np.int64)
        self.rank[order] = np.arange(n)
        out: list[dict[int, int]] = [{} for _ in range(n)]
        into: list[dict[int, int]] = [{} for _ in range(n)]
        for a, b, w in zip(self.rank[tail].tolist(), self.rank[head].tolist(), weight.tolist(), strict=True):
            if a != b and w < out[a].get(b, w + 1):
                out[a][b] = into[b][a] = w
        self.middle: dict[tuple[int, int], int] = {}
        self.up: list[dict[int, int]] = [{} for _ in range(n)]
        self.down: list[dict[int, int]] = [{} for _ in range(n)]
        for v in range(n if count is None else count):
            self.up[v], self.down[v] = out[v], into[v]
            most = max(out[v].values(), default=0)
            for a, w in into[v].items():
                near = _witnesses(out, a, v, out[v].keys() - {a}, w + most)
                for b, x in out[v].items():
                    if a != b and w + x < near.get(b, w + x + 1):
                        out[a][b] = into[b][a] = w + x
                        self.middle[a, b] = v
            for a in into[v]:
                del out[a][v]
            for b in out[v]:
                del into[b][v]
        self.overlay = out if count is not None else []

    def label(self, v: int, down: bool) -> list[tuple[int, int]]:
        """(rank of the hub, distance) of a search towards higher ranks."""
        side = self.down if down else self.up
        dist, queue, done = {v: 0}, [(0, v)], []
        while queue:
            d, a = heapq.heappop(queue)
            if d > dist[a]:
                continue
            done.append((a, d))
            for b, w in side[a].items():
                if d + w < dist.get(b, d + w + 1):
                    dist[b] = d + w
                    heapq.heappush(queue, (d + w, b))
        return sorted(done)

    def pruned_label(self, v: int, down: bool) -> list[tuple[int, int]]:
        """The label without hubs that another one reaches by a shorter way down: their distance isn't the true one."""
        own = self.label(v, down)
        other = self.down if not down else self.up
        kept = dict(own)
        return [(h, d) for h, d in own if not any(kept.get(b, d) + w < d for b, w in other[h].items())]

    def unpack(self, a: int, b: int) -> list[int]:
        """Nodes on the way that the arc between two ranks stands for."""
        out, stack = [a], [(a, b)]
        while stack:
            x, y = stack.pop()
            m = self.middle.get((x, y))
            if m is None:
                out.append(y)
            else:
                stack += [(m, y), (x, m)]
        return self.order[out].tolist()


def build(arcs: DataFrame, nodes: DataFrame) -> Contraction:
    """Contraction on the driver by a nested dissection order, up to a checked size."""
    check_size(arcs)
    p = arcs.select("tail", "head", "weight").toPandas()
    q = nodes.select("node", "x", "y").orderBy("node").toPandas()
    tail, head, weight = (p[c].to_numpy(np.int64) for c in ("tail", "head", "weight"))
    return Contraction(dissection_order(q["x"].to_numpy(float), q["y"].to_numpy(float), tail, head), tail, head, weight)


def labels(spark: SparkSession, own: Contraction, nodes: DataFrame, down: bool) -> DataFrame:
    """``node, hub, dist`` for ``nodes(node)``, one upward search each."""
    shared = spark.sparkContext.broadcast(own)

    def work(frames):
        h = shared.value
        for frame in frames:
            rows = [(v, hub, d) for v in frame["node"].tolist() for hub, d in h.pruned_label(int(h.rank[v]), down)]
            yield pd.DataFrame(rows, columns=["node", "hub", "dist"]).astype("int64")

    return nodes.select("node").distinct().mapInPandas(work, "node long, hub long, dist long")


def _without(f: pd.DataFrame, cell: int, shift: int) -> pd.DataFrame:
    """A cell's arcs after the contraction of its nodes that go, but those beside one that goes elsewhere."""
    tail, head = (f[c].to_numpy(np.int64) for c in ("tail", "head"))
    ids, at = np.unique(np.concatenate([tail, head]), return_inverse=True)
    t, h = at[: len(f)], at[len(f) :]
    leaf, goes = np.empty(len(ids), np.int64), np.zeros(len(ids), bool)
    leaf[at] = np.concatenate([f["leaf_t"].to_numpy(np.int64), f["leaf_h"].to_numpy(np.int64)])
    goes[at] = np.concatenate([f["goes_t"].to_numpy(bool), f["goes_h"].to_numpy(bool)])
    outside = goes & (leaf >> shift != cell)
    ready = goes & ~outside
    ready[t[outside[h]]] = ready[h[outside[t]]] = False
    mixed = np.argsort(ids * 2_654_435_761 % 2**32, kind="stable")  # one after the other along a line makes more shortcuts on the way
    order = np.concatenate([mixed[ready[mixed]], mixed[~ready[mixed]]])
    own = Contraction(order, t, h, f["weight"].to_numpy(np.int64), count=int(ready.sum()))
    rows = [(order[a], order[b], w) for a, arcs in enumerate(own.overlay) if not ready[order[a]] for b, w in arcs.items()]
    a, b, w = np.array(rows, np.int64).reshape(-1, 3).T
    return pd.DataFrame({"tail": ids[a], "head": ids[b], "weight": w, "leaf_t": leaf[a], "leaf_h": leaf[b], "goes_t": goes[a], "goes_h": goes[b]})


def _going(shift: int) -> Callable:
    return lambda key, frame: _without(frame, int(key[0]), shift)


def overlay(arcs: DataFrame, nodes: DataFrame, gone: str, store: Callable[..., DataFrame], size: int | None = None) -> DataFrame:
    """``tail, head, weight`` among the nodes where ``gone`` (an expression of ``node``) is false, with the distances of ``arcs``; no memory holds the graph.

    Leaves of ``nodes(node, x, y)`` and rounds as in :mod:`cells`: a task gets the arcs at the nodes that go in its cell, and those among
    their neighbours there as witnesses. Witnesses elsewhere aren't seen, so there may be more shortcuts than by :class:`Contraction` on
    the whole. A task of the last round holds the arcs of the nodes that are still to go.
    """
    at, bits = cells.leaves(nodes, size or cells.LEAF)
    at = store(at.selectExpr("node", "leaf", f"({gone}) AS goes"))
    t, h = (at.select(F.col("node").alias(c), F.col("leaf").alias(f"leaf_{c[0]}"), F.col("goes").alias(f"goes_{c[0]}")) for c in ("tail", "head"))
    keys = ["tail", "head", "leaf_t", "leaf_h", "goes_t", "goes_h"]
    least = lambda df: df.groupBy(*keys).agg(F.min("weight").alias("weight")).select("tail", "head", "weight", *keys[2:])
    rest = store(least(arcs.where("tail <> head").select("tail", "head", "weight").join(t, "tail").join(h, "head")))
    kind = "tail long, head long, weight long, leaf_t long, leaf_h long, goes_t boolean, goes_h boolean"
    for shift in cells._rounds(bits):
        going, kept = rest.where("goes_t OR goes_h"), rest.where("NOT goes_t AND NOT goes_h")
        cells_of = F.array_distinct(F.array_compact(F.array(*(F.expr(f"IF(goes_{e}, shiftright(leaf_{e}, {shift}), NULL)") for e in "th"))))
        asked = store(going.withColumn("cell", F.explode(cells_of)))
        beside = store(asked.where("NOT goes_t").select("cell", F.col("tail").alias("node")).union(asked.where("NOT goes_h").select("cell", "head")).distinct())
        witnesses = kept.join(beside.withColumnRenamed("node", "tail"), "tail").join(beside.withColumnRenamed("node", "head"), ["cell", "head"]).select(asked.columns)
        out = asked.union(witnesses).groupBy("cell").applyInPandas(_going(shift), kind)
        rest = store(least(kept.union(out.select(kept.columns))))
    return rest.select("tail", "head", "weight")

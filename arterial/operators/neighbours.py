"""The k nearest targets of each source: from truncated buckets as a join, by cells of the elimination tree, and in the plane."""

from __future__ import annotations

import heapq
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .hierarchy import Hierarchy
from .search import _dealt

#: Targets up to which a cell is searched as a whole.
CELL_TARGETS = 8


def buckets(in_labels: DataFrame, k: int) -> DataFrame:
    """``hub, target, dist``: of the targets' labels (``node, hub, dist``) the k nearest to each hub, ties by target.

    Who is not among them has k others before it at every source that comes through this hub.
    """
    nth = F.row_number().over(Window.partitionBy("hub").orderBy("dist", "node"))
    return in_labels.withColumn("nth", nth).where(F.col("nth") <= k).select("hub", F.col("node").alias("target"), "dist")


def by_buckets(out_labels: DataFrame, in_labels: DataFrame, k: int) -> DataFrame:
    """``source, target, dist, place``: the k nearest targets, ties by target. A source meets k targets at each of its hubs, not all."""
    a = out_labels.select(F.col("node").alias("source"), "hub", F.col("dist").alias("d1"))
    met = a.join(buckets(in_labels, k), "hub").groupBy("source", "target").agg(F.min(F.col("d1") + F.col("dist")).alias("dist"))
    place = F.row_number().over(Window.partitionBy("source").orderBy("dist", "target"))
    return met.withColumn("place", place.cast("long")).where(F.col("place") <= k)


class Cells:
    """Subtrees of the elimination tree with the targets in them."""

    def __init__(self, own: Hierarchy, weights: tuple[list, list], targets: list[int]):
        self.own, self.up = own, weights[0]
        n = len(own.parent)
        self.children: list[list[int]] = [[] for _ in range(n)]
        self.roots = []
        self.count = [0] * n
        self.low = list(range(n))  # the first rank in a cell's chain of ancestors is itself
        self.label: dict[int, list[tuple[int, int]]] = {}
        self.weights = weights
        wanted = {int(own.rank[t]) for t in targets}
        for v in range(n):
            self.count[v] += v in wanted
            p = int(own.parent[v])
            if p >= 0:
                self.children[p].append(v)
                self.count[p] += self.count[v]
            else:
                self.roots.append(v)
        self.wanted = wanted

    def _to(self, dist: dict[int, int], v: int) -> int | None:
        """The distance to rank ``v`` from the source whose label is ``dist``."""
        if v not in self.label:
            self.label[v] = self.own.label(self.weights[1], v)
        return min((dist[h] + d for h, d in self.label[v] if h in dist), default=None)

    def nearest(self, source: int, k: int) -> list[tuple[int, int]]:
        """(distance, target) of the k nearest targets, ties by target: cells in the order of the way to their border."""
        s = int(self.own.rank[source])
        dist = dict(self.own.label(self.up, s))
        inside = set()
        at = s
        while at >= 0:
            inside.add(at)
            at = int(self.own.parent[at])
        queue = [(0, v) for v in self.roots if self.count[v]]
        heapq.heapify(queue)
        best: list[tuple[int, int]] = []
        while queue:
            bound, v = heapq.heappop(queue)
            if len(best) == k and bound > best[-1][0]:
                break
            if self.count[v] <= CELL_TARGETS:
                stack = [v]
                while stack:
                    c = stack.pop()
                    stack.extend(x for x in self.children[c] if self.count[x])
                    d = self._to(dist, c) if c in self.wanted else None
                    if d is not None:
                        best.append((d, int(self.own.order[c])))
                best = sorted(best)[:k]
                continue
            if v in self.wanted and (d := self._to(dist, v)) is not None:
                best = sorted([*best, (d, int(self.own.order[v]))])[:k]
            for c in self.children[v]:
                if self.count[c]:
                    # all ways from outside into a subtree pass an upper neighbour of its root
                    ways = [0] if c in inside else [d for b in self.own.upper[c] if (d := self._to(dist, b)) is not None]
                    if ways:
                        heapq.heappush(queue, (min(ways), c))
        return best


def by_cells(spark, own: Hierarchy, weights: tuple[list, list], sources: DataFrame, targets: list[int], k: int) -> DataFrame:
    """``source, target, dist, place`` as :func:`by_buckets`, one search over cells for each of ``sources(source)``."""
    shared = spark.sparkContext.broadcast(Cells(own, weights, targets))

    def work(frames):
        cells = shared.value
        for frame in frames:
            rows = [(s, t, d, i + 1) for s in frame["source"].tolist() for i, (d, t) in enumerate(cells.nearest(s, k))]
            yield pd.DataFrame(rows, columns=["source", "target", "dist", "place"]).astype("int64")

    return _dealt(sources.select("source").distinct()).mapInPandas(work, "source long, target long, dist long, place long")


def nearest_points(probes: DataFrame, points: DataFrame, size: float, store: Callable[[DataFrame], DataFrame], rounds: int = 40) -> DataFrame:
    """``probe, node, gap2`` (squared distance): of ``points(node, x, y)`` the nearest to each of ``probes(probe, x, y)``, ties by node.

    Both sides meet in squares of a grid of width ``size``. A probe looks at the squares around its own; once the nearest
    of them lies within the ring that it has seen, it is settled, else it looks again with four times the width. ``store`` cuts
    the lineage.
    """
    left = probes.select("probe", F.col("x").alias("px"), F.col("y").alias("py"))
    done = None
    for _ in range(rounds):
        square = lambda c, w=size: F.floor(F.col(c) / w)
        at = points.select("node", "x", "y", square("x").alias("i"), square("y").alias("j"))
        around = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)]))
        seen = left.withColumn("s", around).select("probe", "px", "py", (square("px") + F.col("s.a")).alias("i"), (square("py") + F.col("s.b")).alias("j"))
        gap = (F.col("px") - F.col("x")) * (F.col("px") - F.col("x")) + (F.col("py") - F.col("y")) * (F.col("py") - F.col("y"))
        best = seen.join(at, ["i", "j"]).groupBy("probe").agg(F.min(F.struct(gap.alias("gap2"), "node")).alias("m"))
        best = store(best.select("probe", "m.node", "m.gap2").where(F.col("gap2") <= size * size))
        done = best if done is None else done.union(best)
        left = store(left.join(best.select("probe"), "probe", "left_anti"))
        if left.isEmpty():
            return done
        size *= 4
    raise RuntimeError(f"no nearest point within {rounds} rounds")

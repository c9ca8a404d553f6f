"""The shape of a graph: connected and biconnected components, the core without side branches."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .search import check_size


def weak_components(arcs: DataFrame, nodes: DataFrame, store: Callable[[DataFrame], DataFrame], rounds: int = 64) -> DataFrame:
    """``node, component`` (the smallest node) for ``nodes(node)``, arcs taken in both directions.

    Each round every component hangs itself below its smallest neighbour if that is smaller, and jumps
    to the root of its chain; arcs inside a component go. ``store`` cuts the lineage.
    """
    edges = store(arcs.where("tail <> head").select(F.col("tail").alias("a"), F.col("head").alias("b")).distinct())
    own = nodes.select("node", F.col("node").alias("component")).distinct()
    for _ in range(rounds):
        if edges.isEmpty():
            return own
        both = edges.union(edges.select("b", "a"))
        hang = store(both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("root")))
        while True:
            up = hang.select(F.col("a").alias("root"), F.col("root").alias("next"))
            far = hang.join(up, "root").select("a", F.col("next").alias("root"), (F.col("next") < F.col("root")).alias("moved"))
            far = store(far)
            hang = far.drop("moved")
            if far.where("moved").isEmpty():
                break
        moved = hang.select(F.col("a").alias("component"), "root")
        own = store(own.join(moved, "component", "left").select("node", F.coalesce("root", "component").alias("component")))
        a, b = hang.select("a", F.col("root").alias("x")), hang.select(F.col("a").alias("b"), F.col("root").alias("y"))
        edges = store(edges.join(a, "a").join(b, "b").where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def connected_only(trips: DataFrame, components: DataFrame) -> DataFrame:
    """``trips`` with ``possible``: false where no path can exist, which saves the search."""
    s = components.select(F.col("node").alias("source"), F.col("component").alias("of_source"))
    t = components.select(F.col("node").alias("target"), F.col("component").alias("of_target"))
    out = trips.join(s, "source", "left").join(t, "target", "left")
    return out.withColumn("possible", F.coalesce(F.col("of_source") == F.col("of_target"), F.lit(False))).drop("of_source", "of_target")


def neighbours(n: int, tail: np.ndarray, head: np.ndarray) -> list[list[int]]:
    """Distinct neighbours in both directions, rising, without the node itself."""
    out: list[set[int]] = [set() for _ in range(n)]
    for a, b in zip(tail.tolist(), head.tolist(), strict=True):
        if a != b:
            out[a].add(b)
            out[b].add(a)
    return [sorted(s) for s in out]


def preorder(near: list[list[int]], root: int = 0) -> list[int]:
    """Nodes by first visit of a depth-first search, smaller neighbours first, further trees after the root's."""
    seen = [False] * len(near)
    out = []
    for start in [root, *range(len(near))]:
        stack = [start]
        while stack:
            v = stack.pop()
            if not seen[v]:
                seen[v] = True
                out.append(v)
                stack.extend(w for w in reversed(near[v]) if not seen[w])
    return out


def blocks(near: list[list[int]]) -> list[set[int]]:
    """Biconnected components as sets of nodes (a bridge is one of two), by least reachable numbers of a depth-first search."""
    number = [-1] * len(near)
    low = [0] * len(near)
    count = 0
    out = []
    for root in range(len(near)):
        if number[root] >= 0:
            continue
        number[root] = low[root] = count
        count += 1
        open_nodes = [root]
        walk = [(root, -1, iter(near[root]))]
        while walk:
            v, parent, rest = walk[-1]
            w = next(rest, None)
            if w is None:
                walk.pop()
                if parent >= 0:
                    low[parent] = min(low[parent], low[v])
                    if low[v] >= number[parent]:
                        block = {parent}
                        while not block >= {v}:
                            block.add(open_nodes.pop())
                        out.append(block)
            elif number[w] < 0:
                number[w] = low[w] = count
                count += 1
                open_nodes.append(w)
                walk.append((w, v, iter(near[w])))
            elif w != parent:
                low[v] = min(low[v], number[w])
    return out


def core(spark: SparkSession, arcs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, in_core, degree, bridge``: the biggest block is the core, ``degree`` counts neighbours in it.

    ``bridge``: where the node's side component meets the core (itself inside, null if it never does).
    The search is sequential, so it runs on the driver, up to a checked size.
    """
    check_size(arcs)
    p = arcs.select("tail", "head").toPandas()
    top = nodes.agg(F.max("node")).first()[0]
    n = 0 if top is None else int(top) + 1
    near = neighbours(n, p["tail"].to_numpy(np.int64), p["head"].to_numpy(np.int64))
    found = blocks(near)
    best = max(found, key=lambda b: (len(b), -min(b)), default=set())
    bridge: list[int | None] = [v if v in best else None for v in range(n)]
    stack = sorted(best)
    while stack:
        v = stack.pop()
        for w in near[v]:
            if bridge[w] is None:
                bridge[w] = bridge[v]
                stack.append(w)
    rows = [(v, v in best, sum(w in best for w in near[v]), bridge[v]) for v in range(n)]
    return nodes.select("node").join(spark.createDataFrame(rows, "node long, in_core boolean, degree long, bridge long"), "node")

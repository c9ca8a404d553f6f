"""Label-setting searches: kernels in Spark tasks over a broadcast graph, one DataFrame of queries in, one of results out.

The graph is broadcast as arrays only up to ``MOST_BYTES``, estimated from its arcs and points before anything is
collected. Beyond that :func:`fixpoint` is a way of joins and minima.
"""

from __future__ import annotations

import bisect
import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..schema import INFINITY

#: Bytes that a graph may take in a task as Python lists: about 250 for an arc and 90 for a point of its function.
MOST_BYTES = 4 << 30
ARC_BYTES, POINT_BYTES = 250, 90


class Graph:
    """Adjacency arrays; arcs of a node keep the order of their ids."""

    def __init__(self, tail: np.ndarray, head: np.ndarray, weight: np.ndarray, arc: np.ndarray, extra: list | None = None):
        order = np.lexsort((arc, tail))
        self.n = int(max(tail.max(initial=-1), head.max(initial=-1))) + 1
        self.head, self.weight, self.arc = head[order], weight[order], arc[order]
        self.first = np.searchsorted(tail[order], np.arange(self.n + 1))
        self.extra = [extra[i] for i in order.tolist()] if extra else None

    def transposed(self) -> Graph:
        tail = np.repeat(np.arange(self.n), np.diff(self.first))
        return Graph(self.head, tail, self.weight, self.arc, self.extra)

    def lists(self) -> list[list[tuple[int, int, int]]]:
        """(head, weight, place) of each node's arcs."""
        rows = list(zip(self.head.tolist(), self.weight.tolist(), range(len(self.head)), strict=True))
        return [rows[a:b] for a, b in zip(self.first[:-1].tolist(), self.first[1:].tolist(), strict=True)]


def check_size(arcs: DataFrame, most: int = MOST_BYTES) -> None:
    """Raise where the lists of ``arcs`` would take more than ``most`` bytes."""
    points = F.sum(F.size("ttf")) if "ttf" in arcs.columns else F.lit(0)
    n, held = arcs.agg(F.count(F.lit(1)), points).first()
    if n * ARC_BYTES + (held or 0) * POINT_BYTES > most:
        raise ValueError(f"{n} arcs with {held or 0} points are too many for a broadcast of {most} bytes; use a fixpoint or labels")


def collect(arcs: DataFrame) -> Graph:
    """The graph in the driver's memory, for a broadcast."""
    check_size(arcs)
    columns = ["tail", "head", "weight", "arc_id"]
    timed = [F.col("ttf.dep").alias("dep"), F.col("ttf.tt").alias("tt")] if "ttf" in arcs.columns else []
    p = arcs.select(*columns, *timed).toPandas()
    extra = [(np.asarray(d), np.asarray(t)) for d, t in zip(p["dep"], p["tt"], strict=True)] if timed else None
    return Graph(*(p[c].to_numpy(np.int64) for c in columns), extra)


Step = Callable[[int, int, int], int]


def settle(
    out: list, starts: list[tuple[int, int]], step: Step | None = None, potential: Callable[[int], int | None] | None = None
) -> Iterator[tuple[int, int, int]]:
    """(node, distance, predecessor) in the order in which nodes are settled, ties by node.

    ``starts``: (node, distance). ``step(distance, weight, place)``: the distance after an arc, by default
    the sum. ``potential``: a feasible lower bound to go, None where the target can't be reached.
    """
    best: dict[int, int] = {}
    queue: list[tuple[int, int, int, int]] = []
    for node, d in starts:
        h = potential(node) if potential else 0
        if h is not None and d < best.get(node, d + 1):
            best[node] = d
            heapq.heappush(queue, (d + h, node, d, -1))
    done = set()
    while queue:
        _, node, d, before = heapq.heappop(queue)
        if node in done:
            continue
        done.add(node)
        yield node, d, before
        for head, weight, place in out[node] if node < len(out) else ():
            if head in done:
                continue
            t = step(d, weight, place) if step else d + weight
            if t < best.get(head, t + 1):
                h = potential(head) if potential else 0
                if h is not None:
                    best[head] = t
                    heapq.heappush(queue, (t + h, head, t, node))


def bidirectional(out: list, back: list, source: int, target: int, cap: int | None = None) -> int | None:
    """Distance by two searches that take turns by the smaller key, and stop when both keys pass the best meeting."""
    if source == target:
        return 0
    dist = ({source: 0}, {target: 0})
    queues = ([(0, source)], [(0, target)])
    graphs = (out, back)
    best = cap
    found = None
    while queues[0] and queues[1]:
        if best is not None and queues[0][0][0] + queues[1][0][0] >= best + (found is None):
            break
        side = 0 if queues[0][0] <= queues[1][0] else 1
        d, node = heapq.heappop(queues[side])
        if d > dist[side][node]:
            continue
        for head, weight, _ in graphs[side][node] if node < len(graphs[side]) else ():
            t = d + weight
            if t < dist[side].get(head, t + 1):
                dist[side][head] = t
                heapq.heappush(queues[side], (t, head))
                if head in dist[1 - side] and (best is None or t + dist[1 - side][head] < best + (found is None)):
                    best = found = t + dist[1 - side][head]
    return found


def branching(graph: Graph) -> list[bool]:
    """Nodes with other than one or two neighbours (of both directions): all but those inside chains and at dead ends."""
    tail = np.repeat(np.arange(graph.n), np.diff(graph.first))
    ends = np.concatenate([np.stack([tail, graph.head]), np.stack([graph.head, tail])], axis=1)
    near = np.unique(ends[:, ends[0] != ends[1]], axis=1)
    return (np.bincount(near[0], minlength=graph.n) > 2).tolist()


def chained(out: list, branches: list[bool], source: int, target: int) -> int | None:
    """Distance by a search whose queue holds branching nodes only: a label runs on along a chain at once."""
    best = {source: 0}
    queue: list[tuple[int, int]] = []
    run = [(source, 0)]
    while run:
        node, d = run.pop()
        if d == best[node] and node < len(out):
            for head, weight, _ in out[node]:
                t = d + weight
                if t < best.get(head, t + 1):
                    best[head] = t
                    if branches[head]:
                        heapq.heappush(queue, (t, head))
                    else:
                        run.append((head, t))
        if not run and queue and queue[0][0] < best.get(target, INFINITY):
            d, node = heapq.heappop(queue)
            run.append((node, d))
    return best.get(target)


def goal_directed(out: list, back: list, source: int, target: int, to_target: dict[int, int], from_source: dict[int, int]) -> int | None:
    """:func:`bidirectional` on reduced costs by the average of two consistent potentials (lower bounds; absent: no path).

    All costs are doubled, so that the average stays whole.
    """
    if source not in to_target or target not in from_source:
        return None
    p = {v: d - from_source[v] for v, d in to_target.items() if v in from_source}
    if source not in p or target not in p:
        return None
    # the same reduced cost on both sides: forward and backward potentials are opposite
    fw = [[(h, 2 * w - p[v] + p[h], x) for h, w, x in arcs if h in p] if v in p else [] for v, arcs in enumerate(out)]
    bw = [[(t, 2 * w - p[t] + p[v], x) for t, w, x in arcs if t in p] if v in p else [] for v, arcs in enumerate(back)]
    found = bidirectional(fw, bw, source, target)
    return None if found is None else (found + p[source] - p[target]) // 2


def one_to_all(arcs: DataFrame, sources: DataFrame) -> DataFrame:
    """``source, node, dist, before`` of all reachable nodes for each of ``sources(source)``."""
    graph = arcs.sparkSession.sparkContext.broadcast(collect(arcs))

    def work(frames):
        out = graph.value.lists()
        for frame in frames:
            for s in frame["source"].tolist():
                rows = list(settle(out, [(s, 0)]))
                yield pd.DataFrame(rows, columns=["node", "dist", "before"]).assign(source=s)[["source", "node", "dist", "before"]]

    return _dealt(sources.select("source").distinct()).mapInPandas(work, "source long, node long, dist long, before long")


def _dealt(rows: DataFrame) -> DataFrame:
    """Queries spread over the tasks; a search is long, so a few rows a task are enough."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *rows.columns)


def distances(arcs: DataFrame, trips: DataFrame, two_sided: bool = False) -> DataFrame:
    """``trips`` with ``dist`` (null: no path). Trips of one source share a search."""
    if two_sided:
        return _two_sided(arcs, trips)
    graph = arcs.sparkSession.sparkContext.broadcast(collect(arcs))

    def work(frames):
        out = graph.value.lists()
        for frame in frames:
            rows = []
            for s, targets in zip(frame["source"].tolist(), frame["targets"], strict=True):
                wanted = set(targets.tolist())
                for node, d, _ in settle(out, [(s, 0)]):
                    if node in wanted:
                        wanted.discard(node)
                        rows.append((s, node, d))
                        if not wanted:
                            break
            yield pd.DataFrame(rows, columns=["source", "target", "dist"]).astype("int64")

    # a source has at most as many targets as there are nodes
    each = _dealt(trips.groupBy("source").agg(F.collect_set("target").alias("targets")))
    found = each.mapInPandas(work, "source long, target long, dist long")
    return trips.join(found, ["source", "target"], "left")


def _two_sided(arcs: DataFrame, trips: DataFrame) -> DataFrame:
    graph = arcs.sparkSession.sparkContext.broadcast(collect(arcs))

    def work(frames):
        out, back = graph.value.lists(), graph.value.transposed().lists()
        for frame in frames:
            yield frame.assign(dist=[bidirectional(out, back, s, t) for s, t in zip(frame["source"].tolist(), frame["target"].tolist(), strict=True)]).astype(
                {"dist": "Int64"}
            )

    return trips.mapInPandas(work, StructType([*trips.schema.fields, StructField("dist", LongType())]))


def chain_distances(arcs: DataFrame, trips: DataFrame) -> DataFrame:
    """``trips`` with ``dist`` by :func:`chained`; trips are independent, so tasks share them out."""
    graph = arcs.sparkSession.sparkContext.broadcast(collect(arcs))

    def work(frames):
        out, branches = graph.value.lists(), branching(graph.value)
        for frame in frames:
            found = [chained(out, branches, s, t) for s, t in zip(frame["source"].tolist(), frame["target"].tolist(), strict=True)]
            yield frame.assign(dist=pd.array(found, "Int64"))

    return _dealt(trips).mapInPandas(work, StructType([*trips.schema.fields, StructField("dist", LongType())]))


def fixpoint(arcs: DataFrame, sources: DataFrame, store: Callable[[DataFrame], DataFrame], rounds: int = 10_000) -> DataFrame:
    """``source, node, dist`` by joins and minima until nothing improves; ``store`` cuts the lineage of each round."""
    best = store(sources.selectExpr("source", "source AS node", "0L AS dist").distinct())
    front = best
    for _ in range(rounds):
        reached = front.join(arcs, front["node"] == arcs["tail"]).select("source", F.col("head").alias("node"), (F.col("dist") + F.col("weight")).alias("dist"))
        better = reached.groupBy("source", "node").agg(F.min("dist").alias("dist"))
        old = best.withColumnRenamed("dist", "old")
        front = store(better.join(old, ["source", "node"], "left").where("old IS NULL OR dist < old").select("source", "node", "dist"))
        if front.isEmpty():
            return best
        best = store(best.union(front).groupBy("source", "node").agg(F.min("dist").alias("dist")))
    raise RuntimeError(f"no fixpoint in {rounds} rounds")


def _grown(arcs: DataFrame, starts: DataFrame, store: Callable[[DataFrame], DataFrame], ready: Column, kept: Column | None, rounds: int) -> DataFrame:
    """``source, node, dist, open`` from ``starts(source, node)``: labels improved by joins, those where ``ready`` once at each value; only those that ``kept`` go on."""
    best = store(starts.selectExpr("source", "node", "0L AS dist", "true AS open").distinct())
    for _ in range(rounds):
        marked = best.withColumn("now", F.col("open") & ready)
        front = marked.where("now").select("source", "node", "dist")
        if front.isEmpty():
            return best
        reached = front.join(arcs, front["node"] == arcs["tail"]).select("source", F.col("head").alias("node"), (F.col("dist") + F.col("weight")).alias("dist"), F.lit(True).alias("open"))
        known = marked.select("source", "node", "dist", (F.col("open") & ~F.col("now")).alias("open"))
        least = known.union(reached).groupBy("source", "node").agg(F.min(F.struct("dist", "open")).alias("m")).select("source", "node", "m.dist", "m.open")
        best = store(least if kept is None else least.withColumn("kept", kept).where("kept").drop("kept"))
    raise RuntimeError(f"no fixpoint in {rounds} rounds")


def balls(arcs: DataFrame, sources: DataFrame, size: int, store: Callable[[DataFrame], DataFrame], rounds: int = 10_000) -> DataFrame:
    """``source, node, dist`` of the ``size`` nearest nodes to each of ``sources(source)``, and of all as near as the last of them.

    No task or driver sees the graph: a node among the nearest is reached over nodes as near, so labels beyond that many
    smaller ones can go in every round.
    """
    near = F.rank().over(Window.partitionBy("source").orderBy("dist")) <= size
    return _grown(arcs, sources.selectExpr("source", "source AS node"), store, F.lit(True), near, rounds).drop("open")


def until(arcs: DataFrame, sources: DataFrame, limit: int, store: Callable[[DataFrame], DataFrame], rounds: int = 10_000) -> DataFrame:
    """``source, node, dist``: all nodes nearer than ``limit`` to each source, and beyond it labels of which the least are distances.

    As :func:`balls` by joins; the nearest labels beyond the limit are searched from too, for arcs of weight 0.
    """
    first = F.min(F.when(F.col("dist") >= limit, F.col("dist"))).over(Window.partitionBy("source"))
    return _grown(arcs, sources.selectExpr("source", "source AS node"), store, (F.col("dist") < limit) | (F.col("dist") == first), None, rounds).drop("open")


def earliest_arrivals(arcs: DataFrame, starts: DataFrame, period: int) -> DataFrame:
    """``source, departure, node, travel_time`` over integer travel-time functions for each of ``starts(source, departure)``."""
    graph = arcs.sparkSession.sparkContext.broadcast(collect(arcs))

    def work(frames):
        g = graph.value
        out = g.lists()
        points = [(d.tolist(), t.tolist()) for d, t in g.extra]

        def step(at: int, _: int, place: int) -> int:
            return at + value(*points[place], at % period)

        for frame in frames:
            for s, t in zip(frame["source"].tolist(), frame["departure"].tolist(), strict=True):
                rows = [(s, t, node, at - t) for node, at, _ in settle(out, [(s, t)], step)]
                yield pd.DataFrame(rows, columns=["source", "departure", "node", "travel_time"])

    return _dealt(starts.select("source", "departure").distinct()).mapInPandas(work, "source long, departure long, node long, travel_time long")


def towards(arcs: DataFrame, pairs: DataFrame, store: Callable[..., DataFrame], rounds: int = 10_000) -> DataFrame:
    """``pairs(source, target)`` that have a path with its ``dist``, by joins that stop where the target is nearer."""
    goal = F.min(F.when(F.col("node") == F.col("source.target"), F.col("dist"))).over(Window.partitionBy("source"))
    starts = pairs.select(F.struct("source", "target").alias("source"), F.col("source").alias("node"))
    found = _grown(arcs, starts, store, F.lit(True), F.coalesce(F.col("dist") <= goal, F.lit(True)), rounds)
    return found.where("node = source.target").select("source.source", "source.target", "dist")


def regions(arcs: DataFrame, pairs: DataFrame, store: Callable[..., DataFrame], rounds: int = 10_000) -> DataFrame:
    """``source, target, node``: for each of ``pairs(source, target, most)`` the nodes that are at most that far from the source."""
    starts = pairs.select(F.struct("source", "target", "most").alias("source"), F.col("source").alias("node"))
    found = _grown(arcs, starts, store, F.lit(True), F.col("dist") <= F.col("source.most"), rounds)
    return store(found.select("source.source", "source.target", "node"))


def inside(arcs: DataFrame, region: DataFrame, store: Callable[..., DataFrame]) -> DataFrame:
    """``arcs`` with ``source, target`` of each of the ``regions`` that holds both of their ends."""
    nodes = store(region.select(F.col("node").alias("tail")).distinct())
    some = arcs.join(nodes, "tail", "left_semi")
    from_ = region.select("source", "target", F.col("node").alias("tail"))
    return some.join(from_, "tail").join(region.withColumnRenamed("node", "head"), ["source", "target", "head"])


def by_cells(arcs: DataFrame, starts: DataFrame, step_of: Callable[[pd.DataFrame], Step], store: Callable[..., DataFrame], size: int = 50_000, kind: str = "long", rounds: int = 10_000, parts: int = 1, most: int | None = None, limits: DataFrame | None = None) -> DataFrame:
    """``source, departure, node, at, before``: earliest arrivals where no memory holds the graph, as no later departure arrives earlier.

    Nodes fall into cells of ``size`` neighbouring ids. A task searches one cell from the labels sent to it, with
    ``step_of`` (the step on the rows of ``arcs`` of the cell), and sends labels on to cells that may gain by them, until
    none does. A cell remembers what others sent, so labels don't bounce. ``kind``: the type of times. ``starts`` may have
    ``node, at``, else a search starts at its source and departure. ``parts``: tasks that share a cell's searches. Labels above
    ``most`` are dropped, and with ``limits(source, departure, node, at)`` those that are later there, or at any other node.
    """
    columns = [c for c in arcs.columns if c != "ttf"]
    timed = [F.col("ttf.dep").alias("dep"), F.col("ttf.tt").alias("tt")] if "ttf" in arcs.columns else []
    own = store(arcs.select(*columns, *timed, F.expr(f"tail div {size}").alias("cell")).repartition("cell"), "cell")
    at = [c for c in ("node", "at") if c in starts.columns]
    first = starts.select("source", "departure", *at).distinct()
    if not at:
        first = first.withColumn("node", F.col("source")).withColumn("at", F.col("departure"))
    schema = f"cell long, source long, departure long, node long, at {kind}, before long, sent boolean"
    sent = store(first.select(F.expr(f"node div {size}").alias("cell"), "source", "departure", "node", F.col("at").cast(kind), F.lit(-1).cast("long").alias("before"), F.lit(True).alias("sent")))
    rows = [sent]
    limited = limits is not None
    # rows of limits have no value for sent
    bounds = limits and store(limits.select(F.expr(f"node div {size}").alias("cell"), "source", "departure", "node", F.col("at").cast(kind), F.lit(-1).cast("long").alias("before"), F.lit(None).cast("boolean").alias("sent")))

    def work(key, frame: pd.DataFrame, labels: pd.DataFrame) -> pd.DataFrame:
        cell = int(key[0])
        out: dict[int, list[tuple[int, int]]] = {}
        for place, (tail, head) in enumerate(zip(frame["tail"].tolist(), frame["head"].tolist(), strict=True)):
            out.setdefault(tail, []).append((head, place))
        weight = frame["weight"].tolist()
        step = step_of(frame) if len(frame) else None
        found = []
        for (source, departure), part in labels.groupby(["source", "departure"]):
            best: dict[int, float] = {}
            before: dict[int, int] = {}
            offered: dict[int, tuple[float, int]] = {}
            last: dict[int, float] = {}
            if limited:
                ends = part["sent"].isna()
                last = dict(zip(part["node"][ends].tolist(), part["at"][ends].tolist(), strict=True))
                part = part[~ends]
            for node, at, b, new in sorted(zip(part["node"].tolist(), part["at"].tolist(), part["before"].tolist(), part["sent"].tolist(), strict=True), key=lambda x: x[3]):
                if new and node // size == cell:
                    offered[node] = min((at, b), offered.get(node, (at, b)))
                elif at < best.get(node, at + 1):
                    best[node] = at
            queue = []
            for node, (at, b) in offered.items():
                if limited and at > last.get(node, at - 1):
                    continue
                if at < best.get(node, at + 1):
                    best[node], before[node] = at, b
                    queue.append((at, node))
            heapq.heapify(queue)
            while queue:
                at, v = heapq.heappop(queue)
                if at > best[v]:
                    continue
                for head, place in out.get(v, ()):
                    t = step(at, weight[place], place)
                    own_head = head // size == cell
                    if (most is not None and t > most) or (limited and own_head and t > last.get(head, t - 1)):
                        continue
                    if t < best.get(head, t + 1):
                        best[head], before[head] = t, v
                        if own_head:
                            heapq.heappush(queue, (t, head))
            for node, b in before.items():
                other = node // size
                found.append((other, source, departure, node, best[node], b, other != cell))
                if other != cell:  # what the other cell need not send back
                    found.append((other, source, departure, b, best[b], before.get(b, -1), False))
        return pd.DataFrame(found, columns=["cell", "source", "departure", "node", "at", "before", "sent"])

    for _ in range(rounds):
        active = [r[0] for r in sent.where("sent").select("cell").distinct().collect()]  # at most as many as cells
        if not active:
            known = rows[0]
            for r in rows[1:]:
                known = known.union(r)
            # what a cell tells another of its own nodes isn't a label with a predecessor
            known = known.where(F.col("cell") == F.expr(f"node div {size}"))
            best = known.groupBy("source", "departure", "node").agg(F.min(F.struct("at", "before")).alias("m"))
            return best.select("source", "departure", "node", "m.at", "m.before")
        known = None
        for i, r in enumerate(rows):
            # labels sent in earlier rounds are known by now
            part = r.where(F.col("cell").isin(active))
            part = part if i == len(rows) - 1 else part.withColumn("sent", F.lit(False))
            known = part if known is None else known.union(part)
        if bounds:
            known = known.union(bounds.where(F.col("cell").isin(active)))
        some = own.where(F.col("cell").isin(active))
        if parts > 1:
            some = some.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
            known = known.withColumn("part", F.expr(f"CAST(pmod(xxhash64(source, departure), {parts}) AS INT)"))
        by = ["cell", "part"] if parts > 1 else ["cell"]
        sent = store(some.groupBy(*by).cogroup(known.groupBy(*by)).applyInPandas(work, schema))
        rows.append(sent)
    raise RuntimeError(f"no fixpoint in {rounds} rounds")


def value(dep: list[int], tt: list[int], x: int) -> int:
    """An integer travel-time function at ``x`` within the period."""
    if len(dep) <= 2:
        return tt[0]
    i = bisect.bisect_right(dep, x) - 1
    if dep[i] == x:
        return tt[i]
    a, b = dep[i] + tt[i], dep[i + 1] + tt[i + 1]
    return a + (x - dep[i]) * (b - a) // (dep[i + 1] - dep[i]) - x


def ranks(settled: DataFrame) -> DataFrame:
    """Of ``source, node, dist``: the nodes settled as 1st, 2nd, 4th, 8th ... with ``rank`` 0, 1, 2 ..., ties by node."""
    nth = F.row_number().over(Window.partitionBy("source").orderBy("dist", "node"))
    power = F.col("nth").bitwiseAND(F.col("nth") - 1) == 0
    return settled.withColumn("nth", nth).where(power).select("source", F.log2("nth").cast("int").alias("rank"), "node", "dist")


def nearest(dists: DataFrame, k: int) -> DataFrame:
    """Of ``source, target, dist``: the k nearest targets of each source with their ``place``, ties by target."""
    place = F.row_number().over(Window.partitionBy("source").orderBy("dist", "target"))
    return dists.where("dist IS NOT NULL").select("source", "target", "dist").distinct().withColumn("place", place.cast("long")).where(F.col("place") <= k)

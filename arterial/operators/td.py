"""Time-dependent searches beyond earliest arrivals: profiles, live traffic, samples of the day, hierarchies of functions.

Kernels run in Spark tasks over a broadcast graph. Float functions are pairs of arrays in seconds.
"""

from __future__ import annotations

import bisect
import heapq
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import plf
from ..schema import INFINITY, PERIOD
from .hierarchy import Hierarchy
from .search import Graph, _dealt, by_cells, check_size, collect, inside, regions, settle, towards, value

Function = tuple[np.ndarray, np.ndarray]
#: Default windows of the day for samples, in hours; fixed values.
WINDOWS = ((22, 5), (7, 10), (11, 15), (16, 19))


def seconds(graph: Graph) -> list[Function]:
    return [(d / 1000.0, t / 1000.0) for d, t in graph.extra]


def corridor(graph: Graph, back: Graph, source: int, target: int) -> set[int]:
    """Nodes that lie on a path whose lower bound doesn't exceed the least upper bound from source to target."""
    low = [int(t.min()) for _, t in graph.extra]
    high = [int(t.max()) for _, t in graph.extra]
    low_back = [int(t.min()) for _, t in back.extra]
    out = graph.lists()
    most = next((d for v, d, _ in settle(out, [(source, 0)], lambda d, _, p: d + high[p]) if v == target), None)
    if most is None:
        return set()
    there = {v: d for v, d, _ in settle(out, [(source, 0)], lambda d, _, p: d + low[p])}
    return {v for v, d, _ in settle(back.lists(), [(target, 0)], lambda d, _, p: d + low_back[p]) if v in there and there[v] + d <= most}


def _spliced(old: list, new: list, first: list[tuple[float, bool]]) -> list:
    """Of two lists (valid from, path): the old one's paths where the flag is set, else the new one's."""
    times = sorted({t for t, _ in old} | {t for t, _ in new} | {t for t, _ in first})
    out: list = []
    at = [0, 0, 0]
    for t in times:
        for k, rows in enumerate((old, new, first)):
            while at[k] + 1 < len(rows) and rows[at[k] + 1][0] <= t:
                at[k] += 1
        path = (old if first[at[2]][1] else new)[at[0] if first[at[2]][1] else at[1]][1]
        if not out or out[-1][1] is not path:
            out.append((t, path))
    return out


def profile(out: list, functions: list[Function], nodes: Iterable[int], source: int, target: int, period: float):
    """(function, [(valid from, arc places)]) of the fastest paths for all departures, None without a path.

    Labels are functions; a node whose function improves anywhere passes it on, smallest lower bound first.
    """
    allowed = set(nodes)
    labels: dict = {source: (np.array([0.0]), np.array([0.0]), [(0.0, None)])}
    queue: list[tuple[float, int]] = [(0.0, source)]
    dirty = {source}
    while queue:
        _, v = heapq.heappop(queue)
        if v not in dirty:
            continue
        dirty.discard(v)
        if v == target:
            continue
        dep, tt, paths = labels[v]
        for head, _, place in out[v]:
            if head not in allowed or head == source:
                continue
            new = plf.link((dep, tt), functions[place], period)
            moved = [(t, (place, path)) for t, path in paths]
            if head in labels:
                old = labels[head]
                if new[1].min() >= old[1].max():
                    continue
                best, first = plf.merge(old[:2], new, period)
                if all(flag for _, flag in first):
                    continue
                labels[head] = (*best, _spliced(old[2], moved, first))
            else:
                labels[head] = (*new, moved)
            dirty.add(head)
            heapq.heappush(queue, (float(labels[head][1].min()), head))
    if target not in labels:
        return None
    dep, tt, paths = labels[target]
    rows: list[tuple[float, list[int]]] = []
    for t, path in paths:
        arcs = []
        while path is not None:
            arcs.append(path[0])
            path = path[1]
        arcs.reverse()
        if not rows or rows[-1][1] != arcs:
            rows.append((t, arcs))
    return (dep, tt), rows


PROFILES = "source long, target long, dep array<double>, tt array<double>, switches array<struct<valid_from: double, arcs: array<long>>>"


def _profile_row(g: Graph, back: Graph, out: list, functions: list[Function], s: int, t: int, period: int, window: tuple[float, float] | None) -> tuple:
    found = profile(out, functions, corridor(g, back, s, t), s, t, period / 1000)
    if found is None:
        return s, t, None, None, None
    f, switches = found
    if window:
        f = plf.crop(*f, *window, period / 1000)
        cuts = [b for _, b in zip(switches, [x[0] for x in switches[1:]] + [period / 1000], strict=True)]
        switches = [(max(a, window[0]), p) for (a, p), b in zip(switches, cuts, strict=True) if a <= window[1] and b > window[0]]
    return s, t, f[0].tolist(), f[1].tolist(), [{"valid_from": a, "arcs": [int(g.arc[i]) for i in p]} for a, p in switches]


def _profiles_in_regions(arcs: DataFrame, pairs: DataFrame, period: int, window: tuple[float, float] | None, store) -> DataFrame:
    """:func:`profiles` on the nodes whose least time from the source doesn't exceed the pair's least greatest time."""
    bounds = store(arcs.selectExpr("tail", "head", f"{plf.least('ttf')} AS low", f"{plf.most('ttf')} AS high"))
    pairs = pairs.select("source", "target").distinct()
    most = towards(bounds.selectExpr("tail", "head", "high AS weight"), pairs, store).withColumnRenamed("dist", "most")
    region = regions(bounds.selectExpr("tail", "head", "low AS weight"), most, store)
    own = inside(arcs.select("arc_id", "tail", "head", "weight", F.col("ttf.dep").alias("dep"), F.col("ttf.tt").alias("tt")), region, store)

    def work(key, pair: pd.DataFrame, frame: pd.DataFrame) -> pd.DataFrame:
        s, t = int(key[0]), int(key[1])
        # ids in rising order keep the order of ties
        names = np.unique(np.concatenate([frame["tail"].to_numpy(np.int64), frame["head"].to_numpy(np.int64), [s, t]]))
        at = lambda v: np.searchsorted(names, v)
        # a loop that no path takes makes room for both ends
        loops = at(np.array([s, t]))
        ends = [np.concatenate([at(frame[c].to_numpy(np.int64)), loops]) for c in ("tail", "head")]
        none = np.array([0]), np.array([INFINITY])
        extra = [(np.asarray(d), np.asarray(x)) for d, x in zip(frame["dep"], frame["tt"], strict=True)] + [none, none]
        g = Graph(*ends, *(np.concatenate([frame[c].to_numpy(np.int64), [INFINITY, INFINITY]]) for c in ("weight", "arc_id")), extra)
        row = _profile_row(g, g.transposed(), g.lists(), seconds(g), int(loops[0]), int(loops[1]), period, window)
        return pd.DataFrame([(s, t, *row[2:])], columns=["source", "target", "dep", "tt", "switches"])

    return pairs.groupBy("source", "target").cogroup(own.groupBy("source", "target")).applyInPandas(work, PROFILES)


def profiles(arcs: DataFrame, pairs: DataFrame, period: int = PERIOD, window: tuple[float, float] | None = None, store=None) -> DataFrame:
    """For ``pairs(source, target)`` the travel times (s) over the day and the paths with the departures from which they are best.

    ``window``: departures (s) to restrict to. Without a path the arrays are null; a node reaches itself at once.
    With ``store`` a task gets only the arcs that a pair's fastest paths may pass, found by joins on bounds.
    """
    if store:
        return _profiles_in_regions(arcs, pairs, period, window, store)
    graph = arcs.sparkSession.sparkContext.broadcast(collect(arcs))

    def work(frames):
        g = graph.value
        back, out, functions = g.transposed(), g.lists(), seconds(g)
        for frame in frames:
            rows = []
            for s, t in zip(frame["source"].tolist(), frame["target"].tolist(), strict=True):
                rows.append(_profile_row(g, back, out, functions, s, t, period, window))
            yield pd.DataFrame(rows, columns=["source", "target", "dep", "tt", "switches"])

    return _dealt(pairs.select("source", "target").distinct()).mapInPandas(work, PROFILES)


def live_step(points: list, live: list, period: int = PERIOD, pessimistic: bool = False):
    """The arrival after an arc of ``points`` (function by place), where ``live`` has (time, until) or None."""

    def step(at: int, _: int, place: int) -> int:
        p = value(*points[place], at % period)
        if live[place] is None:
            return at + p
        now, until = live[place]
        then = value(*points[place], until % period)
        if pessimistic:
            return at + (p if at >= until else max(p, min(now, then + until - at)))
        if at < until:
            return at + now
        return at + (max(now + until - at, 0, p) if then < now else min(now + at - until, p))

    return step


def live_of(arcs: DataFrame, g: Graph) -> list[tuple[int, int] | None]:
    """(live, until) of each place, None without a live time."""
    own = {r.arc_id: (r.live, r.until) for r in arcs.where("live IS NOT NULL").select("arc_id", "live", "until").toLocalIterator()}
    return [own.get(a) for a in g.arc.tolist()]


def _lists(frame: pd.DataFrame) -> list[tuple[list, list]]:
    known: dict[tuple[bytes, bytes], tuple[list, list]] = {}  # equal functions are common
    each = []
    for d, t in zip(frame["dep"], frame["tt"], strict=True):
        key = d.tobytes(), t.tobytes()
        if key not in known:
            known[key] = d.tolist(), t.tolist()
        each.append(known[key])
    return each


def live_arrivals(arcs: DataFrame, starts: DataFrame, period: int = PERIOD, pessimistic: bool = False, store=None, size: int = 50_000, parts: int = 1, limits: DataFrame | None = None) -> DataFrame:
    """``source, departure, node, travel_time`` with live times on ``arcs(..., ttf, live, until)`` (null: prediction only).

    By default a live time moves back to the prediction by one for each unit of time after ``until``;
    ``pessimistic``: before ``until`` it holds, or waiting for ``until``, but never less than predicted. With ``store``
    (as of :func:`search.by_cells`, like ``parts`` and ``limits``) no memory holds the graph.
    """
    if store:

        def step_of(frame: pd.DataFrame):
            live = [None if pd.isna(x) else (int(x), int(u)) for x, u in zip(frame["live"], frame["until"], strict=True)]
            return live_step(_lists(frame), live, period, pessimistic)

        found = by_cells(arcs, starts, step_of, store, size, *(("long", 10_000, parts, None, limits) if limits else ()))
        return found.select("source", "departure", "node", (F.col("at") - F.col("departure")).alias("travel_time"))
    g = collect(arcs)
    shared = arcs.sparkSession.sparkContext.broadcast((g, live_of(arcs, g)))

    def work(frames):
        graph, live = shared.value
        out = graph.lists()
        points = [(d.tolist(), t.tolist()) for d, t in graph.extra]

        step = live_step(points, live, period, pessimistic)
        for frame in frames:
            for s, t in zip(frame["source"].tolist(), frame["departure"].tolist(), strict=True):
                rows = [(s, t, node, at - t) for node, at, _ in settle(out, [(s, t)], step)]
                yield pd.DataFrame(rows, columns=["source", "departure", "node", "travel_time"])

    return _dealt(starts.select("source", "departure").distinct()).mapInPandas(work, "source long, departure long, node long, travel_time long")


def _float_step(points: list, period: int):
    def step(at: float, _: int, place: int) -> float:
        dep, tt = points[place]
        if len(dep) <= 2:
            return at + tt[0]
        x = at % period
        i = bisect.bisect_right(dep, x) - 1
        return at + (tt[i] + (x - dep[i]) * (tt[i + 1] - tt[i]) / (dep[i + 1] - dep[i]))

    return step


def float_arrivals(arcs: DataFrame, starts: DataFrame, period: int = PERIOD, store=None, size: int = 50_000) -> DataFrame:
    """``source, departure, node, travel_time, before`` with float functions (unrounded) for each of ``starts(source, departure)``.

    ``before``: the node from which each is reached, -1 at the source, so the rows are timed paths. With ``store``
    (as of :func:`search.by_cells`) no memory holds the graph.
    """
    if store:
        found = by_cells(arcs, starts, lambda frame: _float_step(_lists(frame), period), store, size, "double")
        return found.select("source", "departure", "node", (F.col("at") - F.col("departure")).alias("travel_time"), "before")
    graph = arcs.sparkSession.sparkContext.broadcast(collect(arcs))

    def work(frames):
        g = graph.value
        out = g.lists()
        step = _float_step([(d.tolist(), t.tolist()) for d, t in g.extra], period)
        for frame in frames:
            for s, t in zip(frame["source"].tolist(), frame["departure"].tolist(), strict=True):
                rows = [(s, t, node, at - t, b) for node, at, b in settle(out, [(s, float(t))], step)]
                yield pd.DataFrame(rows, columns=["source", "departure", "node", "travel_time", "before"])

    kind = "source long, departure long, node long, travel_time double, before long"
    return _dealt(starts.select("source", "departure").distinct()).mapInPandas(work, kind)


def path_times(arcs: DataFrame, paths: DataFrame, period: int = PERIOD) -> DataFrame:
    """``paths(qid, departure, arcs)`` with ``travel_time``, the integer functions of the arcs applied in a row."""
    graph = arcs.sparkSession.sparkContext.broadcast(collect(arcs))

    def work(frames):
        g = graph.value
        points = {a: (d.tolist(), t.tolist()) for a, (d, t) in zip(g.arc.tolist(), g.extra, strict=True)}
        for frame in frames:
            took = []
            for departure, path in zip(frame["departure"].tolist(), frame["arcs"], strict=True):
                at = departure
                for a in path.tolist():
                    at += value(*points[a], at % period)
                took.append(at - departure)
            yield frame[["qid", "departure"]].assign(travel_time=took)

    return paths.select("qid", "departure", "arcs").mapInPandas(work, "qid long, departure long, travel_time long")


def window_means(arcs: DataFrame, windows: tuple = WINDOWS, period: int = PERIOD) -> DataFrame:
    """``arc_id, w0, w1, ...``: mean travel times in windows of the day (hours); a window may pass midnight."""
    hour = period // 24

    def mean(a: int, b: int) -> str:
        if a < b:
            return plf.average("ttf", f"{a * hour}L", f"{b * hour}L")
        late, early = plf.average("ttf", f"{a * hour}L", f"{period}L"), plf.average("ttf", "0L", f"{b * hour}L")
        return f"({late} * {24 - a} + {early} * {b}) div {24 - a + b}"

    return arcs.selectExpr("arc_id", *[f"{mean(a, b)} AS w{i}" for i, (a, b) in enumerate(windows)])


def sampled(arcs: DataFrame, trips: DataFrame, windows: tuple = WINDOWS, period: int = PERIOD) -> DataFrame:
    """``trips(qid, source, target, departure)`` with ``travel_time`` on the union of each window's shortest paths.

    A heuristic: the best of what the samples use, never less than the true time; null without a path.
    """
    g = collect(arcs)
    means = window_means(arcs, windows, period).toPandas().set_index("arc_id").loc[g.arc]
    shared = arcs.sparkSession.sparkContext.broadcast((g, [means[f"w{i}"].to_numpy() for i in range(len(windows))]))

    def work(frames):
        graph, metrics = shared.value
        out = graph.lists()
        points = [(d.tolist(), t.tolist()) for d, t in graph.extra]
        for frame in frames:
            took = []
            for s, t, departure in zip(frame["source"].tolist(), frame["target"].tolist(), frame["departure"].tolist(), strict=True):
                steps: dict[int, set[int]] = {}
                for metric in metrics:
                    before = {}
                    for v, _, b in settle(out, [(s, 0)], lambda d, _, p, m=metric: d + int(m[p])):
                        before[v] = b
                        if v == t:
                            break
                    v = t if t in before else s
                    while v != s:
                        steps.setdefault(before[v], set()).add(v)
                        v = before[v]
                own = {v: [x for x in out[v] if x[0] in heads] for v, heads in steps.items()}
                part = [own.get(v, ()) for v in range(len(out))]
                reached = settle(part, [(s, departure)], lambda at, _, p: at + value(*points[p], at % period))
                took.append(next((at - departure for v, at, _ in reached if v == t), None))
            yield frame.assign(travel_time=pd.array(took, "Int64"))

    return trips.select("qid", "source", "target", "departure").mapInPandas(work, "qid long, source long, target long, departure long, travel_time long")


def range_minima(arcs: DataFrame, ranges: DataFrame, period: int = PERIOD) -> DataFrame:
    """``arc_id, start, length, weight``: least travel time of each arc in each of few ``ranges(start, length)`` within the day.

    The metrics of potentials for ranges. An arc meets all ranges at once in arrays, which took less time than
    searching its points in an expression for each pair.
    """
    rows = ranges.select("start", "length").limit(10_001).collect()
    if len(rows) > 10_000:
        raise ValueError("more than 10000 ranges")
    start, length = (np.array([r[k] for r in rows], np.int64) for k in range(2))
    end = start + length

    def work(frames):
        ends = np.concatenate([start, end]) % period
        for frame in frames:
            least = []
            for dep, tt in zip(frame["dep"], frame["tt"], strict=True):
                if len(dep) <= 2:
                    least.append(np.full(len(start), tt[0], np.int64))
                    continue
                i = np.searchsorted(dep, ends, "right") - 1
                arrive = dep + tt
                at = arrive[i] + (ends - dep[i]) * (arrive[i + 1] - arrive[i]) // (dep[i + 1] - dep[i]) - ends
                inside = np.where((dep >= start[:, None]) & (dep <= end[:, None]), tt, INFINITY).min(axis=1)
                least.append(np.minimum(inside, np.minimum(at[: len(start)], at[len(start) :])))
            n = len(frame)
            yield pd.DataFrame({"arc_id": np.repeat(frame["arc_id"].to_numpy(), len(start)), "start": np.tile(start, n), "length": np.tile(length, n), "weight": np.concatenate(least) if least else []})

    points = arcs.selectExpr("arc_id", "ttf.dep AS dep", "ttf.tt AS tt")
    return points.mapInPandas(work, "arc_id long, start long, length long, weight long")


class FunctionHierarchy:
    """A hierarchy whose arcs carry travel-time functions (s), exact for every departure."""

    def __init__(self, own: Hierarchy, tail: np.ndarray, head: np.ndarray, functions: list[Function], period: float):
        self.own, self.period = own, period
        self.up: list[dict[int, Function]] = [{} for _ in own.upper]
        self.down: list[dict[int, Function]] = [{} for _ in own.upper]
        for a, b, f in zip(own.rank[tail].tolist(), own.rank[head].tolist(), functions, strict=True):
            if a != b:
                self._put(a, b, f)
        for v, u in enumerate(own.upper):
            for a in u:
                for b in u:
                    if a != b and a in self.down[v] and b in self.up[v]:
                        self._put(a, b, plf.link(self.down[v][a], self.up[v][b], period))

    def _put(self, a: int, b: int, f: Function) -> None:
        """The function from a to b becomes the smaller of its own and ``f``."""
        side, low, high = (self.up, a, b) if a < b else (self.down, b, a)
        known = side[low].get(high)
        if known is None or f[1].max() <= known[1].min():
            side[low][high] = f
        elif f[1].min() < known[1].max():
            side[low][high] = plf.merge(known, f, self.period)[0]

    def _ancestors(self, v: int) -> list[int]:
        out = [v]
        while self.own.parent[out[-1]] >= 0:
            out.append(int(self.own.parent[out[-1]]))
        return out

    def travel_time(self, source: int, target: int, departure: float) -> float | None:
        """Up along the ancestors of the source, down to the target along its own."""
        s, t = int(self.own.rank[source]), int(self.own.rank[target])
        at = {s: departure}
        for v in self._ancestors(s):
            if v in at:
                for b, f in self.up[v].items():
                    x = at[v] + float(plf.evaluate(*f, at[v], self.period))
                    at[b] = min(at.get(b, x), x)
        for v in reversed(self._ancestors(t)):
            for b, f in self.down[v].items():
                if b in at:
                    x = at[b] + float(plf.evaluate(*f, at[b], self.period))
                    at[v] = min(at.get(v, x), x)
        return at[t] - departure if t in at else None

    def bucket_minima(self, buckets: int) -> list[tuple[int, int, int, float]]:
        """(from, to, bucket, least travel time) of every arc (ranks) in equal parts of the period."""
        size = self.period / buckets
        return [
            (a, b, k, float(plf.crop(*f, k * size, (k + 1) * size, self.period)[1].min()))
            for side, turned in ((self.up, False), (self.down, True))
            for low, arcs in enumerate(side)
            for high, f in arcs.items()
            for a, b in [(high, low) if turned else (low, high)]
            for k in range(buckets)
        ]


def pareto(arcs: DataFrame, trips: DataFrame, cost: str) -> DataFrame:
    """``qid, dist, cost`` of all paths that no other path matches in both sums; ``cost``: a column of ``arcs``."""
    check_size(arcs)
    p = arcs.select("arc_id", "tail", "head", "weight", F.col(cost).cast("long").alias("cost")).toPandas()
    g = Graph(*(p[c].to_numpy(np.int64) for c in ("tail", "head", "weight", "arc_id")))
    by_id = dict(zip(p["arc_id"].tolist(), p["cost"].tolist(), strict=True))
    shared = arcs.sparkSession.sparkContext.broadcast((g, [by_id[a] for a in g.arc.tolist()]))

    def work(frames):
        graph, costs = shared.value
        out = graph.lists()
        for frame in frames:
            rows = []
            for q, s, t in zip(frame["qid"].tolist(), frame["source"].tolist(), frame["target"].tolist(), strict=True):
                rows += [(q, d, c) for d, c in pareto_labels(out, costs, s, t)]
            yield pd.DataFrame(rows, columns=["qid", "dist", "cost"]).astype("int64")

    return trips.select("qid", "source", "target").mapInPandas(work, "qid long, dist long, cost long")


def pareto_labels(out: list, costs: list[int], source: int, target: int) -> list[tuple[int, int]]:
    """Labels come out by (distance, cost); at a node only one with a smaller cost than all before is new."""
    least: dict[int, int] = {}
    queue = [(0, 0, source)]
    found = []
    while queue:
        d, c, v = heapq.heappop(queue)
        if c >= min(least.get(v, INFINITY), least.get(target, INFINITY)):
            continue
        least[v] = c
        if v == target:
            found.append((d, c))
            continue
        for head, weight, place in out[v] if v < len(out) else ():
            if head != v and c + costs[place] < least.get(head, INFINITY):
                heapq.heappush(queue, (d + weight, c + costs[place], head))
    return found

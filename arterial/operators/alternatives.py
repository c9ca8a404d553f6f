"""Alternative and traffic-aware paths: kernels for one query each, and the batches of them in Spark tasks.

A path is a list of nodes. Smooth weights are what drivers know, live ones what they meet.
"""

from __future__ import annotations

import heapq
import time
from collections import deque
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import PERIOD
from .search import _dealt, by_cells, check_size, collect, Graph, settle, value

# Fixed values of the penalty method.
STRETCH, PENALTY, REJOIN, MOST_PENALTIES, NEW_SHARE, MOST_PATHS = 1.25, (11, 10), 100, 5, 5, 5
#: Milliseconds for a traffic-aware query; None sets no limit.
TIME_LIMIT_MS = 10_000


def shortest(out: list, source: int, target: int, step=None, allowed: set[int] | None = None, start: int = 0) -> tuple[int, list[int]] | None:
    """(label at the target, nodes); the source has the label ``start``."""
    before = {}
    part = out if allowed is None else [[x for x in out[v] if x[0] in allowed] if v in allowed else [] for v in range(len(out))]
    for v, d, b in settle(part, [(source, start)], step):
        before[v] = b
        if v == target:
            path = [v]
            while path[-1] != source:
                path.append(before[path[-1]])
            return d, path[::-1]
    return None


def _cheapest(out: list, weight: list[int], a: int, b: int) -> int:
    return min((weight[p], p) for h, _, p in out[a] if h == b)[1]


def penalty_paths(out: list, back: list, weight: list[int], source: int, target: int) -> list[list[int]] | None:
    """Up to five alternatives to the shortest path, each with more than a fifth of its length on new arcs.

    Arcs of the last path cost a tenth more, arcs that leave or rejoin it a share of the distance that
    grows along it; a node causes penalties five times at most. Only nodes on some path of up to 1.25
    times the distance take part. None: there is no path; the shortest path itself isn't listed.
    ``back[v]``: (tail, place) of the arcs into v.
    """
    now = list(weight)
    step = lambda d, _, p: d + now[p]
    first = shortest(out, source, target, step)
    if first is None:
        return None
    base, path = first
    longest, rejoin = int(base * STRETCH), base // REJOIN
    cap = int(base * STRETCH * PENALTY[0] / PENALTY[1]) + 2 * rejoin
    there = {v: d for v, d, _ in settle(out, [(source, 0)], lambda d, _, p: d + weight[p])}
    here = {v: d for v, d, _ in settle([[(t, 0, p) for t, p in x] for x in back], [(target, 0)], lambda d, _, p: d + weight[p])}
    allowed = {v for v, d in there.items() if v in here and d + here[v] <= longest}
    arcs = [_cheapest(out, now, a, b) for a, b in zip(path, path[1:], strict=False)]
    used = set(arcs)
    times: dict[int, int] = {}
    found: list[list[int]] = []
    while True:
        fresh = lambda v: times.get(v, 0) < MOST_PENALTIES
        for (a, b), p in zip(zip(path, path[1:], strict=False), arcs, strict=True):
            if fresh(a) or fresh(b):
                now[p] = now[p] * PENALTY[0] // PENALTY[1]
        along = np.concatenate([[0], np.cumsum([now[p] for p in arcs])]).tolist()
        for i, (a, b) in enumerate(zip(path, path[1:], strict=False)):
            if fresh(b):
                for t, p in back[b]:
                    if t != a:
                        now[p] += rejoin * along[i + 1] // max(along[-1], 1)
            if fresh(a):
                for h, _, p in out[a]:
                    if h != b:
                        now[p] += rejoin * along[i] // max(along[-1], 1)
        penalized = [v for v in path if fresh(v)]
        for v in penalized:
            times[v] = times.get(v, 0) + 1
        if not penalized:
            return found
        again = shortest(out, source, target, step, allowed)
        if again is None or again[0] > cap:
            return found
        path = again[1]
        arcs = [_cheapest(out, now, a, b) for a, b in zip(path, path[1:], strict=False)]
        length = sum(weight[p] for p in arcs)
        if sum(weight[p] for p in arcs if p not in used) > length // NEW_SHARE:
            found.append(path)
            used.update(arcs)
        if len(found) >= MOST_PATHS or length > longest:
            return found


def graph_statistics(out: list, weight: list[int], paths: list[list[int]]) -> tuple[float, float, int]:
    """(total distance, average distance, decision arcs) of the graph that the paths (the shortest one first) form.

    Total: sum of each arc's share of the shortest way through it inside that graph; average: arcs'
    lengths over total times the distance; decisions: arcs beyond the first that leave a node.
    """
    own = {_cheapest(out, weight, a, b): (a, b) for path in paths for a, b in zip(path, path[1:], strict=False)}
    n = len(out)
    fw: list[list] = [[] for _ in range(n)]
    bw: list[list] = [[] for _ in range(n)]
    for p, (a, b) in own.items():
        fw[a].append((b, weight[p], p))
        bw[b].append((a, weight[p], p))
    s, t = paths[0][0], paths[0][-1]
    to = {v: d for v, d, _ in settle(fw, [(s, 0)])}
    rest = {v: d for v, d, _ in settle(bw, [(t, 0)])}
    total = sum(weight[p] / (to[a] + weight[p] + rest[b]) for p, (a, b) in own.items() if to[a] + weight[p] + rest[b])
    average = sum(weight[p] for p in own) / (total * rest[s]) if total and rest[s] else 1.0
    return total, average, sum(len(x) - 1 for v, x in enumerate(fw) if x and v != t)


def violations(path: list[int], along: list[int], far: Callable[[int], dict[int, int]], eps: float) -> list[tuple[int, int]]:
    """Minimal subpaths (first, last place) longer than (1 + eps) times the shortest distance ``far(node)[other]``; a cycle is one."""
    bad: list[tuple[int, int]] = []
    for i in range(len(path) - 1, -1, -1):
        dist = far(path[i])
        end = bad[-1][1] if bad else len(path)
        # a later start with the same or an earlier end lies inside
        for j in range(i + 1, end):
            d = dist[path[j]]
            if along[j] - along[i] - d > int(d * eps):
                bad.append((i, j))
                break
    return bad[::-1]


class Forbidden:
    """A matcher of forbidden node sequences: states are their prefixes, and a step that completes one is refused.

    A search over (node, state) finds the best walk that contains none of them.
    """

    def __init__(self, paths: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.fail = [0]
        self.ends = [False]
        for path in paths:
            at = 0
            for v in path:
                if v not in self.next[at]:
                    self.next[at][v] = len(self.next)
                    self.next.append({})
                    self.fail.append(0)
                    self.ends.append(False)
                at = self.next[at][v]
            self.ends[at] = True
        queue = deque(self.next[0].values())
        while queue:
            at = queue.popleft()
            for v, to in self.next[at].items():
                self.fail[to] = self.step(self.fail[at], v)
                queue.append(to)
            self.ends[at] |= self.ends[self.fail[at]]

    def step(self, state: int, node: int) -> int:
        while state and node not in self.next[state]:
            state = self.fail[state]
        return self.next[state].get(node, 0)


def avoiding(out: list, step: Callable[[int, int, int], int], forbidden: Forbidden, source: int, target: int, start: int = 0) -> tuple[int, list[int]] | None:
    """(label, nodes) of the best walk without a forbidden sequence, as a search over pairs of node and state."""
    first = (source, forbidden.step(0, source))
    best = {first: start}
    before: dict = {first: None}
    queue = [(start, *first)]
    done = set()
    while queue:
        d, v, state = heapq.heappop(queue)
        if (v, state) in done:
            continue
        done.add((v, state))
        if v == target:
            path, at = [], (v, state)
            while at is not None:
                path.append(at[0])
                at = before[at]
            return d, path[::-1]
        for head, weight, place in out[v]:
            to = forbidden.step(state, head)
            t = step(d, weight, place)
            if not forbidden.ends[to] and t < best.get((head, to), t + 1):
                best[head, to] = t
                before[head, to] = (v, state)
                heapq.heappush(queue, (t, head, to))
    return None


def avoiding_detours(out: list, step: Callable[[int, int, int], int], forbidden: list[list[int]], source: int, target: int, start: int = 0) -> tuple[int, list[int]] | None:
    """Like :func:`avoiding` with one label for each node: an arc is refused if it completes a forbidden sequence along the
    present predecessors. Faster, but it may miss a walk."""
    ending: dict[int, list[list[int]]] = {}
    for path in forbidden:
        ending.setdefault(path[-1], []).append(path[-2::-1])
    best, before = {source: start}, {source: -1}
    queue = [(start, source)]
    while queue:
        d, v = heapq.heappop(queue)
        if d > best[v]:
            continue
        if v == target:
            path = [v]
            while before[path[-1]] >= 0 and len(path) <= len(best):
                path.append(before[path[-1]])
            return d, path[::-1]
        for head, weight, place in out[v]:
            t = step(d, weight, place)
            if t >= best.get(head, t + 1) or any(_follows(before, v, path) for path in ending.get(head, ())):
                continue
            best[head], before[head] = t, v
            heapq.heappush(queue, (t, head))
    return None


def _follows(before: dict[int, int], v: int, backwards: list[int]) -> bool:
    for w in backwards:
        if v != w:
            return False
        v = before.get(v, -1)
    return True


class Traffic:
    """Traffic-aware queries on one graph: ``smooth`` weights by place; live labels by ``step`` (by default ``live`` weights)."""

    def __init__(self, out: list, smooth: list[int], live: list[int], step: Callable[[int, int, int], int] | None = None):
        self.out, self.smooth, self.live = out, smooth, live
        self.step = step or (lambda d, _, p: d + live[p])
        self.known = lambda d, _, p: d + smooth[p]
        self.cache: dict[int, dict[int, int]] = {}
        #: The longest path looked at, by smooth weights.
        self.longest = 0

    def far(self, v: int) -> dict[int, int]:
        if v not in self.cache:
            self.cache[v] = {w: d for w, d, _ in settle(self.out, [(v, 0)], self.known)}
        return self.cache[v]

    def along(self, path: list[int], smooth: bool = True) -> list[int]:
        """Cumulated weights, the cheapest of parallel arcs each."""
        weight = self.smooth if smooth else self.live
        out = [0]
        for a, b in zip(path, path[1:], strict=False):
            out.append(out[-1] + weight[_cheapest(self.out, weight, a, b)])
        return out

    def label(self, path: list[int], start: int = 0) -> int:
        """The live label at the end of ``path``."""
        for a, b in zip(path, path[1:], strict=False):
            start = min(self.step(start, w, p) for h, w, p in self.out[a] if h == b)
        return start

    def bad(self, path: list[int], eps: float) -> list[tuple[int, int]]:
        along = self.along(path)
        self.longest = max(self.longest, along[-1])
        return violations(path, along, self.far, eps)

    def blocked(self, source: int, target: int, eps: float, limit_ms: float | None = TIME_LIMIT_MS, start: int = 0, detours: bool = False):
        """(label, path, rounds, done): best live paths, forbidding their bad subpaths, until one has none.

        ``done`` is false when time runs out, or when nothing is left that avoids them: the last path is returned.
        """
        began = time.monotonic()
        forbidden: list[list[int]] = []
        last = None
        rounds = 0
        while True:
            if detours:
                found = avoiding_detours(self.out, self.step, forbidden, source, target, start)
            else:
                found = avoiding(self.out, self.step, Forbidden(forbidden), source, target, start)
            if found is None:
                return (*last, rounds, False) if last else None
            last = found
            rounds += 1
            bad = [found[1][a : b + 1] for a, b in self.bad(found[1], eps)]
            if not bad:
                return (*found, rounds, True)
            new = [p for p in bad if p not in forbidden]
            if not new or (limit_ms is not None and (time.monotonic() - began) * 1000 > limit_ms):
                return (*found, rounds, False)
            forbidden += new

    def fixed(self, path: list[int], eps: float, limit_ms: float | None = TIME_LIMIT_MS) -> tuple[list[int], bool]:
        """``path`` with bad subpaths (from the left, without overlap) replaced by shortest ones until none is left."""
        began = time.monotonic()
        while bad := self.bad(path, eps):
            if limit_ms is not None and (time.monotonic() - began) * 1000 > limit_ms:
                return path, False
            out, until = [], 0
            for a, b in bad:
                if a >= until:
                    out += path[until:a] + shortest(self.out, path[a], path[b], self.known)[1][:-1]
                    until = b
            path = out + path[until:]
        return path, True


def _shared(arcs: DataFrame, live: str | None):
    check_size(arcs)
    p = arcs.select("arc_id", "tail", "head", "weight", *([live] if live else [])).toPandas()
    g = Graph(*(p[c].to_numpy(np.int64) for c in ("tail", "head", "weight", "arc_id")))
    order = np.lexsort((p["arc_id"].to_numpy(), p["tail"].to_numpy()))
    return arcs.sparkSession.sparkContext.broadcast((g, p[live].to_numpy(np.int64)[order].tolist() if live else None))


def alternatives(arcs: DataFrame, trips: DataFrame) -> DataFrame:
    """``qid, nth, dist, path`` for ``trips(qid, source, target)``: the shortest path (nth 0) and its alternatives."""
    shared = _shared(arcs, None)

    def work(frames):
        g, _ = shared.value
        out, weight = g.lists(), g.weight.tolist()
        back: list[list[tuple[int, int]]] = [[] for _ in out]
        for v, x in enumerate(out):
            for head, _, p in x:
                back[head].append((v, p))
        for frame in frames:
            rows = []
            for q, s, t in zip(frame["qid"].tolist(), frame["source"].tolist(), frame["target"].tolist(), strict=True):
                found = penalty_paths(out, back, weight, s, t)
                if found is not None:
                    all_paths = [shortest(out, s, t)[1], *found]
                    rows += [(q, i, sum(weight[_cheapest(out, weight, a, b)] for a, b in zip(x, x[1:], strict=False)), x) for i, x in enumerate(all_paths)]
            yield pd.DataFrame(rows, columns=["qid", "nth", "dist", "path"])

    return _dealt(trips.select("qid", "source", "target")).mapInPandas(work, "qid long, nth int, dist long, path array<long>")


HOW = ("blocking", "detours", "fixing", "smooth")


def traffic_aware(arcs: DataFrame, trips: DataFrame, live: str, eps: float, how: str = "blocking", limit_ms: float | None = TIME_LIMIT_MS, store: Callable[..., DataFrame] | None = None) -> DataFrame:
    """``qid, live_dist, path, done`` for ``trips``; smooth weights in ``weight``, live ones in the column ``live``.

    ``how``: block bad subpaths (exact), block detours (heuristic), fix the live path, or take the smooth path.
    ``store``: no memory holds the graph, a task gets what lies around a source (:func:`_around`).
    """
    if how not in HOW:
        raise ValueError(f"{how} is none of {HOW}")
    if store:
        return _around(arcs, trips, live, eps, how, limit_ms, store)
    shared = _shared(arcs, live)

    def work(frames):
        g, now = shared.value
        own = Traffic(g.lists(), g.weight.tolist(), now)
        for frame in frames:
            rows = []
            for q, s, t in zip(frame["qid"].tolist(), frame["source"].tolist(), frame["target"].tolist(), strict=True):
                found = _answer(own, s, t, eps, how, limit_ms)
                if found:
                    rows.append((q, *found))
            yield pd.DataFrame(rows, columns=["qid", "live_dist", "path", "done"])

    return _dealt(trips.select("qid", "source", "target")).mapInPandas(work, "qid long, live_dist long, path array<long>, done boolean")


def _answer(own: Traffic, source: int, target: int, eps: float, how: str, limit_ms: float | None) -> tuple[int, list[int], bool] | None:
    """(live distance, path, done) of one trip."""
    if how in ("blocking", "detours"):
        found = own.blocked(source, target, eps, limit_ms, detours=how == "detours")
        return found and (found[0], found[1], found[3])
    found = shortest(own.out, source, target, own.known if how == "smooth" else own.step)
    if not found:
        return None
    path, done = own.fixed(found[1], eps, limit_ms) if how == "fixing" else (found[1], True)
    own.longest = max(own.longest, found[0], own.along(path)[-1])
    return own.along(path, smooth=False)[-1], path, done


def _around(arcs: DataFrame, trips: DataFrame, live: str, eps: float, how: str, limit_ms: float | None, store: Callable[..., DataFrame], first: int | None = None) -> DataFrame:
    """:func:`traffic_aware` where a source's task gets the nodes within a bound by the smaller of both weights, found by cells.

    Labels up to the bound are settled before any other, and no part of a path that long, nor a shorter way between two of its
    nodes, leaves these nodes. So an answer whose live label and whose paths' smooth lengths keep to the bound is that on the
    whole graph, ties included; other trips are asked again with twice the bound, until no arc leaves the nodes. A bound
    starts at ``first``, by default 64 mean weights.
    """
    arcs = arcs.select("arc_id", "tail", "head", "weight", F.col(live).alias("live"))
    least = arcs.select("arc_id", "tail", "head", F.least("weight", "live").alias("weight"))
    most = first or 1 + int(64 * (least.agg(F.avg("weight")).first()[0] or 0))
    open_ = store(trips.select("qid", "source", "target"))
    answered = None
    while not open_.isEmpty():
        starts = open_.select("source", F.lit(0).cast("long").alias("departure"))
        near = store(by_cells(least, starts, lambda _: lambda d, w, p: d + w, store, most=most, parts=8).select("source", "node"))
        inside = near.select("source", F.col("node").alias("head"), F.lit(True).alias("inside"))
        own = store(arcs.join(near.withColumnRenamed("node", "tail"), "tail").join(inside, ["source", "head"], "left"))

        def work(asked: pd.DataFrame, rows: pd.DataFrame, most: int = most) -> pd.DataFrame:
            whole = bool(rows["inside"].notna().all())
            p = rows[rows["inside"].notna()].sort_values(["tail", "arc_id"])
            ids = np.unique(np.concatenate([p["tail"], p["head"], asked["source"], asked["target"]]).astype(np.int64))
            place = lambda c: np.searchsorted(ids, c.to_numpy(np.int64))
            g = Graph(place(p["tail"]), place(p["head"]), p["weight"].to_numpy(np.int64), p["arc_id"].to_numpy(np.int64))
            traffic = Traffic(g.lists() + [[] for _ in range(len(ids) - g.n)], g.weight.tolist(), p["live"].tolist())
            out = []
            for q, s, t in zip(asked["qid"].tolist(), place(asked["source"]).tolist(), place(asked["target"]).tolist(), strict=True):
                traffic.longest = 0
                found = _answer(traffic, s, t, eps, how, limit_ms)
                # nothing left that avoids what is forbidden: there may be more outside
                sure = whole or bool(found and found[2] and max(found[0], traffic.longest) <= most)
                out.append((q, found[0], ids[found[1]].tolist(), found[2], sure) if found else (q, None, None, None, sure))
            return pd.DataFrame(out, columns=["qid", "live_dist", "path", "done", "sure"]).astype({"live_dist": "Int64", "done": "boolean"})

        asked = open_.groupBy("source").cogroup(own.groupBy("source"))
        found = store(asked.applyInPandas(lambda t, f: work(t, f) if len(t) else pd.DataFrame({c: [] for c in ("qid", "live_dist", "path", "done", "sure")}), "qid long, live_dist long, path array<long>, done boolean, sure boolean"))
        ready = found.where("sure AND path IS NOT NULL").drop("sure")
        answered = ready if answered is None else answered.union(ready)
        open_ = store(open_.join(found.where("NOT sure").select("qid"), "qid", "left_semi"))
        most *= 2
    return answered if answered is not None else open_.selectExpr("qid", "0L AS live_dist", "array(0L) AS path", "true AS done")


def td_traffic_aware(arcs: DataFrame, trips: DataFrame, eps: float, how: str = "blocking", limit_ms: float | None = TIME_LIMIT_MS, period: int = PERIOD) -> DataFrame:
    """:func:`traffic_aware` at the time of day: ``arcs(..., weight, ttf)``, ``trips(qid, source, target, departure)``; ``live_dist`` is the travel time."""
    if how not in HOW:
        raise ValueError(f"{how} is none of {HOW}")
    shared = arcs.sparkSession.sparkContext.broadcast(collect(arcs))

    def work(frames):
        g = shared.value
        points = [(d.tolist(), t.tolist()) for d, t in g.extra]
        own = Traffic(g.lists(), g.weight.tolist(), [], lambda at, _, p: at + value(*points[p], at % period))
        for frame in frames:
            rows = []
            for q, s, t, start in zip(*(frame[c].tolist() for c in ("qid", "source", "target", "departure")), strict=True):
                if how in ("blocking", "detours"):
                    found = own.blocked(s, t, eps, limit_ms, start, how == "detours")
                    if found:
                        rows.append((q, found[0] - start, found[1], found[3]))
                    continue
                found = shortest(own.out, s, t, own.known if how == "smooth" else own.step, start=0 if how == "smooth" else start)
                if found:
                    path, done = own.fixed(found[1], eps, limit_ms) if how == "fixing" else (found[1], True)
                    rows.append((q, own.label(path, start) - start, path, done))
            yield pd.DataFrame(rows, columns=["qid", "live_dist", "path", "done"])

    return _dealt(trips.select("qid", "source", "target", "departure")).mapInPandas(work, "qid long, live_dist long, path array<long>, done boolean")

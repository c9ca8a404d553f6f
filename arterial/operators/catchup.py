"""Time-dependent queries over a hierarchy of bounds: corridor by elimination-tree walk, exact search inside it.

The hierarchy is customized twice, with each arc's least and greatest travel time. A walk over the ancestors of both ends
gives every hub a pair (least, greatest); hubs whose least exceeds the smallest greatest total can't lie on a fastest path.
What is left bounds the exact search on the functions themselves, whose potential is the distance under the least times.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import plf
from ..schema import PERIOD
from . import hierarchy
from .hierarchy import INFINITY, Hierarchy, lower_neighbours
from .lazy import TargetDistances
from .graph import reversed_arcs
from .search import Step, _dealt, by_cells, collect, settle, value
from .td import _lists, live_arrivals, live_of, live_step


def bound_metrics(arcs: DataFrame, nodes: DataFrame) -> tuple[Hierarchy, tuple[list, list], tuple[list, list]]:
    """The hierarchy of ``arcs(..., ttf)`` and its weights for the least and for the greatest travel times."""
    low = arcs.selectExpr("arc_id", "tail", "head", f"{plf.least('ttf')} AS weight")
    high = arcs.selectExpr("arc_id", "tail", "head", f"{plf.most('ttf')} AS weight")
    own, lows = hierarchy.build(low, nodes)
    return own, lows, hierarchy.build(high, nodes)[1]


def corridor(own: Hierarchy, lows: tuple[list, list], highs: tuple[list, list], source: int, target: int) -> tuple[int, list[int]] | None:
    """(greatest travel time, ranks of the hubs that a fastest path may pass), None without a path."""
    s, t = int(own.rank[source]), int(own.rank[target])
    low = [dict(own.label(w, v)) for w, v in zip(lows, (s, t), strict=True)]
    high = [dict(own.label(w, v)) for w, v in zip(highs, (s, t), strict=True)]
    most = min((high[0][h] + high[1][h] for h in high[0].keys() & high[1].keys()), default=None)
    if most is None:
        return None
    return most, sorted(h for h in low[0].keys() & low[1].keys() if low[0][h] + low[1][h] <= most)


def fastest(out: list, step: Step, potential: TargetDistances, source: int, target: int, departure: int, most: int) -> tuple[int, list[tuple[int, int]]] | None:
    """(travel time, [(node, time)]) of the fastest path that takes at most ``most``; ``step``: the arrival after an arc."""

    def allowed(node: int) -> int | None:
        d = potential(node)
        return d if d is not None and d <= most else None

    before: dict[int, tuple[int, int]] = {}
    for node, at, b in settle(out, [(source, departure)], step, allowed):
        before[node] = (b, at)
        if node == target:
            path = [(node, at)]
            while path[-1][0] != source:
                p = before[path[-1][0]][0]
                path.append((p, before[p][1]))
            return at - departure, path[::-1]
        if at - departure > most:
            break
    return None


def queries(arcs: DataFrame, nodes: DataFrame, trips: DataFrame, period: int = PERIOD) -> DataFrame:
    """``trips(qid, source, target, departure)`` with ``travel_time, n_hubs, path`` (node, at); null without a path."""
    own, lows, highs = bound_metrics(arcs, nodes)
    shared = arcs.sparkSession.sparkContext.broadcast((collect(arcs), own, lows, highs))

    def work(frames):
        g, h, low, high = shared.value
        out = g.lists()
        points = [(d.tolist(), t.tolist()) for d, t in g.extra]
        to = TargetDistances(h, low)

        def step(at: int, _: int, place: int) -> int:
            return at + value(*points[place], at % period)

        for frame in frames:
            rows = []
            for q, s, t, departure in zip(*(frame[c].tolist() for c in ("qid", "source", "target", "departure")), strict=True):
                bounds = corridor(h, low, high, s, t)
                found = fastest(out, step, to.aim(t), s, t, departure, bounds[0]) if bounds else None
                path = [{"node": v, "at": at} for v, at in found[1]] if found else None
                rows.append((q, s, t, departure, found and found[0], len(bounds[1]) if bounds else 0, path))
            frame = pd.DataFrame(rows, columns=["qid", "source", "target", "departure", "travel_time", "n_hubs", "path"])
            yield frame.astype({"travel_time": "Int64"})

    kind = "qid long, source long, target long, departure long, travel_time long, n_hubs long, path array<struct<node: long, at: long>>"
    dealt = _dealt(trips.select("qid", "source", "target", "departure")).sortWithinPartitions("target")
    return dealt.mapInPandas(work, kind)


def live_queries(arcs: DataFrame, nodes: DataFrame, trips: DataFrame, now: int, window: int = 3_540_000, smooth: bool = False, period: int = PERIOD, store=None, size: int = 50_000, parts: int = 6) -> DataFrame:
    """``trips(qid, source, target)`` that leave at ``now`` with ``travel_time`` on ``arcs(..., ttf, live, until)``; null without a path.

    Two metrics bound live times from below: over the next ``window`` and over the whole day. A trip whose upper bound ends
    within the window takes the closer one as its potential. The upper bound is the distance by greatest times (live ones
    too), or with ``smooth`` the live time of the path that is shortest by the least predicted times. With ``smooth`` and ``store`` (as of :func:`search.by_cells`) no memory
    holds the graph: trips of one source share their searches.
    """
    floor = lambda least: f"least(coalesce(live, {INFINITY}L), {least})"
    soon = plf.extreme_in_range("ttf", f"{now % period}L", f"{(now + window) % period}L")
    if smooth and store:
        return _live_in_cells(arcs, trips, now, window, floor(plf.least("ttf")), floor(soon), period, store, size, parts)
    metrics = [floor(plf.least("ttf")), floor(soon), f"greatest(coalesce(live, 0L), {plf.most('ttf')})", plf.least("ttf")]
    built = [hierarchy.build(arcs.selectExpr("arc_id", "tail", "head", f"{m} AS weight"), nodes) for m in metrics]
    own = built[0][0]
    g = collect(arcs)
    shared = arcs.sparkSession.sparkContext.broadcast((g, live_of(arcs, g), own, [w for _, w in built]))

    def work(frames):
        g, live, h, (day, near, high, predicted) = shared.value
        out = g.lists()
        step = live_step([(d.tolist(), t.tolist()) for d, t in g.extra], live, period)
        potentials = TargetDistances(h, day), TargetDistances(h, near)
        above, calm = TargetDistances(h, high), TargetDistances(h, predicted)
        lower = lower_neighbours(h) if smooth else []

        def bound(s: int, t: int) -> int | None:
            if not smooth:
                return above.aim(t)(s)
            path = calm.aim(t).path(s, lower)
            at = now
            for a, b in zip(path or [], (path or [])[1:], strict=False):
                at = min(step(at, w, place) for head, w, place in out[a] if head == b)
            return at - now if path else None

        for frame in frames:
            took = []
            for s, t in zip(frame["source"].tolist(), frame["target"].tolist(), strict=True):
                most = bound(s, t)
                found = None if most is None else fastest(out, step, potentials[most <= window].aim(t), s, t, now, most)
                took.append(found and found[0])
            yield frame.assign(travel_time=pd.array(took, "Int64"))

    dealt = _dealt(trips.select("qid", "source", "target")).sortWithinPartitions("target")
    return dealt.mapInPandas(work, "qid long, source long, target long, travel_time long")


#: A calm distance and the live time on its path (both below ``INFINITY``) in one label.
_BITS = INFINITY.bit_length()


def _live_in_cells(arcs: DataFrame, trips: DataFrame, now: int, window: int, day: str, near: str, period: int, store, size: int, parts: int) -> DataFrame:
    """:func:`live_queries` with ``smooth``, by cells. The least times to the targets, less what each may take at most, tell until when a node is of use."""

    def calm(frame: pd.DataFrame) -> Step:
        live = [None if pd.isna(x) else (int(x), int(u)) for x, u in zip(frame["live"], frame["until"], strict=True)]
        step = live_step(_lists(frame), live, period)

        def both(at: int, weight: int, place: int) -> int:
            took = step(now + (at & INFINITY), weight, place) - now
            if took > INFINITY:
                raise ValueError(f"a path takes {took}, more than times may be")
            return ((at >> _BITS) + weight << _BITS) + took

        return both

    pairs = store(trips.select("source", "target").distinct())
    sources = pairs.select("source", F.lit(now).cast("long").alias("departure")).distinct()
    predicted = arcs.selectExpr("tail", "head", f"{plf.least('ttf')} AS weight", "ttf", "live", "until")
    found = by_cells(predicted, sources.selectExpr("*", "source AS node", "0L AS at"), calm, store, size, parts=parts)
    most = store(pairs.join(found.selectExpr("source", "node AS target", f"at & {INFINITY}L AS most"), ["source", "target"]))
    limits = None
    for metric, ends in ((day, f"most > {window}"), (near, f"most <= {window}")):
        back = reversed_arcs(arcs.selectExpr("arc_id", "tail", "head", f"{metric} AS weight")).select("tail", "head", "weight")
        starts = most.where(ends).selectExpr("source", f"{now}L AS departure", "target AS node", "-most AS at")
        to = by_cells(back, starts, lambda _: lambda at, weight, place: at + weight, store, size, parts=parts, most=0)
        limits = to if limits is None else limits.union(to)
    limits = store(limits.groupBy("source", "departure", "node").agg((now - F.min("at")).alias("at")))
    own = live_arrivals(arcs.select("tail", "head", "weight", "ttf", "live", "until"), sources, period, store=store, size=size, parts=parts, limits=limits)
    took = own.select("source", F.col("node").alias("target"), "travel_time")
    return trips.select("qid", "source", "target").join(took, ["source", "target"], "left").select("qid", "source", "target", "travel_time")


def path_arcs(found: DataFrame, arcs: DataFrame) -> DataFrame:
    """``qid, departure, arcs``: the arc ids (the first of parallel ones) along the paths of :func:`queries`."""
    first = arcs.groupBy("tail", "head").agg(F.min("arc_id").alias("arc_id"))
    steps = found.select("qid", "departure", F.posexplode(F.expr("zip_with(slice(path, 1, size(path) - 1), slice(path, 2, size(path) - 1), (a, b) -> named_struct('tail', a.node, 'head', b.node))")).alias("pos", "s"))
    steps = steps.select("qid", "departure", "pos", "s.tail", "s.head").join(first, ["tail", "head"])
    return steps.groupBy("qid", "departure").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "arc_id"))), lambda x: x["arc_id"]).alias("arcs"))

"""A hierarchy whose arcs keep bounds of their travel-time functions and, by departure, what they stand for.

An arc's sources are rows (valid from, source): an original arc, or the lower node its two sides meet at. Functions are
rebuilt from the sources only for the intervals that somebody asks for, and kept (``Parts``). A travel time at one
departure needs no function at all: sources are looked up on the way down.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import plf
from ..functions.bounded import Bounded, Function, Parts, merged, valid_at
from ..schema import EPSILON, PERIOD
from . import hierarchy
from .hierarchy import Hierarchy
from .search import _dealt, collect
from .td import seconds

#: (valid from, source): the place of an original arc, or -1 - rank of the node in the middle.
Sources = list[tuple[float, int]]


def combined(old: Sources, new: Sources, first: list[tuple[float, bool]]) -> Sources:
    """Of two lists of sources, the old one's where the flag in force is set, else the new one's."""
    out: Sources = []
    for t in sorted({t for rows in (old, new, first) for t, _ in rows}):
        source = valid_at(old if valid_at(first, t) else new, t)
        if not out or out[-1][1] != source:
            out.append((t, source))
    return out


def sources_for(sources: Sources, start: float, end: float, period: float) -> list[tuple[float, float, int]]:
    """(from, to, source) on start..end in absolute times, which may lie in several periods."""
    out: list[tuple[float, float, int]] = []
    k = int(start // period)
    while k * period < end or not out:
        for (t, source), u in zip(sources, [*(t for t, _ in sources[1:]), period], strict=True):
            a, b = max(start, t + k * period), min(end, u + k * period)
            if a < b or (start == end and a == b):
                if out and out[-1][2] == source:
                    a = out.pop()[0]
                out.append((a, b, source))
        k += 1
    return out


class Shortcut:
    def __init__(self, known: Bounded, source: int):
        self.known = known
        self.sources: Sources = [(0.0, source)]
        self.parts = Parts()


class Shortcuts:
    """Arcs between ranks: ``arcs[a, b]`` for each direction of a chordal arc that some path stands behind."""

    def __init__(self, own: Hierarchy, tail: np.ndarray, head: np.ndarray, functions: list[Function], period: float, error: float = 1.0, most_points: int = 16):
        """``error``: how far bounds of more than ``most_points`` points may move when they are simplified."""
        self.own, self.functions, self.period = own, functions, period
        self.error, self.most_points = error, most_points
        self.arcs: dict[tuple[int, int], Shortcut] = {}
        self._switches: dict[tuple[int, int], list[float]] = {}
        for place, (a, b) in enumerate(zip(own.rank[tail].tolist(), own.rank[head].tolist(), strict=True)):
            if a != b:
                self._put(a, b, Bounded(functions[place]), place)
        for v, u in enumerate(own.upper):
            for a in u:
                for b in u:
                    if a != b and (a, v) in self.arcs and (v, b) in self.arcs:
                        self._put(a, b, None, -1 - v)
        self.kept = self._needed()

    def _put(self, a: int, b: int, known: Bounded | None, source: int) -> None:
        """Another way from a to b. Its sides are final by now; the arc itself may still change, so it keeps no parts."""
        old = self.arcs.get((a, b))
        if known is None:
            sides = self.arcs[a, -1 - source].known, self.arcs[-1 - source, b].known
            if old and sides[0].least + sides[1].least >= old.known.most:
                return
            known = sides[0].linked(sides[1], self.period)
        if old is None or known.most <= old.known.least:
            self.arcs[a, b] = Shortcut(self._small(known), source)
        elif known.least < old.known.most:
            ways = {True: old.sources, False: [(0.0, source)]}
            both, first = merged(old.known, known, self.period, lambda f, x, y: self._made(ways[f], a, b, x, y))
            old.known, old.sources = self._small(both), combined(old.sources, [(0.0, source)], first)

    def _small(self, known: Bounded) -> Bounded:
        return known.approximated(self.error) if max(len(known.low[0]), len(known.high[0])) > self.most_points else known

    def _made(self, sources: Sources, a: int, b: int, start: float, end: float) -> Function:
        """The function of a list of sources on a part of the period."""
        out = None
        for x, y, source in sources_for(sources, start, end, self.period):
            part = self._through(source, a, b, x, y)
            out = part if out is None else plf.appended(out, part)
        return out

    def _through(self, source: int, a: int, b: int, start: float, end: float) -> Function:
        if source >= 0:
            return plf.crop(*self.functions[source], start, end, self.period)
        dep, tt = self.part(a, -1 - source, start, end)
        arrive = dep + tt
        after = self.part(-1 - source, b, float(arrive[0]), float(arrive[-1]))
        at = np.unique(np.concatenate([dep, np.interp(after[0][1:-1], arrive, dep)]))
        own = np.interp(at, dep, tt)
        return at, own + np.interp(at + own, *after)

    def part(self, a: int, b: int, start: float, end: float) -> Function:
        """The exact function of an arc on start..end in absolute times."""
        if end - start <= EPSILON:
            return np.array([start]), np.array([self.evaluate(a, b, start)[0]])
        arc, out = self.arcs[a, b], None
        for k in range(int(start // self.period), int(np.ceil(end / self.period))):
            x, y = max(start - k * self.period, 0.0), min(end - k * self.period, self.period)
            if y - x <= EPSILON:
                continue
            for gap in arc.parts.missing(x, y):
                arc.parts.insert(self._made(arc.sources, a, b, *gap))
            dep, tt = arc.parts.on(x, y)
            out = (dep + k * self.period, tt) if out is None else plf.appended(out, (dep + k * self.period, tt))
        return out

    def evaluate(self, a: int, b: int, departure: float) -> tuple[float, list[int]]:
        """(travel time, places of the original arcs) at one departure."""
        source = valid_at(self.arcs[a, b].sources, departure % self.period)
        if source >= 0:
            return float(plf.evaluate(*self.functions[source], departure, self.period)), [source]
        t, path = self.evaluate(a, -1 - source, departure)
        u, rest = self.evaluate(-1 - source, b, departure + t)
        return t + u, path + rest

    def switches(self, a: int, b: int) -> list[float]:
        """Departures within the period from which another path of original arcs is the fastest."""
        if (a, b) not in self._switches:
            self._switches[a, b] = self._path_changes(a, b)
        return self._switches[a, b]

    def _path_changes(self, a: int, b: int) -> list[float]:
        out = []
        for x, y, source in sources_for(self.arcs[a, b].sources, 0.0, self.period, self.period):
            if x > 0:
                out.append(x)
            if source < 0:
                out += [t for t in self.switches(a, -1 - source) if x < t < y]
                dep, tt = self.part(a, -1 - source, x, y)
                arrive = dep + tt
                for t in self.switches(-1 - source, b):
                    for k in range(int(arrive[0] // self.period), int(arrive[-1] // self.period) + 1):
                        if arrive[0] < t + k * self.period < arrive[-1]:
                            out.append(float(np.interp(t + k * self.period, arrive, dep)))
        return sorted(set(out))

    def unique_paths(self) -> set[tuple[int, int]]:
        """Arcs that stand for one path all day."""
        out: set[tuple[int, int]] = set()
        for a, b in sorted(self.arcs, key=min):  # sides have a lower end
            sources = self.arcs[a, b].sources
            v = -1 - sources[0][1]
            if len(sources) == 1 and (v < 0 or {(a, v), (v, b)} <= out):
                out.add((a, b))
        return out

    def bounds(self) -> list[tuple[int, int, float, float]]:
        """(from, to, least, greatest travel time) of every arc."""
        return [(a, b, x.known.least, x.known.most) for (a, b), x in self.arcs.items()]

    def _needed(self) -> dict[int, list[tuple[int, int]]]:
        """The arcs that searches follow, by their lower end: no way over a third node is always faster.

        Arcs that are left out may still be sides of others.
        """
        high = {x: s.known.most for x, s in self.arcs.items()}
        for v in range(len(self.own.upper) - 1, -1, -1):
            for a in self.own.upper[v]:
                for b in self.own.upper[v]:
                    for x, y, z in ((v, a, b), (b, a, v)):
                        if (x, y) in high and (y, z) in high and (x, z) in high:
                            high[x, z] = min(high[x, z], high[x, y] + high[y, z])
        out = defaultdict(list)
        for (a, b), s in self.arcs.items():
            if s.known.least <= high[a, b]:
                out[min(a, b)].append((a, b))
        return out

    def _ancestors(self, v: int) -> list[int]:
        out = [v]
        while self.own.parent[out[-1]] >= 0:
            out.append(int(self.own.parent[out[-1]]))
        return out

    def travel_time(self, source: int, target: int, departure: float) -> tuple[float, list[int]] | None:
        """(travel time, places of the arcs): up along the source's ancestors, down along the target's."""
        s, t = int(self.own.rank[source]), int(self.own.rank[target])
        at: dict[int, tuple[float, list[int]]] = {s: (departure, [])}

        def relax(a: int, b: int) -> None:
            if a in at and at[a][0] + self.arcs[a, b].known.least < at.get(b, (np.inf,))[0]:
                took, path = self.evaluate(a, b, at[a][0])
                if at[a][0] + took < at.get(b, (np.inf,))[0]:
                    at[b] = at[a][0] + took, at[a][1] + path

        for v in self._ancestors(s):
            for a, b in self.kept.get(v, ()):
                if a == v:
                    relax(a, b)
        for v in reversed(self._ancestors(t)):
            for a, b in self.kept.get(v, ()):
                if b == v:
                    relax(a, b)
        return (at[t][0] - departure, at[t][1]) if t in at else None

    def profile(self, source: int, target: int) -> Function | None:
        """The travel times of the whole day: exact functions linked and merged along both chains of ancestors."""
        s, t = int(self.own.rank[source]), int(self.own.rank[target])
        found: dict[int, Function] = {s: (np.array([0.0]), np.array([0.0]))}

        def relax(a: int, b: int) -> None:
            if a not in found or b == s:
                return
            if b in found and found[a][1].min() + self.arcs[a, b].known.least >= found[b][1].max():
                return
            new = plf.link(found[a], self.part(a, b, 0.0, self.period), self.period)
            found[b] = plf.merge(found[b], new, self.period)[0] if b in found else new

        for v in self._ancestors(s):
            for a, b in self.kept.get(v, ()):
                if a == v:
                    relax(a, b)
        for v in reversed(self._ancestors(t)):
            for a, b in self.kept.get(v, ()):
                if b == v:
                    relax(a, b)
        return found.get(t)


def build(arcs: DataFrame, nodes: DataFrame, period: int = PERIOD) -> tuple[Shortcuts, np.ndarray]:
    """The shortcuts of ``arcs(..., ttf)`` and the arc ids by place. Sequential, so on the driver, up to the checked size of ``collect``.

    Like hierarchies they are kept by what the tables hold.
    """

    def made():
        own, _ = hierarchy.build(arcs, nodes)
        g = collect(arcs)
        tail = np.repeat(np.arange(g.n), np.diff(g.first))
        return Shortcuts(own, tail, g.head, seconds(g), period / 1000), g.arc

    key = ("shortcuts", hierarchy.contents(arcs, "arc_id", "tail", "head", "ttf"), hierarchy.contents(nodes, "node", "x", "y"), period)
    return hierarchy.remembered(key, made)


def travel_times(spark, built: tuple[Shortcuts, np.ndarray], trips: DataFrame) -> DataFrame:
    """``trips(qid, source, target, departure)`` (ms) with ``travel_time`` (s) and ``arcs`` (ids); null without a path."""
    shared = spark.sparkContext.broadcast(built)

    def work(frames):
        own, ids = shared.value
        for frame in frames:
            rows = []
            for q, s, t, d in zip(*(frame[c].tolist() for c in ("qid", "source", "target", "departure")), strict=True):
                found = own.travel_time(s, t, d / 1000)
                rows.append((q, s, t, d, found and found[0], [int(ids[p]) for p in found[1]] if found else None))
            yield pd.DataFrame(rows, columns=["qid", "source", "target", "departure", "travel_time", "arcs"]).astype({"travel_time": "Float64"})

    kind = "qid long, source long, target long, departure long, travel_time double, arcs array<long>"
    return _dealt(trips.select("qid", "source", "target", "departure")).mapInPandas(work, kind)


def profiles(spark, built: tuple[Shortcuts, np.ndarray], pairs: DataFrame) -> DataFrame:
    """``source, target, dep, tt`` (s) for ``pairs(source, target)`` with a path."""
    shared = spark.sparkContext.broadcast(built)

    def work(frames):
        own, _ = shared.value
        for frame in frames:
            found = [(s, t, own.profile(s, t)) for s, t in zip(frame["source"].tolist(), frame["target"].tolist(), strict=True)]
            rows = [(s, t, f[0].tolist(), f[1].tolist()) for s, t, f in found if f]
            yield pd.DataFrame(rows, columns=["source", "target", "dep", "tt"])

    return _dealt(pairs.select("source", "target").distinct()).mapInPandas(work, "source long, target long, dep array<double>, tt array<double>")


def bounds(spark, built: tuple[Shortcuts, np.ndarray]) -> DataFrame:
    """``tail, head`` (ranks), ``low, high`` (s) and ``one_path`` of every arc."""
    own = built[0]
    one = own.unique_paths()
    rows = [(a, b, x, y, (a, b) in one) for a, b, x, y in own.bounds()]
    return spark.createDataFrame(rows, "tail long, head long, low double, high double, one_path boolean").orderBy(F.least("tail", "head"))

"""Travel-time functions that are known exactly or only by bounds, and parts of a function by interval.

All functions are pairs of arrays (departure, travel time) without overtaking. Two functions are compared by their bounds;
only on intervals where these overlap are exact parts asked for.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable

import numpy as np

from ..schema import EPSILON
from . import plf

Function = tuple[np.ndarray, np.ndarray]


class Bounded:
    """A periodic function between ``low`` and ``high``; without ``high`` it is ``low`` exactly."""

    def __init__(self, low: Function, high: Function | None = None):
        self.low, self.high = low, high or low
        self.exact = high is None
        self.least, self.most = float(self.low[1].min()), float(self.high[1].max())

    def linked(self, after: Bounded, period: float) -> Bounded:
        """This function and then ``after``; bounds stay bounds, since neither lets a later departure overtake."""
        low = plf.link(self.low, after.low, period)
        return Bounded(low) if self.exact and after.exact else Bounded(low, plf.link(self.high, after.high, period))

    def approximated(self, error: float) -> Bounded:
        """Bounds of fewer points, at most about ``error`` further apart."""
        return Bounded(plf.bounds(*self.low, error)[0], plf.bounds(*self.high, error)[1])


def valid_at(rows: list, t: float):
    """The value of the last of ``rows`` (valid from, value) that starts by ``t``."""
    return rows[max(bisect.bisect_right(rows, t, key=lambda r: r[0]) - 1, 0)][1]


def merged(f: Bounded, g: Bounded, period: float, exact: Callable[[bool, float, float], Function]) -> tuple[Bounded, list[tuple[float, bool]]]:
    """The smaller of both, and from when on ``f`` is the smaller one (time, flag).

    ``exact(first, start, end)``: ``f`` (or ``g``) on an interval where the bounds leave both possible.
    """
    if f.exact and g.exact:
        low, first = plf.merge(f.low, g.low, period)
        return Bounded(low), first
    sure = plf.merge(f.high, g.low, period)[1], plf.merge(g.high, f.low, period)[1]
    times = sorted({t for rows in sure for t, _ in rows})
    first: list[tuple[float, bool]] = []
    open_since = None
    for start in [*times, period]:
        known = start < period and next((flag for flag, rows in zip((True, False), sure, strict=True) if valid_at(rows, start)), None)
        if open_since is not None and (known is not None or start == period):
            first += _smaller(exact(True, open_since, start), exact(False, open_since, start))
            open_since = None
        if start == period:
            break
        if known is None:
            open_since = start if open_since is None else open_since
        else:
            first.append((start, known))
    first = [x for i, x in enumerate(first) if not i or first[i - 1][1] != x[1]]
    return Bounded(plf.merge(f.low, g.low, period)[0], plf.merge(f.high, g.high, period)[0]), first


def _smaller(f: Function, g: Function) -> list[tuple[float, bool]]:
    """For two parts on one interval, from when on ``f`` is at most ``g``."""
    dep = np.unique(np.concatenate([f[0], g[0]]))
    gap = np.interp(dep, *f) - np.interp(dep, *g)
    cross = np.flatnonzero(gap[:-1] * gap[1:] < 0)
    at = dep[cross] + np.diff(dep)[cross] * gap[cross] / (gap[cross] - gap[cross + 1])
    starts = np.sort(np.concatenate([dep[:-1], at]))
    middle = (starts + np.append(starts[1:], dep[-1])) / 2
    flags = np.interp(middle, *f) <= np.interp(middle, *g) + EPSILON
    return list(zip(starts.tolist(), flags.tolist(), strict=True))


class Parts:
    """Parts of one function on intervals that don't overlap: what was asked for once isn't computed again."""

    def __init__(self):
        self.parts: list[Function] = []

    def missing(self, start: float, end: float) -> list[tuple[float, float]]:
        """The gaps within start..end."""
        gaps, at = [], start
        for dep, _ in self.parts:
            if dep[-1] <= at + EPSILON:
                continue
            if dep[0] >= end - EPSILON:
                break
            if dep[0] > at + EPSILON:
                gaps.append((at, float(dep[0])))
            at = float(dep[-1])
        return [*gaps, (at, end)] if at < end - EPSILON else gaps

    def insert(self, part: Function) -> None:
        """Add a part that fills a gap; parts that touch become one."""
        rows = sorted([*self.parts, part], key=lambda p: p[0][0])
        self.parts = rows[:1]
        for p in rows[1:]:
            if abs(self.parts[-1][0][-1] - p[0][0]) <= EPSILON:
                self.parts[-1] = plf.appended(self.parts[-1], p)
            else:
                self.parts.append(p)

    def on(self, start: float, end: float) -> Function | None:
        """The function on start..end, None where a gap is left."""
        for dep, tt in self.parts:
            if dep[0] <= start + EPSILON and dep[-1] >= end - EPSILON:
                inner = dep[(dep > start + EPSILON) & (dep < end - EPSILON)]
                at = np.concatenate([[start], inner, [end]])
                return at, np.interp(at, dep, tt)
        return None

    def periodic(self, period: float) -> Function | None:
        return self.on(0.0, period)

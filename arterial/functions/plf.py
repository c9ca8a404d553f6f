"""Piecewise-linear travel-time functions.

Columns: expressions over ``ttf``, an array of ``(dep, tt)`` structs, for integer functions (the search
in the array and the interpolation stay in the JVM). Arrays: numpy functions over points of a float
function for linking, merging and simplifying inside kernels.
"""

from __future__ import annotations

import numpy as np

from ..schema import EPSILON, PERIOD


def normalized(ttf: str, period: int = PERIOD) -> str:
    """One point stands at 0; others get a point at 0 and one at the period, both with the first value, where missing."""
    first = f"element_at({ttf}, 1).tt"
    point = lambda at: f"array(named_struct('dep', CAST({at} AS BIGINT), 'tt', {first}))"
    head = f"IF(element_at({ttf}, 1).dep = 0, slice({ttf}, 1, 0), {point(0)})"
    tail = f"IF(element_at({ttf}, -1).dep = {period}, slice({ttf}, 1, 0), {point(period)})"
    return f"IF(size({ttf}) = 1, {point(0)}, concat({head}, {ttf}, {tail}))"


def value_at(ttf: str, t: str, period: int = PERIOD) -> str:
    """Travel time at ``t``: on a point its value, else the floor of the interpolated arrival, minus the departure.

    One pass over the array finds the place; arrays of one element bind it, so nothing is computed twice.
    """
    lo, hi = f"element_at({ttf}, k_)", f"element_at({ttf}, k_ + 1)"
    line = f"({lo}.dep + {lo}.tt) + ((x_ - {lo}.dep) * (({hi}.dep + {hi}.tt) - ({lo}.dep + {lo}.tt))) div ({hi}.dep - {lo}.dep) - x_"
    case = f"CASE WHEN size({ttf}) <= 2 THEN element_at({ttf}, 1).tt WHEN {lo}.dep = x_ THEN {lo}.tt ELSE {line} END"
    place = f"array(size(filter({ttf}, p_ -> p_.dep <= x_)))"
    return f"element_at(transform(array(pmod({t}, {period})), x_ -> element_at(transform({place}, k_ -> {case}), 1)), 1)"


def least(ttf: str) -> str:
    return f"array_min(transform({ttf}, p -> p.tt))"


def most(ttf: str) -> str:
    return f"array_max(transform({ttf}, p -> p.tt))"


def extreme_in_range(ttf: str, start: str, end: str, take: str = "array_min", period: int = PERIOD) -> str:
    """Least (or with ``array_max`` greatest) value on the closed range start..end, which wraps when end < start."""
    inside = f"IF({start} <= {end}, p.dep BETWEEN {start} AND {end}, p.dep >= {start} OR p.dep <= {end})"
    points = f"transform(filter({ttf}, p -> {inside}), p -> p.tt)"
    return f"{take}(concat({points}, array({value_at(ttf, start, period)}, {value_at(ttf, end, period)})))"


def slope_extremes(ttf: str) -> tuple[str, str]:
    """Least and greatest slope over the segments, 0 for a constant."""
    slopes = f"zip_with(slice({ttf}, 1, size({ttf}) - 1), slice({ttf}, 2, size({ttf}) - 1), (a, b) -> (b.tt - a.tt) / (b.dep - a.dep))"
    return (f"IF(size({ttf}) < 2, 0.0D, array_min({slopes}))", f"IF(size({ttf}) < 2, 0.0D, array_max({slopes}))")


def average(ttf: str, start: str, end: str) -> str:
    """Mean over start..end (start < end): values at both ends of each segment, weighed by the part of it inside."""
    part = "greatest(0L, least(b.dep, {e}) - greatest(a.dep, {s}))".format(s=start, e=end)
    parts = f"zip_with(slice({ttf}, 1, size({ttf}) - 1), slice({ttf}, 2, size({ttf}) - 1), (a, b) -> (a.tt + b.tt) * {part})"
    return f"IF(size({ttf}) < 2, element_at({ttf}, 1).tt, aggregate({parts}, 0L, (s, x) -> s + x) div 2 div ({end} - {start}))"


def live_value(ttf: str, live: str, soon: str, t: str) -> str:
    """Live time until ``soon``; afterwards it moves by one for each unit of time until it meets the prediction."""
    p, at_soon = value_at(ttf, t), value_at(ttf, soon)
    falling = f"greatest(greatest({live} + {soon} - {t}, 0L), {p})"
    rising = f"least({live} + {t} - {soon}, {p})"
    return f"CASE WHEN {live} IS NULL THEN {p} WHEN {t} < {soon} THEN {live} WHEN {at_soon} < {live} THEN {falling} ELSE {rising} END"


def pessimistic_value(ttf: str, live: str, until: str, t: str) -> str:
    """The prediction, or before ``until`` the smaller of live and waiting for it, if that is larger."""
    p, at_until = value_at(ttf, t), value_at(ttf, until)
    return f"CASE WHEN {live} IS NULL OR {t} >= {until} THEN {p} ELSE greatest({p}, least({live}, {at_until} + {until} - {t})) END"


def evaluate(dep: np.ndarray, tt: np.ndarray, t, period: float = PERIOD / 1000):
    """Values of a float function at times ``t`` (any, taken modulo the period)."""
    x = np.mod(t, period)
    return np.interp(x, dep, tt) if len(dep) > 1 else np.full(np.shape(x), tt[0], float)


def _clean(dep: np.ndarray, tt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points closer than the tolerance become one; points on the line of their neighbours go."""
    keep = np.concatenate(([True], np.diff(dep) > EPSILON))
    dep, tt = dep[keep], tt[keep]
    if len(dep) < 3:
        return dep, tt
    slope = np.diff(tt) / np.diff(dep)
    bend = np.concatenate(([True], np.abs(np.diff(slope)) > 1e-12, [True]))
    return dep[bend], tt[bend]


def link(f: tuple[np.ndarray, np.ndarray], g: tuple[np.ndarray, np.ndarray], period: float = PERIOD / 1000):
    """Travel time of f and then g: breakpoints are f's and the departures that reach one of g's."""
    (fd, ft), (gd, gt) = f, g
    if len(fd) == 1:
        fd, ft = np.array([0.0, period]), np.array([ft[0], ft[0]])
    arrive = fd + ft
    lo, hi = int(np.floor(arrive[0] / period)), int(np.floor(arrive[-1] / period)) + 1
    wanted = np.concatenate([gd + k * period for k in range(lo, hi + 1)])
    wanted = wanted[(wanted > arrive[0]) & (wanted < arrive[-1])]
    dep = np.unique(np.concatenate([fd, np.interp(wanted, arrive, fd)]))
    own = np.interp(dep, fd, ft)
    return _clean(dep, own + evaluate(gd, gt, dep + own, period))


def merge(f: tuple[np.ndarray, np.ndarray], g: tuple[np.ndarray, np.ndarray], period: float = PERIOD / 1000):
    """The smaller of both at each time, and from when on the first one is the smaller (time, flag)."""
    dep = np.unique(np.concatenate([f[0], g[0], [0.0, period]]))
    a, b = evaluate(*f, dep[:-1], period), evaluate(*g, dep[:-1], period)
    a, b = np.append(a, a[0]), np.append(b, b[0])
    gap = a - b
    cross = np.flatnonzero((gap[:-1] * gap[1:] < 0) & (np.abs(gap[:-1]) > EPSILON) & (np.abs(gap[1:]) > EPSILON))
    at = dep[cross] + (dep[cross + 1] - dep[cross]) * gap[cross] / (gap[cross] - gap[cross + 1])
    times = np.concatenate([dep, at])
    low = np.concatenate([np.minimum(a, b), np.interp(at, dep, a)])
    order = np.argsort(times, kind="stable")
    middle = np.sort(np.concatenate([dep[:-1], at]))
    mids = (middle + np.append(middle[1:], period)) / 2
    first = np.interp(mids, dep, a) <= np.interp(mids, dep, b) + EPSILON
    change = np.concatenate(([True], first[1:] != first[:-1]))
    return _clean(times[order], low[order]), list(zip(middle[change].tolist(), first[change].tolist(), strict=True))


def simplify(dep: np.ndarray, tt: np.ndarray, error: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Fewer points, each dropped one within ``error`` of the line that replaces it."""
    keep = np.zeros(len(dep), bool)
    keep[[0, -1]] = True
    stack = [(0, len(dep) - 1)]
    while stack:
        a, b = stack.pop()
        if b - a < 2:
            continue
        off = np.abs(tt[a + 1 : b] - np.interp(dep[a + 1 : b], dep[[a, b]], tt[[a, b]]))
        k = int(off.argmax())
        if off[k] > error:
            keep[a + 1 + k] = True
            stack += [(a, a + 1 + k), (a + 1 + k, b)]
    return dep[keep], tt[keep]


def fewest(dep: np.ndarray, tt: np.ndarray, error: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """The fewest of the points, each dropped one within ``error`` of the line that replaces it; quadratic at worst.

    The points passed narrow a cone of slopes from where a line starts; the least number of allowed lines is a shortest path.
    """
    n = len(dep)
    lines, before = [0, *[n] * (n - 1)], [0] * n
    for i in range(n - 1):
        low, high = -np.inf, np.inf
        for j in range(i + 1, n):
            run, rise = dep[j] - dep[i], tt[j] - tt[i]
            if low <= rise / run <= high and lines[i] + 1 < lines[j]:
                lines[j], before[j] = lines[i] + 1, i
            low, high = max(low, (rise - error) / run), min(high, (rise + error) / run)
            if low > high:
                break
    keep = [n - 1]
    while keep[-1]:
        keep.append(before[keep[-1]])
    return dep[keep[::-1]], tt[keep[::-1]]


def remembering(f, most: int = 10_000):
    """``f(dep, tt, *more)``, computed once for equal arguments; everything known is dropped after ``most`` functions."""
    known: dict[tuple, object] = {}

    def get(dep: np.ndarray, tt: np.ndarray, *more):
        key = (dep.tobytes(), tt.tobytes(), *more)
        if key not in known:
            if len(known) >= most:
                known.clear()
            known[key] = f(dep, tt, *more)
        return known[key]

    return get


def fifo(dep: np.ndarray, tt: np.ndarray) -> np.ndarray:
    """The greatest function below ``tt`` that never lets a later departure arrive earlier."""
    arrive = np.minimum.accumulate((dep + tt)[::-1])[::-1]
    return arrive - dep


def floored(ttf: str, least_time: int = 1) -> str:
    """Travel times of at least ``least_time``."""
    return f"transform({ttf}, p -> named_struct('dep', p.dep, 'tt', greatest(p.tt, {least_time}L)))"


def shifted(ttf: str, cost: str) -> str:
    """The function plus a constant."""
    return f"transform({ttf}, p -> named_struct('dep', p.dep, 'tt', p.tt + {cost}))"


def departure_for(ttf: str, arrival: str, period: int = PERIOD) -> str:
    """The departure (double) that arrives at ``arrival`` of a function without overtaking; whole periods are kept."""
    first = f"element_at({ttf}, 1).tt"
    lo, hi = f"element_at({ttf}, k_)", f"element_at({ttf}, k_ + 1)"
    line = f"{arrival} - x_ + {lo}.dep + ({hi}.dep - {lo}.dep) * (x_ - {lo}.dep - {lo}.tt) / ({hi}.dep + {hi}.tt - {lo}.dep - {lo}.tt)"
    case = f"IF(size({ttf}) < 2, CAST({arrival} - {first} AS DOUBLE), {line})"
    place = f"array(size(filter({ttf}, p_ -> p_.dep + p_.tt <= x_)))"
    x = f"pmod({arrival} - {first}, {period}) + {first}"
    return f"element_at(transform(array({x}), x_ -> element_at(transform({place}, k_ -> {case}), 1)), 1)"


def switch_start(ttf: str, live: str, until: str) -> str:
    """When waiting for ``until`` starts to be better than the live time, 0 at the earliest."""
    return f"greatest(0L, {until} - greatest(0L, {live} - {value_at(ttf, until)}))"


def pessimistic_upper(ttf: str, live: str, until: str, now: str) -> str:
    """An upper bound from ``now`` on: the prediction's, or the live time as far as it counts now."""
    return f"greatest({most(ttf)}, least(coalesce({live}, 0L), {pessimistic_value(ttf, live, until, now)}))"


def inverse(dep: np.ndarray, tt: np.ndarray, arrival, period: float = PERIOD / 1000):
    """Departures that arrive at times ``arrival``; whole periods are kept."""
    if len(dep) == 1:
        return arrival - tt[0]
    whole = np.floor((arrival - tt[0]) / period) * period
    return whole + np.interp(arrival - whole, dep + tt, dep)


def crop(dep: np.ndarray, tt: np.ndarray, start: float, end: float, period: float = PERIOD / 1000) -> tuple[np.ndarray, np.ndarray]:
    """The part of a periodic function on start..end in absolute times, which may lie in several periods."""
    turns = np.arange(int(np.floor(start / period)), int(np.floor(end / period)) + 1) * period
    inner = np.unique(np.concatenate([dep + k for k in turns]))
    inner = inner[(inner > start + EPSILON) & (inner < end - EPSILON)]
    at = np.concatenate([[start], inner, [end]]) if end > start else np.array([start], float)
    return at, evaluate(dep, tt, at, period)


def appended(f: tuple[np.ndarray, np.ndarray], g: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two parts in a row; ``g`` starts where ``f`` ends, and its first point counts there."""
    if abs(f[0][-1] - g[0][0]) > EPSILON:
        raise ValueError("the second part must start where the first one ends")
    return _clean(np.concatenate([f[0][:-1], g[0]]), np.concatenate([f[1][:-1], g[1]]))


def link_part(f: tuple[np.ndarray, np.ndarray], g: tuple[np.ndarray, np.ndarray], period: float = PERIOD / 1000) -> tuple[np.ndarray, np.ndarray]:
    """A part f (absolute times) followed by the periodic g."""
    arrive = f[0] + f[1]
    wanted, _ = crop(*g, arrive[0], arrive[-1], period)
    dep = np.unique(np.concatenate([f[0], np.interp(wanted[1:-1], arrive, f[0])]))
    own = np.interp(dep, *f)
    return _clean(dep, own + evaluate(*g, dep + own, period))


def bounds(dep: np.ndarray, tt: np.ndarray, error: float = 1.0) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Simpler functions, one never above and one never below, both periodic and without overtaking.

    Each kept point moves by the greatest deviation in the two segments it ends.
    """
    at, value = simplify(dep, tt, error)
    if len(at) < 2:
        return (at, value), (at, value)
    off = tt - np.interp(dep, at, value)
    part = np.clip(np.searchsorted(at, dep, "right") - 1, 0, len(at) - 2)
    below, above = np.zeros(len(at) - 1), np.zeros(len(at) - 1)
    np.minimum.at(below, part, off)
    np.maximum.at(above, part, off)
    low = value + np.minimum(np.append(below, 0), np.insert(below, 0, 0))
    high = value + np.maximum(np.append(above, 0), np.insert(above, 0, 0))
    for _ in range(len(at)):
        low[[0, -1]] = min(low[0], low[-1])
        low = fifo(at, low)
        if low[0] == low[-1]:
            break
    for _ in range(len(at)):
        high[[0, -1]] = max(high[0], high[-1])
        high = np.maximum.accumulate(at + high) - at
        if high[0] == high[-1]:
            break
    return (at, low), (at, high)


def switch_point(dep: np.ndarray, tt: np.ndarray, live: float, soon: float, period: float = PERIOD / 1000) -> tuple[float, float]:
    """(time, value) at which the live time, moving by one for each unit of time after ``soon``, meets the prediction."""
    at, value = crop(dep, tt, soon, soon + period, period)
    if abs(value[0] - live) <= EPSILON:
        return soon, live
    sign = -1.0 if value[0] < live else 1.0
    line = live + sign * (at - soon)
    gap = (value - line) * sign
    k = int(np.flatnonzero(gap <= EPSILON)[0]) if (gap <= EPSILON).any() else len(at) - 1
    share = gap[k - 1] / (gap[k - 1] - gap[k])
    x = float(at[k - 1] + share * (at[k] - at[k - 1]))
    return x, live + sign * (x - soon)


def evaluate_live(dep: np.ndarray, tt: np.ndarray, live: float, soon: float, t, period: float = PERIOD / 1000):
    """Live until ``soon``, then towards the prediction, which holds from where they meet."""
    x, value = switch_point(dep, tt, live, soon, period)
    return np.where(np.asarray(t) < x, np.interp(t, [soon, max(x, soon + EPSILON)], [live, value]), evaluate(dep, tt, t, period))


def from_speeds(at: np.ndarray, speed: np.ndarray, length: float, period: int = PERIOD) -> tuple[np.ndarray, np.ndarray]:
    """Integer travel times (ms) of ``length`` m when ``speed[i]`` km/h holds from ``at[i]`` (ms, from 0) on.

    The way since midnight is a growing function W of time; who enters at t leaves at W^-1(W(t) + length).
    Breakpoints are the changes of speed and the entries that leave at one. Times are rounded down once.
    """
    if length <= 0 or (speed <= 0).any():
        raise ValueError("lengths and speeds must be positive")
    edges = np.append(at, period).astype(float)
    way = np.concatenate([[0.0], np.cumsum(np.diff(edges) * speed / 3600)])
    days = 2 + int(np.ceil(length / way[-1]))
    times = np.concatenate([edges[:-1] + k * period for k in range(days)] + [[days * period]])
    walked = np.concatenate([way[:-1] + k * way[-1] for k in range(days)] + [[days * way[-1]]])
    entries = np.interp(walked - length, walked, times, left=-1.0)
    dep = np.unique(np.floor(np.concatenate([edges, entries[(entries >= 0) & (entries < period)]])))
    leave = np.interp(np.interp(dep, times, walked) + length, walked, times)
    tt = np.floor(leave - dep + 1e-6)
    tt[-1] = tt[0]
    return dep.astype(np.int64), fifo(dep, tt).astype(np.int64)

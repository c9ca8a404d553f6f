"""Suffix arrays by induced sorting, and permuted common prefixes, in numpy.

Suffixes are classified as smaller (S) or larger (L) than their right neighbour. The substrings
between leftmost S suffixes are sorted by inducing, named, and the shorter string of names is sorted;
two more induced passes then place every suffix. An induced pass handles one bucket (first byte) at a
time: all suffixes of a finished bucket hand their left neighbours on to the neighbours' buckets at
once, so the Python steps are a few for each byte value and not for each suffix.

The string of names has an alphabet as large as itself, where buckets of one member would make that
form slow; it is sorted by doubling instead (names of 2, 4, 8, ... successive substrings), which ends
once all names differ or once a name covers ``depth`` bytes.
"""

from __future__ import annotations

import numpy as np


def classify(t: np.ndarray) -> np.ndarray:
    """True for S suffixes. The last suffix (the sentinel) is S."""
    n = len(t)
    step = np.zeros(n, np.int8)  # 1: smaller than the next value, -1: larger
    step[:-1] = np.sign(t[1:].astype(np.int64) - t[:-1].astype(np.int64))
    step[-1] = 1
    at = np.where(step != 0, np.arange(n), n)
    return step[np.minimum.accumulate(at[::-1])[::-1]] > 0


def _split(t: np.ndarray, j: np.ndarray, to: dict[int, list[np.ndarray]]) -> None:
    """Deal the positions ``j`` to their buckets, in order."""
    if not len(j):
        return
    c = t[j]
    order = np.argsort(c, kind="stable")
    c = c[order]
    j = j[order]
    cuts = np.flatnonzero(c[1:] != c[:-1]) + 1
    start = 0
    for end in [*cuts.tolist(), len(j)]:
        to.setdefault(int(c[start]), []).append(j[start:end])
        start = end


def _chain(t: np.ndarray, c: int, got: list[np.ndarray]) -> list[np.ndarray]:
    """``got`` with all left neighbours of the same value, wave after wave."""
    out = []
    wave = np.concatenate(got) if got else np.zeros(0, np.int64)
    while len(wave):
        out.append(wave)
        wave = wave[wave > 0] - 1
        wave = wave[t[wave] == c]
    return out


def induce(t: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """The suffix array induced from the order of the leftmost S suffixes ``lms``."""
    values = np.unique(t)
    own: dict[int, list[np.ndarray]] = {}
    _split(t, lms, own)
    larger: dict[int, np.ndarray] = {}
    to: dict[int, list[np.ndarray]] = {}
    for c in values.tolist():
        done = _chain(t, c, to.pop(c, []))
        larger[c] = np.concatenate(done) if done else np.zeros(0, np.int64)
        both = np.concatenate([larger[c], *own.get(c, [])])
        j = both[both > 0] - 1
        _split(t, j[t[j] > c], to)
    smaller: dict[int, np.ndarray] = {}
    to = {}
    n = len(t)
    for c in values[::-1].tolist():
        got = to.pop(c, [])
        if c == t[n - 1]:
            got = [*got, np.array([n - 1])]
        done = _chain(t, c, got)
        smaller[c] = np.concatenate(done) if done else np.zeros(0, np.int64)
        both = np.concatenate([smaller[c], larger[c][::-1]])
        j = both[both > 0] - 1
        _split(t, j[t[j] < c], to)
    return np.concatenate([x for c in values.tolist() for x in (larger[c], smaller[c][::-1])])


def _names(t: np.ndarray, sorted_lms: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A name for each sorted leftmost-S substring, equal for equal bytes and rising. ``end``: last place of the one that starts at i."""
    n = len(t)
    a, b = sorted_lms[:-1], sorted_lms[1:]
    size = end[sorted_lms] - sorted_lms
    differs = size[1:] != size[:-1]
    alive = np.flatnonzero(~differs)
    k = 0
    while len(alive):
        bad = t[np.minimum(a[alive] + k, n - 1)] != t[np.minimum(b[alive] + k, n - 1)]
        differs[alive[bad]] = True
        alive = alive[~bad]
        alive = alive[size[alive] > k]
        k += 1
    return np.concatenate(([0], np.cumsum(differs)))


def _order_names(names: np.ndarray, depth: int | None) -> np.ndarray:
    """The order of the suffixes of ``names`` by doubling. Two bytes at least lie under each name.

    A rank is the place where its group of equals starts, so a round sorts only members of groups of
    two or more. Equals may come in any order: a group's members share a rank.
    """
    n = len(names)
    order = np.argsort(names)
    rank = np.empty(n, np.int64)
    new = np.concatenate(([True], np.diff(names[order]) != 0))
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    h = 1
    while h < n and not (depth and 2 * h > depth):
        alone = new & np.append(new[1:], True)
        slot = np.flatnonzero(~alone)
        if not len(slot):
            break
        own = order[slot]
        nxt = np.zeros(len(own), np.int64)
        inside = own + h < n
        nxt[inside] = rank[own[inside] + h] + 1
        key = rank[own] * (n + 1) + nxt
        by = np.argsort(key)
        own, key = own[by], key[by]
        order[slot] = own
        first = np.concatenate(([True], key[1:] != key[:-1]))
        new[slot] = first
        rank[own] = np.maximum.accumulate(np.where(first, slot, 0))
        h *= 2
    return order


def suffix_array(t: np.ndarray, depth: int | None = None) -> np.ndarray:
    """The suffix array of ``t``, whose last value is smaller than all others.

    With ``depth``, suffixes that agree in their first ``depth`` values may stand in any order.
    """
    n = len(t)
    if n == 1:
        return np.zeros(1, np.int64)
    s = classify(t)
    lms = np.flatnonzero(s[1:] & ~s[:-1]) + 1
    if len(lms) > 1:
        first = induce(t, lms)
        is_lms = np.zeros(n, bool)
        is_lms[lms] = True
        ordered = first[is_lms[first]]
        end = np.zeros(n, np.int64)
        end[lms[:-1]] = lms[1:]
        end[lms[-1]] = lms[-1]
        name = np.empty(n, np.int64)
        name[ordered] = _names(t, ordered, end)
        lms = lms[_order_names(name[lms], depth)]
    return induce(t, lms)


def common_prefixes(t: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """Permuted common prefixes: for each place, how far its suffix agrees with the one before it in ``sa``, up to ``most``.

    They are computed in text order, eight bytes at a time; ``t`` holds bytes (values below 256).
    """
    n = len(t)
    before = np.empty(n, np.int64)
    before[sa[0]] = n
    before[sa[1:]] = sa[:-1]
    pad = np.zeros(2 * n + most + 16, np.uint8)[: n + most + 16]
    pad[:n] = t
    words = np.lib.stride_tricks.as_strided(pad.view(), (n + most + 8, 8), (1, 1))
    words = np.ascontiguousarray(words).view("<u8").ravel()
    out = np.zeros(n, np.int64)
    alive = np.flatnonzero(before < n)
    k = 0
    while len(alive) and k < most:
        diff = words[alive + k] ^ words[before[alive] + k]
        same = diff == 0
        rest = diff[~same]
        low = rest & (~rest + np.uint64(1))
        out[alive[~same]] = k + (np.log2(low.astype(np.float64)).astype(np.int64) >> 3)
        alive = alive[same]
        k += 8
        out[alive] = k
    return np.minimum(out, most)

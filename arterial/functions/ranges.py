"""Ranges of the day that may pass its end, as SQL expressions. Equal start and end mean the whole period."""

from __future__ import annotations

from ..schema import PERIOD


def holds(start: str, end: str, t: str) -> str:
    """Whether ``t`` (within the period) lies in start..end; the end is outside."""
    return f"CASE WHEN {start} = {end} THEN true WHEN {start} < {end} THEN {t} >= {start} AND {t} < {end} ELSE {t} >= {start} OR {t} < {end} END"


def straight_end(start: str, end: str, period: int = PERIOD) -> str:
    """The end as a time not before the start: one period later where the range passes the period's end."""
    return f"IF({end} <= {start}, {end} + {period}, {end})"


def parts(start: str, end: str, period: int = PERIOD) -> str:
    """The one or two parts within the period as an array of (start, end), none of them empty."""
    part = lambda a, b: f"named_struct('start', CAST({a} AS BIGINT), 'end', CAST({b} AS BIGINT))"
    both = f"filter(array({part(start, period)}, {part(0, end)}), p -> p.start < p.end)"
    return f"IF({start} < {end}, array({part(start, end)}), {both})"


def overlap(a_start: str, a_end: str, b_start: str, b_end: str) -> str:
    """The common part of two ranges that don't pass the period's end as (start, end); null where there is none."""
    start, end = f"greatest({a_start}, {b_start})", f"least({a_end}, {b_end})"
    return f"IF({start} < {end}, named_struct('start', {start}, 'end', {end}), NULL)"

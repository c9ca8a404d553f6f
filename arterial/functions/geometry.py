"""Predicates on points and segments in the plane, as SQL expressions over coordinates."""

from __future__ import annotations

Point = tuple[str, str]


def turn(a: Point, b: Point, c: Point, eps: float = 1e-9) -> str:
    """1 where c lies left of the line from a to b (counter-clockwise), -1 right of it, 0 on it."""
    area = f"(({b[0]}) - ({a[0]})) * (({c[1]}) - ({a[1]})) - (({b[1]}) - ({a[1]})) * (({c[0]}) - ({a[0]}))"
    return f"CASE WHEN {area} > {eps}D THEN 1 WHEN {area} < -{eps}D THEN -1 ELSE 0 END"


def in_order(a: Point, b: Point, c: Point, eps: float = 1e-9) -> str:
    """Whether the three lie on one line with b between the others."""
    between = " AND ".join(f"({b[k]}) BETWEEN least({a[k]}, {c[k]}) - {eps}D AND greatest({a[k]}, {c[k]}) + {eps}D" for k in (0, 1))
    return f"({turn(a, b, c, eps)} = 0 AND {between})"


def crosses(a: Point, b: Point, c: Point, d: Point, eps: float = 1e-9) -> str:
    """Whether the segments ab and cd cross, each with its ends on different sides of the other."""
    return f"(({turn(a, b, c, eps)}) * ({turn(a, b, d, eps)}) < 0 AND ({turn(c, d, a, eps)}) * ({turn(c, d, b, eps)}) < 0)"


def crossing(a: Point, b: Point, c: Point, d: Point) -> Point:
    """The point in which the lines through ab and cd meet; null where they are parallel."""
    dx1, dy1, dx2, dy2 = (f"(({q[k]}) - ({p[k]}))" for p, q in ((a, b), (c, d)) for k in (0, 1))
    share = f"((({c[0]}) - ({a[0]})) * {dy2} - (({c[1]}) - ({a[1]})) * {dx2}) / nullif({dx1} * {dy2} - {dy1} * {dx2}, 0)"
    return f"({a[0]}) + {dx1} * ({share})", f"({a[1]}) + {dy1} * ({share})"

"""Conventions shared by all operators.

Weights and times are longs (milliseconds by convention). ``NULL`` is "no path" in every table; inside
kernels ``INFINITY`` stands for it. Arcs are rows ``(arc_id, tail, head, weight)``, node ids are dense
from 0. A travel-time function is an array of ``(dep, tt)`` structs in rising order over one period.
"""

#: Fixed values of the data model.
INFINITY = 2147483647
PERIOD = 86_400_000
EPSILON = 1e-6

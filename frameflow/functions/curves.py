"""Clamped piecewise-linear curves as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def piecewise(x: Column | str, points) -> Column:
    """Interpolate x through (input, output) points; flat outside, NULL for NULL."""
    x = F.col(x) if isinstance(x, str) else x
    first, last = points[0], points[-1]
    out = F.when(x <= first[0], F.lit(float(first[1])))
    for (x0, y0), (x1, y1) in zip(points, points[1:]):
        out = out.when(x <= x1, F.lit(float(y0)) + F.lit(float(y1 - y0)) * (x - x0) / float(x1 - x0))
    return out.when(x.isNotNull(), F.lit(float(last[1])))

"""Tests of points in the plane, given their two coordinates."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def in_box(x: Column, y: Column, min_x: float, min_y: float, max_x: float, max_y: float) -> Column:
    """All sides belong to the box; NaN bounds hold nothing."""
    if any(math.isnan(v) for v in (min_x, min_y, max_x, max_y)):
        return F.lit(False)
    return x.between(min_x, max_x) & y.between(min_y, max_y)


def in_circle(x: Column, y: Column, cx: float, cy: float, radius: float) -> Column:
    """Squared distances are compared, after a bracket on x that a scan can use."""
    if any(math.isnan(v) for v in (cx, cy, radius)) or radius < 0:
        return F.lit(False)
    dx, dy = x - F.lit(float(cx)), y - F.lit(float(cy))
    squared = float(radius) * float(radius)
    inside = dx * dx + dy * dy <= F.lit(squared)
    inside = inside & ~F.isnan(x) & ~F.isnan(y) if math.isinf(squared) else inside
    return x.between(cx - radius, cx + radius) & inside

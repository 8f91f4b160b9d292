"""Geometry predicates and cell arithmetic as plain Column expressions."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Bounds(NamedTuple):
    """Axis-parallel box."""

    min_x: float
    min_y: float
    max_x: float
    max_y: float


def in_disc(x: Column, y: Column, cx: Column, cy: Column, r: Column) -> Column:
    """True when (x, y) lies in the closed disc; the sign of ``r`` does not matter."""
    return (x - cx) * (x - cx) + (y - cy) * (y - cy) <= r * r


def clamp(value: Column, low: float, high: float) -> Column:
    """Clip ``value`` into ``[low, high]``."""
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), value))


def grid_cell(value: Column, low: float, high: float, cells: int) -> Column:
    """Index of the equal-width cell along one axis.

    Truncates toward zero and caps only the upper end, so values below ``low`` may get
    negative indexes.  An axis of zero width has the single cell 0.
    """
    width = (float(high) - float(low)) / cells
    if width == 0.0:
        return F.lit(0)
    # capping before the cast gives the same index and keeps far outliers from overflowing INT
    position = F.least((value - F.lit(float(low))) / F.lit(width), F.lit(float(cells - 1)))
    return F.greatest(position, F.lit(-2147483648.0)).cast("int")


def is_finite(*columns: Column) -> Column:
    """True when no column is null, NaN or infinite."""
    infinity = F.lit(float("inf"))
    checks = [c.isNotNull() & ~F.isnan(c) & (F.abs(c) < infinity) for c in columns]
    result = checks[0]
    for check in checks[1:]:
        result = result & check
    return result

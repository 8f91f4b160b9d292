"""Ratios and display strings."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def percentage(part: Column, whole: Column) -> Column:
    """``100 * part / whole`` to one decimal; 0 when ``whole`` is not positive or missing."""
    # the inner guard keeps ANSI division safe wherever the optimizer places the expression
    ratio = part.cast("double") * 100.0 / F.when(whole > 0, whole.cast("double"))
    return F.when(whole > 0, F.round(ratio, 1)).otherwise(F.lit(0.0))


def utilisation(used: Column, capacity: Column) -> Column:
    """``used / capacity * 100`` to one decimal; 0 when there is no capacity."""
    ratio = used.cast("double") / F.when(capacity > 0, capacity.cast("double")) * 100.0
    return F.when(capacity > 0, F.round(ratio, 1)).otherwise(F.lit(0.0))


def guess_count(k: int, epsilon: float) -> int:
    """Number of threshold guesses needed to bracket the unknown optimum."""
    check_parameters(k, epsilon)
    return math.ceil(math.log(k) / math.log(1 + epsilon)) + 1


def check_parameters(k: int, epsilon: float) -> None:
    if k < 1:
        raise ValueError(f"k must be at least 1, got {k}")
    if not (epsilon > 0 and math.isfinite(epsilon)):
        raise ValueError(f"epsilon must be a positive number, got {epsilon}")


def elapsed_text(start_ms: Column, now_ms: Column) -> Column:
    """Elapsed time as ``"3m 7s"``, or ``"7s"`` below one minute."""
    seconds = F.floor((now_ms - start_ms) / F.lit(1000)).cast("bigint")
    minutes = F.floor(seconds / F.lit(60)).cast("bigint")
    # remainder keeps the sign of the dividend, as for clocks that run ahead of "now"
    rest = (seconds % F.lit(60)).cast("bigint")
    return F.when(minutes > 0, F.format_string("%dm %ds", minutes, rest)).otherwise(
        F.format_string("%ds", rest)
    )

"""Coverage of circle sets and marginal gains of candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from encircle.operators.grid import BROADCAST_ROWS
from encircle.operators.pairs import count_by_circle, covered_points, uncovered_points

_CIRCLE = ("circle_id", "cx", "cy", "r")


def point_count(points: DataFrame) -> DataFrame:
    """One row: ``points``."""
    return points.agg(F.count("*").alias("points"))


def set_coverage(
    points: DataFrame, selected: DataFrame, broadcast_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """One row: ``coverage``, the number of points inside any selected circle."""
    return covered_points(points, selected, broadcast_rows).agg(F.count("*").alias("coverage"))


def coverage_by_circle(
    points: DataFrame, circles: DataFrame, broadcast_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """``circle_id, coverage`` for every circle, zeros included."""
    return count_by_circle(
        points, circles.select(*_CIRCLE), "coverage", broadcast_rows
    ).select("circle_id", "coverage")


def best_single(
    points: DataFrame, circles: DataFrame, broadcast_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """The circle covering most points; the lowest id among equals."""
    return (
        coverage_by_circle(points, circles, broadcast_rows)
        .orderBy(F.desc("coverage"), "circle_id")
        .limit(1)
    )


def remaining_circles(circles: DataFrame, selected: DataFrame) -> DataFrame:
    """Candidates that are not selected yet."""
    return circles.join(selected.select("circle_id"), "circle_id", "left_anti")


def add_circle(selected: DataFrame, circle: DataFrame) -> DataFrame:
    """The selected set with the given circles added; a set, so nothing is added twice."""
    added = circle.join(selected.select("circle_id"), "circle_id", "left_anti")
    return selected.unionByName(added.select(*selected.columns))


def marginal_gain(
    points: DataFrame,
    selected: DataFrame,
    candidate: DataFrame,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """One row: ``gain``, the points a candidate adds to the selected set."""
    inside = covered_points(points, candidate, broadcast_rows)
    return uncovered_points(inside, selected, broadcast_rows).agg(F.count("*").alias("gain"))


def marginal_gains(
    points: DataFrame,
    circles: DataFrame,
    selected: DataFrame,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """``circle_id, gain`` for every remaining candidate, zeros included."""
    open_points = uncovered_points(points, selected, broadcast_rows)
    candidates = remaining_circles(circles, selected)
    return count_by_circle(
        open_points, candidates.select(*_CIRCLE), "gain", broadcast_rows
    ).select("circle_id", "gain")


def candidates_above(gains: DataFrame, threshold: float) -> DataFrame:
    """Candidates whose gain reaches the threshold."""
    return gains.where(F.col("gain") >= F.lit(float(threshold)))


def first_candidate_above(gains: DataFrame, threshold: float) -> DataFrame:
    """The lowest-numbered candidate that reaches the threshold: one row or none."""
    first = F.min(F.struct("circle_id", "gain")).alias("first")
    return candidates_above(gains, threshold).agg(first).where("first IS NOT NULL").select("first.*")

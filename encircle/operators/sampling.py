"""Samples for display: repeatable, and independent of how the points are partitioned."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from encircle.functions.geometry import Bounds, clamp, grid_cell
from encircle.functions.hashing import hash_uniform, sample_order
from encircle.functions.numbers import percentage

# When and how much to sample.
SHOW_ALL_UP_TO = 5_000
UNIFORM_UP_TO = 50_000
GRID = 50
PER_CELL = 10
SEED = 42

#: Slices of a cell when a large sample of it is cut in two steps.
SLICES = 256


def clamp_points(points: DataFrame, bounds: Bounds) -> DataFrame:
    """Points moved to the nearest place inside the box."""
    return points.withColumns(
        {
            "x": clamp(F.col("x"), bounds.min_x, bounds.max_x),
            "y": clamp(F.col("y"), bounds.min_y, bounds.max_y),
        }
    )


def grid_cells(points: DataFrame, bounds: Bounds, grid: int = GRID) -> DataFrame:
    """Points with their ``cell_x`` and ``cell_y``."""
    return points.withColumns(
        {
            "cell_x": grid_cell(F.col("x"), bounds.min_x, bounds.max_x, grid),
            "cell_y": grid_cell(F.col("y"), bounds.min_y, bounds.max_y, grid),
        }
    )


def cell_density(points: DataFrame, bounds: Bounds, grid: int = GRID) -> DataFrame:
    """Number of points per occupied cell."""
    return (
        grid_cells(points, bounds, grid)
        .groupBy("cell_x", "cell_y")
        .agg(F.count("*").alias("points"))
    )


def uniform_sample(
    points: DataFrame, max_rows: int = SHOW_ALL_UP_TO, seed: int = SEED, total: int | None = None
) -> DataFrame:
    """All points when there are few, else each one with probability ``max_rows / total``."""
    total = points.count() if total is None else total
    if total <= max_rows:
        return points
    draw = hash_uniform(seed, "sample", F.col("point_id"))
    return points.where(draw < F.lit(max_rows / total))


def stratified_sample(
    points: DataFrame, bounds: Bounds, grid: int = GRID, per_cell: int = PER_CELL
) -> DataFrame:
    """At most ``per_cell`` points of every cell, in a scrambled order fixed by the id.

    Spark also applies the rank filter inside each task before the shuffle, so a crowded cell sends
    at most ``per_cell`` rows per task, however many points it holds.  It does so up to a limit of
    its own (``spark.sql.optimizer.windowGroupLimitThreshold``); beyond it, every cell is first cut
    slice by slice, so that no task sorts a whole crowded cell.  The sample is the same.
    """
    cells = grid_cells(points, bounds, grid)
    cut_early = int(points.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    if per_cell > cut_early:
        sliced = cells.withColumn("_slice", F.pmod(F.xxhash64("point_id"), F.lit(SLICES)))
        cells = _first_of(sliced, ["cell_x", "cell_y", "_slice"], per_cell).drop("_slice")
    return _first_of(cells, ["cell_x", "cell_y"], per_cell)


def _first_of(rows: DataFrame, key: list[str], n: int) -> DataFrame:
    """The first ``n`` rows of every key in the scrambled order."""
    order = Window.partitionBy(*key).orderBy(sample_order(F.col("point_id")), "point_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).drop("rank")


def display_sample(
    points: DataFrame, bounds: Bounds, all_up_to: int = SHOW_ALL_UP_TO, uniform_up_to: int = UNIFORM_UP_TO
) -> DataFrame:
    """Everything up to ``all_up_to`` points, then that many drawn uniformly up to
    ``uniform_up_to`` points, beyond that a stratified sample."""
    total = points.count()
    if total <= all_up_to:
        return points
    if total <= uniform_up_to:
        return uniform_sample(points, all_up_to, total=total)
    return stratified_sample(points, bounds).select(*points.columns)


def sampling_info(points: DataFrame, shown: DataFrame) -> DataFrame:
    """One row: how many points are shown, out of how many, and a label saying so."""
    total = points.agg(F.count("*")).scalar()
    counted = shown.agg(F.count("*").alias("displayed")).withColumn("total", total)
    is_sampled = F.col("total") > F.col("displayed")
    whole = F.format_number("total", 0)
    return counted.select(
        "displayed",
        "total",
        is_sampled.alias("is_sampled"),
        F.when(is_sampled, percentage(F.col("displayed"), F.col("total")))
        .otherwise(F.lit(100.0))
        .alias("percentage"),
        F.when(
            is_sampled, F.concat(whole, F.lit(" ("), F.format_number("displayed", 0), F.lit(" shown)"))
        )
        .otherwise(whole)
        .alias("points_label"),
    )

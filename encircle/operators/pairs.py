"""Which points lie in which circles."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from encircle.functions.geometry import in_disc
from encircle.operators.grid import (
    BROADCAST_ROWS,
    CircleGrid,
    SplitCircles,
    candidate_join,
    cell_totals,
    circle_grid,
    point_key,
    split_circles,
    split_depth,
    tasks_for,
    weighted,
)
from encircle.operators.skew import hot_keys, sliced_join
from encircle.operators.tiles import counts_in_tiles
from encircle.session import cut_lineage

#: Disc tests from which points are counted in circles by searches in every cell.
TILE_TESTS = 1 << 28


def hits(
    points: DataFrame,
    grid: CircleGrid,
    spread_by: tuple[str, ...] = ("point_id",),
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Point columns and circle columns for every point inside a circle."""
    inside = in_disc(F.col("x"), F.col("y"), F.col("cx"), F.col("cy"), F.col("r"))
    return candidate_join(points, grid, spread_by, broadcast_rows).where(inside)


def coverage_pairs(
    points: DataFrame, circles: DataFrame, broadcast_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """``point_id, circle_id`` for every point inside a circle."""
    grid = circle_grid(circles)
    if grid.is_dense and grid.fits_broadcast(broadcast_rows):
        grid, count = weighted(points, grid)
        if grid.is_dense:
            points = points.repartition(tasks_for(count * grid.candidates_per_point, points), "point_id")
    return hits(points, grid, broadcast_rows=broadcast_rows).select("point_id", "circle_id")


def positions(points: DataFrame) -> DataFrame:
    """Distinct ``x, y`` with their number of points ``w``.

    Merged before the shuffle, so a popular position costs no more than any other, and spread
    evenly however the input was laid out.
    """
    return points.groupBy("x", "y").agg(F.count("*").alias("w"))


def _spread_positions(points: DataFrame, tests: float) -> DataFrame:
    # Adaptive execution sizes partitions by bytes and would leave many tests to few tasks.  The
    # hash keeps this from being folded into the shuffle of the merge, which it may shrink.
    return positions(points).repartition(tasks_for(tests, points), F.xxhash64("x", "y"))


@dataclass(frozen=True)
class Meeting:
    """How points and circles meet: the circles' grid with its measured density, and the points."""

    grid: CircleGrid
    points: int  #: 0 where there are too few circles for it to matter

    @property
    def tests(self) -> float:
        return self.points * self.grid.candidates_per_point

    @property
    def depth(self) -> int:
        return split_depth(self.points, self.grid) if self.grid.is_very_dense and not self.tiled else 0

    @property
    def tiled(self) -> bool:
        """Whether there are so many tests that neither they nor the cells that save them should be rows."""
        return self.grid.is_very_dense and self.tests > TILE_TESTS

    def of_some(self, circles: DataFrame) -> Meeting:
        """What to expect of the same points and some of the circles, without another look at the points."""
        grid = circle_grid(circles)
        share = grid.circles / max(1, self.grid.circles)
        expected = min(float(grid.circles), self.grid.candidates_per_point * share)
        return Meeting(replace(grid, candidates_per_point=expected), self.points)


def meeting(points: DataFrame, circles: DataFrame) -> Meeting:
    """Measure how points and circles meet; one pass over the points unless there are few circles."""
    grid, count = circle_grid(circles), 0
    if grid.is_dense:
        grid, count = weighted(points, grid)
    return Meeting(grid, count)


def count_by_circle(
    points: DataFrame,
    circles: DataFrame,
    name: str,
    broadcast_rows: int = BROADCAST_ROWS,
    depth: int | None = None,
    met: Meeting | None = None,
) -> DataFrame:
    """Circle columns plus the number of points inside, zeros included.

    ``points`` has ``x, y`` and, where it is already merged by position, a weight ``w``.
    Where points meet very many circles, cells inside a circle are counted as a whole and only
    points in the cells on its rim are tested; ``depth`` overrules how fine those cells are.
    Beyond TILE_TESTS the points and circles of a cell meet in one function (``tiles.py``).
    """
    met = met or meeting(points, circles)
    if "w" not in points.columns:
        if met.tiled and depth is None:
            points = positions(points)
        else:
            points = _spread_positions(points, met.tests) if met.grid.is_dense else points.withColumn("w", F.lit(1))
    counted = _counts(points.select("x", "y", "w"), circles, met, depth, (), broadcast_rows)
    return circles.join(counted, "circle_id", "left").select(
        *circles.columns, F.coalesce("_n", F.lit(0)).alias(name)
    )


def count_by_circle_and(
    by: tuple[str, ...],
    points: DataFrame,
    circles: DataFrame,
    name: str,
    broadcast_rows: int = BROADCAST_ROWS,
    depth: int | None = None,
    met: Meeting | None = None,
) -> DataFrame:
    """``circle_id``, the columns ``by`` of the points and their number, where there are any.

    ``points`` has ``x, y, w`` and ``by``.  Where they meet very many circles, they are counted per
    cell and value of ``by``; cells inside a circle are joined by these totals, whatever the number
    of points in them, and only the points in the cells on its rim are tested.
    """
    met = met or meeting(points, circles)
    points = points.select("x", "y", "w", *by)
    if (met.depth if depth is None else depth) > 0:
        points = cut_lineage(points)  # used twice
    return _counts(points, circles, met, depth, by, broadcast_rows).withColumnRenamed("_n", name)


def _counts(
    points: DataFrame, circles: DataFrame, met: Meeting, depth: int | None, by: tuple[str, ...], broadcast_rows: int
) -> DataFrame:
    tiled = met.tiled and depth is None
    depth = met.depth if depth is None else depth
    if tiled:
        parts = counts_in_tiles(points, met.grid, by)
    elif depth > 0:
        parts = _counts_by_cells(points, split_circles(circles, depth), by, broadcast_rows)
    else:
        parts = _counts_by_tests(points, met.grid, by, broadcast_rows)
    # partial sums leave each task with one row per circle (and group), whatever the number of points
    return parts.groupBy("circle_id", *by).agg(F.sum("_n").alias("_n"))


def _counts_by_tests(
    points: DataFrame, grid: CircleGrid, by: tuple[str, ...], broadcast_rows: int
) -> DataFrame:
    return hits(points, grid, ("x", "y"), broadcast_rows).select(
        "circle_id", *by, F.col("w").cast("bigint").alias("_n")
    )


def _counts_by_cells(
    points: DataFrame, split: SplitCircles, by: tuple[str, ...], broadcast_rows: int
) -> DataFrame:
    on_rim = _counts_by_tests(points, split.rim, by, broadcast_rows)
    if not split.whole_rows:
        return on_rim
    cell = ["_e", "_gx", "_gy"]
    totals = cell_totals(points, split.whole_exponents, by)
    whole = split.whole.select("circle_id", *cell)
    if split.whole_rows <= broadcast_rows:
        inside = totals.join(F.broadcast(whole), cell)
    else:
        hot = hot_keys(whole.groupBy(*cell).agg(F.count("*").alias("_c")), cell, "_c")
        inside = sliced_join(whole, totals, cell, hot, ("circle_id",))
    return on_rim.unionByName(inside.select("circle_id", *by, "_n"))


def _with_near(
    points: DataFrame, grid: CircleGrid, payload: list[str]
) -> tuple[DataFrame, list[Column]]:
    """Points with one array of nearby circles per grid, by broadcast lookups of their cells."""
    entry = F.struct(*payload, "cx", "cy", "r")
    per_cell = grid.cells.groupBy("cell").agg(F.collect_list(entry).alias("_near"))
    placed, near = points, []
    for number, exponent in enumerate(grid.exponents):
        name = f"_near{number}"
        placed = (
            placed.withColumn("cell", point_key(F.lit(exponent)))
            .join(F.broadcast(per_cell), "cell", "left")
            .withColumnRenamed("_near", name)
            .drop("cell")
        )
        near.append(F.col(name))
    return placed, near


def with_circles_at(
    points: DataFrame, grid: CircleGrid, payload: list[str], keep_outside: bool = False
) -> DataFrame:
    """Append ``inside``: the payload structs, in order, of the circles that contain the point.

    For circle sets of a checked size only: the points are neither moved nor multiplied.  Points
    outside all circles are dropped unless they are to be kept, with an empty array.
    """
    placed, near = _with_near(points, grid, payload)
    candidates = near[0]
    if len(near) > 1:
        candidates = F.flatten(F.array_compact(F.array(*near)))
    inside = F.transform(
        F.filter(
            candidates, lambda c: in_disc(F.col("x"), F.col("y"), c["cx"], c["cy"], c["r"])
        ),
        lambda c: F.struct(*[c[name].alias(name) for name in payload]),
    )
    found = placed.select(*points.columns, F.coalesce(F.array_sort(inside), F.array()).alias("inside"))
    return found if keep_outside else found.where(F.size("inside") > 0)


def covered_points(
    points: DataFrame, selected: DataFrame, broadcast_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Points inside at least one selected circle."""
    grid = circle_grid(selected)
    if grid.fits_broadcast(broadcast_rows):
        return points.where(F.lit(False)) if not grid.exponents else _split(points, grid, True)
    return points.join(_covered_ids(points, grid, broadcast_rows), "point_id", "left_semi")


def uncovered_points(
    points: DataFrame, selected: DataFrame, broadcast_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Points inside none of the selected circles."""
    grid = circle_grid(selected)
    if grid.fits_broadcast(broadcast_rows):
        return points if not grid.exponents else _split(points, grid, False)
    return points.join(_covered_ids(points, grid, broadcast_rows), "point_id", "left_anti")


def _split(points: DataFrame, grid: CircleGrid, covered: bool) -> DataFrame:
    """Covered or uncovered points, found where they are: no shuffle of the points.

    One existence test per grid: a lookup of the point's cell in the broadcast circles, with the
    disc test as a condition of the join, in generated code.  It ends at the first circle found.
    """
    keys = {f"_cell{i}": point_key(F.lit(e)) for i, e in enumerate(grid.exponents)}
    # renamed: no column of the points can be taken for one of the circles
    circles = grid.cells.select("cell", "cx", "cy", "r").toDF("_at", "_cx", "_cy", "_r")
    inside = in_disc(F.col("x").outer(), F.col("y").outer(), F.col("_cx"), F.col("_cy"), F.col("_r"))
    found = F.lit(False)
    for key in keys:
        held = circles.where((F.col("_at") == F.col(key).outer()) & inside)
        found = found | F.broadcast(held).exists()
    return points.withColumns(keys).where(found if covered else ~found).select(*points.columns)


def _covered_ids(points: DataFrame, grid: CircleGrid, broadcast_rows: int) -> DataFrame:
    # distinct before the shuffle: a point inside many circles travels once
    return hits(points, grid, broadcast_rows=broadcast_rows).select("point_id").distinct()

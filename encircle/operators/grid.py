"""Dyadic grid that turns the point-in-circle theta join into an equi-join.

A circle lives on the grid whose cell width is the power of two just below its radius, so its
bounding box meets at most 5 x 5 cells however large or small it is.  A point is looked up once
per grid in use; grids that hold few circles are merged into coarser ones where the lookups saved
are worth more than the tests added.  Cell coordinates are packed into one BIGINT: 11 bits for the grid, 26 for each
axis, wrapped around.  Wrapping can only bring in extra candidates, which the exact disc test
drops again; the cells of one circle always keep different keys, so no pair comes up twice.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from encircle.operators.skew import hot_products, product_join
from encircle.session import cut_lineage, shuffle_partitions

AXIS_BITS = 26
AXIS_MASK = (1 << AXIS_BITS) - 1
EXPONENT_BITS = 11

#: Most cells a circle can meet on its grid.
CELLS_PER_CIRCLE = 25

#: Largest circle side, in cell rows, that is sent to every executor (about 100 bytes a row).
BROADCAST_ROWS = 2_000_000

#: Candidates per point above which the points are dealt out again before the join, so that the
#: work does not follow the layout of the input files.
DENSE = 32

#: Cost of looking up a point on one more grid, in disc tests.
LOOKUP_COST = 16

#: Cost of a cell row (made, sent and put into a hash table) in disc tests.
CELL_COST = 500
MAX_DEPTH = 8

#: Buckets of the sketch of points and circles per cell.
SKETCH_BUCKETS = 1 << 16

#: Disc tests that are worth a task of their own, and how far they may raise the number of tasks
#: above the session's.
TASK_TESTS = 1 << 24
MOST_TASKS = 16


def _reach() -> Column:
    """|r| widened by a few units in the last place, so rounding never loses a candidate."""
    pad = (F.abs("cx") + F.abs("cy") + F.abs("r")) * F.lit(1e-15)
    return F.abs("r") + pad


def grid_exponent() -> Column:
    """Grid of a circle: ``reach / 2 < 2^e <= reach`` (0 for a circle of reach 0)."""
    return F.coalesce(F.floor(F.log2(_reach())).cast("int"), F.lit(0))


def _width(exponent: Column) -> Column:
    return F.pow(F.lit(2.0), exponent.cast("double"))


def pack_cell(exponent: Column, gx: Column, gy: Column) -> Column:
    """One BIGINT for (grid, cell x, cell y)."""
    level = exponent.cast("bigint").bitwiseAND(F.lit((1 << EXPONENT_BITS) - 1))
    x = gx.bitwiseAND(F.lit(AXIS_MASK))
    y = gy.bitwiseAND(F.lit(AXIS_MASK))
    return (
        F.shiftleft(level, 2 * AXIS_BITS).bitwiseOR(F.shiftleft(x, AXIS_BITS)).bitwiseOR(y)
    )


def point_key(exponent: Column) -> Column:
    """Cell key of (x, y) on the grid with that exponent."""
    width = _width(exponent)
    return pack_cell(exponent, F.floor(F.col("x") / width), F.floor(F.col("y") / width))


@dataclass(frozen=True)
class CircleGrid:
    """Circles spread over grid cells, with what is needed to choose a join for them."""

    cells: DataFrame  #: the circle columns plus ``cell``
    exponents: tuple[int, ...]  #: grids in use; at most one per binary exponent of a double
    cell_rows: int  #: no fewer than there are
    #: Circles a point meets in its cells: their number, unless :func:`weighted` knows better.
    candidates_per_point: float
    circles: int = 0

    def fits_broadcast(self, limit: int) -> bool:
        return self.cell_rows <= limit

    @property
    def is_dense(self) -> bool:
        """Whether a point meets so many candidates that moving it once is the smaller cost."""
        return self.candidates_per_point > DENSE

    @property
    def is_very_dense(self) -> bool:
        """Whether it is worth finding out if whole cells should be counted unseen."""
        return self.candidates_per_point > 8 * DENSE


def _spread(circles: DataFrame, levels: list[int] | None = None) -> DataFrame:
    """Circles with the grid ``_e`` and every cell ``_gx, _gy`` of their bounding box.

    With ``levels``, a circle is lifted to the next of these grids; the last is the coarsest.
    """
    placed = circles.withColumn("_reach", _reach()).withColumn("_e", grid_exponent())
    if levels:
        lifted = F.lit(levels[-1])
        for level in reversed(levels[:-1]):
            lifted = F.when(F.col("_e") <= level, F.lit(level)).otherwise(lifted)
        placed = placed.withColumn("_e", lifted)
    for axis in "xy":
        placed = placed.withColumn(f"_g{axis}", F.explode(F.sequence(*_cells_along(axis))))
    return placed.select(*circles.columns, "_e", "_gx", "_gy")


def _cells_along(axis: str) -> tuple[Column, Column]:
    """First and last cell of the circle's bounding box."""
    width = _width(F.col("_e"))
    low, high = (F.floor((F.col(f"c{axis}") + side * F.col("_reach")) / width) for side in (-1, 1))
    return low, high


def _cell() -> Column:
    return pack_cell(F.col("_e"), F.col("_gx"), F.col("_gy")).alias("cell")


def circle_grid(circles: DataFrame) -> CircleGrid:
    """Spread circles over the cells of as few grids as pays (one small job over the circles)."""
    (x0, x1), (y0, y1) = (_cells_along(axis) for axis in "xy")
    box = [f(f"c{axis}").alias(f"{f.__name__}_{axis}") for axis in "xy" for f in (F.min, F.max)]
    # one row per binary exponent reaches the driver
    found = (
        circles.select("cx", "cy", _reach().alias("_reach"), grid_exponent().alias("_e"))
        .withColumn("_rows", (x1 - x0 + 1) * (y1 - y0 + 1))
        .groupBy("_e")
        .agg(F.count("*").alias("n"), F.sum("_rows").alias("rows"), *box)
        .collect()
    )
    area = 0.0
    if found:
        area = math.prod(max(r[f"max_{axis}"] for r in found) - min(r[f"min_{axis}"] for r in found) for axis in "xy")
    levels = lifted_levels(Census({r["_e"]: r["n"] for r in found}, area))
    total = sum(r["n"] for r in found)
    rows = sum(r["rows"] for r in found)  # grids nest: a lifted circle meets no more cells
    cells = _spread(circles, levels).select(*circles.columns, _cell())
    return CircleGrid(cells, tuple(levels), rows, float(total), total)


@dataclass(frozen=True)
class Census:
    """Circles per grid and the area of the box around their centres."""

    circles: dict[int, int]
    area: float


def lifted_levels(census: Census) -> list[int]:
    """The grids to keep, ascending: those where a point costs least, the coarsest among them.

    A grid costs every point a lookup.  A circle costs a point a test if the point shares a cell
    with it; the chance is the area of the circle's cells over the area that holds the circles, and
    never more than 1, so it is the number of circles lifted that bounds the harm of a bad guess.
    """
    exponents = sorted(census.circles)

    def tests(e: int, level: int) -> float:
        # compared by logarithms: the square of a width may overflow
        side = max(3 * 2.0 ** (e - level), 0.0) + 1.0
        share = 0.0 if census.area <= 0 else 2 * (level + math.log2(side)) - math.log2(census.area)
        return census.circles[e] * 2.0 ** min(0.0, share)

    # best[i]: least cost of the grids up to the i-th, which is kept, and the kept one before it
    best: list[tuple[float, int]] = []
    for i, level in enumerate(exponents):
        here, cost = [], 0.0
        for j in range(i, -1, -1):
            cost += tests(exponents[j], level)
            here.append((cost + LOOKUP_COST + (best[j - 1][0] if j else 0.0), j - 1))
        best.append(min(here))
    kept, i = [], len(exponents) - 1
    while i >= 0:
        kept.append(exponents[i])
        i = best[i][1]
    return kept[::-1]


def weighted(points: DataFrame, grid: CircleGrid) -> tuple[CircleGrid, int]:
    """The grid with its density where the points are, and the number of points (one pass).

    A mean over occupied cells would know nothing of where the points lie and miss a popular cell
    among many quiet ones.  Points and circles per cell are counted in SKETCH_BUCKETS buckets of a
    hash of the cell; the counts of any parts of the data add up, so they leave a task as one row
    per bucket, however many cells there are.  Cells that share a bucket add
    ``rows x rows / buckets`` products to the sum by chance, which are taken off again.
    """
    bucket = F.pmod(F.xxhash64("cell"), F.lit(SKETCH_BUCKETS)).alias("bucket")
    there = with_cells(points, grid.exponents).groupBy(bucket).agg(F.count("*").alias("n"))
    here = grid.cells.groupBy(bucket).agg(F.count("*").alias("m"))
    met = there.join(here, "bucket", "left").agg(
        F.sum("n").alias("rows"), F.sum(F.col("n").cast("double") * F.coalesce("m", F.lit(0))).alias("products")
    ).first()
    looked_up = met["rows"] or 0
    if not looked_up:
        return grid, 0
    by_chance = looked_up * (grid.cell_rows / SKETCH_BUCKETS)
    tests = max(0.0, (met["products"] - by_chance) * SKETCH_BUCKETS / (SKETCH_BUCKETS - 1))
    count = looked_up // len(grid.exponents)
    return replace(grid, candidates_per_point=min(tests / count, grid.candidates_per_point)), count


def tasks_for(tests: float, frame: DataFrame) -> int:
    """Partitions for a join of so many disc tests; adaptive execution would only see its bytes."""
    usual = shuffle_partitions(frame)
    return max(usual, min(MOST_TASKS * usual, int(-(-tests // TASK_TESTS))))


@dataclass(frozen=True)
class SplitCircles:
    """Circles taken apart into cells that lie inside them and cells their rim runs through."""

    whole: DataFrame  #: the circle columns plus the cell as ``_e, _gx, _gy``
    whole_rows: int
    whole_exponents: tuple[int, ...]
    rim: CircleGrid


def split_circles(circles: DataFrame, depth: int) -> SplitCircles:
    """Quarter the cells on the rim ``depth`` times.

    A circle ends up with O(2^depth) cells of either kind, while the area of its rim cells, and
    with it the number of points that need the disc test, halves with every step.  Cells within
    rounding distance of the rim count as rim cells, so whole cells are safe to count unseen.
    """
    near, far = _distances()
    margin = F.abs("r") * F.lit(1e-9) + (F.abs("cx") + F.abs("cy")) * F.lit(1e-14)
    outer, inner = F.abs("r") + margin, F.abs("r") - margin
    # cell numbers beyond 2^52 are not exact; such cells stay rim cells of their grid
    exact = (F.abs("_gx") < F.lit(1 << 52)) & (F.abs("_gy") < F.lit(1 << 52))
    touched = near <= outer * outer
    whole = exact & (inner > 0) & (far < inner * inner)

    # few rows in, many out: deal the circles out first
    spread = _spread(circles.repartition("circle_id")).withColumn("_w", _width(F.col("_e")))
    cells = spread.where(touched).withColumn("_whole", whole)
    for _ in range(depth):
        kept = F.array(F.struct("_e", "_gx", "_gy", "_w"))
        quarters = F.array(
            *[
                F.struct(
                    (F.col("_e") - 1).alias("_e"),
                    (F.col("_gx") * 2 + right).alias("_gx"),
                    (F.col("_gy") * 2 + up).alias("_gy"),
                    (F.col("_w") / 2).alias("_w"),
                )
                for right in (0, 1)
                for up in (0, 1)
            ]
        )
        split = F.when(F.col("_whole") | ~exact, kept).otherwise(quarters)
        cells = (
            cells.select(*circles.columns, F.col("_whole").alias("_was"), F.inline(split))
            .where(F.col("_was") | touched)
            .withColumn("_whole", F.col("_was") | whole)
            .drop("_was")
        )
    cells = cut_lineage(cells.drop("_w"))  # used four times
    levels = cells.groupBy("_whole", "_e").agg(F.count("*").alias("rows")).collect()

    def of(whole: bool) -> tuple[tuple[int, ...], int]:
        mine = [level for level in levels if level["_whole"] == whole]
        return tuple(sorted(level["_e"] for level in mine)), sum(level["rows"] for level in mine)

    exponents, rows = of(True)
    rim_exponents, rim_rows = of(False)
    rim = cells.where("NOT _whole").select(*circles.columns, _cell())
    return SplitCircles(
        cells.where("_whole").drop("_whole"), rows, exponents,
        CircleGrid(rim, rim_exponents, rim_rows, math.inf),
    )


def _distances() -> tuple[Column, Column]:
    """Squared distance from the centre to the nearest and the farthest point of the cell."""
    near, far = F.lit(0.0), F.lit(0.0)
    for axis in ("x", "y"):
        low = F.col(f"_g{axis}").cast("double") * F.col("_w") - F.col(f"c{axis}")
        high = low + F.col("_w")
        closest = F.greatest(low, -high, F.lit(0.0))
        farthest = F.greatest(F.abs(low), F.abs(high))
        near, far = near + closest * closest, far + farthest * farthest
    return near, far


def cell_totals(positions: DataFrame, exponents: tuple[int, ...], by: tuple[str, ...] = ()) -> DataFrame:
    """``_e, _gx, _gy, _n``: number of points in every occupied cell of the given grids.

    With columns ``by``, the points of a cell are counted for each of their values.  Points are
    counted on the finest grid first.  The grids nest, so any point of a fine cell tells in which
    coarse cell all of them are.
    """
    finest = _width(F.lit(min(exponents)))
    keys = []
    for axis in ("x", "y"):
        number = F.col(axis) / finest
        # too far out for an exact cell number: leave such points apart
        far_out = F.when(F.abs(number) >= F.lit(2.0**62), F.col(axis))
        keys += [F.floor(number).alias(f"_f{axis}"), far_out.alias(f"_o{axis}")]
    fine = positions.groupBy(*keys, *by).agg(
        F.min("x").alias("x"), F.min("y").alias("y"), F.sum("w").alias("w")
    )
    width = _width(F.col("_e"))
    return (
        fine.withColumn("_e", F.explode(F.array(*[F.lit(e) for e in exponents])))
        .groupBy("_e", F.floor(F.col("x") / width).alias("_gx"), F.floor(F.col("y") / width).alias("_gy"), *by)
        .agg(F.sum("w").alias("_n"))
    )


def split_depth(points: int, grid: CircleGrid) -> int:
    """How often to quarter the rim cells: 0 unless it saves more tests than it adds rows."""
    tests = points * grid.candidates_per_point
    best, best_cost = 0, float(tests)
    for depth in range(1, MAX_DEPTH + 1):
        # rough shares: rim cells of depth 1 cover 2/5 of the bounding box cells, and there are
        # about three times as many cells; from then on the area halves and the number doubles
        step = 2.0 ** (depth - 1)
        cost = tests * 0.4 / step + grid.cell_rows * 3 * step * CELL_COST
        if cost < best_cost:
            best, best_cost = depth, cost
    return best


def with_cells(points: DataFrame, exponents: tuple[int, ...]) -> DataFrame:
    """One row per point and grid, with the point's ``cell`` there."""
    if not exponents:
        return points.withColumn("cell", F.lit(0).cast("bigint")).where(F.lit(False))
    if len(exponents) == 1:
        return points.withColumn("cell", point_key(F.lit(exponents[0])))
    grids = F.explode(F.array(*[F.lit(e) for e in exponents]))
    return (
        points.withColumn("_grid", grids).withColumn("cell", point_key(F.col("_grid"))).drop("_grid")
    )


def candidate_join(
    points: DataFrame,
    grid: CircleGrid,
    spread_by: tuple[str, ...],
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Inner join of points with the circles whose cells they fall into.

    Small circle sides are broadcast and the points never move.  Larger ones are shuffled by
    cell.  There a histogram of both sides tells what each cell costs, and a cell that holds a
    large share of all the work is dealt out: its points into some slices by a hash of the
    ``spread_by`` columns, its circles into others, and every slice of either meets every slice of
    the other in a place of its own.
    """
    placed = with_cells(points, grid.exponents)
    if grid.fits_broadcast(broadcast_rows):
        return placed.join(F.broadcast(grid.cells), "cell")

    hot, tests = hot_products(
        placed.groupBy("cell").agg(F.count("*").alias("_n")),
        grid.cells.groupBy("cell").agg(F.count("*").alias("_m")),
        "cell",
    )
    return product_join(
        placed, grid.cells, "cell", hot, spread_by, ("circle_id",), tasks_for(tests, points)
    )

"""Counting points in circles cell by cell, where points meet very many circles.

The points and the circles of a grid cell meet in one Arrow function, which counts without
enumerating pairs.  The points are put into about sqrt(n / 2) strips of equal numbers by y, each
sorted by x.  A circle holds one run of a strip for sure and none outside a longer run; both ends
come from binary searches and the weight of the sure run from running sums, so only the points that
the rim passes by are tested, with the same comparison as everywhere else.  A circle costs a cell
O(sqrt n) however its points lie.

A cell with many points or circles is dealt out: every slice of its points meets every slice of its
circles in a group of their own, so no group outgrows a task.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from encircle.operators.grid import CircleGrid, with_cells
from encircle.session import cut_lineage

# sent by value: executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Most points and circles that meet in one group, on average over the slices of a cell.
GROUP_POINTS = 1 << 18
GROUP_CIRCLES = 1 << 15

#: Disc tests held at once.
TESTS_AT_ONCE = 1 << 19


def counts_in_tiles(
    points: DataFrame,
    grid: CircleGrid,
    by: tuple[str, ...] = (),
    group_points: int = GROUP_POINTS,
    group_circles: int = GROUP_CIRCLES,
) -> DataFrame:
    """``circle_id``, the columns ``by`` of the points and their weight ``_n``: parts, none of them 0."""
    points = cut_lineage(points.select("x", "y", F.col("w").cast("bigint"), *by))  # used twice
    placed = with_cells(points, grid.exponents).where("cell is not null")
    circles = grid.cells.select("circle_id", "cx", "cy", "r", "cell").where("cell is not null")
    across = _large_cells(placed, "_across", group_points)
    down = _large_cells(circles, "_down", group_circles)
    key = ["cell", "_i", "_j"]
    # large cells are few: one per GROUP_CIRCLES rows at most
    large = F.broadcast(across.join(down, "cell", "full"))
    own, other = F.coalesce("_across", F.lit(1)), F.coalesce("_down", F.lit(1))

    def dealt(side: DataFrame, spread: tuple[str, ...], place: str, slices: Column, repeated: str, times: Column):
        known = side.join(large, "cell", "left")
        return (
            known.withColumn(place, F.pmod(F.xxhash64(*spread), slices).cast("int"))
            .withColumn(repeated, F.explode(F.sequence(F.lit(0), times - 1)))
            .drop("_across", "_down")
        )

    left = dealt(placed, ("x", "y"), "_i", own, "_j", other)
    right = dealt(circles, ("circle_id", "cx", "cy", "r"), "_j", other, "_i", own)
    schema = StructType(
        [circles.schema["circle_id"], *[points.schema[c] for c in by], StructField("_n", LongType())]
    )
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_counted(by), schema)


def _large_cells(rows: DataFrame, name: str, most: int) -> DataFrame:
    """The cells with more than ``most`` rows, and how many slices of that size those are."""
    slices = F.ceil(F.col("_c") / F.lit(most)).cast("int").alias(name)
    return rows.groupBy("cell").agg(F.count("*").alias("_c")).where(F.col("_c") > most).select("cell", slices)


def _counted(by: tuple[str, ...]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(points: pa.Table, circles: pa.Table) -> pa.Table:
        ids, names = circles.column("circle_id"), ["circle_id", *by, "_n"]
        x, y, w = (points.column(c).to_numpy() for c in ("x", "y", "w"))
        discs = [circles.column(c).to_numpy() for c in ("cx", "cy", "r")]
        parts = []
        for rows in _alike(points, by) if len(ids) else []:
            found = disc_counts(x[rows], y[rows], w[rows], *discs)
            held = np.flatnonzero(found)
            same = [points.column(c).take(pa.array(np.full(len(held), rows[0]))) for c in by]
            parts.append(pa.table([ids.take(pa.array(held)), *same, pa.array(found[held])], names))
        if parts:
            return pa.concat_tables(parts)
        none = [ids.slice(0, 0), *[points.column(c).slice(0, 0) for c in by], pa.array([], pa.int64())]
        return pa.table(none, names)

    return run


def _alike(points: pa.Table, by: tuple[str, ...]) -> list[np.ndarray]:
    """Numbers of the points, apart by their values of ``by``."""
    if not len(points):
        return []
    code = np.zeros(len(points), np.int64)
    for column in by:
        values = points.column(column).combine_chunks().dictionary_encode(null_encoding="encode")
        code = np.unique(code * len(values.dictionary) + values.indices.to_numpy(), return_inverse=True)[1]
    order = np.argsort(code, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(code[order])) + 1)


def disc_counts(
    x: np.ndarray, y: np.ndarray, w: np.ndarray, cx: np.ndarray, cy: np.ndarray, r: np.ndarray
) -> np.ndarray:
    """Weight of the points in every disc.

    Points within rounding distance of a rim are tested, so what is counted unseen is safe.
    """
    found = np.zeros(len(cx), np.int64)
    usable = np.isfinite(x) & np.isfinite(y)
    if not usable.all():
        x, y, w = x[usable], y[usable], w[usable]
    if not len(x):
        return found
    margin = np.abs(r) * 1e-9 + (np.abs(cx) + np.abs(cy)) * 1e-14
    outer, inner = np.abs(r) + margin, np.maximum(np.abs(r) - margin, 0.0)

    near_x, far_x = _distances(x.min(), x.max(), cx)
    near_y, far_y = _distances(y.min(), y.max(), cy)
    whole = far_x * far_x + far_y * far_y < inner * inner
    found[whole] = w.sum()
    some = np.flatnonzero(~whole & (near_x * near_x + near_y * near_y <= outer * outer))
    some = some[np.argsort(cx[some])]  # searches are faster in order
    cx, cy, r, outer, inner = cx[some], cy[some], r[some], outer[some], inner[some]
    counts = np.zeros(len(some), np.int64)

    by_y = np.argsort(y, kind="stable")
    for rows in np.array_split(by_y, max(1, math.isqrt(len(x) // 2))):
        near, far = _distances(y[rows[0]], y[rows[-1]], cy)
        met = np.flatnonzero(near <= outer)
        if not len(met):
            continue
        rows = rows[np.argsort(x[rows], kind="stable")]
        xs, ys, ws = x[rows], y[rows], w[rows]
        before = np.concatenate([[0], np.cumsum(ws)])
        centre, near, far = cx[met], near[met], far[met]
        half = np.sqrt(outer[met] * outer[met] - near * near)
        first, end = np.searchsorted(xs, centre - half, "left"), np.searchsorted(xs, centre + half, "right")
        square = inner[met] * inner[met] - far * far
        sure = square > 0
        half = np.sqrt(np.where(sure, square, 0.0))
        sure_first = np.where(sure, np.searchsorted(xs, centre - half, "left"), end)
        sure_end = np.where(sure, np.searchsorted(xs, centre + half, "right"), end)
        counts[met] += before[sure_end] - before[sure_first]
        for start, stop in ((first, sure_first), (sure_end, end)):
            open_ = np.flatnonzero(stop > start)
            counts[met[open_]] += _tested(xs, ys, ws, start[open_], stop[open_], met[open_], cx, cy, r)
    found[some] = counts
    return found


def _distances(low: float, high: float, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distance from the centre to the nearest and the farthest place between low and high."""
    below, above = low - centre, centre - high
    return np.maximum(np.maximum(below, above), 0.0), np.maximum(np.abs(below), np.abs(above))


def _tested(
    xs: np.ndarray, ys: np.ndarray, ws: np.ndarray, start: np.ndarray, stop: np.ndarray,
    disc: np.ndarray, cx: np.ndarray, cy: np.ndarray, r: np.ndarray,
) -> np.ndarray:
    """Weight, in every disc, of those points ``start`` to ``stop`` that lie in it; no run is empty."""
    sizes = stop - start
    past = np.cumsum(sizes)
    result, begin = np.zeros(len(start), np.int64), 0
    while begin < len(start):
        done = past[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(past, done + TESTS_AT_ONCE, "right")))
        size, offset = sizes[begin:end], past[begin:end] - sizes[begin:end] - done
        at = np.repeat(start[begin:end] - offset, size) + np.arange(past[end - 1] - done)
        of = disc[begin:end]
        dx, dy = xs[at] - np.repeat(cx[of], size), ys[at] - np.repeat(cy[of], size)
        inside = dx * dx + dy * dy <= np.repeat(r[of] * r[of], size)
        result[begin:end] = np.add.reduceat(np.where(inside, ws[at], 0), offset)
        begin = end
    return result

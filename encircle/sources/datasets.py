"""Any DataFrame as a set of points or candidate circles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from encircle.functions.geometry import is_finite
from encircle.session import cut_lineage, shuffle_partitions

#: Equal rows that one task numbers.
SLICE = 1 << 14


def points_from(
    frame: DataFrame, point_id: str = "point_id", x: str = "x", y: str = "y"
) -> DataFrame:
    """``point_id BIGINT, x DOUBLE, y DOUBLE``; rows without usable coordinates are dropped."""
    return frame.select(
        F.col(point_id).cast("bigint").alias("point_id"),
        F.col(x).cast("double").alias("x"),
        F.col(y).cast("double").alias("y"),
    ).where(is_finite(F.col("x"), F.col("y")))


def circles_from(
    frame: DataFrame, circle_id: str = "circle_id", cx: str = "cx", cy: str = "cy", r: str = "r"
) -> DataFrame:
    """``circle_id BIGINT, cx DOUBLE, cy DOUBLE, r DOUBLE``; unusable rows are dropped."""
    return frame.select(
        F.col(circle_id).cast("bigint").alias("circle_id"),
        F.col(cx).cast("double").alias("cx"),
        F.col(cy).cast("double").alias("cy"),
        F.col(r).cast("double").alias("r"),
    ).where(is_finite(F.col("cx"), F.col("cy"), F.col("r")))


def with_ordinal(frame: DataFrame, order_by: list[str], name: str = "circle_id") -> DataFrame:
    """Number the rows 0, 1, 2, ... in the order of the given columns.

    A global window would pull every row into one task.  Here the rows are range-partitioned and
    sorted, numbered inside their partition, and shifted by the number of rows in the partitions
    before; only those counts (one row per partition) meet in one place.  Rows that tie on the
    given columns are ordered by a hash of the row.  Equal rows are numbered first, so that ranges
    may cut between them: no task gets all copies of a row that makes up much of the table.
    """
    order = [F.col(c) for c in order_by] + [F.xxhash64(*frame.columns), F.col("_copy")]
    local = F.monotonically_increasing_id()  # partition number << 33 | position
    numbered = cut_lineage(
        _copies(frame).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_local", local)
    )
    part = F.shiftright("_local", 33).alias("_part")
    sizes = numbered.groupBy(part).agg(F.count("*").alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset")
    )
    position = F.col("_local").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        numbered.withColumn("_part", F.shiftright("_local", 33))
        .join(F.broadcast(offsets), "_part")  # one row per partition
        .select((F.col("_offset") + position).alias(name), *frame.columns)
    )


def _copies(frame: DataFrame) -> DataFrame:
    """The rows with ``_copy``, which tells equal rows apart whatever partition they come from.

    Copies are counted before they are shuffled and written out again slice by slice.
    """
    counted = frame.groupBy(*frame.columns).agg(F.count("*").alias("_n"))

    def numbers(first: Column, past: Column) -> Column:
        return F.explode(F.sequence(first, past - 1)).alias("_copy")

    few = counted.where(F.col("_n") <= SLICE).select(*frame.columns, numbers(F.lit(0).cast("bigint"), F.col("_n")))
    slices = F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(_n - 1) div {SLICE}")))
    many = counted.where(F.col("_n") > SLICE).select(*frame.columns, "_n", slices.alias("_slice"))
    start = F.col("_slice") * SLICE
    dealt = many.repartition(shuffle_partitions(frame), F.xxhash64(*frame.columns, "_slice")).select(
        *frame.columns, numbers(start, F.least(start + SLICE, F.col("_n")))
    )
    return few.unionAll(dealt)

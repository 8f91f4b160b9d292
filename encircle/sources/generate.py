"""Synthetic clustered points and random circles, repeatable for a seed on any cluster."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from encircle.functions.geometry import Bounds, clamp
from encircle.functions.hashing import hash_normal_pair, hash_uniform, hash_uniform_pair


class Preset(NamedTuple):
    """Size of a standard data set."""

    n_points: int
    n_circles: int
    n_clusters: int


# The standard data-set sizes and the parameters they are used with.
PRESETS = {
    "small": Preset(2_000, 500, 8),
    "medium": Preset(25_000, 2_000, 20),
    "large": Preset(100_000, 5_000, 50),
}
DEFAULT_BOUNDS = Bounds(0.0, 0.0, 1000.0, 1000.0)
DEFAULT_RADII = (30.0, 100.0)
DEFAULT_STD = 80.0
DEFAULT_SEED = 42
DEFAULT_K = 10
DEFAULT_EPSILON = 0.2


def cluster_of(ident: Column, n_points: int, n_clusters: int) -> Column:
    """Cluster of a point id: contiguous even blocks, the first ones take the remainder."""
    size, extra = divmod(n_points, n_clusters)
    boundary = extra * (size + 1)
    in_long_block = F.floor(ident / F.lit(size + 1))
    if size == 0:
        return in_long_block.cast("int")
    in_short_block = F.lit(extra) + F.floor((ident - F.lit(boundary)) / F.lit(size))
    return F.when(ident < boundary, in_long_block).otherwise(in_short_block).cast("int")


def generate_points(
    spark: SparkSession,
    n: int,
    clusters: int,
    bounds: Bounds = DEFAULT_BOUNDS,
    std: float = DEFAULT_STD,
    seed: int = DEFAULT_SEED,
) -> DataFrame:
    """Gaussian clusters around uniform centres, clamped to the box; clusters of even size."""
    if n < 0 or clusters < 1:
        raise ValueError("need n >= 0 and at least one cluster")
    ids = spark.range(n).select(F.col("id").alias("point_id"))
    numbered = ids.withColumn("cluster", cluster_of(F.col("point_id"), n, clusters))
    return place_points(numbered, bounds, std, seed)


def place_points(
    rows: DataFrame, bounds: Bounds = DEFAULT_BOUNDS, std: float = DEFAULT_STD, seed: int = DEFAULT_SEED
) -> DataFrame:
    """``rows`` with ``x, y``: Gaussian around the centre of their ``cluster``, fixed by ``point_id``.

    Works row by row.  A null cluster or id has null coordinates.
    """
    centre_u, centre_v = hash_uniform_pair(seed, "centre", F.col("cluster"))
    normal_x, normal_y = hash_normal_pair(seed, "point", F.col("point_id"))

    def coordinate(low: float, high: float, centre: Column, normal: Column) -> Column:
        place = F.lit(low) + F.lit(high - low) * centre + F.lit(float(std)) * normal
        return F.when(place.isNotNull(), clamp(place, low, high))

    return rows.withColumns(
        {
            "x": coordinate(bounds.min_x, bounds.max_x, centre_u, normal_x),
            "y": coordinate(bounds.min_y, bounds.max_y, centre_v, normal_y),
        }
    )


def generate_circles(
    spark: SparkSession,
    n: int,
    bounds: Bounds = DEFAULT_BOUNDS,
    radii: tuple[float, float] = DEFAULT_RADII,
    seed: int = DEFAULT_SEED + 1,
) -> DataFrame:
    """Uniform centres and radii."""
    return place_circles(spark.range(n).select(F.col("id").alias("circle_id")), bounds, radii, seed)


def place_circles(
    rows: DataFrame,
    bounds: Bounds = DEFAULT_BOUNDS,
    radii: tuple[float, float] = DEFAULT_RADII,
    seed: int = DEFAULT_SEED + 1,
) -> DataFrame:
    """``rows`` with ``cx, cy, r``: uniform, fixed by ``circle_id``; null for a null id."""
    ident = F.col("circle_id")
    u, v = hash_uniform_pair(seed, "circle", ident)
    low, high = radii
    return rows.withColumns(
        {
            "cx": F.lit(bounds.min_x) + F.lit(bounds.max_x - bounds.min_x) * u,
            "cy": F.lit(bounds.min_y) + F.lit(bounds.max_y - bounds.min_y) * v,
            "r": F.lit(low) + F.lit(high - low) * hash_uniform(seed, "radius", ident),
        }
    )


def generate_preset(spark: SparkSession, name: str) -> tuple[DataFrame, DataFrame]:
    """Points and circles of a standard size."""
    preset = PRESETS[name]
    return (
        generate_points(spark, preset.n_points, preset.n_clusters),
        generate_circles(spark, preset.n_circles),
    )

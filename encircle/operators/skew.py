"""Splitting hot join keys into slices.

A key is hot when it holds more than 1/HOT_SHARE of all rows, so there are at most HOT_SHARE hot
keys and the table of them has a fixed size bound: it can always be broadcast.  The many-row side
deals the rows of a hot key out over slices by a hash; the other side repeats its rows once per
slice.  Every pair of rows still meets exactly once.

Where both sides may hold many rows of a key, the pairs are what costs.  There a key is hot by its
share of all pairs, and both sides are dealt out over a grid of slices.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from encircle.session import cut_lineage, local_frame

HOT_SHARE = 256

#: What moving a row costs, in pairs.
ROW_PAIRS = 32

_PRODUCTS = pa.schema({"_key": pa.int64(), "_across": pa.int32(), "_down": pa.int32()})


def hot_keys(counts: DataFrame, keys: list[str], count: str) -> DataFrame:
    """The keys and ``_slices`` for the hot keys of a per-key count: at most HOT_SHARE rows."""
    total = counts.agg(F.sum(count)).scalar()
    share = F.col(count) * HOT_SHARE
    return counts.where(share > total).select(
        *keys, F.ceil(share / F.nullif(total, F.lit(0))).cast("int").alias("_slices")
    )


def sliced_join(
    many: DataFrame, few: DataFrame, keys: list[str], hot: DataFrame, spread_by: tuple[str, ...]
) -> DataFrame:
    """Inner equi-join that survives hot keys on the ``many`` side; null keys are equal."""
    slices = F.coalesce("_slices", F.lit(1))
    dealt = null_safe_join(many, F.broadcast(hot), keys, "left").withColumn(
        "_slice", F.pmod(F.xxhash64(*spread_by), slices).cast("int")
    )
    repeated = null_safe_join(few, F.broadcast(hot), keys, "left").withColumn(
        "_slice", F.explode(F.sequence(F.lit(0), slices - 1))
    )
    joined = null_safe_join(dealt.drop("_slices"), repeated.drop("_slices"), [*keys, "_slice"])
    return joined.drop("_slice")


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on columns both sides have, where null equals null; each key appears once."""
    renamed = right.withColumnsRenamed({k: f"_same_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_same_{k}")) for k in keys]
    return left.join(renamed, same, how).drop(*[f"_same_{k}" for k in keys])


def hot_products(left: DataFrame, right: DataFrame, key: str) -> tuple[DataFrame, int]:
    """Slices of the keys that hold much of the work of an equi-join, and the number of its pairs.

    ``left`` and ``right`` count the rows of a BIGINT key on either side, as ``_n`` and ``_m``.  A
    key costs its pairs and the moving of its rows.  Hot ones, at most HOT_SHARE, come with the
    number of slices of their left rows (``_across``) and right rows (``_down``), chosen so that
    repeating the rows costs least.
    """
    both = cut_lineage(
        left.join(right, key, "full").select(
            F.col(key).alias("_key"),
            *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in ("_n", "_m")],
        )
    )
    cost = F.col("_n") * F.col("_m") + ROW_PAIRS * (F.col("_n") + F.col("_m"))
    whole = both.agg(F.sum(cost).alias("cost"), F.sum(F.col("_n") * F.col("_m")).alias("pairs")).first()
    total = whole["cost"] or 0.0
    rows = both.withColumn("_cost", cost).where(F.col("_cost") * HOT_SHARE > F.lit(total)).collect()
    slices = [(r["_key"], *_slices(r["_n"], r["_m"], math.ceil(r["_cost"] * HOT_SHARE / total))) for r in rows]
    return local_frame(left.sparkSession, slices, _PRODUCTS), int(whole["pairs"] or 0)


def _slices(n: float, m: float, wanted: int) -> tuple[int, int]:
    """``across x down`` of about ``wanted`` slices, where ``n x down + m x across`` is least."""
    across = math.ceil(math.sqrt(wanted * n / m)) if m else wanted
    across = max(1, min(across, wanted, int(n)))
    return across, max(1, min(math.ceil(wanted / across), int(m)))


def product_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    hot: DataFrame,
    spread_left: tuple[str, ...],
    spread_right: tuple[str, ...],
    partitions: int,
) -> DataFrame:
    """Inner equi-join on a key both sides have, with the slices of :func:`hot_products`."""
    own, other = F.coalesce("_across", F.lit(1)), F.coalesce("_down", F.lit(1))

    def dealt(side: DataFrame, slices, spread, place: str, repeats, repeated: str) -> DataFrame:
        known = side.join(F.broadcast(hot), F.col(key) == F.col("_key"), "left")
        return (
            known.withColumn(place, F.pmod(F.xxhash64(*spread), slices).cast("int"))
            .withColumn(repeated, F.explode(F.sequence(F.lit(0), repeats - 1)))
            .drop("_key", "_across", "_down")
            .repartition(partitions, key, "_i", "_j")
        )

    points = dealt(left, own, spread_left, "_i", other, "_j")
    circles = dealt(right, other, spread_right, "_j", own, "_i")
    return points.join(circles, [key, "_i", "_j"]).drop("_i", "_j")

"""Sharding: minimax contiguous partition of groups in a fixed order.

Documents of equal text form a group that no shard boundary divides.  Groups stand in the order of
their text's digest; a shard is a run of groups.  The smallest capacity is wanted at which greedy
filling needs no more than the given shards: the search probes ``PROBES`` capacities at a time, and
each greedy step looks up, for all probes in one pass over the group ends, the last group that still
fits.  Within that capacity the cuts are then put as close to equal shares as the groups allow.

The positions need prefix sums over all groups.  The digest's first bits divide the order into
``BUCKETS`` runs of about equal length; sums run inside a bucket, and the totals of the buckets
before are added.  A hot group is cut into cells by a hash of the id before anything is sorted, so
no task holds a whole group.

Null texts are empty texts of one byte more, like every text.  Repeated rows keep their own slots.
With fewer groups than shards, some shards stay empty.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from encircle.llm.shared import written

SHARDS = 8
#: Runs of the digest order, at most 2^16, and cells of a group.
BUCKETS = 4096
CELLS = 64
PROBES = 32


def text_size(text: Column | str) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + 1


def text_digest(text: Column | str) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def _places(rows: DataFrame) -> DataFrame:
    """One row per cell: ``digest, cell, rows_before, end, rows_end`` in the order of groups.

    ``end`` is the number of bytes up to the end of the whole group, ``rows_end`` of rows.
    """
    cells = rows.groupBy("digest", "cell").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    first_bits = F.conv(F.hex(F.substring("digest", 1, 2)), 16, 10).cast("int")
    cells = written(cells.withColumn("bucket", F.floor(first_bits * BUCKETS / 65536).cast("int")), "cells")
    totals = cells.groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))
    earlier = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # BUCKETS rows at most
    offsets = totals.select(
        "bucket",
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n_0"),
        F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("bytes_0"),
    )
    inside = Window.partitionBy("bucket").orderBy("digest", "cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    group = Window.partitionBy("bucket", "digest")
    summed = cells.select("*", F.sum("n").over(inside).alias("n_1"), F.sum("bytes").over(inside).alias("bytes_1"))
    ended = summed.select("*", F.max("n_1").over(group).alias("n_2"), F.max("bytes_1").over(group).alias("bytes_2"))
    return ended.join(F.broadcast(offsets), "bucket").select(
        "digest", "cell",
        (F.col("n_0") + F.col("n_1") - F.col("n")).alias("rows_before"),
        (F.col("bytes_0") + F.col("bytes_2")).alias("end"),
        (F.col("n_0") + F.col("n_2")).alias("rows_end"),
        (F.col("bytes_1") == F.col("bytes_2")).alias("last"),
        F.sum("bytes").over(group).alias("group_bytes"),
    )


def _last_ends(ends: DataFrame, limits: list[int]) -> list[int]:
    """For every limit, the last group end that does not exceed it (0: none)."""
    found = ends.agg(*[F.max(F.when(F.col("end") <= x, F.col("end"))).alias(f"e{i}") for i, x in enumerate(limits)]).first()
    return [e or 0 for e in found]


def smallest_capacity(ends: DataFrame, total: int, largest: int, shards: int) -> int:
    """Smallest capacity at which greedy filling needs at most ``shards`` shards."""
    low, high = max(-(-total // shards), largest), -(-total // shards) + largest  # high is enough
    while low < high:
        step = max(1, -(-(high - low) // (PROBES + 1)))
        probes = list(range(low, high, step))[:PROBES]
        filled = [0] * len(probes)
        for _ in range(shards):
            filled = _last_ends(ends, [f + c for f, c in zip(filled, probes)])
        enough = [c for c, f in zip(probes, filled) if f >= total]
        if enough:
            high = enough[0]
            below = [c for c in probes if c < high]
            low = below[-1] + 1 if below else high
        else:
            low = probes[-1] + 1
    return high


def cuts(ends: DataFrame, total: int, capacity: int, shards: int) -> list[int]:
    """Ends of the first ``shards - 1`` shards: near equal shares, none above the capacity."""
    earliest = [total]  # cut i must not lie before this, or the rest would not fit
    for _ in range(shards - 1):
        need = earliest[-1] - capacity
        found = ends.where(F.col("end") >= need).agg(F.min("end")).first()[0] if need > 0 else 0
        earliest.append(found)
    earliest = earliest[::-1]  # one per cut, the last is the total
    chosen, at = [], 0
    for i in range(shards - 1):
        ideal = at + (total - at) // (shards - i)
        low, high = max(at, earliest[i]), at + capacity
        below, most = _last_ends(ends, [min(ideal, high), high])
        above = ends.where((F.col("end") > ideal) & (F.col("end") <= high)).agg(F.min("end")).first()[0]
        options = [e for e in (below, above, most) if e is not None and low <= e <= high]
        at = min(options, key=lambda e: abs(e - ideal)) if options else at
        chosen.append(at)
    return chosen


def shard(docs: DataFrame, doc_id: str, size: str, digest: str, shards: int = SHARDS) -> DataFrame:
    """All rows and columns of ``docs`` with ``shard`` and ``slot``, gapless from 0 in each shard.

    ``size`` and ``digest`` are columns with the bytes of a document and the digest of its text.
    """
    own = [f"d{i}" for i in range(len(docs.columns))]
    at = dict(zip(docs.columns, own))
    cell = F.pmod(F.xxhash64(at[doc_id]), F.lit(CELLS)).cast("int")
    rows = docs.toDF(*own).withColumn("_cell", cell)
    slim = rows.select(F.col(at[digest]).alias("digest"), F.col("_cell").alias("cell"), F.col(at[size]).alias("size"))
    places = written(_places(slim), "places")
    sums = places.agg(F.max("end").alias("total"), F.max("group_bytes").alias("largest")).first()
    total, largest = sums.total or 0, sums.largest or 0
    ends = places.where("last").select("end", "rows_end")
    boundaries = []
    if total:
        capacity = smallest_capacity(ends, total, largest, shards)
        boundaries = cuts(ends, total, capacity, shards)
    starts = {0: 0} | {r.end: r.rows_end for r in ends.where(F.col("end").isin(boundaries or [0])).collect()}
    number = sum([(F.col("end") > b).cast("int") for b in boundaries], F.lit(0))
    first_rows = F.array(*[F.lit(starts[b]).cast("bigint") for b in [0, *boundaries]])
    inside = Window.partitionBy(at[digest], "_cell").orderBy(F.col(at[doc_id]).asc_nulls_last())
    placed = rows.join(places, (rows[at[digest]] == places.digest) & (rows["_cell"] == places.cell))
    numbered = placed.withColumn("_shard", number).withColumn("_row", F.row_number().over(inside))
    slot = F.col("rows_before") + F.col("_row") - 1 - F.element_at(first_rows, F.col("_shard") + 1)
    return numbered.select(
        *[F.col(o).alias(c) for c, o in at.items() if c.lower() not in ("shard", "slot")],
        F.col("_shard").alias("shard"),
        slot.alias("slot"),
    )

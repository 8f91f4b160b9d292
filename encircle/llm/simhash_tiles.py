"""Near-duplicates by SimHash: exact comparison of fingerprints, tile by tile.

Distinct fingerprints are dealt into tiles of equal population counts (one count for either half of
the 64 bits).  Two fingerprints that differ in at most ``radius`` bits have halves whose counts
differ by at most ``radius`` together, so only such tiles are brought together; a pair of tiles
is one unit of work for any executor.  Inside, stretches of equal counts by byte are skipped in
the same way, and what is left is compared with exclusive-or and bit counts.  A unit reports a
spanning forest of its links, never all of them.

The number of comparisons grows with the square of the distinct fingerprints; the skipping makes
the factor small (see README), not the power.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from encircle.llm.components import connected_components
from encircle.llm.shared import in_slices, written
from encircle.operators.skew import hot_keys, sliced_join

BITS = 64
SHINGLE = 4
SEED = 42
#: Bits in which linked fingerprints may differ.
RADIUS = 4

#: Fingerprints of a tile: a 256th of all of them, between these bounds.
TILE_LEAST, TILE_MOST, TILE_SHARE = 1 << 10, 1 << 16, 256
#: Fingerprints that are skipped or compared together inside a tile, and comparisons made at once.
STRETCH = 64
AT_ONCE = 1 << 16
#: Hashes whose bits are counted at once.
HASHES = 1 << 15


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """SimHash of the words' shingles as a signed 64-bit number; 0 without words."""
    words = (text or "").encode().lower().split()  # bytes: ASCII letters and white space only
    if not words:
        return 0
    line = b" ".join(words)
    edges = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    starts, ends = [0, *(edges + 1).tolist()], [*edges.tolist(), len(line)]
    if len(words) > width:
        spans = zip(starts[: 1 - width], ends[width - 1 :])
    else:
        spans = [(0, len(line))]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a:b], SEED) for a, b in spans], "<u8")
    ones = np.zeros(BITS, np.int64)
    for start in range(0, len(hashes), HASHES):
        some = hashes[start : start + HASHES].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(some, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """The other columns and ``print`` (a column of that name gives way); texts go to Python once."""
    names = [c for c in docs.columns if c not in (text, "print")]
    own = [f"c{i}" for i in range(len(names))]
    hidden = docs.select(*[F.col(f"`{c}`").alias(o) for c, o in zip(names, own)], F.col(f"`{text}`").alias("text"))
    schema = T.StructType([*hidden.drop("text").schema.fields, T.StructField("print", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            made = pa.array([fingerprint(t) for t in batch.column("text").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(o) for o in own), made], [*own, "print"])

    return hidden.mapInArrow(run, schema).toDF(*names, "print")


def _halves(value: Column) -> tuple[Column, Column]:
    low = value.bitwiseAND(F.lit((1 << 32) - 1))
    return F.bit_count(F.shiftrightunsigned(value, 32)), F.bit_count(low)


def tiles(prints: DataFrame) -> DataFrame:
    """``high, low, tile, prints``: the distinct values of ``print``, by the counts of their halves."""
    high, low = _halves(F.col("print"))
    placed = prints.select("print", high.alias("high"), low.alias("low"))
    sizes = placed.groupBy("high", "low").agg(F.count("*").alias("_n"))  # at most 33 x 33 rows
    total = sizes.agg(F.sum("_n")).first()[0] or 0
    size = min(TILE_MOST, max(TILE_LEAST, -(-total // TILE_SHARE)))
    dealt = sizes.select("high", "low", F.ceil(F.col("_n") / size).alias("_tiles"))
    return (
        placed.join(F.broadcast(dealt), ["high", "low"])
        .withColumn("tile", F.pmod(F.xxhash64("print"), "_tiles").cast("int"))
        .groupBy("high", "low", "tile")
        .agg(F.collect_list("print").alias("prints"))
    )


def tile_pairs(tiled: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``a, b, prints``: two rows for every pair of tiles that may hold links, one for a tile itself."""
    known = tiled.groupBy("high", "low").agg((F.max("tile") + 1).alias("_tiles"))  # at most 33 x 33 rows
    steps = [(h, l) for h in range(-radius, radius + 1) for l in range(-radius, radius + 1) if abs(h) + abs(l) <= radius]
    near = F.explode(F.array(*[F.struct(F.lit(h).alias("h"), F.lit(l).alias("l")) for h, l in steps]))
    there = known.withColumnsRenamed({"high": "_high", "low": "_low"})
    own = F.struct("high", "low", "tile")
    other = F.struct(F.col("_high").alias("high"), F.col("_low").alias("low"), F.col("_tile").alias("tile"))
    return (
        tiled.withColumn("_near", near)
        .withColumns({"_high": F.col("high") + F.col("_near.h"), "_low": F.col("low") + F.col("_near.l")})
        .join(F.broadcast(there), ["_high", "_low"])
        .withColumn("_tile", F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1)))
        .select(F.least(own, other).alias("a"), F.greatest(own, other).alias("b"), "prints")
    )


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``a, b``: enough of the links between values of ``print`` to connect all that are linked."""

    def compare(key: tuple[pa.Scalar, ...], pair: pa.Table) -> pa.Table:
        given = [np.asarray(p.values, np.int64) for p in pair["prints"].combine_chunks()]
        a, b = forest(given[0], given[-1], radius, len(given) == 1)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    pairs = tile_pairs(written(tiles(prints), "tiles"), radius)
    return pairs.groupBy("a", "b").applyInArrow(compare, "a bigint, b bigint")


class _Forest:
    """Union-find over positions; roots of many positions are looked up together."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self, at: np.ndarray) -> np.ndarray:
        found = self.up[at]
        while True:
            further = self.up[found]
            if np.array_equal(further, found):
                self.up[at] = found
                return found
            found = further

    def join(self, x: int, y: int) -> bool:
        up = self.up
        while up[x] != x:
            x = up[x]
        while up[y] != y:
            y = up[y]
        if x != y:
            up[max(x, y)] = min(x, y)
        return x != y


def _stretches(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prints ordered by the counts of their bytes; lowest and highest counts of every stretch."""
    prints = np.ascontiguousarray(prints)
    counts = np.bitwise_count(prints.view(np.uint8).reshape(-1, 8))
    order = np.lexsort(counts.T)
    counts = counts[order].astype(np.int16)
    starts = np.arange(0, len(prints), STRETCH)
    return prints[order], np.minimum.reduceat(counts, starts), np.maximum.reduceat(counts, starts)


def forest(a: np.ndarray, b: np.ndarray, radius: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is linked between ``a`` and ``b`` (or within ``a``): fewer than prints."""
    a, a_low, a_high = _stretches(a)
    b, b_low, b_high = (a, a_low, a_high) if same else _stretches(b)
    offset = 0 if same else len(a)
    trees = _Forest(offset + len(b))
    left, right = [], []
    x, y = a.view(np.uint64), b.view(np.uint64)
    for s, start in enumerate(range(0, len(a), STRETCH)):
        gap = np.maximum(np.maximum(a_low[s] - b_high, b_low - a_high[s]), 0).sum(axis=1)
        near = np.flatnonzero(gap <= radius)
        if same:
            near = near[near >= s]
        some = x[start : start + STRETCH]
        step = max(1, AT_ONCE // (STRETCH * len(some)))
        for first in range(0, len(near), step):
            at = (near[first : first + step, None] * STRETCH + np.arange(STRETCH)).ravel()
            at = at[at < len(b)]
            hit = np.bitwise_count(some[:, None] ^ y[at][None, :]) <= radius
            if not hit.any():
                continue
            i, j = np.nonzero(hit)
            i, j = i + start, at[j] + offset
            roots_i, roots_j = trees.roots(i), trees.roots(j)
            apart = roots_i != roots_j
            if not apart.any():
                continue
            code = roots_i[apart] * (offset + len(b)) + roots_j[apart]
            _, picked = np.unique(code, return_index=True)
            i, j = i[apart], j[apart]
            for p in picked.tolist():
                if trees.join(int(i[p]), int(j[p])):
                    left.append(int(i[p]))
                    right.append(int(j[p]) - offset)
    return a[left], b[right]


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """``doc_id, print, component_id``: the smallest id among the documents reachable by links.

    Null and empty texts have fingerprint 0 and are linked like any other; texts of fewer words than
    a shingle are one shingle.  Repeated rows are rows of their own.  A null id never is a component's
    smallest; a component of null ids only has a null id.  An empty table gives an empty result.
    Columns beyond the two named are not read.
    """
    own = written(fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text")), "_text"), "prints")
    prints = written(own.groupBy("print").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "distinct")
    edges = written(links(prints.select("print"), radius), "links")
    classes = connected_components(edges)
    # only linked prints are in a component of several; its smallest id is worked out among those
    linked = written(prints.join(classes, F.col("print") == F.col("node")).select("print", "component", "first"), "linked")
    smallest = linked.groupBy("component").agg(F.min("first").alias("component_id"))
    of_print = prints.join(linked.join(smallest, "component").select("print", "component_id", F.lit(True).alias("_linked")), "print", "left").select(
        "print", F.when(F.col("_linked"), F.col("component_id")).otherwise(F.col("first")).alias("component_id")
    )
    hot = hot_keys(prints, ["print"], "n")
    return sliced_join(own, of_print, ["print"], hot, ("doc_id",)).select("doc_id", "print", "component_id")

"""Benchmark decontamination: Wu-Manber search for many word windows at once.

Text is a sequence of words.  A benchmark item gives the windows of ``words`` consecutive words
(one shorter window if it has fewer).  Windows of one length are searched together: a shift table
over blocks of two words says how far the search may jump, at a shift of zero the block at the
window's end selects a bucket of windows, its first two words narrow the bucket, and a direct
comparison of the remaining words confirms the occurrence.

Windows reach the tasks by broadcast in blocks of a bounded size.  Every block is one more pass
over the stream of documents; the spans and items found so far travel with the row, so no pass
shuffles, whatever the size of the benchmark.  Whole texts are searched.

Nulls and texts without words hold nothing and have n_words 0.  Rows of one item_id are one item,
rows without an id belong to one item whose id is the empty string.  Repeated documents get equal
results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from encircle.llm.shared import lower_ascii, own_text, row_step, written

WORDS = 10
#: Characters of windows in one broadcast block.
BLOCK_CHARS = 32 << 20

#: Words are runs of ASCII letters and digits and of everything beyond ASCII; in UTF-8, of bytes.
_WORD_BYTES = re.compile(rb"[0-9a-z\x80-\xff]+")
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: str | None) -> list[bytes]:
    return _WORD_BYTES.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []


def windows(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """``window, items``: every distinct window (words joined by spaces) and the items that hold it."""
    listed = benchmark.select(
        F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"),
        F.regexp_extract_all(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(_WORD), 0).alias("w"),
    ).where("size(w) > 0")
    last = F.greatest(F.size("w") - words, F.lit(0))
    starts = listed.select("item", "w", F.explode(F.sequence(F.lit(0), last)).alias("i"))
    window = F.array_join(F.slice("w", F.col("i") + 1, F.least(F.size("w"), F.lit(words))), " ")
    return starts.select("item", window.alias("window")).groupBy("window").agg(
        F.sort_array(F.collect_set("item")).alias("items")
    )


class _Searcher:
    """The tables for windows of one length."""

    def __init__(self, length: int, patterns: list[tuple[tuple[bytes, ...], list[str]]]):
        self.length = m = length
        self.block = b = min(2, m)
        self.default = m - b + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.buckets: dict[tuple[bytes, ...], dict[tuple[bytes, ...], list]] = {}
        for pattern, items in patterns:
            for end in range(b, m + 1):
                block = pattern[end - b : end]
                self.shift[block] = min(self.shift.get(block, self.default), m - end)
            self.buckets.setdefault(pattern[m - b :], {}).setdefault(pattern[:b], []).append((pattern, items))

    def occurrences(self, text: list[bytes]) -> Iterator[tuple[int, list[str]]]:
        m, b, shift, default = self.length, self.block, self.shift.get, self.default
        end, n = m, len(text)
        while end <= n:
            block = tuple(text[end - b : end])
            jump = shift(block, default)
            if jump:
                end += jump
                continue
            start = end - m
            for pattern, items in self.buckets[block].get(tuple(text[start : start + b]), ()):
                if tuple(text[start:end]) == pattern:
                    yield start, items
            end += 1


def _search(block):
    """Per task, the search of one block's windows: adds what it finds to spans and items."""

    def make():
        by_length: dict[int, list] = {}
        for window, items in block.value:
            pattern = tuple(window.encode("utf-8", "surrogatepass").split(b" "))
            by_length.setdefault(len(pattern), []).append((pattern, items))
        searchers = [_Searcher(m, patterns) for m, patterns in sorted(by_length.items())]

        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            counts, hits, items, spans = [], [], [], []
            for text, old_items, old_spans in zip(*(c.to_pylist() for c in batch.columns)):
                words = words_of(text)
                found, held = list(old_spans), set(old_items)
                for searcher in searchers:
                    for start, names in searcher.occurrences(words):
                        if found and found[-2] <= start <= found[-1] <= start + searcher.length:
                            found[-1] = start + searcher.length
                        else:
                            found += (start, start + searcher.length)
                        held.update(names)
                counts.append(len(words))
                hits.append(_hits(found))
                items.append(sorted(held))
                spans.append(found)
            return [
                pa.array(counts, pa.int64()), pa.array(hits, pa.int64()),
                pa.array(items, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.int32())),
            ]

        return work

    return make


def _hits(spans: list[int]) -> int:
    """Words in the union of spans."""
    ends = np.array(spans, np.int64).reshape(-1, 2)
    ends = ends[np.argsort(ends[:, 0], kind="stable")]
    if not len(ends):
        return 0
    reach = np.maximum.accumulate(ends[:, 1])
    before = np.concatenate([[0], reach[:-1]])
    return int(np.maximum(reach - np.maximum(ends[:, 0], before), 0).sum())


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    words: int = WORDS,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """All columns of ``docs`` and ``n_words, n_hit, items, spans``.

    ``items`` are the sorted ids of the items found, ``spans`` the word positions of the
    occurrences as start, end, start, end, ...  Columns of these names give way.
    """
    spark = docs.sparkSession
    made = written(windows(benchmark, words=words), "windows")
    size = made.agg(F.sum(F.length("window") + F.length(F.array_join("items", ",")))).first()[0] or 0
    blocks = max(1, -(-size // block_chars))
    results = {
        "n_words": T.LongType(), "n_hit": T.LongType(),
        "items": T.ArrayType(T.StringType()), "spans": T.ArrayType(T.IntegerType()),
    }
    found = docs
    none = {"items": F.array().cast("array<string>"), "spans": F.array().cast("array<int>")}
    for block in range(blocks):
        mine = made.where(F.pmod(F.xxhash64("window"), F.lit(blocks)) == block).collect()
        shared = spark.sparkContext.broadcast([(r.window, r["items"]) for r in mine])
        before = {c: F.col(c) for c in none} if block else none
        found = row_step(found, {"text": own_text(found, text), **before}, _search(shared), results)
    return found


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that hold no window of the benchmark."""
    own = [f"d{i}" for i in range(len(docs.columns))]
    found = contamination(docs.toDF(*own), benchmark, own[docs.columns.index(text)])
    return found.where("n_hit = 0").select(*own).toDF(*docs.columns)

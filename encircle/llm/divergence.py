"""How far the sources of a language differ in what they write about.

Arrow kernels split, lower and count the terms of every batch inside the tasks, so only partial
counts per (language, source, term) are shuffled.  The merged counts lie in shards, a range of a
language's terms each with the counts of all its sources as columns, and each shard adds its part
to every divergence.  All arithmetic is on integers.

A term is a run of letters A-Z, a-z and characters beyond ASCII; only A-Z are lowered.  A language
keeps the terms found in at least ``least`` of its documents.  With ``count`` occurrences of a kept
term in a group whose kept terms occur N times, V terms being kept, its share is
``p = 1 + floor(SCALE * (count + SMOOTH) / (N + SMOOTH * V))``; a language's share uses its totals.

Null texts, languages and sources are empty ones; an empty text has no terms, yet its group exists.
Rows count one by one, so a repeated row counts again.  Equal values are ranked by the item's UTF-8
bytes.  An empty table gives an empty result; columns beyond the three named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from encircle.llm.shared import written

#: What lies between terms.
GAP = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Documents of a language that must hold a term for it to be kept.
LEAST = 30
SCALE = 1_000_000_000
SMOOTH = 5
#: Ranks reported of a group's telling terms.
RANKS = 50

#: Bytes of text that a task splits at a time; a single longer text is split whole.
SPLIT_BYTES = 4 << 20
#: Partial counts a task holds before it merges them, and merged ones before it sends them on.
PENDING = 1 << 18
#: Counts (terms x sources) of a shard, and sources that a task compares with all others.
SHARD_CELLS = 1 << 17
TILE = 1024
#: Languages up to which their totals are broadcast (a row each).
FEW_LANGUAGES = 10_000

_PARTIAL = "lang string, source string, term string, occurrences bigint, documents bigint"
_KEYS = ["lang", "source", "term"]
_PARTS = pa.schema(
    {"lang": pa.string(), "source": pa.string(), "part": pa.string(), "item": pa.string(), "value": pa.int64()}
)


def partial_counts(docs: DataFrame) -> DataFrame:
    """``lang, source, term, occurrences, documents``; a key may come in several rows."""
    text = F.coalesce("text", F.lit("")).alias("text")
    return docs.select(*_groups(), text).mapInArrow(_count_terms, _PARTIAL)


def _groups() -> list:
    return [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pending, rows = [], 0
    for batch in _by_bytes(batches):
        pending.append(_batch_counts(batch))
        rows += pending[-1].num_rows
        if rows > PENDING:
            merged = _merged(pending)
            if merged.num_rows > PENDING // 2:
                yield from merged.to_batches()
                merged = merged.slice(0, 0)
            pending, rows = [merged], merged.num_rows
            pa.default_memory_pool().release_unused()
    if pending:
        yield from _merged(pending).to_batches()
    pa.default_memory_pool().release_unused()


def _by_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All rows, in slices of about SPLIT_BYTES of text."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            before = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + SPLIT_BYTES, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def _batch_counts(batch: pa.RecordBatch) -> pa.Table:
    split = pc.split_pattern_regex(pc.ascii_lower(batch.column("text")), GAP)
    row, term = pc.list_parent_indices(split), pc.list_flatten(split)
    real = pc.not_equal(term, "")
    row, term = row.filter(real), term.filter(real).dictionary_encode()
    per_document = (
        pa.table({"row": row, "code": term.indices})
        .group_by(["row", "code"], use_threads=False)
        .aggregate([([], "count_all")])
    )
    lang, source = (batch.column(c).dictionary_encode() for c in ("lang", "source"))
    counted = (
        pa.table(
            {
                "lang": lang.indices.take(per_document["row"]),
                "source": source.indices.take(per_document["row"]),
                "code": per_document["code"],
                "n": per_document["count_all"],
            }
        )
        .group_by(["lang", "source", "code"], use_threads=False)
        .aggregate([("n", "sum"), ([], "count_all")])
    )
    return pa.table(
        {
            "lang": lang.dictionary.take(counted["lang"]),
            "source": source.dictionary.take(counted["source"]),
            "term": term.dictionary.take(counted["code"]),
            "occurrences": counted["n_sum"],
            "documents": counted["count_all"],
        }
    )


def _merged(tables: list[pa.Table]) -> pa.Table:
    sums = [("occurrences", "sum"), ("documents", "sum")]
    merged = pa.concat_tables(tables).group_by(_KEYS, use_threads=False).aggregate(sums)
    return merged.select([*_KEYS, "occurrences_sum", "documents_sum"]).rename_columns(
        [*_KEYS, "occurrences", "documents"]
    )


def kept_terms(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """``lang, term, total, counts``: kept terms with their counts by source, zeros left out.

    A row holds at most one count per source of its language.
    """
    counts = partial_counts(docs).groupBy(*_KEYS).agg(
        F.sum("occurrences").alias("occurrences"), F.sum("documents").alias("documents")
    )
    by_term = counts.groupBy("lang", "term").agg(
        F.sum("documents").alias("documents"),
        F.sum("occurrences").alias("total"),
        F.collect_list(F.struct("source", "occurrences")).alias("counts"),
    )
    return by_term.where(F.col("documents") >= least).select("lang", "term", "total", "counts")


def divergences(docs: DataFrame, least: int = LEAST, ranks: int = RANKS) -> DataFrame:
    """``lang, source, part, item, value, rank`` for every occurring (lang, source).

    Part ``pair``: every other source of the language by the summed difference of the shares of
    all kept terms.  Part ``term``: kept terms whose share in the source is above their share in
    the language, by the difference, up to rank ``ranks``.
    """
    terms = written(kept_terms(docs, least), "terms")
    groups, shares = _totals(docs, terms)
    shards = F.col("_shards")
    sharded = terms.join(shares, "lang").select(
        "lang", "term", "total", "counts",
        F.pmod(F.xxhash64("term"), shards).cast("int").alias("shard"),
        F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1)).alias("tile"),
    )
    columns = (
        groups.join(shares, "lang")
        .withColumn("shard", F.explode(F.sequence(F.lit(0), shards - 1)))
        .withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1)))
    )
    keys = ["lang", "shard", "tile"]
    work = _shard_work(ranks)
    found = sharded.groupBy(*keys).cogroup(columns.groupBy(*keys)).applyInArrow(
        work, "lang string, source string, part string, item string, value bigint"
    )
    found = written(found, "divergences")
    pairs = found.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    turned = pairs.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    both = pairs.unionByName(turned)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = both.withColumn("rank", F.row_number().over(order)).withColumn("part", F.lit("pair"))
    telling = (
        found.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= ranks)
    )
    result = ["lang", "source", "part", "item", "value", "rank"]
    return ranked.select(result).unionByName(telling.select(result))


def _totals(docs: DataFrame, terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``lang, source, n`` of every group, and per language its totals and how it is dealt out."""
    per_source = (
        terms.select("lang", F.inline("counts")).groupBy("lang", "source").agg(F.sum("occurrences").alias("n"))
    )
    groups = written(
        docs.select(*_groups()).distinct().join(per_source, ["lang", "source"], "left")
        .select("lang", "source", F.coalesce("n", F.lit(0)).alias("n")),
        "groups",
    )
    vocabulary = terms.groupBy("lang").agg(F.count("*").alias("v"))
    sources = groups.groupBy("lang").agg(F.sum("n").alias("lang_n"), F.count("*").alias("_sources"))
    v = F.coalesce("v", F.lit(0))
    # a shard has no fewer terms than sources, so the pairs it adds to are no more than its counts
    dealt = F.ceil(v * F.col("_sources") / F.greatest(F.lit(SHARD_CELLS), F.col("_sources") * F.col("_sources")))
    shares = written(
        sources.join(vocabulary, "lang", "left").select(
            "lang", v.alias("v"), "lang_n",
            F.greatest(dealt, F.lit(1)).cast("int").alias("_shards"),
            F.ceil(F.col("_sources") / TILE).cast("int").alias("_tiles"),
        ),
        "shares",
    )
    # then the terms of a language need not meet in one place
    return groups, F.broadcast(shares) if shares.count() <= FEW_LANGUAGES else shares


def _share(count: np.ndarray, whole: int | np.ndarray) -> np.ndarray:
    """``1 + floor(SCALE * (count + SMOOTH) / whole)`` by long division: products stay below whole * 1000."""
    rest, share = count + SMOOTH, 0
    share, rest = rest // whole, rest % whole
    for _ in range(3):
        rest = rest * 1000
        share, rest = share * 1000 + rest // whole, rest % whole
    return share + 1


def _shard_work(ranks: int):
    def work(key, terms: pa.Table, columns: pa.Table) -> pa.Table:
        """Its share of the pairs, smaller source first, and its best terms of each source."""
        if not columns.num_rows:
            return _PARTS.empty_table()
        lang, tile = key[0].as_py(), key[2].as_py()
        tiles = columns["_tiles"][0].as_py()
        columns = columns.sort_by("source")
        sources = columns["source"].to_pylist()
        at = {source: i for i, source in enumerate(sources)}
        mine = [i for i in range(len(sources)) if i % tiles == tile]
        v, lang_n = columns["v"][0].as_py(), columns["lang_n"][0].as_py()
        terms = terms.sort_by("term")
        names = terms["term"].to_pylist()
        counts = np.zeros((len(names), len(sources)), np.int64)
        for row, cells in enumerate(terms["counts"].to_pylist()):
            for cell in cells:
                counts[row, at[cell["source"]]] = cell["occurrences"]
        out = {"source": [], "part": [], "item": [], "value": []}

        def put(source, part, items, values):
            out["source"] += [source] * len(items)
            out["part"] += [part] * len(items)
            out["item"] += items
            out["value"] += [int(x) for x in values]

        if names:
            whole = columns["n"].to_numpy().astype(np.int64) + SMOOTH * v
            shares = _share(counts, whole[None, :])
            usual = _share(terms["total"].to_numpy().astype(np.int64), lang_n + SMOOTH * v)
        for i in mine:
            if not names:
                put(sources[i], "pair", sources[i + 1 :], [0] * (len(sources) - i - 1))
                continue
            apart = np.abs(shares[:, i + 1 :] - shares[:, i : i + 1]).sum(axis=0)
            put(sources[i], "pair", sources[i + 1 :], apart)
            above = np.flatnonzero((counts[:, i] > 0) & (shares[:, i] > usual))
            value = shares[above, i] - usual[above]
            best = np.argsort(-value, kind="stable")[:ranks]
            put(sources[i], "term", [names[above[b]] for b in best], value[best])
        return pa.table({"lang": [lang] * len(out["item"]), **out}, schema=_PARTS)

    return work

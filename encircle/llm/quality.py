"""Quality rules: tokeniser fertility.

Each word of a text is split by a public vocabulary.  Four measures tell how the text as a whole
reads: characters per token, tokens per word, the share of tokens that fall back to single bytes,
and the entropy of the tokens.  What is usual depends on language and length, so the corpus gives
the bands: per language (per script where ``lang`` is no language code) and length class, the
quartiles of every measure over all documents that pass the base rules.  They are exact, on
measures in thousandths, and so the same however the documents are partitioned.  A document is rejected
when a measure lies further from the median than ``width`` robust standard deviations and than a
floor; entropy and byte share have one-sided bands.  A group of fewer than ``least`` documents is
judged by the bands of its language or script over all lengths, and where that has fewer as well by
those of the whole corpus, which has bands whatever its size: every document that passes the base
rules is judged.

Base rules: fewer than 20 words, or over 30 % of the words in repeated windows of 8 words.

Nulls and texts without words have zero counts and fail the base rules.  Repeated rows get equal
results.  An empty table gives an empty result.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from encircle.llm.shared import SPACE_BYTES, own_text, row_step, written

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MIN_WORDS = 20
MAX_REPEATED_PERCENT = 30
WINDOW = 8
SYMBOLS = "#*$%&|<>"
#: Robust standard deviations, and documents that a group needs to have its own bands.
WIDTH = 8.0
LEAST = 50
#: Measures are counted in steps of 1/STEPS, up to LARGEST, for the quartiles.
STEPS, LARGEST = 1000, 1000
#: A band is never narrower than this: a share of the median, or a difference.
CHARS_FLOOR, FERTILITY_FLOOR, ENTROPY_FLOOR, BYTES_FLOOR = 0.05, 0.10, 0.05, 0.20
#: Words a task remembers the tokens of, and the longest of them in bytes.
CACHE, LONGEST = 1 << 18, 64
#: First letter of each script's main range, in the order of code points.
SCRIPTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0900, "indic"), (0x0E00, "southeast"), (0x10A0, "georgian"), (0x1100, "hangul"),
    (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"),
    (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"),
]
_STARTS = np.array([start for start, _ in SCRIPTS])
_LETTER = re.compile(r"[^\W\d_]")

BASE = {
    "n_words": T.LongType(), "word_chars": T.LongType(), "n_symbols": T.LongType(),
    "n_dup_lines": T.LongType(), "n_repeat_words": T.LongType(),
}
MEASURES = {
    "n_tokens": T.LongType(), "chars_per_token": T.DoubleType(), "tokens_per_word": T.DoubleType(),
    "byte_share": T.DoubleType(), "token_entropy": T.DoubleType(), "script": T.StringType(),
}


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows that occur at least twice; windows are compared exactly."""
    n = len(words)
    if n <= window:
        return 0
    numbers: dict[bytes, int] = {}
    ranks = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, n)
    if len(numbers) > n - window:  # each repeated window repeats all its words
        return 0
    length = 1
    while length < window:  # ranks of windows from ranks of their two (overlapping) halves
        step = min(length, window - length)
        pairs = ranks[: len(ranks) - step] * (n + 1) + ranks[step:]
        _, ranks = np.unique(pairs, return_inverse=True)
        length += step
    often = np.bincount(ranks)[ranks] > 1
    marks = np.zeros(n + 1, np.int64)
    np.add.at(marks, np.flatnonzero(often), 1)
    np.add.at(marks, np.flatnonzero(often) + window, -1)
    return int((np.cumsum(marks)[:n] > 0).sum())


def base_counts(text: str | None) -> tuple[list[bytes], tuple[int, int, int, int, int]]:
    if not text:
        return [], (0, 0, 0, 0, 0)
    words = text.encode("utf-8", "surrogatepass").split()
    lines = [line for line in text.split("\n") if line.strip(SPACE_BYTES)]
    return words, (
        len(words),
        len(text) - sum(map(text.count, SPACE_BYTES)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def _script(text: str) -> str:
    letters = np.fromiter(map(ord, _LETTER.findall(text)), np.int64)
    if not len(letters):
        return "none"
    found = np.searchsorted(_STARTS, letters, side="right") - 1
    names = [name for _, name in SCRIPTS]
    counts: dict[str, int] = {}
    for i, c in zip(*np.unique(found, return_counts=True)):
        counts[names[i]] = counts.get(names[i], 0) + int(c)
    return max(sorted(counts), key=counts.get)


def _measured(model):
    """Per task: base counts and token measures of texts; ``model`` is the broadcast vocabulary."""

    def make():
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_proto=model.value)
        bytes_ = np.array([pieces.is_byte(i) for i in range(pieces.get_piece_size())])
        cache: dict[bytes, tuple[int, ...]] = {}

        def tokens(words: list[bytes]) -> np.ndarray:
            if len(cache) > CACHE:
                cache.clear()
            new = [w for w in dict.fromkeys(words) if w not in cache]
            coded = pieces.encode([w.decode("utf-8", "replace") for w in new], num_threads=1) if new else []
            here = {w: tuple(ids) for w, ids in zip(new, coded)}
            cache.update((w, ids) for w, ids in here.items() if len(w) <= LONGEST)
            get = {**here, **{w: cache[w] for w in set(words) - here.keys()}}.__getitem__ if here else cache.__getitem__
            return np.fromiter(chain.from_iterable(map(get, words)), np.int64)

        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            rows = []
            for text, coded_language in zip(*(c.to_pylist() for c in batch.columns)):
                words, counts = base_counts(text)
                ids = tokens(words)
                n = len(ids)
                often = np.unique(ids, return_counts=True)[1]
                entropy = float(np.log2(n) - (often * np.log2(often)).sum() / n) if n else 0.0
                rows.append(
                    (
                        *counts, n, counts[1] / n if n else 0.0, n / counts[0] if counts[0] else 0.0,
                        float(bytes_[ids].mean()) if n else 0.0, entropy,
                        None if coded_language else _script(text or ""),
                    )
                )
            columns = list(zip(*rows)) or [()] * 11
            kinds = [pa.int64()] * 6 + [pa.float64()] * 4 + [pa.string()]
            return [pa.array(c, k) for c, k in zip(columns, kinds)]

        return work

    return make


def _is_code(lang: Column) -> Column:
    return F.coalesce(lang.rlike("^[a-z]{2,3}$"), F.lit(False))


def measured(docs: DataFrame, text: str = "text", lang: str = "lang", vocabulary: str = VOCABULARY) -> DataFrame:
    """``docs`` with the base counts, the measures and ``band_key``, the group whose bands hold.

    Works row by row.  A key is a code of two or three letters or a script, with a length class.
    """
    spark = docs.sparkSession
    with open(vocabulary, "rb") as file:  # a few MB on the driver; the tasks get it by broadcast
        model = spark.sparkContext.broadcast(file.read())
    language = F.col(f"`{lang}`").cast("string")
    inputs = {"text": own_text(docs, text), "coded": _is_code(language)}
    held = docs.withColumn("_lang", language)
    found = row_step(held, inputs, _measured(model), BASE | MEASURES)
    group = F.when(_is_code(F.col("_lang")), F.col("_lang")).otherwise(F.concat(F.lit("script "), "script"))
    length = F.when(F.col("n_words") > 0, F.floor(F.log2("n_words")))
    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words")
    )
    return found.withColumns(
        {"band_key": F.concat_ws(" ", group, length.cast("string")), "base_failed": failed}
    ).drop("_lang")


def _without_length(key: str) -> Column:
    return F.regexp_replace(key, " [0-9]+$", "")


def quartiles(measures: DataFrame) -> DataFrame:
    """``band_key, _n`` and per measure the array of its quartiles, for every key and its parents.

    A quartile is the smallest value with at least that share of the documents at or below it.
    Documents are counted per key, measure and value, in the tasks first, so a key has at most
    STEPS x LARGEST rows per measure whatever its number of documents.
    """
    names = ["chars_per_token", "tokens_per_word", "byte_share", "token_entropy"]
    keys = F.explode(F.array_distinct(F.array("band_key", _without_length("band_key"), F.lit(""))))
    values = [
        F.struct(F.lit(name).alias("measure"), F.round(F.least(F.col(name), F.lit(float(LARGEST))) * STEPS).cast("int").alias("value"))
        for name in names
    ]
    counted = (
        measures.select("band_key", F.array(*values).alias("values"))
        .select(keys.alias("band_key"), "values")
        .select("band_key", F.inline("values"))
        .groupBy("band_key", "measure", "value").agg(F.count("*").alias("n"))
    )
    group = Window.partitionBy("band_key", "measure")
    upto = F.sum("n").over(group.orderBy("value"))
    placed = counted.withColumns({"_upto": upto, "_n": F.sum("n").over(group)})
    at = [
        F.min(F.when((F.col("measure") == name) & (4 * F.col("_upto") >= quarter * F.col("_n")), F.col("value"))) / F.lit(float(STEPS))
        for name in names for quarter in (1, 2, 3)
    ]
    return placed.groupBy("band_key").agg(
        F.max("_n").alias("_n"), *[F.array(*at[3 * i : 3 * i + 3]).alias(name) for i, name in enumerate(names)]
    )


def bands(measures: DataFrame, width: float = WIDTH, least: int = LEAST) -> DataFrame:
    """``band_key`` and the limits of every measure, from all documents that pass the base rules.

    Keys are codes of at most three letters or scripts, with length classes (below 64) or alone, so
    there are fewer than 1.2 million possible keys, two per ``least`` documents at most, and the
    empty one of the whole corpus.
    """
    found = quartiles(measures.where("not base_failed")).where((F.col("_n") >= least) | (F.col("band_key") == ""))

    def reach(name: str, floor: Column) -> Column:
        return F.greatest((F.col(name)[2] - F.col(name)[0]) / 1.349 * width, floor)

    def middle(name: str) -> Column:
        return F.col(name)[1]

    chars = reach("chars_per_token", middle("chars_per_token") * CHARS_FLOOR)
    fertility = reach("tokens_per_word", middle("tokens_per_word") * FERTILITY_FLOOR)
    return found.select(
        "band_key",
        (middle("chars_per_token") - chars).alias("chars_low"),
        (middle("chars_per_token") + chars).alias("chars_high"),
        (middle("tokens_per_word") - fertility).alias("fertility_low"),
        (middle("tokens_per_word") + fertility).alias("fertility_high"),
        (middle("byte_share") + reach("byte_share", F.lit(BYTES_FLOOR))).alias("bytes_high"),
        (middle("token_entropy") - reach("token_entropy", middle("token_entropy") * ENTROPY_FLOOR)).alias("entropy_low"),
    )


def judged(measures: DataFrame, limits: DataFrame) -> DataFrame:
    """``measures`` with ``kept``; the limits are a small table of a bounded number of keys."""
    outside = (
        (F.col("chars_per_token") < F.col("chars_low")) | (F.col("chars_per_token") > F.col("chars_high"))
        | (F.col("tokens_per_word") < F.col("fertility_low")) | (F.col("tokens_per_word") > F.col("fertility_high"))
        | (F.col("byte_share") > F.col("bytes_high")) | (F.col("token_entropy") < F.col("entropy_low"))
    )
    names = [c for c in limits.columns if c != "band_key"]
    joined = measures
    for i, key in enumerate((F.col("band_key"), _without_length("band_key"), F.lit(""))):
        level = limits.select(F.col("band_key").alias(f"_key{i}"), F.struct(*names).alias(f"_limits{i}"))
        joined = joined.join(F.broadcast(level), key == F.col(f"_key{i}"), "left").drop(f"_key{i}")
    held = [f"_limits{i}" for i in range(3)]
    joined = joined.withColumn("_limits", F.coalesce(*held)).select("*", "_limits.*").drop("_limits", *held)
    kept = ~F.col("base_failed") & ~F.coalesce(outside, F.lit(False))
    return joined.withColumn("kept", kept).drop(*names)


def quality(docs: DataFrame, text: str = "text", lang: str = "lang", vocabulary: str = VOCABULARY) -> DataFrame:
    """Base counts, measures and verdict for every row of ``docs``; its other columns stay.

    The text itself is not in the result.
    """
    measures = written(measured(docs, text, lang, vocabulary).drop(text), "measures")
    return judged(measures, written(bands(measures), "bands"))


def keep_good(docs: DataFrame, text: str = "text", lang: str = "lang", vocabulary: str = VOCABULARY) -> DataFrame:
    """The rows of ``docs`` that the rules keep, all columns.

    The rows are written once with their measures, which give the bands and are then filtered by
    them: no text is split into tokens twice, and none is shuffled.
    """
    own = [f"d{i}" for i in range(len(docs.columns))]
    hidden = docs.toDF(*own)
    at = {name: own[docs.columns.index(name)] for name in (text, lang)}
    measures = written(measured(hidden, at[text], at[lang], vocabulary), "measures")
    limits = written(bands(measures), "bands")
    return judged(measures, limits).where("kept").select(*own).toDF(*docs.columns)

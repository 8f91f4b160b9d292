"""What each of several document filters removes, in every order in which they can be applied.

Every document becomes a mask: one bit for each filter it fails.  The masks are counted per part of
the corpus (one row per part, with at most 2^5 mask cells), and a recursive common table
expression extends prefixes of filters by every unused filter, carrying the bits applied so far and
reading that step's figures off the cells.  Whatever the corpus, the recursion sees a row per part
and prefix: 325 steps for five filters.
"""

from __future__ import annotations

import math
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from encircle.llm.shared import written

#: Filters by the bit they set; the last one compares texts with each other.
LETTERS = "ABCDE"
REPEATED = 1 << LETTERS.index("E")

LEAST_WORDS = 50
#: Percent of words that must be distinct, and of characters that may be capitals.
DISTINCT_PERCENT, CAPITAL_PERCENT = 65, 5
SYMBOLS = r"[#$%&*|]"
SPACES = r"[\x20\x09-\x0D]+"

#: Counts of a mask cell.
FIGURES = ("n", "good", "toxic")
_ROW_LIMIT = "spark.sql.cteRecursionRowLimit"


def failing(text: Column, words: Column) -> Column:
    """Mask of the filters A to D that a text fails; ``words`` are its words."""
    length, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    fails = (
        length < LEAST_WORDS,
        100 * distinct < DISTINCT_PERCENT * length,
        100 * capitals > CAPITAL_PERCENT * F.length(text),
        text.rlike(SYMBOLS),
    )
    mask = F.lit(0)
    for bit, fail in enumerate(fails):
        mask = mask + F.when(fail, 1 << bit).otherwise(0)
    return mask.cast("int")


def document_masks(docs: DataFrame) -> DataFrame:
    """``doc_id, part, mask, digest`` of every row, filters A to D only; texts stay where they are."""
    text = F.coalesce("text", F.lit("")).alias("text")
    split = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text
    ).withColumn("words", F.filter(F.split("text", SPACES), lambda word: word != ""))
    return split.select(
        "doc_id", "part", failing(F.col("text"), F.col("words")).alias("mask"),
        F.unhex(F.sha2("text", 256)).alias("digest"),
    )


def mask_cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, mask, n, good, toxic``: documents by part and by the filters they fail, E included.

    A row fails E if its text is that of a row with a smaller id.  Rows are first counted per
    (id, text), then per (text, part, labels) with the smallest id among them, so a text costs the
    window at most four rows per part however often it occurs.
    """
    facts = document_masks(docs)
    one = facts.where("doc_id is not null").groupBy("doc_id", "part", "mask", "digest").agg(F.count("*").alias("n"))
    flags = (
        labels.where("doc_id is not null")
        .groupBy(F.col("doc_id").cast("bigint").alias("doc_id"))
        .agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
        .where("good or toxic")
    )
    known = one.join(flags, "doc_id", "left").withColumns(
        {c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")}
    )
    first = F.min(F.struct("doc_id", "n"))
    alike = known.groupBy("digest", "part", "mask", "good", "toxic").agg(F.sum("n").alias("n"), first.alias("first"))
    smallest = F.min("first.doc_id").over(Window.partitionBy("digest"))
    kept = F.when(F.col("first.doc_id") == F.col("smallest"), F.col("first.n")).otherwise(F.lit(0))
    halves = F.inline(
        F.array(
            F.struct(F.col("mask").alias("mask"), kept.alias("n")),
            F.struct((F.col("mask") + REPEATED).alias("mask"), (F.col("n") - kept).alias("n")),
        )
    )
    numbered = alike.withColumn("smallest", smallest).select("part", "good", "toxic", halves.alias("mask", "n"))
    nameless = facts.where("doc_id is null").select(
        "part", F.lit(False).alias("good"), F.lit(False).alias("toxic"), "mask", F.lit(1).cast("bigint").alias("n")
    )
    return numbered.unionByName(nameless).groupBy("part", "mask").agg(
        F.sum("n").alias("n"),
        *[F.sum(F.when(F.col(flag), F.col("n")).otherwise(0)).alias(flag) for flag in ("good", "toxic")],
    )


def _sum_where(condition: str, figure: str) -> str:
    """SQL for the sum of a figure over the cells ``c`` of a part that meet the condition."""
    return f"aggregate(cells.cells, 0L, (s, c) -> s + IF({condition}, c.{figure}, 0L))"


def _recursion() -> str:
    steps = {
        "kept": ("c.mask & (prefix.applied | letters.bit) = 0", "n"),
        "removed": ("c.mask & prefix.applied = 0 AND c.mask & letters.bit <> 0", "n"),
        "redundant": ("c.mask & prefix.applied <> 0 AND c.mask & letters.bit <> 0", "n"),
        "unique_fails": ("c.mask = letters.bit", "n"),
        "good_lost": ("c.mask & prefix.applied = 0 AND c.mask & letters.bit <> 0", "good"),
        "toxic_lost": ("c.mask & prefix.applied = 0 AND c.mask & letters.bit <> 0", "toxic"),
    }
    letters = ", ".join(f"('{letter}', {1 << bit})" for bit, letter in enumerate(LETTERS))
    return f"""
        WITH RECURSIVE letters(letter, bit) AS (VALUES {letters}), prefix AS (
            SELECT part, '' AS filters, '' AS letter, 0 AS applied, 0 AS step,
                   {", ".join(f"0L AS {name}" for name in steps)}
            FROM {{cells}}
            UNION ALL
            SELECT prefix.part, concat(prefix.filters, letters.letter), letters.letter,
                   prefix.applied | letters.bit, prefix.step + 1,
                   {", ".join(_sum_where(*how) for how in steps.values())}
            FROM prefix
            JOIN letters ON prefix.applied & letters.bit = 0
            JOIN {{cells}} AS cells ON cells.part = prefix.part
        )
        SELECT part, filters, letter, step, {", ".join(steps)} FROM prefix WHERE step > 0
    """


@contextmanager
def _rows_of_recursion(spark: SparkSession, rows: int):
    """The session's limit on rows of a recursion, raised for a recursion of a known size."""
    before = spark.conf.get(_ROW_LIMIT)
    spark.conf.set(_ROW_LIMIT, max(int(before), rows) if int(before) >= 0 else before)
    try:
        yield
    finally:
        spark.conf.set(_ROW_LIMIT, before)


def prefix_steps(cells: DataFrame) -> DataFrame:
    """``part, filters, letter, step`` and the figures of the last filter of every prefix."""
    spark = cells.sparkSession
    by_part = written(
        cells.groupBy("part").agg(F.collect_list(F.struct("mask", *FIGURES)).alias("cells")), "mask-cells"
    )
    prefixes = sum(math.perm(len(LETTERS), length) for length in range(len(LETTERS) + 1))
    with _rows_of_recursion(spark, prefixes * by_part.count() + 1):
        return written(spark.sql(_recursion(), cells=by_part), "prefix-steps")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step, with what that step's filter does.

    ``docs`` needs ``doc_id, text, source``, ``labels`` ``doc_id, quality, toxic``; more columns are
    not read.  A null text is an empty one, a null source the part ''.  Repeated rows count one by
    one; equal ids do not make a text repeated.  A null id has no labels, is smaller than no id
    and larger than none, so its row never fails E nor makes another fail it.  A document is good or
    toxic if any of its label rows says so.  No documents: no rows.  ``shapley`` is what the step's
    filter removes, summed over all orders.
    """
    steps = prefix_steps(mask_cells(docs, labels))
    orders_behind = F.factorial(len(LETTERS) - F.col("step"))
    shapley = steps.groupBy("part", "letter").agg(F.sum(F.col("removed") * orders_behind).alias("shapley"))
    orders = (
        steps.where(F.col("step") == len(LETTERS))
        .select(F.col("filters").alias("filter_order"))
        .distinct()
        .withColumn("_length", F.explode(F.sequence(F.lit(1), F.lit(len(LETTERS)))))
        .withColumn("filters", F.expr("substring(filter_order, 1, _length)"))
        .drop("_length")
    )
    # at most 5! x 5 rows
    return (
        steps.join(F.broadcast(orders), "filters")
        .join(shapley, ["part", "letter"])
        .select(
            "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost",
            "toxic_lost", "shapley",
        )
    )

"""Mixing sources to target weights: multivariate-hypergeometric splitting tree.

Every source aims at its share of the words of all documents, at most ``repeats`` times its own
size.  Its documents are dealt into blocks by a hash.  A source that aims at r times its size draws
each block floor(r) times and, in a random order of its blocks, one more time as long as the target
allows.  What is then missing comes from the block that fits best: whole, or as many of its
documents, in a random order, as come closest.

The draws of a source are its quota.  A binary tree over the output shards splits the quotas: at
every node, half of the blocks go left, and how many of each source follows the multivariate
hypergeometric law (the blocks of the node are put in a random order and cut in the middle).  The
quotas of all sources stay exact at every level.  A shard then takes that many of the next blocks
of the source's own random order, so shards hold disjoint draws, and shuffles its documents.

Everything random is a hash of seed, id and text, so reruns agree.  Sources are split in trees of
``TREE_SOURCES`` at most; a tree sees quotas, never documents, so the rows it handles do not grow
with the corpus.  Documents move once, by source and block; a hot source is spread over its blocks.

Null texts have size 0.  Documents of size 0 belong to blocks like others and come with them.  A
null source is a source of its own, the last.  Repeated rows are documents of their own.  Empty
tables, and tables without words, give targets and draws of 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from encircle.llm.shared import replacing, written
from encircle.sources.datasets import with_ordinal

WEIGHTS = (1, 2, 3)
REPEATS = 3
SHARDS = 16
BLOCKS = 256
TREE_SOURCES = 64
SEED = 20


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """``source, source_size, ordinal, target`` from ``source, source_size``.

    Weights repeat in the order of sources (by code point, null last).  The level at which shares
    meet the caps is found by raising it until no source is above its cap: each round sums over all
    sources, and only the sums reach the driver.
    """
    ranked = sizes.withColumn("_last", F.col("source").isNull())
    ordered = written(
        with_ordinal(ranked.select("_last", "source", "source_size"), ["_last", "source"], "ordinal").drop("_last"),
        "sources",
    )
    which = F.pmod("ordinal", F.lit(len(weights))).cast("int")
    weight = F.element_at(F.array(*map(F.lit, weights)), which + 1).cast("double")
    cap = F.col("source_size").cast("double") * repeats
    level, total = 0.0, None
    while True:
        capped = cap <= weight * level
        sums = ordered.agg(
            F.sum("source_size").alias("total"),
            F.sum(F.when(capped, cap)).alias("capped"),
            F.sum(F.when(~capped, weight)).alias("free"),
        ).first()
        total = float(sums.total or 0)
        if not total or not sums.free:
            break
        raised = (total - (sums.capped or 0.0)) / sums.free
        if raised <= level:
            break
        level = raised
    return ordered.withColumn("target", F.least(cap, weight * level))


def _uniform(*parts: Column | int | str) -> Column:
    """Hash by which things are put in a random order."""
    return F.xxhash64(*[F.lit(p) if isinstance(p, int) else p for p in parts])


def _split(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """``ordinal, shard, quota`` from ``ordinal, quota``."""
    nodes = quotas.where("quota > 0").select(
        F.floor(F.col("ordinal") / TREE_SOURCES).alias("tree"), "ordinal", F.lit(0).alias("first"),
        F.lit(shards).alias("width"), "quota",
    )
    depth = max(0, (shards - 1).bit_length())
    for level in range(depth):
        blocks = nodes.select("tree", "first", "width", "ordinal", F.explode(F.sequence(F.lit(1), "quota")).alias("unit"))
        node = Window.partitionBy("tree", "first", "width")
        order = _uniform(seed, level, "tree", "first", "ordinal", "unit")
        half = F.floor(F.col("width") / 2).cast("int")
        cut = blocks.select(
            "*", F.row_number().over(node.orderBy(order, "ordinal", "unit")).alias("_at"), F.count("*").over(node).alias("_all")
        ).withColumn("_left", F.col("_at") <= F.round(F.col("_all") * half / F.col("width")))
        nodes = (
            cut.select(
                "tree", "ordinal",
                F.when(F.col("_left"), F.col("first")).otherwise(F.col("first") + half).cast("int").alias("first"),
                F.when(F.col("_left"), half).otherwise(F.col("width") - half).cast("int").alias("width"),
            )
            .groupBy("tree", "ordinal", "first", "width").agg(F.count("*").cast("int").alias("quota"))
        )
    return nodes.select("ordinal", F.col("first").alias("shard"), "quota")


def draw_plan(blocks: DataFrame, shards: int, seed: int, repeats: int = REPEATS) -> DataFrame:
    """What every block gives: ``source, block, source_size, target, draws``.

    ``draws`` are structs of epoch, shard and ``words``, the words up to which the draw goes (null:
    the whole block).  ``blocks``: ``source, block, words, n``.
    """
    sizes = blocks.groupBy("source").agg(F.sum("words").alias("source_size"))
    aimed = targets(sizes, repeats=repeats)
    joined = blocks.join(aimed, blocks.source.eqNullSafe(aimed.source)).select(
        blocks.source, "block", "words", "n", "source_size", "target", "ordinal"
    )
    turn = Window.partitionBy("ordinal").orderBy(_uniform(seed, "ordinal", "block"), "block")
    full = F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(repeats)).cast("int")
    counted = (
        joined.withColumn("_before", F.coalesce(F.sum("words").over(turn.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("_full", F.when(F.col("source_size") > 0, full).otherwise(0))
        .withColumn("_rest", F.greatest(F.col("target") - F.col("_full") * F.col("source_size"), F.lit(0.0)))
        .withColumn("_more", (F.col("_full") < repeats) & (F.col("_before") + F.col("words") <= F.col("_rest")))
    )
    source = Window.partitionBy("ordinal")
    taken = F.coalesce(F.max(F.when(F.col("_more"), F.col("_before") + F.col("words"))).over(source), F.lit(0))
    missing = F.col("_missing")
    one = F.least(F.abs(F.col("words") - missing), missing)
    several = F.when(F.col("words") <= missing, missing - F.col("words")).otherwise(F.col("words") / F.col("n") / 2)
    counted = (
        counted.withColumn("_missing", F.when(F.col("_full") < repeats, F.col("_rest") - taken).otherwise(0.0))
        .withColumn("_error", F.when(~F.col("_more"), F.when(F.col("n") == 1, one).otherwise(several)))
        .withColumn("_at", F.row_number().over(source.orderBy(F.col("_error").asc_nulls_last(), _uniform(seed, "ordinal", "block"), "block")))
        .withColumn("_part", F.when((F.col("_at") == 1) & (F.col("_error") < missing), missing))
        .withColumn("_more", F.col("_more") | F.col("_part").isNotNull())
        .drop("_at")
    )
    counted = written(counted, "blocks")
    times = F.col("_full") + F.col("_more").cast("int")
    draws = counted.where(times > 0).select("ordinal", "block", "_full", "_part", F.explode(F.sequence(F.lit(0), times - 1)).alias("epoch"))
    own = Window.partitionBy("ordinal").orderBy(_uniform(seed, "epoch", "block", "ordinal"), "epoch", "block")
    drawn = draws.select(
        "ordinal", "block", "epoch", F.when(F.col("epoch") == F.col("_full"), F.col("_part")).alias("words"),
        F.row_number().over(own).alias("_at"),
    )
    quotas = draws.groupBy("ordinal").agg(F.count("*").cast("int").alias("quota"))
    parts = _split(quotas, shards, seed)
    upto = F.sum("quota").over(Window.partitionBy("ordinal").orderBy("shard"))
    dealt = parts.withColumn("_to", upto).select(
        F.col("ordinal").alias("_o"), "shard", F.explode(F.sequence(F.col("_to") - F.col("quota") + 1, "_to")).alias("_n")
    )
    given = (
        drawn.join(dealt, (drawn.ordinal == dealt._o) & (drawn._at == dealt._n))
        .groupBy("ordinal", "block").agg(F.sort_array(F.collect_list(F.struct("epoch", "shard", "words"))).alias("draws"))
    )
    nothing = F.array().cast("array<struct<epoch:int,shard:int,words:double>>")
    return counted.select("source", "block", "source_size", "target", "ordinal").join(given, ["ordinal", "block"], "left").select(
        "source", "block", "source_size", "target", F.coalesce("draws", nothing).alias("draws")
    )


def mix(
    docs: DataFrame, source: str, size: str, mark: str,
    shards: int = SHARDS, blocks: int = BLOCKS, seed: int = SEED, repeats: int = REPEATS,
) -> DataFrame:
    """All rows and columns of ``docs`` with ``source_size, target, draws, taken``.

    ``size`` is the column with the words of a document, ``mark`` a hash that tells documents
    apart.  ``draws`` are structs of epoch, shard and ``place``, a random number by which a shard's
    documents are put in order; ``taken`` is the number of words drawn, repeats counted.
    """
    own = [f"d{i}" for i in range(len(docs.columns))]
    at = dict(zip(docs.columns, own))
    block = F.pmod(_uniform(seed, at[mark]), F.lit(blocks)).cast("int")
    rows = docs.toDF(*own).withColumn("_block", block)
    sums = rows.groupBy(F.col(at[source]).alias("source"), F.col("_block").alias("block")).agg(
        F.sum(at[size]).alias("words"), F.count("*").alias("n")
    )
    plan = written(draw_plan(written(sums, "sums"), shards, seed, repeats), "plan").withColumnRenamed("source", "_source")
    same = rows[at[source]].eqNullSafe(plan._source) & (rows["_block"] == plan.block)
    inside = Window.partitionBy(at[source], "_block").orderBy(_uniform(seed, at[mark], 1), at[mark])
    upto = F.sum(at[size]).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    joined = rows.join(plan, same).withColumn("_upto", upto)
    # of a block drawn in part: the documents whose middle lies before the end of the draw
    middle = F.col("_upto") - F.col(at[size]) / 2
    held = F.filter("draws", lambda d: d.words.isNull() | (middle <= d.words))
    placed = F.transform(
        held, lambda d: F.struct(d.epoch.alias("epoch"), d.shard.alias("shard"), _uniform(seed, at[mark], d.epoch).alias("place"))
    )
    done = joined.withColumn("_draws", placed)
    results = {
        "source_size": F.col("source_size"), "target": F.col("target"), "draws": F.col("_draws"),
        "taken": F.col(at[size]) * F.size("_draws"),
    }
    named = done.select(
        *[F.col(o).alias(c) for c, o in at.items() if c.lower() not in results],
        *[v.alias(c) for c, v in results.items()],
    )
    return named


def mixed_rows(mixture: DataFrame) -> DataFrame:
    """The mixture itself: a row per draw, with ``epoch, shard, place``, each shard in its order."""
    drawn = mixture.withColumn("_draw", F.explode("draws"))
    rows = replacing(drawn, {c: F.col("_draw")[c] for c in ("epoch", "shard", "place")}).drop("_draw", "draws")
    return rows.repartition("shard", F.pmod("place", F.lit(64))).sortWithinPartitions("shard", "place")

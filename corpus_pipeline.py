"""From raw documents to training shards: quality, near-duplicates, benchmarks, mixture, shards.

Every stage takes (spark, docs, folder of tables) and works on all that the stage before kept.
Nulls, empty texts, repeated rows and empty tables are dealt with as the operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from encircle.llm import decontaminate, mixing, ngram_join, quality, sharding
from encircle.llm.shared import table, word_count, written


def _numbered(docs: DataFrame) -> tuple[DataFrame, list[str], dict[str, str]]:
    """``docs`` under names that cannot clash, these names, and where each column went."""
    own = [f"p{i}" for i in range(len(docs.columns))]
    return docs.toDF(*own), own, dict(zip(docs.columns, own))


def keep_quality(spark: SparkSession, docs: DataFrame, d: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.keep_good(docs)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, d: str) -> DataFrame:
    """Of documents connected by near-duplicate links, the one with the smallest id."""
    return ngram_join.keep_one(docs)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, d: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontaminate.clean(docs, table(spark, d, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, d: str) -> DataFrame:
    """Documents as often as the mixture draws them (between 0 and 3 times), by shard, each in its order."""
    hidden, own, at = _numbered(docs)
    sized = hidden.withColumns(
        {"size": word_count(at["text"]), "mark": F.xxhash64(F.col(at["doc_id"]).cast("bigint"), at["text"])}
    )
    mixture = mixing.mix(sized, at["source"], "size", "mark")
    drawn = mixing.mixed_rows(mixture.select(*own, "draws"))
    return drawn.select(*own).toDF(*docs.columns)


def cut_shards(spark: SparkSession, docs: DataFrame, d: str) -> DataFrame:
    """Documents with ``shard`` and ``slot``."""
    hidden, own, at = _numbered(docs)
    sized = hidden.withColumns(
        {"size": sharding.text_size(at["text"]), "digest": sharding.text_digest(at["text"])}
    )
    placed = sharding.shard(sized, at["doc_id"], "size", "digest")
    kept = [(o, c) for c, o in at.items() if c.lower() not in ("shard", "slot")]
    return placed.select(*[F.col(o).alias(c) for o, c in kept], "shard", "slot")


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", keep_one_of_each_group),
    ("decontamination", keep_uncontaminated),
    ("mixture", mix_sources),
    ("shards", cut_shards),
]

#: Tokens and hashes have no SQL form; the pipeline is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table ``documents``; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

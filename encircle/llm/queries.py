"""One query per training-data operator: ``name -> (spark, folder) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from encircle.llm import (
    decontaminate, divergence, filter_audit, license_scan, line_chunks, mixing, ngram_join, page_text, quality,
    sharding, simhash_tiles, url_filter, warc,
)
from encircle.llm.shared import table, word_count
from encircle.session import scratch_path

Query = Callable[[SparkSession, str], DataFrame]


def op1_url_filters(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").select("page_id", "url")
    judged = url_filter.judge_urls(pages, table(spark, d, "labels").select("doc_id", "quality", "toxic"))
    return judged.select(F.col("page_id").cast("bigint").alias("page_id"), "host", "path", "rule", "verdict", "template")


def op2_benchmark_decontamination(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    found = decontaminate.contamination(docs, table(spark, d, "benchmark").select("item_id", "text"))
    return found.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op3_source_mixing(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        "source",
        word_count("text").alias("size"),
        F.xxhash64("doc_id", "text").alias("mark"),
    )
    return mixing.mix(docs, "source", "size", "mark").select(
        "doc_id", "size", "source_size", "target", "taken",
        F.array_join(F.transform("draws", lambda x: x.shard.cast("string")), ",").alias("draw_shards"),
        F.array_join(F.transform("draws", lambda x: x.place.cast("string")), ",").alias("draw_places"),
    )


def op4_quality_rules(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "lang")
    return quality.quality(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_tokens", "chars_per_token", "tokens_per_word", "byte_share", "token_entropy",
    )


def op8_html_extraction(spark: SparkSession, d: str) -> DataFrame:
    return page_text.extract_text(table(spark, d, "pages"))


def op9_line_dedup(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return line_chunks.dedup_lines(docs).select("doc_id", "n_lines", "n_removed", "text")


def op10_sharding(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        sharding.text_size("text").alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        sharding.text_digest("text").alias("digest"),
    )
    placed = sharding.shard(docs, "doc_id", "size", "digest")
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op5_warc(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_archives(table(spark, d, "pages").select("page_id", "url", "html"), path)
    records = warc.resolved(warc.read_archives(spark, path, with_payload=False))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_license_scans(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return license_scan.scan_licenses(docs).select(
        "doc_id",
        F.size("matches").cast("bigint").alias("n_matches"),
        F.array_join("matches.license", ",").alias("licenses"),
        F.array_max("matches.coverage").alias("best_coverage"),
        F.array_join(F.transform("matches", lambda m: F.concat_ws("-", m.first.cast("string"), m.past.cast("string"))), ",").alias("spans"),
    )


def op7_ngram_jaccard_join(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    return ngram_join.similar_groups(docs).select("doc_id", "n_shingles", "component_id")


def op11_filter_audit(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text", "source")
    return filter_audit.audit(docs, table(spark, d, "labels").select("doc_id", "quality", "toxic"))


def op12_simhash(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return simhash_tiles.near_duplicates(docs).select(
        "doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op13_source_divergence(spark: SparkSession, d: str) -> DataFrame:
    return divergence.divergences(table(spark, d, "documents").select("lang", "source", "text"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_url_filters, op2_benchmark_decontamination, op3_source_mixing, op4_quality_rules, op5_warc,
        op6_license_scans, op7_ngram_jaccard_join, op8_html_extraction, op9_line_dedup, op10_sharding,
        op11_filter_audit, op12_simhash, op13_source_divergence,
    )
}

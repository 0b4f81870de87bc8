"""One query for each llm operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chaining, cws, katz, kdtree, mixing, neardup, packing, quality, template, warc
from .common import new_path, table


def op1_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.perplexities(table(spark, sf_dir, "documents"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chaining.passages(table(spark, sf_dir, "documents"))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return template.rendered(table(spark, sf_dir, "conversations"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order of training: which document is passed over when; texts stay where they are."""
    return mixing.order(table(spark, sf_dir, "documents"))


def op8_kdtree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kdtree.document_shards(table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written as a WARC request and response in the shared folder, and the responses read back."""
    return warc.round_trip(table(spark, sf_dir, "pages"), new_path(spark, "warc"))


def op10_weighted_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cws.fingerprints(table(spark, sf_dir, "documents"))


_QUERIES = (
    op1_katz_backoff,
    op2_simhash_near_dedup,
    op3_quality_rules,
    op4_packing,
    op5_substring_dedup,
    op6_chat_formatting,
    op7_source_mixing,
    op8_kdtree_sharding,
    op9_warc,
    op10_weighted_fingerprints,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return {
        "op3_quality_rules": quality.sql(),
        "op6_chat_formatting": template.sql(),
        "op9_warc": "SELECT page_id, url, html FROM pages",
    }

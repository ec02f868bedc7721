"""The queries opN_<name>: each operator over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact_dedup, html_text, packing, quality_classifier, quality_rules, simhash, substring_dedup, token_counts, warc_revisits
from .common import table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.bpe_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_neardup(table(spark, sf_dir, "documents"), shingle=3, max_distance=2, blocks=8)


def op4_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(table(spark, sf_dir, "documents")).drop("kept_text")


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.html_main_text(table(spark, sf_dir, "pages"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.quality_classifier(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every revisit of a crawl of the pages: the full response it belongs to and its merged headers, sorted and written out."""
    headers = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    found = warc_revisits.resolve_revisits(warc_revisits.capture_log(table(spark, sf_dir, "pages")))
    return found.select("record_id", "canonical", F.col("resolved_id").cast("string").alias("resolved_id"), "status", F.array_join(headers, "\n").alias("headers"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").where(F.col("quality") == 1).select("doc_id")
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"), trusted)


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_bpe, op3_simhash, op4_substring, op5_html, op6_quality, op7_warc, op8_packing, op9_exact_dedup, op10_quality_rules)}
ORACLE_SQL = {"op7_warc": warc_revisits.SQL, "op9_exact_dedup": exact_dedup.SQL}

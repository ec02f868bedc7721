"""The corpus pipeline: documents through filtering and packing stages, each written as Parquet and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithic.llm.common import checkpoint_dir, keyed, table
from lithic.llm.exact_dedup import exact_dedup
from lithic.llm.near_dedup import near_dedup
from lithic.llm.packing import pack
from lithic.llm.quality_classifier import quality_classifier
from lithic.llm.substring_dedup import substring_dedup


def _only(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of keyed ``docs`` with one of the row keys of ``rows``, in the columns of the documents."""
    return docs.join(rows.select("row_key"), "row_key", "left_semi").drop("row_key")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    rows = docs.select("doc_id", "text", F.struct(*docs.columns).alias("row"))
    return quality_classifier(rows, table(spark, sf_dir, "labels"), carry="row").where("predicted = 1").select("row.*")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest id stays, and of equal ids one."""
    docs = keyed(docs)
    found = exact_dedup(docs.select(F.struct("doc_id", "row_key").alias("at"), "text"), id_col="at")
    return _only(docs, found.where("kept").select("at.row_key"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows linked by an exact five-word Jaccard similarity of 0.8 or more, the one with the smallest id stays, one without an id only alone."""
    docs = keyed(docs)
    found = near_dedup(docs, id_col="row_key").join(docs.select("row_key", "doc_id"), "row_key")
    first = found.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")).alias("at"))
    return _only(docs, first.select("at.row_key"))


def substring(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring passages are taken out of the texts; every row stays. A null text becomes an empty one."""
    found = substring_dedup(docs.select("doc_id", "text", F.struct(*[c for c in docs.columns if c != "text"]).alias("row")), carry="row")
    cut = F.col("kept_text").isNotNull()
    new = {"text": F.coalesce("kept_text", "whole_text"), "n_chars": F.when(cut, F.length("kept_text")).otherwise(F.col("row.n_chars")).cast("long")}
    return found.select([new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's words in bins of 2048, one document of a source or of a duplicate cluster to a bin."""
    return pack(docs)


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact),
    ("SimHash near-dedup", near),
    ("substring dedup", substring),
    ("best-fit packing", packing),
]
#: The classifier, near-dedup and packing cannot be expressed in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def _removed(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES in turn over ``documents``. Each stage's table stays until the next one is written; the last one's is returned."""
    docs, home = table(spark, sf_dir, "documents"), f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{home}/{k}")
        docs = spark.read.parquet(f"{home}/{k}")
        if k:
            _removed(spark, f"{home}/{k - 1}")
    return docs

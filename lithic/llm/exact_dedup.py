"""Operator 9, exact dedup: skew-safe combining, DataFrame functions only.

Three stages, each of which groups by the full content and not by its digest alone:

1. every map task combines its own rows (Spark's partial aggregation),
2. what the tasks made of one digest meets in ``salts`` groups, salted by task,
3. the winners of the salted groups are combined over all rows.

A text with a third of all rows therefore leaves a task as one row, and reaches the last stage as at most
``salts`` rows. The winners go back to the rows by digest, a second hash and the
length of the confirmed content; that join may be split by the adaptive planner.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical after lower-casing A-Z; the largest id of a group stays.
    A null text counts as empty. A null id never wins against another id; in a group of null ids only,
    keep_id is null and every row is kept. Repeated rows with the winning id are all kept. Very long texts are compared whole. No rows: no rows.
    Other columns are ignored, whatever their names.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = df.select(F.col(f"`{id_col}`").alias("id"), ascii_lower(text).alias("norm"))
    rows = rows.select("id", "norm", F.sha2("norm", 256).alias("sha"), F.pmod(F.spark_partition_id(), F.lit(salts)).alias("salt"))
    salted = rows.groupBy("sha", "salt", "norm").agg(F.max("id").alias("top"), F.count(F.lit(1)).alias("n"))
    winners = salted.groupBy("sha", "norm").agg(F.max("top").alias("keep_id"), F.sum("n").alias("group_size"))
    confirmed = [F.xxhash64("norm").alias("hash2"), F.length("norm").alias("len")]
    winners = winners.select(F.col("sha").alias("w_sha"), *[c.alias(f"w_{n}") for c, n in zip(confirmed, ("hash2", "len"), strict=True)], "keep_id", "group_size")
    back = rows.select("id", "sha", *confirmed)
    same = (F.col("sha") == F.col("w_sha")) & (F.col("hash2") == F.col("w_hash2")) & (F.col("len") == F.col("w_len"))
    return back.join(winners, same).select(
        F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256")
    )


SQL = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""

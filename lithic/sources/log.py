"""Histories from files or maps, provenance, and catalog snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

def read_history(spark: SparkSession, folder: str) -> DataFrame:
    """(seq, filename, content): every ``*.sql`` of a folder, the number at the head of its name as its place; others are skipped."""
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    files = spark.read.option("pathGlobFilter", "*.sql").text(folder, wholetext=True).select(name.alias("filename"), F.col("value").alias("content"))
    return files.withColumn("seq", F.regexp_extract("filename", r"^(\d+)", 1).try_cast("long")).where("seq IS NOT NULL").select("seq", "filename", "content")


def history_from_map(spark: SparkSession, migrations: dict[int, str]) -> DataFrame:
    """As read_history, from sequence -> SQL text, or -> path where the value ends in .sql and has no line break."""
    paths = {k: v for k, v in migrations.items() if v.rstrip().lower().endswith(".sql") and "\n" not in v}
    texts = spark.createDataFrame([(k, f"migration_{k}", v) for k, v in migrations.items() if k not in paths], "seq long, filename string, content string")
    for k, path in paths.items():
        one = spark.read.text(path, wholetext=True).select(F.lit(k).cast("long").alias("seq"), F.lit(path.rsplit("/", 1)[-1]).alias("filename"), F.col("value").alias("content"))
        texts = texts.union(one)
    return texts


def should_stream(files: DataFrame, threshold_mb: int = 5, max_files: int = 100) -> tuple[bool, str]:
    """Whether a history is taken in file by file: more than ``max_files`` files, or more bytes than the threshold."""
    n, size = files.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("content")), F.lit(0))).first()
    if n > max_files:
        return True, f"{n} files"
    return (True, f"{size} bytes") if size > threshold_mb << 20 else (False, "")


def read_provenance(spark: SparkSession, path: str) -> DataFrame:
    """A provenance map (JSON) with a column that says whether its content hash holds."""
    df = spark.read.json(path, multiLine=True)
    return df.withColumn("hash_holds", F.sha2(F.col("output_sql"), 256) == F.col("output_hash"))


class SnapshotCache:
    """Catalog snapshots by id, kept in Spark's cache until they are dropped or ``ttl`` seconds old."""

    def __init__(self, ttl: float = 300.0) -> None:
        self.ttl, self._kept = ttl, {}

    def get(self, snapshot: str, load) -> DataFrame:
        import time

        df, at = self._kept.get(snapshot, (None, 0.0))
        if df is None or time.monotonic() - at > self.ttl:
            self.drop(snapshot)
            df = load().cache()
            self._kept[snapshot] = (df, time.monotonic())
        return df

    def drop(self, snapshot: str) -> None:
        df, _ = self._kept.pop(snapshot, (None, 0.0))
        if df is not None:
            df.unpersist()

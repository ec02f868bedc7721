"""Streaming ingest of histories: files to the statement log, and object states kept up to date (STM-1..4)."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from lithic.operators.parse import statement_log


def stream_history(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """(seq, filename, content) as a stream over a folder of ``*.sql``."""
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    files = spark.readStream.format("text").schema("value string").option("wholetext", True).option("pathGlobFilter", "*.sql").option("maxFilesPerTrigger", files_per_trigger).load(folder)
    return files.select(F.regexp_extract(name, r"^(\d+)", 1).try_cast("long").alias("seq"), name.alias("filename"), F.col("value").alias("content")).where("seq IS NOT NULL")


def stream_log(spark: SparkSession, folder: str, out: str, checkpoint: str, files_per_trigger: int = 100):
    """Appends the typed log of new files to Parquet, each file once; returns the query."""
    log = statement_log(stream_history(spark, folder, files_per_trigger))
    return log.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def live_states(log: DataFrame) -> DataFrame:
    """A streaming aggregate over (k, pos, op): each object's number of statements, last place and last operation.

    The maximum of (pos, op) does not depend on the order in which rows arrive, so no watermark is needed.
    """
    out = log.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("pos", "op")).alias("last"))
    return out.select("k", "n", F.col("last.pos").alias("last_pos"), F.col("last.op").alias("last_op"))


def settings(memory_mb: int, files: int) -> dict[str, str]:
    """STM-2, STM-4. Spark settings for a history of many files under a limit of memory for each task: smaller splits and batches, and files taken in by so many at a time."""
    split = max(1, min(128, memory_mb // 8))
    return {"spark.sql.files.maxPartitionBytes": f"{split}m", "spark.sql.execution.arrow.maxRecordsPerBatch": str(max(100, min(10_000, memory_mb * 10))), "maxFilesPerTrigger": str(max(1, min(files, memory_mb // 2)))}


@dataclass
class Progress:
    """STM-3. How far an ingest is: phases with their weights, and the time that is left at the pace so far."""

    total: int
    weights: dict[str, float] = field(default_factory=lambda: {"parse": 0.5, "track": 0.2, "consolidate": 0.2, "render": 0.1})
    done: dict[str, int] = field(default_factory=dict)
    began: float = field(default_factory=time.monotonic)

    def update(self, phase: str, n: int) -> None:
        if phase not in self.weights:
            raise ValueError(f"unknown phase: {phase}")
        self.done[phase] = min(n, self.total)

    @property
    def share(self) -> float:
        return sum(w * self.done.get(p, 0) / max(1, self.total) for p, w in self.weights.items()) / sum(self.weights.values())

    def seconds_left(self, now: float | None = None) -> float | None:
        spent = (time.monotonic() if now is None else now) - self.began
        return spent * (1 - self.share) / self.share if self.share else None


class ProgressListener(StreamingQueryListener):
    """STM-3. Feeds a Progress from a streaming query's batches."""

    def __init__(self, progress: Progress) -> None:
        self.progress, self.rows = progress, 0

    def onQueryStarted(self, event) -> None:
        self.rows = 0

    def onQueryProgress(self, event) -> None:
        self.rows += event.progress.numInputRows
        self.progress.update("parse", self.rows)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.progress.update("parse", self.progress.total)

"""What the operators of this subpackage share."""

from __future__ import annotations

import gc
import re
import tempfile

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, as every operator here splits them: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, nothing else. A text without multi-byte characters takes the fast path."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the session names. Where none is set, a folder of our own, but only with everything on one machine."""
    named = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if named is None and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return named or tempfile.mkdtemp(prefix="lithic-checkpoints-")


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with row_key, different for each row and repeated by every read of the same files: file (by hash) and place. Rows of other sources are numbered and settled."""
    try:
        return docs.select("*", F.struct(F.xxhash64("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("r")).alias("row_key"))
    except AnalysisException:
        return settled(docs.select("*", F.struct(F.lit(0).cast("long").alias("f"), F.monotonically_increasing_id().alias("r")).alias("row_key")))


def tidied(spark: SparkSession) -> None:
    """Asks Python and the driver's heap for a collection: files of exchanges and checkpoints that nothing refers to any more go with it, and not hours later."""
    gc.collect()
    settled(spark.range(2).repartition(2))  # Spark holds on to the last exchange that was settled; now that is this one
    spark.sparkContext._jvm.System.gc()


def settled(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder: its lineage ends there, so a lost executor repeats little."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(checkpoint_dir(spark))
    return df.checkpoint()


def dealt_out(df: DataFrame, key: str) -> DataFrame:
    """``df`` partitioned by ``key`` and settled so: what is grouped by the key later needs no exchange of it.

    The adaptive planner hides a plan's partitioning from the checkpoint, so it rests meanwhile; there is no join here.
    """
    conf = df.sparkSession.conf
    before = conf.get("spark.sql.adaptive.enabled")
    conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return settled(df.repartition(int(conf.get("spark.sql.shuffle.partitions")), key))
    finally:
        conf.set("spark.sql.adaptive.enabled", before)

"""Cutting lineage in the shared checkpoint folder."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame


def settled(df: DataFrame) -> DataFrame:
    """``df`` written to the folder that spark.checkpoint.dir names. Where it is unset, to a folder of our own, but only with everything on one machine."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="lithic-checkpoints-"))
    return df.checkpoint()


def keyed(df: DataFrame) -> DataFrame:
    """``df`` as the other side of a join by key, both sides sorted. The planner takes rows parsed from texts for no larger than the compressed files they come from, and would send millions of them to every task by way of the driver."""
    return df.hint("merge")

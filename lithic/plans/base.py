"""How plans are registered: a DataFrame function over tables or histories, with a DuckDB text."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lithic.sources.checkpoints import settled

from . import histories

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def for_spark(sql: str, sf_dir: str) -> str:
    sql = sql.replace("{sha}(definition)", "sha2(definition, 256)")
    return re.sub(r"\{(\w+)\}", lambda m: f"parquet.`{sf_dir}/{m[1]}.parquet`" if m[1] in TABLES else m[0], sql)


def for_duckdb(sql: str) -> str:
    sql = sql.replace("{columns}", histories.COLUMN_LOG).replace("{log}", histories.EVENT_LOG).replace("{sha}", "sha256")
    sql = re.sub(r"listagg\((.*?), '(.*?)'\) WITHIN GROUP \(ORDER BY (.*?)\)", r"string_agg(\1, '\2' ORDER BY \3)", sql)
    return re.sub(r"\{(\w+)\}", lambda m: m[1] if m[1] in TABLES else m[0], sql)


def frame(spark: SparkSession, sf_dir: str, source: str) -> DataFrame:
    """A DataFrame of a history, a ``{table}`` or a query over tables."""
    if source in histories.SOURCES:
        return histories.SOURCES[source](spark, sf_dir)
    return spark.sql(for_spark(source if " " in source else f"SELECT * FROM {source}", sf_dir))


def once(build: Callable[[DataFrame], DataFrame], *columns: str) -> Callable[[DataFrame], DataFrame]:
    """``build`` over those columns of a log, written first: what reads a log several times has its texts parsed once."""
    return lambda log: build(settled(log.select(*columns)))


class Plans:
    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracle: dict[str, str] = {}

    def sql(self, name: str, text: str, oracle: str | None = None) -> None:
        """A SQL text over tables; the oracle is the same text unless there is one of its own."""
        self.queries[name] = lambda spark, d: spark.sql(for_spark(text, d))
        self.oracle[name] = for_duckdb(oracle or text)

    def frame(self, name: str, build: Callable[..., DataFrame], sources: tuple[str, ...] = ("{log}",), oracle: str | None = None) -> None:
        """``build`` over the DataFrames of ``sources``."""
        self.queries[name] = lambda spark, d: build(*(frame(spark, d, s) for s in sources))
        if oracle:
            self.oracle[name] = for_duckdb(oracle)

"""ANC-3, 4, 6..8. Modernised texts, checks before and after consolidation, the structure of a history, and two catalogs compared."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithic.functions import ddl
from lithic.functions.shapes import shaped
from lithic.functions.sqltext import plain, tokens
from lithic.sources import catalog
from lithic.sources.checkpoints import keyed

from . import dependencies, diff, evolution, lint

#: What modernise() may do; the last two change what a text does and are off unless they are asked for.
TRANSFORMS = ["volatility", "using", "dml_to_select", "drop_to_comment"]


def modernised(sql: str, transforms: tuple[str, ...] = ("volatility", "using")) -> str:
    """ANC-3, ANC-4. One statement with a volatility for functions that have none, a USING for changes of type, and, where asked for, DML as SELECT and DROP as a comment."""
    flat = plain(sql)
    quiet = "".join(t if k not in ("string", "dollar") else t[0] * len(t) for k, t, _ in tokens(flat))
    if "volatility" in transforms and re.match(r"CREATE (OR REPLACE )?FUNCTION\b", quiet, re.I) and not re.search(r"\b(IMMUTABLE|STABLE|VOLATILE)\b", quiet, re.I):
        if m := re.search(r"\bLANGUAGE \w+", quiet, re.I):
            return f"{flat[: m.end()]} VOLATILE{flat[m.end() :]}"
    if "using" in transforms and re.match(r"ALTER TABLE\b", quiet, re.I):
        (schema, table), todo = ddl.actions(flat)
        if any(a["kind"] == "TYPE" and not re.search(r"\bUSING\b", a["value"], re.I) for a in todo):
            made = [f"{a['text']} USING {a['name']}::{a['value']}" if a["kind"] == "TYPE" and not re.search(r"\bUSING\b", a["value"], re.I) else a["text"] for a in todo]
            return f"{flat[: ddl.ALTER.match(flat).start(2)]}{', '.join(made)}"
    if "dml_to_select" in transforms and (m := re.match(rf"(?:UPDATE|DELETE FROM) (?:ONLY )?{ddl.QUALIFIED}(.*)$", flat, re.I | re.S)):
        where = ddl.outside(m[2], r"\bWHERE\b")
        return f"SELECT count(*) FROM {m[1]}{' ' + m[2][where.start() :] if where else ''}"
    if "drop_to_comment" in transforms and re.match(r"DROP\b", quiet, re.I):
        return f"-- {flat}"
    return sql


def modernise(log: DataFrame, transforms: tuple[str, ...] = ("volatility", "using")) -> DataFrame:
    """ANC-3. (k, pos, sql) of the statements that modernised() changes, by an Arrow-batched map."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        new_text = shaped(lambda s: modernised(s, transforms))
        for batch in batches:
            old = batch.column(2).to_pylist()
            new = [new_text(s) for s in old]
            keep = pa.array([a != b for a, b in zip(old, new, strict=True)], pa.bool_())
            yield batch.set_column(2, "sql", pa.array(new, pa.string())).filter(keep)

    return log.select("k", "pos", "sql").mapInArrow(each, "k string, pos long, sql string")


def performance_warnings(log: DataFrame) -> DataFrame:
    """ANC-3. (k, pos, warning) for texts that are slow by their form."""
    upper = F.upper("sql")
    told = {"SELECT_STAR": upper.rlike(r"\bSELECT\s+\*"), "LEADING_WILDCARD": F.col("sql").rlike(r"(?i)\bI?LIKE\s+'%"), "NOT_IN_SUBQUERY": upper.rlike(r"\bNOT\s+IN\s*\(\s*SELECT\b"), "ORDER_BY_RANDOM": upper.rlike(r"\bORDER\s+BY\s+RANDOM\s*\(")}
    return log.select("k", "pos", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(w)) for w, c in told.items()]))).alias("warning"))


def structure(log: DataFrame) -> DataFrame:
    """ANC-7. (k, finding) of a history: tables without a primary key, foreign keys without an index of their own, names that need quotes or are too long, and features that a baseline can't keep."""
    keys = evolution.keys(log)
    made = log.where("op = 'CREATE' AND object_type = 'TABLE'").select("k", F.concat("schema", F.lit("."), "name").alias("full")).distinct()
    primary = keys.where("kind = 'PRIMARY'").select(F.col("table").alias("full")).distinct()
    no_key = made.join(keyed(primary), "full", "left_anti").select("k", F.lit("NO_PRIMARY_KEY").alias("finding"))
    first = lambda c: F.split(c, ",")[0]
    on = F.get("dependencies", F.lit(0))
    indexed = log.where("op = 'CREATE' AND object_type = 'INDEX'").select(
        F.when(F.contains(on, F.lit(".")), on).otherwise(F.concat(F.lit("public."), on)).alias("full"), F.lower(F.regexp_extract("sql", r'(?is)\bON\s+[^(]*\(\s*"?([\w$]+)', 1)).alias("c")
    )
    indexed = indexed.union(keys.where("kind <> 'FOREIGN'").select("table", first(F.col("columns")))).distinct()
    bare = keys.where("kind = 'FOREIGN'").select(F.col("table").alias("full"), first(F.col("columns")).alias("c")).distinct().join(keyed(indexed), ["full", "c"], "left_anti").select("full").distinct()
    no_index = bare.join(keyed(made), "full").select("k", F.lit("FOREIGN_KEY_WITHOUT_INDEX"))
    n = F.col("name")
    named = log.where("op = 'CREATE' AND object_type <> 'VERBATIM'").select("k", F.explode(F.array_compact(F.array(F.when(F.octet_length(n) > 63, "NAME_TOO_LONG"), F.when(~n.rlike(r"^[a-z_][a-z0-9_$]*$") & (n != ""), "NAME_NEEDS_QUOTES")))))
    lost = log.select("k", F.explode(F.array_compact(F.array(F.when(F.col("sql").rlike(r"(?i)\bCREATE\s+(TEMP|TEMPORARY)\b"), "TEMPORARY"), F.when(F.col("sql").rlike(r"(?i)\bUNLOGGED\b"), "UNLOGGED"), F.when(F.col("object_type") == "DO_BLOCK", "DO_BLOCK")))))
    return no_key.union(no_index).union(named).union(lost).distinct()


def before(log: DataFrame) -> DataFrame:
    """ANC-6. Pre-flight: (k, finding) that make a consolidation doubtful: statements that are not known, and uses of what is nowhere created."""
    unknown = log.where("object_type = 'VERBATIM'").select("k", F.lit("UNKNOWN_STATEMENT").alias("finding"))
    missing = dependencies.never_created(log, ("table", "sequence")).select(F.concat("full", F.lit("::"), F.upper("class")), F.lit("NEVER_CREATED"))
    return unknown.union(missing).distinct()


def after(results: DataFrame) -> DataFrame:
    """ANC-6. Post-flight: (k, finding) of consolidated texts that are empty, not sound, or drop something."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array([ddl.sound(s or "") for s in batch.column(1).to_pylist()], pa.bool_())], ["k", "sql", "ok"])

    checked = results.select("k", "sql").mapInArrow(each, "k string, sql string, ok boolean")
    drops = lint.violations(results.select(F.col("k").alias("id"), "sql"), ["BREAKING.DROP_TABLE"]).select(F.col("id").alias("k"), F.lit("DROPS").alias("finding"))
    return checked.where("NOT ok OR trim(sql) = ''").select("k", F.lit("NOT_SOUND").alias("finding")).union(drops)


def compared(spark, expected: dict[str, DataFrame], actual: dict[str, DataFrame], most: int = 250) -> DataFrame:
    """ANC-8, JN-2, SRT-4. Two catalog snapshots by the lines of their signatures: (side, line), the first ``most`` and how many more there are."""
    return diff.truncated(diff.line_difference(catalog.signature(spark, expected), catalog.signature(spark, actual), "expected", "actual"), most)

"""The statement log: one typed row per statement of a history, by an Arrow-batched map over files."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithic.functions.shapes import shaped
from lithic.functions.sqltext import classify, singles, split_statements, static_ddl, uses

from .lint import duration_class, lock_level, no_transaction, version_gate

SCHEMA = (
    "seq long, filename string, stmt_idx int, part int, line int, offset int, sql string, object_type string, operation string, schema_name string, object_name string, category string,"
    " is_data_op boolean, if_not_exists boolean, function_signature string, dependencies array<string>, grantees array<string>, privileges array<string>, comments array<string>, uses array<string>"
)
ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}


@shaped
def statements(content: str) -> list[tuple]:
    """A text's statements in the order of SCHEMA from stmt_idx on, with all that stands before one in place of its offset."""
    fields = [f.split()[0] for f in SCHEMA.split(", ")[6:]]
    out = []
    for k, s in enumerate(split_statements(content)):
        for part, one in enumerate(singles(s["sql"])):
            row = {**s, "sql": one, **classify(one), "uses": uses(one)}
            out.append((k, part, s["line"], content[: s["offset"]], *(row[f] for f in fields)))
    return out


def statement_log(files: DataFrame) -> DataFrame:
    """PRJ-1..18 over (seq, filename, content): the log with locks, transaction needs and pragmas as a metadata struct.

    A text that is null or holds no statement gives no row; a statement on a list of objects gives one for each (``part``).
    Statements that are not known are kept as VERBATIM.
    """
    names = [p.strip().split(" ", 1) for p in SCHEMA.split(",") if p.strip()]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, places = [], []
            for k, content in enumerate(batch.column(2).to_pylist()):
                found = statements(content or "")
                rows += found
                places += [k] * len(found)
            columns = list(zip(*rows, strict=True)) or [()] * (len(names) - 2)
            columns[3] = [len(before) for before in columns[3]]
            at = pa.array(places, pa.int64())
            made = [pa.array(c, ARROW[t]) for c, (_, t) in zip(columns, names[2:], strict=True)]
            yield pa.record_batch([batch.column(0).take(at).cast(pa.int64()), batch.column(1).take(at).cast(pa.string()), *made], [n for n, _ in names])

    log = files.select("seq", "filename", "content").mapInArrow(each, SCHEMA)
    upper = F.upper("sql")
    pragma = F.exists("comments", lambda c: F.lower(c).rlike(r"\b(ignore|no-merge)\b"))
    meta = F.struct(
        lock_level(upper, F.col("object_type"), F.col("operation")).alias("lock_level"), no_transaction(upper).alias("requires_no_transaction"), version_gate(upper, F.col("object_type")).alias("version_gate"),
        duration_class(upper, F.col("object_type"), F.col("operation")).alias("execution_time"), upper.contains("CONCURRENTLY").alias("concurrent"), (pragma | (F.col("object_type") == "VERBATIM")).alias("preserve_verbatim"), (F.col("if_not_exists") | upper.contains("OR REPLACE")).alias("idempotent"),
    )
    return log.withColumn("metadata", meta)


def cross_schema(log: DataFrame) -> DataFrame:
    """PRJ-9. (seq, stmt_idx, schema, name) of dependencies in another schema than the statement's."""
    parts = F.split("dependency", r"\.")
    found = log.select("seq", "stmt_idx", "schema_name", F.explode("dependencies").alias("dependency")).where(F.size(parts) > 1)
    return found.select("seq", "stmt_idx", "schema_name", parts[0].alias("schema"), parts[1].alias("name")).where("schema <> schema_name").drop("schema_name")


def naming_warnings(log: DataFrame) -> DataFrame:
    """PRJ-10. Names that are upper case, over 63 bytes, or not words."""
    n = F.col("object_name")
    told = F.array_compact(F.array(F.when(n != F.lower(n), "MIXED_CASE"), F.when(F.octet_length(n) > 63, "TOO_LONG"), F.when(~n.rlike(r"^[A-Za-z_][A-Za-z0-9_]*$"), "NEEDS_QUOTES")))
    return log.select("seq", "stmt_idx", F.explode(told).alias("warning"))


def do_block_ddl(log: DataFrame) -> DataFrame:
    """PRJ-12, CR-14, CR-15. The static DDL of every DO block, as a log of its own."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.set_column(2, "content", pa.array([";\n".join(static_ddl(s)) for s in batch.column(2).to_pylist()], pa.string()))

    blocks = log.where("object_type = 'DO_BLOCK'").select("seq", "filename", F.col("sql").alias("content"))
    return statement_log(blocks.mapInArrow(each, "seq long, filename string, content string"))


def again(log: DataFrame, rewritten: DataFrame) -> DataFrame:
    """PRJ-15. The log with some statements replaced by (seq, stmt_idx, part, sql): classified anew, with their own place, file and comments. An empty text takes its statement out."""
    key = ["seq", "stmt_idx", "part"]
    origin = log.join(rewritten.select(*key, F.col("sql").alias("new")), key, "left")
    same = origin.where("new IS NULL").drop("new")
    columns = [*key, "filename", "line", "offset", "comments"]
    other = origin.where("new <> ''").select(F.to_json(F.struct(*columns)).alias("filename"), F.lit(0).cast("long").alias("seq"), F.col("new").alias("content"))
    made = statement_log(other).withColumn("o", F.from_json("filename", log.select(*columns).schema))
    return same.unionByName(made.select([F.col(f"o.{c}").alias(c) if c in columns else F.col(c) for c in log.columns]))


def errors(log: DataFrame) -> DataFrame:
    """PRJ-18. Statements that are not known, with a severity, a category and a suggestion."""
    first = F.upper(F.regexp_extract("sql", r"^\s*(\w+)", 1))
    open_ = F.size(F.split("sql", "'")) % 2 == 0
    category = F.when(open_, "UNTERMINATED").when(first.isin("SELECT", "SHOW", "EXPLAIN"), "QUERY").when(first.isin("BEGIN", "COMMIT", "ROLLBACK", "SAVEPOINT", "SET", "RESET"), "SESSION").otherwise("UNKNOWN")
    severity = F.when(category == "UNTERMINATED", "ERROR").when(category == "UNKNOWN", "WARNING").otherwise("INFO")
    advice = F.when(category == "UNTERMINATED", "close the quote").when(category == "QUERY", "leave queries out of a history").when(category == "SESSION", "the statement has no place in a baseline").otherwise("kept verbatim; check it by hand")
    return log.where("object_type = 'VERBATIM'").select("seq", "stmt_idx", "line", severity.alias("severity"), category.alias("category"), advice.alias("suggestion"))

"""Columns, keys and types over a parsed history, and the folding of ALTERs into a CREATE."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from lithic.functions import ddl
from lithic.functions.shapes import shaped
from lithic.functions.sqltext import identifier, plain, qualified, split_list
from lithic.sources.checkpoints import keyed


def column_events(log: DataFrame) -> DataFrame:
    """AGG-9, AGG-11, AGG-18, TYP-8. (table, column, pos, action, value) of the typed log's CREATE, ALTER and DROP TABLE, by an Arrow-batched map.

    A statement's n-th action has its place, n thousandths of a step later. DROP TABLE is action GONE, of no column.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for pos, op, table, sql in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                if op == "DROP":
                    rows.append((table, "", pos * 1000, "GONE", ""))
                else:
                    rows += [(t, c, pos * 1000 + k, a, v) for k, (t, c, a, v) in enumerate(ddl.column_events(sql))]
            kinds = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.string())
            yield pa.record_batch([pa.array([r[c] for r in rows], t) for c, t in enumerate(kinds)], ["table", "column", "pos", "action", "value"])

    rows = log.where("object_type = 'TABLE' AND op IN ('CREATE', 'ALTER', 'DROP')").select("pos", "op", F.concat("schema", F.lit("."), "name").alias("table"), "sql")
    return rows.mapInArrow(each, "table string, column string, pos long, action string, value string")


def type_usage(columns: DataFrame) -> DataFrame:
    """AGG-18, TYP-8. How many columns are given each type, at first or later."""
    return columns.where("action IN ('ADD', 'TYPE')").groupBy(F.col("value").alias("type")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("table", "column").alias("columns"))


def folded(columns: bool) -> Column:
    """CR-3, with ``columns`` CR-4 and CR-5: texts of a history from its CREATE TABLE on -> the texts that are left."""

    @pandas_udf("array<string>")
    def fold(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: net_rls(ddl.fold([plain(s) for s in t], columns)))

    return fold


def net_rls(statements: list[str]) -> list[str]:
    """CR-11. Of the statements that switch row security on and off, the last that enables or disables it and the last that forces it or not; both at their places."""
    last: dict[bool, int] = {}
    for k, s in enumerate(statements):
        todo = ddl.actions(s)[1]
        if len(todo) == 1 and todo[0]["kind"] in ("ENABLE", "DISABLE", "FORCE", "NO FORCE"):
            last["FORCE" in todo[0]["kind"]] = k
    out = []
    for k, s in enumerate(statements):
        todo = ddl.actions(s)[1]
        if len(todo) == 1 and todo[0]["kind"] in ("ENABLE", "DISABLE", "FORCE", "NO FORCE") and last["FORCE" in todo[0]["kind"]] != k:
            continue
        out.append(s)
    return out


@shaped
def statement_keys(sql: str) -> list[tuple[str, str, str, str, str]]:
    """JN-5. (kind, table, columns, ref_table, ref_columns) of the keys that one statement makes; no table where it is the statement's own."""
    import re

    def of(text: str) -> tuple | None:
        if m := re.search(rf"\bFOREIGN KEY ?\(([^)]*)\) ?REFERENCES {ddl.QUALIFIED}(?: ?\(([^)]*)\))?", text, re.I):
            return "FOREIGN", "", m[1], m[2], m[3] or ""
        if m := re.search(r"\b(PRIMARY KEY|UNIQUE)(?: NULLS NOT DISTINCT)? ?\(([^)]*)\)", text, re.I):
            return "PRIMARY" if m[1].upper() != "UNIQUE" else "UNIQUE", "", m[2], "", ""
        return None

    found = []
    if made := ddl.parse_create(sql):
        for e in made.elements:
            if e.kind == "constraint":
                found.append(of(e.text))
            elif e.kind == "column":
                if m := re.search(rf"\bREFERENCES {ddl.QUALIFIED}(?: ?\(([^)]*)\))?", e.text, re.I):
                    found.append(("FOREIGN", "", e.name, m[1], m[2] or ""))
                if m := ddl.outside(e.text, r"\b(PRIMARY KEY|UNIQUE)\b"):
                    found.append(("PRIMARY" if m[1].upper() != "UNIQUE" else "UNIQUE", "", e.name, "", ""))
    elif m := re.match(rf"CREATE UNIQUE INDEX .*?\bON (?:ONLY )?{ddl.QUALIFIED}(?: USING \w+)? ?\(([^()]*)\)$", plain(sql), re.I):
        schema, name = qualified(m[1])
        found.append(("UNIQUE", f"{schema or 'public'}.{name}", m[2], "", ""))
    else:
        found += [of(a["text"]) for a in ddl.actions(sql)[1] if a["kind"] == "ADD_CONSTRAINT"]
    names = lambda x: ",".join(identifier(c) for c in split_list(x))
    full = lambda x: "{}.{}".format(*(p or "public" for p in qualified(x))) if x else ""
    return [(kind, t, names(cols), full(ref), names(ref_cols)) for kind, t, cols, ref, ref_cols in filter(None, found)]


def keys(log: DataFrame) -> DataFrame:
    """JN-5. (kind, table, columns, ref_table, ref_columns, pos) of foreign keys, unique constraints, primary keys and unique indexes; columns in order, joined by commas."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for pos, table, sql in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                rows += [(kind, t or table, *names, pos) for kind, t, *names in statement_keys(sql)]
            kinds = (*[pa.string()] * 5, pa.int64())
            yield pa.record_batch([pa.array([r[c] for r in rows], t) for c, t in enumerate(kinds)], ["kind", "table", "columns", "ref_table", "ref_columns", "pos"])

    some = log.where("object_type IN ('TABLE', 'INDEX') AND op IN ('CREATE', 'ALTER')").select("pos", F.concat("schema", F.lit("."), "name").alias("table"), "sql")
    return some.mapInArrow(each, "kind string, table string, columns string, ref_table string, ref_columns string, pos long")


def unique_targets(all_keys: DataFrame) -> DataFrame:
    """JN-5. Every foreign key (table, columns, ref_table, ref_columns) with the number of keys and unique indexes of the table it names on the same columns, in any order.

    A foreign key without columns names the primary key, which always fits.
    """
    ordered = lambda c: F.array_join(F.array_sort(F.split(c, ",")), ",")
    fks = all_keys.where("kind = 'FOREIGN'").select("table", "columns", "ref_table", "ref_columns").distinct()
    unique = all_keys.where("kind <> 'FOREIGN'").select(F.col("table").alias("u"), ordered(F.col("columns")).alias("uc"), "kind").distinct()
    fits = (F.col("ref_table") == F.col("u")) & F.when(F.col("ref_columns") == "", F.col("kind") == "PRIMARY").otherwise(ordered(F.col("ref_columns")) == F.col("uc"))
    return fks.join(keyed(unique), fits, "left").groupBy("table", "columns", "ref_table", "ref_columns").agg(F.count("u").alias("targets"))


def enums(log: DataFrame) -> DataFrame:
    """AGG-10, TYP-6. (k, schema, name, pos, labels) of the enums that exist in the end, their labels in order of creation."""
    made = log.where("op = 'CREATE' AND object_type = 'ENUM'").select("k", "schema", "name", "pos", F.regexp_extract_all("sql", F.lit(r"'((?:[^']|'')*)'"), 1).alias("labels"))
    ends = log.where("object_type IN ('ENUM', 'TYPE') AND op IN ('CREATE', 'DROP')").groupBy(F.col("k").alias("e")).agg(F.max("pos").alias("end"))
    return made.join(keyed(ends), (F.col("k") == F.col("e")) & (F.col("pos") == F.col("end"))).select("k", "schema", "name", "pos", "labels")


def enum_alters(log: DataFrame) -> DataFrame:
    """AGG-10. (k, pos, kind, label, anchor) of ADD VALUE and RENAME VALUE, as enum_fold reads them."""
    text = lambda k: F.replace(F.regexp_extract("sql", ENUM_ALTER, k), F.lit("''"), F.lit("'"))
    rows = log.where("op = 'ALTER' AND object_type IN ('ENUM', 'TYPE')").where(F.col("sql").rlike(ENUM_ALTER))
    rename = F.upper(F.regexp_extract("sql", ENUM_ALTER, 1)) == "RENAME"
    kind = F.when(rename, "RENAME").when(F.upper(text(3)) == "", "ADD").otherwise(F.upper(text(3)))
    return rows.select("k", "pos", kind.alias("kind"), F.when(rename, text(4)).otherwise(text(2)).alias("label"), F.when(rename, text(2)).otherwise(text(4)).alias("anchor"))


ENUM_ALTER = r"(?i)\b(ADD|RENAME)\s+VALUE\s+(?:IF\s+NOT\s+EXISTS\s+)?'((?:[^']|'')*)'(?:\s+(BEFORE|AFTER|TO)\s+'((?:[^']|'')*)')?"


def similar_enums(found: DataFrame) -> DataFrame:
    """JN-6, CR-8. Pairs (schema, kept, merged) of enums of one schema with the same labels and like names: equal, one the other's beginning, or equal without _enum, _type or _status.

    The one without such an ending is kept, else the first by name. Enums meet by schema and labels only; no pairs of others are made.
    """
    stem = lambda c: F.regexp_replace(c, "_(enum|type|status)$", "")
    rows = found.select("schema", "name", F.array_join("labels", "\x1f").alias("labels"), (stem(F.col("name")) != F.col("name")).alias("suffixed"))
    o = rows.select(F.col("schema").alias("s2"), F.col("labels").alias("l2"), F.col("name").alias("o"), F.col("suffixed").alias("os"))
    pair = rows.join(o, (F.col("schema") == F.col("s2")) & (F.col("labels") == F.col("l2")) & (F.struct("suffixed", "name") < F.struct("os", "o")))
    like = F.startswith("o", F.col("name")) | F.startswith("name", F.col("o")) | (stem(F.col("name")) == stem(F.col("o")))
    return pair.where(like).select("schema", F.col("name").alias("kept"), F.col("o").alias("merged"))


#: CR-8. What each level of safety does with similar enums.
ENUM_BEHAVIOUR = {"paranoid": "keep", "conservative": "report", "standard": "merge if labels are only added", "aggressive": "merge"}


def merged_enums(log: DataFrame, level: str = "standard") -> DataFrame:
    """CR-8. (schema, kept, merged, done) under one of the four behaviours: whether the second type is replaced by the first."""
    behaviour = ENUM_BEHAVIOUR[level]
    if behaviour == "keep":
        return similar_enums(enums(log).limit(0)).withColumn("done", F.lit(False))
    changed = enum_alters(log).where("kind <> 'ADD'").select(F.split(F.split("k", "::")[0], r"\.")[0].alias("schema"), F.split(F.split("k", "::")[0], r"\.")[1].alias("name")).distinct()
    pairs = similar_enums(enums(log))
    for c in ("kept", "merged"):
        pairs = pairs.join(changed.select("schema", F.col("name").alias(c), F.lit(True).alias(f"{c}_changed")), ["schema", c], "left")
    safe = F.coalesce("kept_changed", F.lit(False)) | F.coalesce("merged_changed", F.lit(False))
    done = {"report": F.lit(False), "merge": F.lit(True)}.get(behaviour, ~safe)
    return pairs.select("schema", "kept", "merged", done.alias("done"))


def valid_enum_value(value: Column, labels: Column) -> Column:
    """TYP-6. Whether a value is one of an enum's labels."""
    return F.array_contains(labels, value)


def composites(log: DataFrame) -> DataFrame:
    """TYP-6, NM-8. (k, attribute, type, place) of composite types that the log creates."""
    body = F.regexp_extract("sql", r"(?is)^CREATE\s+TYPE\s+\S+\s+AS\s*\((.*)\)\s*;?\s*$", 1)
    rows = log.where("op = 'CREATE' AND object_type = 'TYPE'").select("k", F.posexplode(F.split(body, r",(?![^(]*\))")).alias("place", "part")).where(F.trim("part") != "")
    return rows.select("k", F.regexp_extract(F.lower(F.trim("part")), r"^(\S+)", 1).alias("attribute"), F.trim(F.regexp_replace(F.lower(F.trim("part")), r"^\S+\s+", "")).alias("type"), F.col("place").cast("long").alias("place"))

"""What statements use and what provides it: edges between objects, what is never created, what is dropped for good and what depends on it."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithic.functions.ddl import actions, outside, without_references
from lithic.functions.shapes import shaped
from lithic.sources.checkpoints import keyed, settled

KEY = ["seq", "stmt_idx", "part"]
#: The kinds of objects that provide what a statement uses as a table, type, function or sequence.
PROVIDERS = {
    "table": ["TABLE", "VIEW", "MATERIALIZED_VIEW", "FOREIGN_TABLE"],
    "type": ["TYPE", "ENUM", "DOMAIN", "TABLE"],
    "function": ["FUNCTION", "PROCEDURE", "AGGREGATE"],
    "sequence": ["SEQUENCE"],
}
#: Kinds of objects that go with a table that they belong to or read.
DEPENDENT = ["INDEX", "TRIGGER", "POLICY", "RULE", "VIEW", "MATERIALIZED_VIEW"]
#: Schemas of platforms, whose objects a history may use without creating them.
PLATFORM = ["auth", "storage", "realtime", "pg_catalog", "information_schema", "extensions", "vault"]


def uses(log: DataFrame) -> DataFrame:
    """GR-11..13, JN-4. From the typed log, a row (k, object_type, seq, stmt_idx, part, pos, class, ref, full) for everything that a statement uses; ``full`` has a schema, public where none is named."""
    use = F.split("use", ":")
    rows = log.select("k", "object_type", *KEY, "pos", F.explode("uses").alias("use")).select("k", "object_type", *KEY, "pos", use[0].alias("class"), use[1].alias("ref"))
    return rows.withColumn("full", F.when(F.contains("ref", F.lit(".")), F.col("ref")).otherwise(F.concat(F.lit("public."), "ref")))


def provisions(log: DataFrame) -> DataFrame:
    """Everything that is created: (dst, class, full, name), once for each class in which it can be used."""
    classes = F.array_compact(F.array(*[F.when(F.col("object_type").isin(kinds), F.lit(c)) for c, kinds in PROVIDERS.items()]))
    made = log.where("op = 'CREATE'").select("k", "object_type", "schema", "name").distinct()
    return made.select(F.col("k").alias("dst"), F.explode(classes).alias("class"), F.concat("schema", F.lit("."), "name").alias("full"), "name")


def matches(log: DataFrame) -> DataFrame:
    """JN-4. Every use with the object that provides it: by schema and name first, else by the bare name where no schema is named."""
    used, made = uses(log), provisions(log)
    exact = used.join(keyed(made.drop("name")), ["class", "full"])
    rest = used.where(~F.contains("ref", F.lit("."))).join(keyed(made.select("class", "full").distinct()), ["class", "full"], "left_anti")
    bare = rest.join(keyed(made.select("class", F.col("name").alias("ref"), "dst")), ["class", "ref"])
    columns = ["k", "object_type", *KEY, "pos", "class", "ref", "dst"]
    return exact.select(columns).union(bare.select(columns)).where("k <> dst")


def edges(log: DataFrame) -> DataFrame:
    """GR-5, GR-11. Distinct (src, dst): src uses what dst provides."""
    return matches(log).select(F.col("k").alias("src"), "dst").distinct()


def never_created(log: DataFrame, classes: tuple[str, ...] = ("table",)) -> DataFrame:
    """JN-11, FLT-6. (class, full) of what is used and nowhere created; platform schemas are left out."""
    used = uses(log).where(F.col("class").isin(*classes)).select("class", "full", "ref").distinct()
    made = provisions(log)
    rest = used.join(keyed(made.select("class", "full").distinct()), ["class", "full"], "left_anti")
    rest = rest.join(keyed(made.select("class", F.col("name").alias("ref")).distinct()), ["class", "ref"], "left_anti")
    return rest.where(~F.split("full", r"\.")[0].isin(PLATFORM)).select("class", "full").distinct()


def dropped(log: DataFrame) -> DataFrame:
    """FLT-3. (k, full, gone_at) of tables, foreign tables and views whose last CREATE or DROP is a DROP, and of the views that read them, to any depth."""
    ends = log.where(F.col("op").isin("CREATE", "DROP") & F.col("object_type").isin(PROVIDERS["table"]))
    ends = ends.groupBy("k").agg(F.max_by("op", "pos").alias("op"), F.max("pos").alias("gone_at"), F.first(F.concat("schema", F.lit("."), "name")).alias("full"))
    gone = settled(ends.where("op = 'DROP'").select("k", "full", "gone_at"))
    readers = settled(uses(log).where("class = 'table' AND object_type IN ('VIEW', 'MATERIALIZED_VIEW')").select("k", "pos", F.col("full").alias("reads")))
    names = log.where("op = 'CREATE'").select(F.col("k").alias("v"), F.concat("schema", F.lit("."), "name").alias("view")).distinct()
    fresh = gone
    while True:  # a round for each level of views upon views
        hit = readers.join(keyed(fresh.select("full", "gone_at")), (F.col("reads") == F.col("full")) & (F.col("pos") < F.col("gone_at"))).groupBy("k").agg(F.max("gone_at").alias("gone_at"))
        hit = hit.join(keyed(names), F.col("k") == F.col("v")).select("k", F.col("view").alias("full"), "gone_at")
        fresh = settled(hit.join(keyed(gone.select("k")), "k", "left_anti"))
        if fresh.isEmpty():
            return gone
        gone = settled(gone.union(fresh))


def without_dropped(log: DataFrame, gone: DataFrame | None = None) -> DataFrame:
    """FLT-3. The typed log without the statements on dropped tables and views, and on what belongs to them, up to the drop."""
    gone = dropped(log) if gone is None else gone
    ends = gone.select(F.col("k").alias("g"), "gone_at")
    own = log.join(keyed(ends), (F.col("k") == F.col("g")) & (F.col("pos") <= F.col("gone_at")), "left_anti")
    used = uses(own).where(F.col("object_type").isin(DEPENDENT) & (F.col("class") == "table")).select("k", "pos", "full")
    bound = used.join(keyed(gone.select(F.col("full").alias("f"), "gone_at")), (F.col("full") == F.col("f")) & (F.col("pos") < F.col("gone_at")))
    bound = bound.groupBy(F.col("k").alias("b")).agg(F.max("gone_at").alias("until"))
    return own.join(keyed(bound), (F.col("k") == F.col("b")) & (F.col("pos") <= F.col("until")), "left_anti")


def without_dropped_references(log: DataFrame, gone: DataFrame | None = None) -> DataFrame:
    """FLT-5. The typed log with no foreign key to a dropped table, nor the DROP CONSTRAINT of one; a statement without anything left goes."""
    gone = dropped(log) if gone is None else gone
    used = uses(log).where("class = 'table' AND object_type = 'TABLE'")
    hit = used.join(keyed(gone.select(F.col("full").alias("f"), "gone_at")), (F.col("full") == F.col("f")) & (F.col("pos") < F.col("gone_at")))
    hit = hit.groupBy(*KEY).agg(F.collect_set("full").alias("gone"))  # as many as one statement's foreign keys

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [freed(f"{sql}\x1e{'\x1f'.join(sorted(names))}") for sql, names in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)]
            new, lost = [n for n, _ in both], [x for _, x in both]
            yield pa.record_batch([*batch.columns[:3], pa.array(new, pa.string()), pa.array(lost, pa.list_(pa.string()))], [*KEY, "new", "lost"])

    changed = settled(log.select(*KEY, "sql").join(keyed(hit), KEY).mapInArrow(each, "seq long, stmt_idx int, part int, new string, lost array<string>"))
    names = log.join(keyed(changed), KEY).select(F.col("k").alias("lk"), F.col("pos").alias("lost_at"), F.explode("lost").alias("constraint"))
    gone_name = F.lower(F.regexp_extract("sql", r'(?i)^\s*ALTER\s+TABLE\s.*\sDROP\s+CONSTRAINT\s+(?:IF\s+EXISTS\s+)?"?([\w$]+)"?(?:\s+(?:CASCADE|RESTRICT))?\s*;?\s*$', 1))
    kept = log.join(keyed(changed.select(*KEY, "new")), KEY, "left").where("new IS NULL OR new <> ''").withColumn("sql", F.coalesce("new", "sql")).drop("new")
    return kept.join(keyed(names), (F.col("k") == F.col("lk")) & (F.col("pos") > F.col("lost_at")) & (gone_name == F.col("constraint")), "left_anti").select(log.columns)


@shaped
def freed(text: str) -> tuple[str, list[str]]:
    """FLT-5. Of a statement and, behind it, the names of dropped tables: the statement without foreign keys to these, and the constraints that it loses."""
    sql, _, names = text.rpartition("\x1e")
    new = without_references(sql, set(names.split("\x1f")))
    return new, lost_constraints(sql, new)


def lost_constraints(before: str, after: str) -> list[str]:
    """Names of the constraints that one text has and the other has not."""
    import re

    name = r"\b(?:CONSTRAINT|ADD CONSTRAINT) \"?([A-Za-z_][\w$]*)\"?"
    return sorted({x.lower() for x in re.findall(name, before, re.I)} - {x.lower() for x in re.findall(name, after, re.I)})


def without_orphans(log: DataFrame) -> DataFrame:
    """FLT-4. The typed log without statements on functions and procedures that it never creates."""
    made = log.where("op = 'CREATE'").select(F.col("k").alias("made")).distinct()
    routine = F.col("object_type").isin("FUNCTION", "PROCEDURE")
    return log.where(~routine).union(log.where(routine).join(keyed(made), F.col("k") == F.col("made"), "left_semi"))


def privilege_owned(sql: Column, op: Column, object_type: Column) -> Column:
    """FLT-2. Whether a statement is about roles, owners and privileges, which a baseline keeps in sections of their own."""
    return op.isin("GRANT", "REVOKE") | (object_type == "ROLE") | F.upper(sql).rlike(r"^\s*(ALTER\s+DEFAULT\s+PRIVILEGES|SET\s+(LOCAL\s+|SESSION\s+)?(ROLE|SESSION\s+AUTHORIZATION)|REASSIGN\s+OWNED)|\bOWNER\s+TO\b")


def orphaned_indexes(log: DataFrame, columns: DataFrame) -> DataFrame:
    """JN-10. Indexes (k, column) that mention a column of their table which is dropped after them. ``columns``: events (table, column, pos, action)."""
    made = log.where("op = 'CREATE' AND object_type = 'INDEX'").select("k", "pos", F.get("dependencies", F.lit(0)).alias("on"), F.regexp_extract("sql", r"(?is)\bON\s+[^(]*\((.*)\)", 1).alias("list"))
    made = made.select("k", "pos", F.when(F.contains("on", F.lit(".")), F.col("on")).otherwise(F.concat(F.lit("public."), "on")).alias("on"), F.explode(F.regexp_extract_all(F.lower("list"), F.lit(r"([a-z_][a-z0-9_$]*)"), 1)).alias("word"))
    gone = columns.where("action = 'DROP'").select("table", "column", F.col("pos").alias("gone_at"))
    return made.join(keyed(gone), (F.col("on") == F.col("table")) & (F.col("word") == F.col("column")) & (F.col("pos") < F.col("gone_at"))).select("k", "column").distinct()


@shaped
def constraint_actions(sql: str) -> list[tuple[str, str]]:
    """WIN-4. (kind, name) of the constraints that an ALTER TABLE adds NOT VALID, validates or drops."""
    return [(a["kind"], a["name"]) for a in actions(sql)[1] if a["kind"] in ("VALIDATE", "DROP_CONSTRAINT") or a["kind"] == "ADD_CONSTRAINT" and outside(a["text"], r"\bNOT VALID\b")]


def constraint_events(log: DataFrame) -> DataFrame:
    """WIN-4. (k, pos, action, name) of constraints added NOT VALID, validated and dropped, and of dropped tables."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, pos, op, sql in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                if op == "DROP":
                    rows.append((k, pos, "DROP_TABLE", None))
                rows += [(k, pos, kind, name) for kind, name in constraint_actions(sql)] if op == "ALTER" else []
            yield pa.record_batch([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.string(), pa.int64(), pa.string(), pa.string()))], ["k", "pos", "action", "name"])

    return log.where("object_type = 'TABLE' AND op IN ('ALTER', 'DROP')").select("k", "pos", "op", "sql").mapInArrow(each, "k string, pos long, action string, name string")


def pending_constraints(events: DataFrame) -> DataFrame:
    """WIN-4, LNT-9. (k, name, pos) of constraints that are NOT VALID in the end: neither validated nor dropped, their table neither."""
    gone = events.where("action = 'DROP_TABLE'").groupBy(F.col("k").alias("g")).agg(F.max("pos").alias("gone_at"))
    last = events.where("name IS NOT NULL").groupBy("k", "name").agg(F.max_by("action", "pos").alias("action"), F.max("pos").alias("pos"))
    return last.where("action = 'ADD_CONSTRAINT'").join(keyed(gone), F.col("k") == F.col("g"), "left").where("gone_at IS NULL OR gone_at < pos").select("k", "name", "pos")

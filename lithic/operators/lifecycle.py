"""Keyed folds over the ordered log (k, pos, op, ...): histories, final states, redundancy, permissions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lithic.sources.checkpoints import keyed

#: Fixed value: risk levels from low to high.
RISKS = ["LOW", "MEDIUM", "HIGH", "CRITICAL"]


@dataclass
class RiskRule:
    """UDF-6. A level and when it holds of a statement of the typed log."""

    name: str
    level: str
    when: Callable[[], Column]


#: What a statement risks; the highest level that holds counts.
RISK_RULES = [
    RiskRule("data loss", "HIGH", lambda: F.col("op") == "DROP"),
    RiskRule("data loss", "MEDIUM", lambda: (F.col("op") == "ALTER") & F.col("is_data")),
    RiskRule("other schemas", "MEDIUM", lambda: F.exists("dependencies", lambda d: F.contains(d, F.lit(".")))),
    RiskRule("production use", "MEDIUM", lambda: F.col("object_type").isin("TABLE", "VIEW")),
    RiskRule("constraints", "HIGH", lambda: (F.col("object_type") == "CONSTRAINT") & (F.col("op") == "DROP")),
    RiskRule("permissions", "MEDIUM", lambda: F.col("op") == "REVOKE"),
]


def risk(rules: list[RiskRule] = RISK_RULES) -> Column:
    """AGG-6. The highest level of the rules that hold, LOW without any."""
    out = F
    for level in reversed(RISKS[1:]):
        fits = [F.coalesce(r.when(), F.lit(False)) for r in rules if r.level == level]
        if fits:
            out = out.when(reduce(Column.__or__, fits), F.lit(level))
    return out.otherwise("LOW") if out is not F else F.lit("LOW")


def typed(log: DataFrame, rules: list[RiskRule] = RISK_RULES) -> DataFrame:
    """The statement log as the operators here read it: object k, place pos, operation op, and what each statement is and does.

    An object is known by schema (public where none is named), name, arguments and kind; what belongs to a table, by the table too.
    """
    own = F.col("object_type").isin("INDEX", "TRIGGER", "POLICY", "RULE") & (F.size("dependencies") > 0)
    table = F.split(F.get("dependencies", F.lit(0)), r"\.")
    schema = F.coalesce(F.nullif(F.col("schema_name"), F.lit("")), F.when(own & (F.size(table) > 1), F.get(table, F.lit(0))), F.lit("public"))
    kind = F.when(F.col("object_type") == "ENUM", "TYPE").otherwise(F.col("object_type"))
    alone = F.col("object_type").isin("SCHEMA", "EXTENSION", "ROLE", "PUBLICATION")  # these lie in no schema
    schema = F.when(F.col("object_type") == "SCHEMA", F.lower("object_name")).when(alone, "").otherwise(schema)
    prefix = F.when(alone, "").otherwise(F.concat(schema, F.lit(".")))
    within = F.when(F.col("object_type").isin("TRIGGER", "POLICY", "RULE") & own, F.concat(F.element_at(table, -1), F.lit("."))).otherwise("")
    out = log.select(
        F.concat(prefix, within, F.lower("object_name"), "function_signature", F.lit("::"), kind).alias("k"),
        schema.alias("schema"), F.lower("object_name").alias("name"), "object_type", (F.col("seq") * 1024 + F.col("stmt_idx") * 16 + F.col("part")).alias("pos"), F.col("filename").alias("file"), F.col("operation").alias("op"),
        "is_data_op", "dependencies", "uses", "grantees", "privileges", "category", "sql", "if_not_exists", F.col("metadata.lock_level").alias("lock"), F.col("metadata.requires_no_transaction").alias("no_txn"), F.col("metadata.execution_time").alias("duration"),
        "seq", "stmt_idx", "part", "function_signature",
    ).withColumnRenamed("is_data_op", "is_data")
    return out.withColumn("risk", risk(rules))


def permissions(typed_log: DataFrame) -> DataFrame:
    """A row (k, pos, op, grantee, privilege, option) for each grantee and privilege of a GRANT or REVOKE, and one without for CREATE and DROP."""
    given = typed_log.where(F.col("op").isin("GRANT", "REVOKE")).select("k", "pos", "op", F.upper("sql").alias("u"), "grantees", F.explode("privileges").alias("privilege"))
    given = given.select("k", "pos", "op", F.explode("grantees").alias("grantee"), "privilege", F.col("u").rlike(r"WITH GRANT OPTION\s*$|^REVOKE\s+GRANT OPTION FOR").alias("option"))
    none = lambda t: F.lit(None).cast(t)
    return given.union(typed_log.where(F.col("op").isin("CREATE", "DROP")).select("k", "pos", "op", none("string"), none("string"), F.lit(False)))


def at(op: str) -> Column:
    return F.col("op") == op


def histories(log: DataFrame) -> DataFrame:
    """AGG-1. One row per object: its operations in order, how many, first and last place."""
    events = F.sort_array(F.collect_list(F.struct("pos", "op")))
    out = log.groupBy("k", "object_type").agg(events.alias("events"))
    return out.select("k", "object_type", F.size("events").cast("long").alias("n"), F.array_join(F.col("events.op"), ">").alias("ops"), F.col("events")[0]["pos"].alias("first_pos"), F.element_at("events", -1)["pos"].alias("last_pos"))


def final_states(log: DataFrame) -> DataFrame:
    """AGG-2. The place of the statement that defines each object at the end; objects that are gone have no row.

    A table that does not end in DROP is its last CREATE. Anything else is its last statement other than GRANT, REVOKE and COMMENT, unless that is a DROP.
    """
    defining = ~F.col("op").isin("GRANT", "REVOKE", "COMMENT")
    ends = log.groupBy("k", "object_type").agg(
        F.max_by("op", "pos").alias("last_op"),
        F.max(F.when(at("CREATE"), F.col("pos"))).alias("last_create"),
        F.max(F.when(defining, F.col("pos"))).alias("last_def"),
        F.max_by("op", F.when(defining, F.col("pos"))).alias("last_def_op"),
    )
    table = (F.col("object_type") == "TABLE") & F.col("last_create").isNotNull()
    final = F.when(F.col("object_type").eqNullSafe("TABLE") & (F.col("last_op") == "DROP"), None).when(table, F.col("last_create")).when(F.col("last_def_op") != "DROP", F.col("last_def"))
    return ends.select("k", "object_type", final.alias("final_pos")).where("final_pos IS NOT NULL")


def distinct_alters(log: DataFrame, text: str = "sql") -> DataFrame:
    """AGG-3. Each object's different ALTER texts, in the order of their first use."""
    first = log.where(at("ALTER")).groupBy("k", F.col(text).alias("text")).agg(F.min("pos").alias("pos"))
    return first.select("k", "pos", F.row_number().over(Window.partitionBy("k").orderBy("pos")).cast("long").alias("n"))


def redundancy(log: DataFrame) -> DataFrame:
    """AGG-4. The first redundancy pattern that fits each object with two statements or more, and what it saves."""
    w = Window.partitionBy("k").orderBy("pos")
    seen = log.select("*", F.lead("op").over(w).alias("next_op"), (F.row_number().over(w) == 1).alias("is_first"))
    later = ~F.col("is_first")
    counts = seen.groupBy("k").agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.when(F.col("is_first"), F.col("op"))).alias("first_op"),
        F.count_if(later & at("ALTER")).alias("alters"),
        F.count_distinct(F.when(later & at("ALTER"), F.col("file"))).alias("alter_files"),
        F.bool_or(later & F.col("is_data")).alias("data"),
        F.count_if(at("DROP") & F.col("next_op").eqNullSafe("CREATE")).alias("pairs"),
        F.count_if(at("CREATE")).alias("creates"),
    )
    kinds = {
        "CREATE_ALTER_SEQUENCE": ((F.col("first_op") == "CREATE") & (F.col("alters") > 0) & ~F.col("data"), F.col("alters"), F.col("alter_files"), F.col("alters") * 2),
        "DROP_CREATE_SEQUENCE": (F.col("pairs") > 0, F.lit(1), F.lit(2), F.lit(3)),
        "DUPLICATE_OPERATIONS": (F.col("creates") > 1, F.col("creates") - 1, F.col("creates"), (F.col("creates") - 1) * 5),
    }

    def pick(k: int) -> Column:
        out = F
        for name, x in kinds.items():
            out = out.when(x[0], F.lit(name) if k == 0 else x[k].cast("long"))
        return out

    out = counts.where("n > 1").select("k", *[pick(k).alias(n) for k, n in enumerate(("pattern", "statements_reduced", "files_affected", "lines_reduced"))])
    return out.where("pattern IS NOT NULL")


def highest_risk(log: DataFrame) -> DataFrame:
    """AGG-6. By an explicit order of the levels, not by their names."""
    rank = F.array_position(F.array(*map(F.lit, RISKS)), F.col("risk"))
    return log.groupBy("k").agg(F.max_by("risk", rank).alias("risk"), F.max(rank).cast("long").alias("risk_rank"))


def net_permissions(given: DataFrame) -> DataFrame:
    """AGG-8. Of permissions(): what is granted and not taken back later: (k, grantee, privilege, pos). CREATE and DROP take back all before them."""
    reset = given.where(F.col("op").isin("CREATE", "DROP")).groupBy("k").agg(F.max("pos").alias("reset"))
    last = given.where(F.col("op").isin("GRANT", "REVOKE")).groupBy("k", "grantee", "privilege").agg(F.max("pos").alias("pos"), F.max_by("op", "pos").alias("op"))
    return last.join(keyed(reset), "k", "left").where(at("GRANT") & (F.col("reset").isNull() | (F.col("pos") > F.col("reset")))).select("k", "grantee", "privilege", "pos")


def history_positions(log: DataFrame) -> DataFrame:
    """WIN-2. The place that orders an object in the result: its last CREATE, else its first statement."""
    return log.groupBy("k").agg(F.coalesce(F.max(F.when(at("CREATE"), F.col("pos"))), F.min("pos")).alias("position"))


def type_changes(columns: DataFrame) -> DataFrame:
    """AGG-18, WIN-5. Of column events (table, column, pos, action, value): changes of a column's type (table, column, pos, old_type, new_type). What comes after a DROP begins anew."""
    w = Window.partitionBy("table", "column").orderBy("pos")
    kept = columns.where(F.col("action").isin("ADD", "TYPE", "DROP")).select("table", "column", "pos", F.when(F.col("action") != "DROP", F.col("value")).alias("type"))
    return kept.select("table", "column", "pos", F.lag("type").over(w).alias("old_type"), F.col("type").alias("new_type")).where("old_type <> new_type")


def statistics(log: DataFrame) -> DataFrame:
    """AGG-5. (dimension, value, statements, objects): counts by kind of object, category, operation and change, and of the whole; by partial aggregation."""
    change = F.when(F.col("op").isin("CREATE", "DROP"), F.col("op")).when(F.col("op").isin("GRANT", "REVOKE"), "PERMISSION").when(F.col("is_data"), "DATA").otherwise("ALTER")
    rows = log.select("k", F.explode(F.create_map(F.lit("type"), "object_type", F.lit("category"), "category", F.lit("operation"), "op", F.lit("change"), change, F.lit("all"), F.lit(""))).alias("dimension", "value"))
    return rows.groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("statements"), F.count_distinct("k").alias("objects"))


def create_conflicts(log: DataFrame) -> DataFrame:
    """AGG-7. Whether an object is created more than once, and whether it has data."""
    return log.groupBy("k").agg((F.count_if(at("CREATE")) > 1).alias("conflict"), F.bool_or("is_data").alias("has_data"))


def drop_create_pairs(log: DataFrame) -> DataFrame:
    """WIN-1. (k, pos, next_pos) of a DROP whose object's next statement is a CREATE."""
    w = Window.partitionBy("k").orderBy("pos")
    seen = log.select("k", "pos", "op", F.lead("op").over(w).alias("next_op"), F.lead("pos").over(w).alias("next_pos"))
    return seen.where("op = 'DROP' AND next_op = 'CREATE'").select("k", "pos", "next_pos")


def data_concat(log: DataFrame) -> DataFrame:
    """AGG-13. Each object's data statements in history order, as one text."""
    texts = F.transform(F.sort_array(F.collect_list(F.struct("pos", "sql"))), lambda e: F.concat(F.rtrim(e["sql"], F.lit("; ")), F.lit(";")))
    return log.where("is_data").groupBy("k").agg(F.array_join(texts, "\n").alias("sql"))


def last_insert(log: DataFrame) -> DataFrame:
    """JN-9. For every statement of an object that is no INSERT, the place of the latest INSERT before it, or null."""
    before = Window.partitionBy("k").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return log.select("k", "pos", "op", F.max(F.when(at("INSERT"), F.col("pos"))).over(before).alias("last_insert")).where("op <> 'INSERT'")


def warning_counts(warnings: DataFrame) -> DataFrame:
    """AGG-16. Warnings (severity, category, message), each counted once by hash: how many of a severity and category."""
    once = warnings.select("severity", "category", F.sha2(F.concat_ws("\x1f", "severity", "category", "message"), 256).alias("h")).distinct()
    return once.groupBy("severity", "category").agg(F.count(F.lit(1)).alias("n"))


def validation_metrics(runs: DataFrame) -> DataFrame:
    """AGG-17. Of runs (file, seconds, ok): how many, how many went well, the mean and the longest, and the share that went well in percent."""
    ok = F.count_if("ok")
    return runs.groupBy("file").agg(
        F.count(F.lit(1)).alias("total"), ok.alias("succeeded"), F.round(F.avg("seconds"), 6).alias("mean"), F.max("seconds").alias("longest"), F.round(100.0 * ok / F.count(F.lit(1)), 6).alias("success_rate")
    )


def compacted(log: DataFrame, threshold: int = 100) -> DataFrame:
    """AGG-14. The log with histories of more than ``threshold`` statements cut to their first and last, as under memory pressure. Lossy: nothing here asks for it."""
    ends = log.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"), F.max("pos").alias("last"))
    return log.join(keyed(ends), "k").where((F.col("n") <= threshold) | F.col("pos").isin(F.col("first"), F.col("last"))).select(log.columns)


def ddl_cycles(log: DataFrame) -> DataFrame:
    """GR-10. Each object's family of cycle, how grave it is, and whether it can be optimised away.

    complex: created and dropped more than once; transient: created and dropped, never altered; simple: dropped; versioning:
    created more than once; constraint: constraints added and dropped; none.
    """
    n = lambda c: F.count_if(c)
    upper = F.upper("sql")
    counts = log.groupBy("k").agg(
        n(at("CREATE")).alias("creates"), n(at("DROP")).alias("drops"), n(at("ALTER")).alias("alters"), n(F.col("op").isin("GRANT", "REVOKE")).alias("grants"),
        n(at("ALTER") & upper.rlike(r"\bADD CONSTRAINT\b")).alias("added"), n(at("ALTER") & upper.rlike(r"\bDROP CONSTRAINT\b")).alias("removed"),
    )
    c, d = F.col("creates"), F.col("drops")
    kind = F.when((c > 1) & (d > 1), "complex").when((c > 0) & (d > 0) & (F.col("alters") == 0), "transient").when(d > 0, "simple").when(c > 1, "versioning").when((F.col("added") > 0) & (F.col("removed") > 0), "constraint").otherwise("none")
    severity = F.when(F.col("kind") == "complex", "HIGH").when(F.col("kind").isin("transient", "simple", "constraint"), "MEDIUM").otherwise("LOW")
    return counts.withColumn("kind", kind).select("k", "kind", severity.alias("severity"), ((d > 0) & (F.col("grants") == 0)).alias("optimisable"))


def savings_summary(log: DataFrame) -> DataFrame:
    """AGG-19. Statements before and after consolidation, and the share saved in percent."""
    saved = redundancy(log).agg(F.count(F.lit(1)).alias("objects"), F.coalesce(F.sum("statements_reduced"), F.lit(0)).alias("saved"))
    total = log.agg(F.count(F.lit(1)).alias("statements")).scalar()
    return saved.select("objects", "saved", total.alias("statements"), F.round(100.0 * F.col("saved") / total, 4).alias("percent"))

"""Stateful folds over ordered histories, as higher-order functions: enums, columns, access control, conditional DDL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lithic.sources.checkpoints import keyed


def enum_fold(labels: Column, alters: Column) -> Column:
    """AGG-10. An enum's labels after ``alters``, an ordered array of struct(kind, label, anchor).

    kind is ADD (at the end), BEFORE or AFTER (the anchor; at the end where it is missing), RENAME (anchor to label) or
    anything else (no change). A label that exists already is not added again.
    """

    def step(acc: Column, a: Column) -> Column:
        place = F.array_position(acc, a["anchor"]).cast("int")
        inserted = F.array_insert(acc, F.when(place > 0, place + (a["kind"] == "AFTER").cast("int")).otherwise(F.size(acc) + 1), a["label"])
        renamed = F.transform(acc, lambda x: F.when(x == a["anchor"], a["label"]).otherwise(x))
        known = F.array_contains(acc, a["label"])
        return (
            F.when(a["kind"] == "RENAME", F.when(known, acc).otherwise(renamed))
            .when(known, acc)
            .when(a["kind"] == "ADD", F.concat(acc, F.array(a["label"])))
            .when(a["kind"].isin("BEFORE", "AFTER"), inserted)
            .otherwise(acc)
        )

    return F.aggregate(alters, labels, step)


def append_only(alters: Column) -> Column:
    """Whether a set of enum changes only adds at the end."""
    return F.forall(alters, lambda a: a["kind"] == "ADD")


def column_fold(log: DataFrame) -> DataFrame:
    """AGG-9. Each column's end over (table, column, pos, action, value): type, nullability, default, status and how often it changed.

    Actions: ADD, DROP, TYPE, DEFAULT, NOT_NULL, NULLABLE, and GONE, of no column, for a dropped table. status is active, dropped
    or readded; a DROP ends all before it. Others are passed over.
    """
    known = log.where(F.col("column") != "").select("table", "column").distinct()
    gone = log.where(F.col("action") == "GONE").select("table", "pos").join(keyed(known), "table").select("table", "column", "pos", F.lit("DROP").alias("action"), F.lit("").alias("value"))
    log = log.where(F.col("action").isin("ADD", "DROP", "TYPE", "DEFAULT", "NOT_NULL", "NULLABLE")).select("table", "column", "pos", "action", "value").union(gone)
    w = Window.partitionBy("table", "column").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    lives = log.select("*", F.coalesce(F.sum((F.col("action") == "DROP").cast("int")).over(w), F.lit(0)).alias("life"))
    by = lives.groupBy("table", "column", "life")
    last = lambda *a: F.max_by("value", F.when(F.col("action").isin(*a), F.col("pos")))
    ends = by.agg(
        last("ADD", "TYPE").alias("type"), last("DEFAULT").alias("default"),
        F.coalesce(F.max_by(F.col("action") == "NULLABLE", F.when(F.col("action").isin("NOT_NULL", "NULLABLE"), F.col("pos"))), F.lit(True)).alias("nullable"),
        F.bool_or(F.col("action") == "DROP").alias("dropped"), F.count(F.lit(1)).alias("changes"),
    )
    status = F.when(F.col("dropped"), "dropped").when(F.col("life") > 0, "readded").otherwise("active")
    newest = ends.groupBy("table", "column").agg(F.max_by(F.struct("type", "default", "nullable", status.alias("status"), "changes"), "life").alias("s"))
    return newest.select("table", "column", "s.*")


def rls_state(log: DataFrame) -> DataFrame:
    """AGG-11. Row security as two states of their own: enabled by ENABLE / DISABLE, forced by FORCE / NO FORCE."""
    state = lambda on, off: F.coalesce(F.max_by(F.col("action") == on, F.when(F.col("action").isin(on, off), F.col("pos"))), F.lit(False))
    return log.groupBy("table").agg(state("ENABLE", "DISABLE").alias("enabled"), state("FORCE", "NO FORCE").alias("forced"))


def conditional_state(log: DataFrame) -> DataFrame:
    """AGG-12. Whether each object should exist at the end, and whether its CREATE should replace, over (k, pos, op, if_exists)."""
    events = F.sort_array(F.collect_list(F.struct("pos", "op", "if_exists")))
    start = F.struct(F.lit(False).alias("exist"), F.lit(False).alias("replace"))

    def step(s: Column, e: Column) -> Column:
        made = F.struct(F.lit(True).alias("exist"), (s["exist"] & ~e["if_exists"] | s["replace"]).alias("replace"))
        gone = F.struct(F.lit(False).alias("exist"), s["replace"].alias("replace"))
        return F.when(e["op"] == "CREATE", made).when(e["op"] == "DROP", gone).otherwise(s)

    return log.groupBy("k").agg(F.aggregate(events, start, step).alias("s")).select("k", F.col("s.exist").alias("should_exist"), F.col("s.replace").alias("use_replace"))


def acl_replay(log: DataFrame) -> DataFrame:
    """ACL-2. Net privileges (k, grantee, grant_option) after an ordered log of (k, pos, grantee, action, option).

    GRANT adds a privilege, and the option if named, and never takes an option away. REVOKE of the option keeps the
    privilege; any other REVOKE removes both.
    """
    events = F.sort_array(F.collect_list(F.struct("pos", "action", "option")))

    def step(s: Column, e: Column) -> Column:
        granted = F.coalesce(s, F.lit(False)) | e["option"]
        return F.when(e["action"] == "GRANT", granted).when(e["option"], F.when(s.isNotNull(), False)).otherwise(F.lit(None).cast("boolean"))

    folded = log.groupBy("k", "grantee").agg(F.aggregate(events, F.lit(None).cast("boolean"), step).alias("grant_option"))
    return folded.where("grant_option IS NOT NULL")


def grant_script(current: DataFrame, wanted: DataFrame) -> DataFrame:
    """ACL-11. The least GRANTs and REVOKEs from one net state (k, grantee, grant_option) to another; grantees with one script share a row."""
    c = current.select("k", "grantee", F.col("grant_option").alias("have"))
    w = wanted.select("k", "grantee", F.col("grant_option").alias("want"))
    verb = (
        F.when(F.col("want").isNull(), "REVOKE").when(F.col("have").isNull(), F.when(F.col("want"), "GRANT WITH GRANT OPTION").otherwise("GRANT"))
        .when(F.col("want") & ~F.col("have"), "GRANT WITH GRANT OPTION").when(~F.col("want") & F.col("have"), "REVOKE GRANT OPTION FOR")
    )
    ops = c.join(keyed(w), ["k", "grantee"], "full_outer").select("k", "grantee", verb.alias("verb")).where("verb IS NOT NULL")
    return ops.groupBy("k", "verb").agg(F.array_join(F.transform(F.sort_array(F.collect_set("grantee")), lambda g: g.cast("string")), ",").alias("grantees"))


def lifetimes(log: DataFrame) -> DataFrame:
    """(k, born, died): every CREATE until the object's next DROP or CREATE; died is null for the last."""
    w = Window.partitionBy("k").orderBy("pos")
    return log.where(F.col("op").isin("CREATE", "DROP")).select("k", "op", F.col("pos").alias("born"), F.lead("pos").over(w).alias("died")).where("op = 'CREATE'").drop("op")


def bulk_grants(lives: DataFrame, grants: DataFrame, buckets: int = 64) -> DataFrame:
    """ACL-6. A grant on all objects of a schema (schema, pos) reaches those that exist at its place (schema, k, born, died).

    A schema's grants are cut into ``buckets`` by place, and a life meets those of the buckets that it spans: a schema is as many
    tasks' work, and nearly all that meet belong together. The result itself has a row for each grant and object.
    """
    g = grants.select(F.col("schema").alias("g_schema"), "pos").where("pos IS NOT NULL")
    ends = g.agg(F.min("pos").alias("low"), F.max("pos").alias("high"))
    low, high = F.broadcast(ends).select("low").scalar(), F.broadcast(ends).select("high").scalar()  # one row
    place = lambda c: F.floor((c - low) * F.lit(float(buckets)) / (high - low + 1)).cast("int")
    g = g.withColumn("g_b", place(F.col("pos")))
    first, last = F.greatest(place(F.col("born")), F.lit(0)), F.least(place(F.coalesce("died", high)), F.lit(buckets - 1))
    spread = lives.select("schema", "k", "born", "died", F.explode(F.when(first <= last, F.sequence(first, last))).alias("b"))
    alive = (F.col("schema") == F.col("g_schema")) & (F.col("b") == F.col("g_b")) & (F.col("born") < F.col("pos")) & (F.col("died").isNull() | (F.col("died") > F.col("pos")))
    return spread.join(keyed(g), alive).select("k", "pos")


def role_at(log: DataFrame, switches: DataFrame, within: str = "file") -> DataFrame:
    """ACL-8. Every statement (within, pos) with the role that SET ROLE (within, pos, role) has put in force before it; RESET is the role null."""
    found = as_of(log.select(within, "pos"), switches.select(within, "pos", F.coalesce("role", F.lit("")).alias("role")), within, "role")
    return found.select(within, "pos", F.nullif("role", F.lit("")).alias("role"))


def column_revokes(revokes: DataFrame, columns: DataFrame) -> DataFrame:
    """ACL-3. A table's REVOKE (table, grantee, privilege, pos) takes the privilege on its columns too, of those (table, column, born, died) that exist then."""
    c = columns.select(F.col("table").alias("t"), "column", "born", "died")
    alive = (F.col("table") == F.col("t")) & (F.col("born") < F.col("pos")) & (F.col("died").isNull() | (F.col("died") > F.col("pos")))
    return revokes.join(keyed(c), alive).select("table", "column", "grantee", "privilege", "pos")


def owner_merged(entries: DataFrame, owners: DataFrame) -> DataFrame:
    """ACL-4, SET-3. ACL entries (k, grantee, grant_option) after a change of owner (k, old, new): the old owner's are the new one's, equal ones are one."""
    moved = entries.join(keyed(owners), "k", "left").select("k", F.when(F.col("grantee") == F.col("old"), F.col("new")).otherwise(F.col("grantee")).alias("grantee"), "grant_option")
    return moved.groupBy("k", "grantee").agg(F.bool_or("grant_option").alias("grant_option"), F.count(F.lit(1)).alias("n"))


def initial_acl(created: DataFrame, defaults: DataFrame) -> DataFrame:
    """JN-12, ACL-7. What a new object (k, object_type, schema, pos) is given by the default privileges (object_type, schema, grantee, privilege, pos) in force."""
    d = defaults.groupBy(F.col("object_type").alias("t"), F.col("schema").alias("s"), "grantee", "privilege").agg(F.min("pos").alias("since"))
    return created.join(d, (F.col("object_type") == F.col("t")) & (F.col("schema") == F.col("s")) & (F.col("pos") > F.col("since"))).select("k", "pos", "grantee", "privilege")


def column_lives(columns: DataFrame) -> DataFrame:
    """(table, column, born, died) from column events (table, column, pos, action): every ADD until the next DROP of the column or its table."""
    known = columns.where(F.col("column") != "").select("table", "column").distinct()
    gone = columns.where(F.col("action") == "GONE").select("table", "pos").join(keyed(known), "table").select("table", "column", "pos", F.lit("DROP").alias("action"))
    ends = columns.where(F.col("action").isin("ADD", "DROP")).select("table", "column", "pos", "action").union(gone)
    w = Window.partitionBy("table", "column").orderBy("pos")
    return ends.select("table", "column", "action", F.col("pos").alias("born"), F.lead("pos").over(w).alias("died")).where("action = 'ADD'").drop("action")


def as_of(points: DataFrame, changes: DataFrame, key: str, value: str, buckets: int = 64) -> DataFrame:
    """ACL-7, JN-9. For each point (key, pos) the value of the latest change (key, pos, value) before it; changes without a value are none.

    A key's rows are cut into ``buckets`` by place, so that a key with very many rows is as many tasks' work; each bucket looks
    back in itself, and to the last change of the buckets before it, of which there is one row for each key and bucket.
    """
    both = points.select(key, "pos", F.lit(1).alias("is_point"), F.lit(None).alias(value)).unionByName(changes.select(key, "pos", F.lit(0).alias("is_point"), F.col(value)))
    ends = both.agg(F.min("pos").alias("low"), F.max("pos").alias("high"))
    low, high = F.broadcast(ends).select("low").scalar(), F.broadcast(ends).select("high").scalar()  # one row
    both = both.withColumn("b", F.floor((F.col("pos") - low) * F.lit(float(buckets)) / (high - low + 1)).cast("int"))
    own = Window.partitionBy(key, "b").orderBy("pos", F.col("is_point").desc()).rowsBetween(Window.unboundedPreceding, 0)
    found = both.select(key, "pos", "b", "is_point", F.last(value, ignorenulls=True).over(own).alias(value)).where("is_point = 1")
    last = both.where(F.col(value).isNotNull()).groupBy(F.col(key).alias("k2"), "b").agg(F.max_by(value, "pos").alias("last"))
    # A change counts for the buckets after its own, until the key's next bucket with a change.
    lives = last.select("k2", F.col("b").alias("since"), F.lead("b").over(Window.partitionBy("k2").orderBy("b")).alias("until"), "last")
    later = F.explode(F.sequence(F.col("since") + 1, F.coalesce("until", F.lit(buckets)))).alias("b2")
    carried = lives.select("k2", later, "last")
    joined = found.join(carried, F.col(key).eqNullSafe(F.col("k2")) & (F.col("b") == F.col("b2")), "left")
    return joined.select(key, "pos", F.coalesce(value, "last").alias(value))

"""Transaction and lock planning over an ordered log (k, pos, lock, no_txn, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: lock levels from weak to strong.
DURATIONS = ["FAST", "MEDIUM", "SLOW"]
LOCKS = ["NONE", "ACCESS_SHARE", "ROW_SHARE", "ROW_EXCLUSIVE", "SHARE_UPDATE_EXCLUSIVE", "SHARE", "SHARE_ROW_EXCLUSIVE", "EXCLUSIVE", "ACCESS_EXCLUSIVE"]


def batches(log: DataFrame, within: str = "file") -> DataFrame:
    """WIN-3. Every statement with its batch: one that must run outside a transaction is a batch of its own and ends the one before.

    Histories are planned per ``within`` (a migration file), which bounds a window's rows.
    """
    w = Window.partitionBy(within).orderBy("pos")
    edge = F.col("no_txn") | F.coalesce(F.lag("no_txn").over(w), F.lit(True))
    marked = log.select("*", edge.cast("long").alias("edge"))
    return marked.select("*", F.sum("edge").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("batch")).drop("edge")


def batch_summary(log: DataFrame, within: str = "file") -> DataFrame:
    """TXN-1. Statements, strongest lock, longest duration class and kind of every batch; locks and durations compare by strength."""
    rank = F.array_position(F.array(*map(F.lit, LOCKS)), F.col("lock"))
    longest = F.array_position(F.array(*map(F.lit, DURATIONS)), F.col("duration"))
    return batches(log, within).groupBy(within, "batch").agg(F.count(F.lit(1)).alias("n"), F.max_by("lock", rank).alias("max_lock"), F.max_by("duration", longest).alias("max_duration"), F.bool_or("no_txn").alias("no_txn"))


def lock_conflicts(log: DataFrame, within: str = "file") -> DataFrame:
    """JN-7, TXN-2. (file, severity, n): pairs of statements on one object in one batch (HIGH: both ACCESS EXCLUSIVE; MEDIUM: one outside a transaction) or in neighbouring ones (LOW).

    Counted from each object's statements in each batch; no pair is made.
    """
    b = batches(log, within)
    exclusive, outside = F.count_if(F.col("lock") == "ACCESS_EXCLUSIVE"), F.count_if("no_txn")
    both = F.count_if((F.col("lock") == "ACCESS_EXCLUSIVE") & F.col("no_txn"))
    n = b.groupBy(within, "k", "batch").agg(F.count(F.lit(1)).alias("n"), exclusive.alias("ae"), outside.alias("out"), both.alias("ae_out"))
    w = Window.partitionBy(within, "k").orderBy("batch")
    after = F.when(F.lead("batch").over(w) == F.col("batch") + 1, F.lead("n").over(w)).otherwise(F.lit(0).cast("long"))
    high = F.col("ae") * (F.col("ae") - 1) / 2
    mixed = F.col("out") * (F.col("n") - F.col("out")) - F.col("ae_out") * (F.col("ae") - F.col("ae_out"))  # those both ACCESS EXCLUSIVE are HIGH
    n = n.withColumns({"high": high.cast("long"), "mixed": mixed.cast("long"), "low": (F.col("n") * after).cast("long")})
    kinds = n.select(within, F.explode(F.create_map(F.lit("HIGH"), F.col("high"), F.lit("MEDIUM"), F.col("mixed"), F.lit("LOW"), F.col("low"))).alias("severity", "n"))
    return kinds.groupBy(within, "severity").agg(F.sum("n").alias("n")).where("n > 0")


def batch_warnings(log: DataFrame, within: str = "file") -> DataFrame:
    """TXN-3. (file, batch, warning) for large, slow, exclusive, mixed and concurrent batches, for constraints checked at once and indexes built under a lock."""
    b, upper = batches(log, within), F.upper("sql")
    checked = F.bool_or((F.col("op") == "ALTER") & upper.rlike(r"\bADD CONSTRAINT \S+ (CHECK|FOREIGN KEY)\b") & ~upper.rlike(r"\bNOT VALID\b"))
    blocking = F.bool_or((F.col("op") == "CREATE") & (F.col("object_type") == "INDEX") & ~upper.contains("CONCURRENTLY"))
    sums = b.groupBy(within, "batch").agg(
        F.count(F.lit(1)).alias("n"), F.bool_or(F.col("duration") == "SLOW").alias("slow"), F.bool_or(F.col("lock") == "ACCESS_EXCLUSIVE").alias("ae"),
        F.count_distinct(F.when((F.col("op") == "ALTER") & (F.col("object_type") == "TABLE"), F.col("k"))).alias("altered"), checked.alias("checked"), blocking.alias("blocking"), F.count_if("no_txn").alias("concurrent"),
    )
    told = {"MANY_STATEMENTS": F.col("n") > 50, "SLOW": F.col("slow"), "ACCESS_EXCLUSIVE": F.col("ae"), "SEVERAL_TABLES": F.col("altered") > 1, "CHECKED_AT_ONCE": F.col("checked"), "BLOCKING_INDEX": F.col("blocking"), "MANY_CONCURRENT": F.col("concurrent") > 5}
    return sums.select(within, "batch", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(w)) for w, c in told.items()]))).alias("warning"))


def format_plan(log: DataFrame, within: str = "file") -> str:
    """TXN-4. The plan as text: every batch with its statements, and the lock report. Rows stream to the driver one partition at a time."""
    out, now = [], None
    rows = batches(log, within).join(batch_summary(log, within).select(within, "batch", "max_lock", "max_duration"), [within, "batch"])
    for r in rows.orderBy(within, "batch", "pos").toLocalIterator():
        if (r[within], r.batch) != now:
            now = (r[within], r.batch)
            out += [f"-- {r[within]}, batch {r.batch}: {r.max_lock}, {r.max_duration}{', outside a transaction' if r.no_txn else ''}", *([] if r.no_txn else ["BEGIN;"])]
        out.append(r.sql.rstrip("; ") + ";")
    return "\n".join(out) + "\n" + lock_report(log, within)


def lock_report(log: DataFrame, within: str = "file") -> str:
    """TXN-4. How many statements take each lock, strongest first, and the conflicts."""
    held = {r.lock: r["count"] for r in log.groupBy("lock").count().collect()}  # one row a lock
    lines = [f"-- {lock}: {held[lock]}" for lock in reversed(LOCKS) if lock in held]
    conflicts = lock_conflicts(log, within).groupBy("severity").agg(F.sum("n").alias("n")).orderBy("severity").collect()  # three rows at most
    return "\n".join(["-- locks", *lines, *(f"-- {r.severity} conflicts: {r.n}" for r in conflicts)]) + "\n"

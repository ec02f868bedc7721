"""UDF-1..3, 7..9. Platforms as plugins: what tells them, what they add to statements, what they keep, and which go together."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Plugin:
    """UDF-1. ``marks``: patterns (name -> regular expression on a statement's text) that tell the platform."""

    name: str
    priority: int
    marks: dict[str, str]
    certain: set[str] = field(default_factory=set)
    extensions: list[str] = field(default_factory=list)
    conflicts: set[str] = field(default_factory=set)
    preserved: str = ""
    compatibility: str = ""
    categories: dict[str, str] = field(default_factory=dict)
    volatility: dict[str, str] = field(default_factory=dict)

    def patterns(self, sql: Column) -> Column:
        """The names of the marks in a text."""
        return F.array_compact(F.array(*[F.when(sql.rlike(p), F.lit(n)) for n, p in self.marks.items()]))

    def enriched(self, log: DataFrame) -> DataFrame:
        """UDF-3, UDF-8. The log with the platform's patterns added to each statement's, its category where the platform has one, and whether it is preserved."""
        sql, found = F.col("sql"), self.patterns(F.col("sql"))
        before = F.col("patterns") if "patterns" in log.columns else F.array().cast("array<string>")
        category = reduce(lambda out, m: F.when(sql.rlike(self.marks[m[0]]), F.lit(m[1])).otherwise(out), self.categories.items(), F.col("category"))
        kept = F.col("preserved") if "preserved" in log.columns else F.lit(False)
        return log.withColumns({"patterns": F.concat(before, F.transform(found, lambda n: F.concat(F.lit(f"{self.name}:"), n))), "category": category, "preserved": kept | (sql.rlike(self.preserved) if self.preserved else F.lit(False))})

    def transformed(self, sql: Column) -> Column:
        """UDF-1. The platform's functions with the volatility that they have, where a text names none."""
        out = sql
        for name, kind in self.volatility.items():
            made = sql.rlike(rf"(?i)^\s*CREATE\s+(OR\s+REPLACE\s+)?FUNCTION\s+(\w+\.)?{name}\b") & ~sql.rlike(r"(?i)\b(IMMUTABLE|STABLE|VOLATILE)\b")
            out = F.when(made, F.regexp_replace(out, r"(?i)(\bLANGUAGE\s+\w+)", f"$1 {kind}")).otherwise(out)
        return out


#: The platforms and what tells them.
PLUGINS = [
    Plugin(
        "clerk", 100, {"org_claims": r"auth\.jwt\(\)[\s\S]*'o'->>'id'", "functions": r"(?i)\b(current_clerk_claims|clerk_user_id|clerk_org_id|clerk_is_admin)\(", "claims": r"auth\.jwt\(\)[\s\S]*->>'(sub|email)'"}, {"org_claims", "functions"},
        conflicts={"supabase"}, preserved=r"(?i)\bclerk_\w+\(", categories={"functions": "functions"}, volatility={"clerk_user_id": "STABLE", "clerk_org_id": "STABLE", "clerk_is_admin": "STABLE"},
    ),
    Plugin(
        "supabase", 90, {"uid": r"(?<!No legacy )auth\.uid\(\)", "users": r"\bauth\.users\b", "storage": r"\bstorage\.(objects|buckets)\b", "realtime": r"\bsupabase_realtime\b"}, {"storage", "realtime"},
        ["pgcrypto", "uuid-ossp"], {"clerk"}, r"\bsupabase_realtime\b|\bstorage\.(objects|buckets)\b", "CREATE SCHEMA IF NOT EXISTS auth;", {"storage": "policies"}, {"uid": "STABLE"},
    ),
    Plugin("prisma", 80, {"migrations": r"(?i)_prisma_migrations", "comment": r"--\s*(CreateTable|CreateEnum|CreateIndex|AddForeignKey|AlterTable)\b", "varchar": r"(?i)\bvarchar\(191\)"}, {"migrations", "comment"}, preserved=r"(?i)_prisma_migrations"),
    Plugin("drizzle", 70, {"migrations": r"(?i)__drizzle_migrations", "identity": r"(?i)generated (always|by default) as identity", "kit": r"(?i)--\s*drizzle|--> statement-breakpoint"}, {"migrations", "kit"}, preserved=r"(?i)__drizzle_migrations"),
]


def detected(log: DataFrame, plugins: list[Plugin] = PLUGINS) -> DataFrame:
    """UDF-7. For each plugin: priority, how many statements show it, how many of its marks they have, whether it is there, and whether that is certain."""
    sql = F.col("sql")
    kinds = F.array(*[F.struct(F.lit(p.name).alias("plugin"), F.lit(p.priority).alias("priority"), p.patterns(sql).alias("marks"), F.array(*map(F.lit, sorted(p.certain))).alias("certain")) for p in plugins])
    rows = log.select(F.explode(kinds).alias("p")).select("p.*")
    seen = rows.groupBy("plugin", "priority").agg(F.count_if(F.size("marks") > 0).alias("statements"), F.array_distinct(F.flatten(F.collect_set("marks"))).alias("marks"), F.bool_or(F.arrays_overlap("marks", "certain")).alias("certain"))
    return seen.select("plugin", "priority", "statements", F.size("marks").cast("long").alias("marks"), (F.col("statements") > 0).alias("found"), "certain")


def active(log: DataFrame, plugins: list[Plugin] = PLUGINS) -> list[Plugin]:
    """UDF-2. The plugins that are there, by priority; one that conflicts with an earlier one is left out."""
    there, out = {r.plugin for r in detected(log, plugins).where("found").collect()}, []  # a row for each plugin
    for p in sorted(plugins, key=lambda p: -p.priority):
        if p.name in there and not any(p.name in q.conflicts or q.name in p.conflicts for q in out):
            out.append(p)
    return out


def same_target(log: DataFrame) -> DataFrame:
    """UDF-9. (k, same): whether all statements of an object are about one table."""
    target = F.coalesce(F.get("dependencies", F.lit(0)), F.col("name"))
    return log.groupBy("k").agg((F.count_distinct(target) == 1).alias("same"))


def merged_policies(log: DataFrame) -> DataFrame:
    """UDF-9. (table, command, roles, n): policies of one table, command and set of roles, which may be merged into one by OR."""
    rows = log.where("object_type = 'POLICY' AND op = 'CREATE'")
    command = F.coalesce(F.nullif(F.upper(F.regexp_extract("sql", r"(?i)\bFOR\s+(ALL|SELECT|INSERT|UPDATE|DELETE)\b", 1)), F.lit("")), F.lit("ALL"))
    roles = F.array_join(F.array_sort(F.split(F.regexp_replace(F.lower(F.regexp_extract("sql", r"(?i)\bTO\s+([\w, ]+?)\s*(?:\bUSING\b|\bWITH\b|;|$)", 1)), " ", ""), ",")), ",")
    return rows.groupBy(F.get("dependencies", F.lit(0)).alias("table"), command.alias("command"), roles.alias("roles")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")

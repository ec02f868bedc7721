"""Consolidation: each object's ordered history becomes the texts that are left, by a ladder of rules over the typed log."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithic.functions.ddl import sound
from lithic.functions.sqltext import uses

from . import dependencies, evolution, folds, lifecycle

#: Fixed value: the sections of a rendered baseline, in order.
SECTIONS = ["extensions", "schemas", "types", "tables", "functions", "views", "indexes", "triggers", "policies", "other"]
LEVELS = ["paranoid", "conservative", "standard", "aggressive"]


@dataclass
class Rule:
    """CR-18, UDF-4. Applies where ``when`` holds of an object's facts; ``build`` makes the texts. The first by priority wins."""

    name: str
    level: str
    when: Callable[[], Column]
    build: Callable[[], Column]
    priority: int = 100
    category: str = ""
    provider: str = "lithic"
    tags: set[str] = field(default_factory=set)


class Registry:
    """CR-18. The rules that are known, by name; some may be switched off."""

    def __init__(self, rules: list[Rule]) -> None:
        self.rules, self.off = {r.name: r for r in rules}, set()

    def add(self, rule: Rule) -> None:
        self.rules[rule.name] = rule

    def disable(self, *names: str) -> None:
        if unknown := set(names) - set(self.rules):
            raise ValueError(f"unknown rules: {sorted(unknown)}")
        self.off |= set(names)

    def enable(self, *names: str) -> None:
        self.off -= set(names)

    def chosen(self, level: str, **wanted) -> list[Rule]:
        """The rules of a level and of those before it, by priority; ``wanted`` may name a category, provider or tag."""
        rules = [r for r in self.rules.values() if r.name not in self.off and LEVELS.index(r.level) <= LEVELS.index(level)]
        for what, value in wanted.items():
            rules = [r for r in rules if (value in r.tags if what == "tag" else getattr(r, what) == value)]
        return sorted(rules, key=lambda r: (r.priority, r.name))


def _texts(events: Column) -> Column:
    return F.transform(events, lambda e: e["sql"])


def _rest() -> Column:
    """What follows the statement that defines the object, without other CREATEs and DROPs (CR-2)."""
    after = F.slice("events", F.col("chosen") + 1, F.greatest(F.size("events") - F.col("chosen"), F.lit(0)))
    return F.filter(after, lambda e: ~e["op"].isin("CREATE", "DROP"))


def _from_chosen() -> Column:
    return F.when(F.col("chosen") == 0, _texts(F.col("events"))).otherwise(_texts(F.concat(F.array(F.get("events", F.col("chosen") - 1)), _rest())))


def _replaced() -> Column:
    """CR-7. The defining statement, for views as CREATE OR REPLACE where there were several, and what follows but GRANTs of earlier lives."""
    text = F.get("events", F.col("chosen") - 1)["sql"]
    again = (F.col("object_type") == "VIEW") & (F.col("creates") > 1)
    text = F.when(again, F.regexp_replace(text, r"(?i)^\s*CREATE\s+(?:OR\s+REPLACE\s+)?", "CREATE OR REPLACE ")).otherwise(text)
    return F.concat(F.array(text), _texts(_rest()))


def _enum() -> Column:
    """CR-8, AGG-10. CREATE TYPE with the labels that are there in the end, and what else follows."""
    text = F.get("events", F.col("chosen") - 1)["sql"]
    unquoted = lambda x: F.replace(x, F.lit("''"), F.lit("'"))
    labels = F.transform(F.regexp_extract_all(text, F.lit(r"'((?:[^']|'')*)'"), 1), unquoted)
    part = lambda e, k: unquoted(F.regexp_extract(e["sql"], evolution.ENUM_ALTER, k))
    rename = lambda e: F.upper(part(e, 1)) == "RENAME"
    alters = F.transform(
        F.filter(_rest(), lambda e: e["sql"].rlike(evolution.ENUM_ALTER)),
        lambda e: F.struct(
            F.when(rename(e), "RENAME").when(part(e, 3) == "", "ADD").otherwise(F.upper(part(e, 3))).alias("kind"), F.when(rename(e), part(e, 4)).otherwise(part(e, 2)).alias("label"), F.when(rename(e), part(e, 2)).otherwise(part(e, 4)).alias("anchor")
        ),
    )
    quoted = F.transform(folds.enum_fold(labels, alters), lambda x: F.concat(F.lit("'"), F.replace(x, F.lit("'"), F.lit("''")), F.lit("'")))
    made = F.concat(F.regexp_extract(text, r"(?is)^(.*?\bAS\s+ENUM\s*)\(", 1), F.lit("("), F.array_join(quoted, ", "), F.lit(")"))
    return F.concat(F.array(made), _texts(F.filter(_rest(), lambda e: ~e["sql"].rlike(evolution.ENUM_ALTER))))


ROUTINES = ["FUNCTION", "PROCEDURE"]
LADDER = [
    Rule("external", "paranoid", lambda: F.col("schema").isin(dependencies.PLATFORM), lambda: _texts(F.col("events")), 0),
    Rule("verbatim", "paranoid", lambda: F.col("verbatim"), lambda: _texts(F.col("events")), 1),
    Rule("renamed", "paranoid", lambda: F.col("renamed"), lambda: _texts(F.col("events")), 2, "tables"),
    Rule("gone", "paranoid", lambda: F.col("gone"), lambda: F.array().cast("array<string>"), 5),
    Rule("replaced", "conservative", lambda: F.col("object_type").isin("VIEW", "MATERIALIZED_VIEW", "TRIGGER", "POLICY", *ROUTINES) & (F.col("chosen") > 0), _replaced, 20),
    Rule("column_lifecycle", "aggressive", lambda: (F.col("object_type") == "TABLE") & (F.col("chosen") > 0), lambda: evolution.folded(True)(_from_chosen()), 25, "tables"),
    Rule("create_alter", "conservative", lambda: (F.col("object_type") == "TABLE") & (F.col("chosen") > 0), lambda: evolution.folded(False)(_from_chosen()), 30, "tables"),
    Rule("enum", "standard", lambda: (F.col("object_type") == "TYPE") & (F.col("chosen") > 0) & F.get("events", F.col("chosen") - 1)["sql"].rlike(r"(?i)\bAS\s+ENUM\b"), _enum, 30, "types"),
    Rule("function_dedup", "aggressive", lambda: (F.col("object_type") == "FUNCTION") & (F.col("creates") > 1), lambda: F.slice(_from_chosen(), 1, 1), 10, "functions"),
    Rule("default", "paranoid", lambda: F.lit(True), _from_chosen, 1000),
]


def consolidate(log: DataFrame, level: str = "standard", rules: list[Rule] | Registry = LADDER) -> DataFrame:
    """CR-1..18. One row per object that is left: k, category, object_type, schema, object_name, rule, n_before, n_after, sql, pos.

    Takes a statement log or the typed log. Data operations and, but at the paranoid level, statements on privileges are no
    objects and are left out (SNK-3, ACL-12 render them); dropped tables take with them what depends on them (FLT-3), and
    foreign keys to them go (FLT-5). A history is folded within its object; objects meet by one shuffle on the key.
    """
    log = log if "k" in log.columns else lifecycle.typed(log)
    ddl = log.where(~F.col("is_data"))
    if level != "paranoid":
        gone = dependencies.dropped(ddl)
        ddl = dependencies.without_orphans(dependencies.without_dropped_references(dependencies.without_dropped(ddl, gone), gone))
        ddl = ddl.where(~dependencies.privilege_owned(F.col("sql"), F.col("op"), F.col("object_type")) | F.col("sql").rlike(r"(?i)\bOWNER\s+TO\b"))
    event = F.struct("pos", "op", "sql", "if_not_exists")
    facts = ddl.groupBy("k").agg(
        F.sort_array(F.collect_list(event)).alias("events"), F.max_by("object_type", "pos").alias("object_type"), F.first("schema").alias("schema"), F.first("name").alias("object_name"),
        F.max_by("category", "pos").alias("category"), F.bool_or(F.col("object_type") == "VERBATIM").alias("verbatim"), F.bool_or(F.col("sql").rlike(r"(?is)\bRENAME\s+TO\b")).alias("renamed"), F.count_if(F.col("op") == "CREATE").alias("creates"),
    )
    facts = facts.withColumn("object_type", F.when(F.col("object_type") == "ENUM", "TYPE").otherwise(F.col("object_type")))
    place = lambda keep: F.array_compact(F.transform("events", lambda e, i: F.when(keep(e), i + 1)))
    last_drop = F.coalesce(F.array_max(place(lambda e: e["op"] == "DROP")), F.lit(0))
    facts = facts.withColumn("last_drop", last_drop)
    hard, soft = place(lambda e: (e["op"] == "CREATE") & ~e["if_not_exists"]), place(lambda e: e["op"] == "CREATE")
    later = lambda places: F.filter(places, lambda i: i > F.col("last_drop"))
    facts = facts.withColumn("chosen", F.coalesce(F.array_max(later(hard)), F.array_min(later(soft)), F.lit(0)))
    facts = facts.withColumn("gone", (F.col("last_drop") > 0) & (F.col("chosen") == 0))
    name, made = F, F
    for r in (rules if isinstance(rules, Registry) else Registry(rules)).chosen(level):
        name, made = name.when(r.when(), F.lit(r.name)), made.when(r.when(), r.build())
    at = F.get("events", F.greatest(F.col("chosen"), F.lit(1)) - 1)["pos"]
    out = facts.select("k", "category", "object_type", "schema", "object_name", name.alias("rule"), F.size("events").cast("long").alias("n_before"), made.alias("made"), at.alias("pos"))
    return out.where(F.size("made") > 0).select("k", "category", "object_type", "schema", "object_name", "rule", "n_before", F.size("made").cast("long").alias("n_after"), F.array_join("made", ";\n").alias("sql"), "pos")


def _sound(results: DataFrame) -> DataFrame:
    """The keys of the results whose texts are sound."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(0).filter(pa.array([sound(s or "") for s in batch.column(1).to_pylist()], pa.bool_()))], ["k"])

    return results.select("k", "sql").mapInArrow(each, "k string")


def recovered(log: DataFrame, results: DataFrame, attempts: int = 1) -> DataFrame:
    """CR-16. Results whose text is not sound are made again with fewer rules, ``attempts`` times at most, at last with the fewest."""
    log = log if "k" in log.columns else lifecycle.typed(log)
    good = _sound(results)
    out, bad = results.join(good, "k", "left_semi"), results.select("k").join(good, "k", "left_anti")
    for level in LEVELS[: max(1, attempts)][::-1]:
        again = consolidate(log.join(bad, "k", "left_semi"), level)
        good = _sound(again)
        out = out.unionByName(again.join(good, "k", "left_semi") if level != LEVELS[0] else again)
        bad = bad.join(good, "k", "left_anti")
    return out


def dependency_order(results: list, rank: Callable[[object], tuple] | None = None) -> list:
    """SRT-1, GR-1, GR-8. Results in order of section and place, but everything behind what it uses; of a cycle, the first by place goes first.

    On the driver: a rendered baseline is one text, and has as many results as a schema has objects.
    """
    rank = rank or (lambda r: (SECTIONS.index(r.category) if r.category in SECTIONS else len(SECTIONS), r.pos))
    by_name: dict[str, list[int]] = {}
    for k, r in enumerate(results):
        for c, kinds in dependencies.PROVIDERS.items():
            if r.object_type in kinds:
                for n in {f"{c}:{r.schema}.{r.object_name}", f"{c}:{r.object_name}"}:
                    by_name.setdefault(n, []).append(k)
    needs = [set() for _ in results]
    for k, r in enumerate(results):
        for u in uses(r.sql.split(";\n")[0] if r.object_type != "TABLE" else r.sql):
            c, name = u.split(":", 1)
            exact = by_name.get(u if "." in name else f"{c}:public.{name}") or ([] if "." in name else by_name.get(u, []))
            needs[k] |= {j for j in exact if j != k}
    users = [set() for _ in results]
    for k, n in enumerate(needs):
        for j in n:
            users[j].add(k)
    waiting, ready, out = set(range(len(results))), [], []
    for k in waiting:
        if not needs[k]:
            heapq.heappush(ready, (rank(results[k]), k))
    while waiting:
        if not ready:  # a cycle
            heapq.heappush(ready, min((rank(results[k]), k) for k in waiting))
        _, k = heapq.heappop(ready)
        if k not in waiting:
            continue
        waiting.discard(k)
        out.append(results[k])
        for j in users[k]:
            needs[j].discard(k)
            if not needs[j] and j in waiting:
                heapq.heappush(ready, (rank(results[j]), j))
    return out


def render(results: DataFrame, roles: list[str] = (), privileges: str = "") -> str:
    """SNK-2. The baseline: roles, sections in order with everything behind what it uses, privileges. Rows stream to the driver one partition at a time."""
    from lithic.sources.sinks import quoted

    out, section = [*(["-- ROLES"] if roles else []), *(f"CREATE ROLE {quoted(r)};" for r in sorted(roles))], None
    schemas = []
    rows = list(results.toLocalIterator())
    made = {r.object_name for r in rows if r.object_type == "SCHEMA"}
    for s in sorted({r.schema for r in rows if r.schema not in ("public", "", *dependencies.PLATFORM)} - made):
        schemas.append(f"CREATE SCHEMA IF NOT EXISTS {quoted(s)};")
    if schemas:
        out += ["\n-- SCHEMAS", *schemas]
    for r in dependency_order(rows):
        if r.category != section:
            section = r.category
            out.append(f"\n-- {section.upper()}")
        out.append(r.sql.rstrip(";") + ";")
    return "\n".join([*out, *(["\n-- PRIVILEGES", privileges.strip()] if privileges else [])]).strip() + "\n"


def data_sql(log: DataFrame) -> str:
    """SNK-3, SRT-3. All data operations: tables behind those that they refer to, each in history order."""
    log = log if "k" in log.columns else lifecycle.typed(log)
    tables = log.where("op = 'CREATE' AND object_type = 'TABLE'").select("k", "category", "object_type", "schema", F.col("name").alias("object_name"), "sql", "pos")
    place = {r.k: n for n, r in enumerate(dependency_order(list(tables.toLocalIterator())))}
    rows = sorted(log.where("is_data").select("k", "pos", "sql").toLocalIterator(), key=lambda r: (place.get(r.k, len(place)), r.pos))
    return "".join(r.sql.rstrip(";") + ";\n" for r in rows)


def provenance(log: DataFrame, results: DataFrame) -> DataFrame:
    """ANC-10. Which statements (seq, stmt_idx) went into each result, by the object's whole key."""
    log = log if "k" in log.columns else lifecycle.typed(log)
    return log.join(results.select("k", F.col("object_type").alias("result_type"), "object_name", "rule"), "k").select("seq", "stmt_idx", "k", "object_name", "result_type", "rule")

"""Static lint rules, locks and durations: predicates over statement rows, and text-level helpers."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lithic.functions.shapes import shaped
from lithic.functions.sqltext import bare, split_statements, tokens
from lithic.sources.checkpoints import keyed

#: The rules' codes, and for each what the statement (upper case, single spaces) must and must not match.
RULES = {
    "BREAKING.DROP_COLUMN": (r"^ALTER TABLE .*\bDROP (?!CONSTRAINT\b|DEFAULT\b|NOT NULL\b|EXPRESSION\b|IDENTITY\b)(COLUMN )?(IF EXISTS )?\S+", None),
    "BREAKING.DROP_TABLE": (r"^DROP TABLE\b", None),
    "BREAKING.RENAME_COLUMN": (r"^ALTER TABLE .*\bRENAME (COLUMN )?\S+ TO\b", r"\bRENAME CONSTRAINT\b"),
    "BREAKING.RENAME_TABLE": (r"^ALTER TABLE (IF EXISTS )?\S+ RENAME TO\b", None),
    "BREAKING.TYPE_CHANGE": (r"^ALTER TABLE .*\bALTER (COLUMN )?\S+ (SET DATA )?TYPE\b", None),
    "SAFETY.CONCURRENT_INDEX": (r"^(CREATE (UNIQUE )?INDEX|DROP INDEX)\b", r"\bCONCURRENTLY\b"),
    "SAFETY.MISSING_WHERE": (r"^(UPDATE|DELETE FROM)\b", r"\bWHERE\b"),
    "SAFETY.CONSTRAINT_NOT_VALID": (r"^ALTER TABLE .*\bADD CONSTRAINT \S+ (CHECK|FOREIGN KEY)\b", r"\bNOT VALID\b"),
    "HYGIENE.PREFER_TEXT": (r"^(CREATE|ALTER) TABLE .*\b(VARCHAR|CHARACTER VARYING|CHAR) ?\(", None),
    "HYGIENE.PREFER_BIGINT": (r"^(CREATE|ALTER) TABLE .*[(, ]\S+ (INT|INTEGER|INT4|SMALLINT|INT2|SERIAL|SMALLSERIAL)\b", None),
}
STATEFUL, UNUSED = "SAFETY.CONSTRAINT_VALIDATE_FLOW", "META.UNUSED_IGNORE_DIRECTIVE"
DIRECTIVE = re.compile(r"lithic:ignore(?P<scope>-file|-next)?(?:\s+(?P<codes>[A-Z_.,\s]+))?", re.I)


#: The lock that a statement takes, by operation, kind of object and modifier; the first row that fits. None: any.
LOCKS = [
    ("INSERT", None, None, "ROW_EXCLUSIVE"),
    ("UPDATE", None, None, "ROW_EXCLUSIVE"),
    ("DELETE", None, None, "ROW_EXCLUSIVE"),
    ("REFRESH", None, "concurrent", "EXCLUSIVE"),
    ("CREATE", "INDEX", "concurrent", "SHARE_UPDATE_EXCLUSIVE"),
    ("CREATE", "INDEX", None, "SHARE"),
    ("CREATE", "TABLE", None, "NONE"),
    ("CREATE", "VIEW", None, "NONE"),
    ("CREATE", "FUNCTION", None, "NONE"),
    ("CREATE", "TRIGGER", None, "NONE"),
    ("CREATE", "SEQUENCE", None, "NONE"),
    ("CREATE", "SCHEMA", None, "NONE"),
    ("CREATE", "EXTENSION", None, "NONE"),
    ("CREATE", "TYPE", None, "NONE"),
    ("CREATE", "ENUM", None, "NONE"),
    ("CREATE", "DOMAIN", None, "NONE"),
    ("ALTER", "TABLE", "not valid", "SHARE_UPDATE_EXCLUSIVE"),
    ("ALTER", "ENUM", "add value", "SHARE_UPDATE_EXCLUSIVE"),
    ("ALTER", "TYPE", "add value", "SHARE_UPDATE_EXCLUSIVE"),
    ("DROP", "INDEX", "concurrent", "SHARE_UPDATE_EXCLUSIVE"),
    ("UNKNOWN", None, "vacuum", "SHARE_UPDATE_EXCLUSIVE"),
    (None, None, None, "ACCESS_EXCLUSIVE"),
]
#: How long a statement is expected to take, in seconds at most, by class.
DURATIONS = {"FAST": 1, "MEDIUM": 60, "SLOW": 3600}


def modifiers(sql: Column) -> dict[str, Column]:
    """What a statement's text (upper case) says about how it is run."""
    word = lambda p: sql.rlike(p)
    return {
        "concurrent": word(r"\bCONCURRENTLY\b"),
        "not valid": word(r"\bADD CONSTRAINT\b") & word(r"\bNOT VALID\b") & ~word(r"\bSET NOT NULL\b"),
        "add value": word(r"\bADD VALUE\b"),
        "vacuum": word(r"^\s*VACUUM\b") & ~word(r"\bFULL\b"),
    }


def lock_level(sql: Column, object_type: Column, operation: Column) -> Column:
    """PRJ-13. The lock that a statement takes, looked up by its text's modifiers (upper case), its object's type and its operation."""
    said, out = modifiers(sql), F
    for op, kind, modifier, lock in LOCKS:
        fits = [operation == op] * bool(op) + [object_type == kind] * bool(kind) + ([said[modifier]] if modifier else [])
        out = out.when(reduce(Column.__and__, fits, F.lit(True)), F.lit(lock))
    return out


def no_transaction(sql: Column) -> Column:
    return sql.rlike(r"\bCONCURRENTLY\b|^\s*VACUUM\b|\bCREATE DATABASE\b")


def version_gate(sql: Column, object_type: Column, server: int = 0) -> Column:
    """PRJ-13. What a statement asks of the server's version; with ``server``, an enum's ADD VALUE is no matter from 12 on."""
    enum = object_type.isin("ENUM", "TYPE") & sql.contains("ADD VALUE") & F.lit(server < 12)
    return F.when(enum, "PG<12: Cannot run in transaction").when(sql.contains("GENERATED ALWAYS"), "PG>=12").when(object_type.isin("SUBSCRIPTION", "STATISTIC"), "PG>=10").otherwise("")


def duration_class(sql: Column, object_type: Column, operation: Column) -> Column:
    """PRJ-13. FAST, MEDIUM or SLOW: what rewrites or reads a whole table, what changes rows, and the rest."""
    slow = (operation == "CREATE") & (object_type == "INDEX") | (operation == "REFRESH") | sql.rlike(r"\b(SET DATA )?TYPE\b.*|\bVACUUM\b|\bVALIDATE CONSTRAINT\b") & (operation.isin("ALTER", "UNKNOWN")) & (object_type != "ENUM") & (object_type != "TYPE")
    return F.when(slow, "SLOW").when(operation.isin("INSERT", "UPDATE", "DELETE", "COPY") | sql.rlike(r"\bADD CONSTRAINT\b") & ~sql.rlike(r"\bNOT VALID\b"), "MEDIUM").otherwise("FAST")


def broken(statements: DataFrame, rules: list[str] | None = None) -> DataFrame:
    """Statements (id, sql) with the codes of the rules that each breaks. Strings and comments count for nothing."""
    flat = F.upper(F.trim(F.regexp_replace(F.regexp_replace("sql", r"(?s)'(?:[^']|'')*'|--[^\n]*|/\*.*?\*/", "''"), r"\s+", " ")))
    hit = lambda code: F.col("flat").rlike(RULES[code][0]) & (~F.col("outer").rlike(RULES[code][1]) if RULES[code][1] else F.lit(True))
    found = F.array_compact(F.array(*[F.when(hit(c), F.lit(c)) for c in rules or RULES]))
    # What must not be found is looked for outside brackets: a subquery's WHERE is not the statement's.
    outer = F.aggregate(F.sequence(F.lit(1), F.lit(8)), F.col("flat"), lambda s, _: F.regexp_replace(s, r"\([^()]*\)", " "))
    return statements.select("id", "sql", flat.alias("flat")).select("id", "sql", "flat", outer.alias("outer")).select("id", "sql", found.alias("codes"))


def violations(statements: DataFrame, rules: list[str] | None = None) -> DataFrame:
    """LNT-1..8, 10, 11. (id, code) for every rule that a statement (id, sql) breaks."""
    return broken(statements, rules).select("id", F.explode("codes").alias("code"))


def suppressed(found: DataFrame, directives: DataFrame, buckets: int = 64) -> DataFrame:
    """FLT-7, LNT-12. Violations (file, line, code) that no directive (file, low, high, code) silences, and every directive that silences none, as a violation at its first line.

    No pairs are made. Each file and code is cut into ``buckets`` by place, so that one with very many lines is as many tasks' work; of the other buckets, each gets one row.
    """
    # A line is silenced if the furthest end of the directives that begin at or before it reaches it; a directive silences something if the next violation from its first line on lies within it.
    kinds = ["file", "code"]
    v = found.select(*kinds, F.col("line").alias("at"), F.lit(None).cast(directives.schema["high"].dataType).alias("high"), F.lit(1).alias("is_line"))
    both = v.union(directives.select(*kinds, "low", "high", F.lit(0)))
    known = F.expr("file IS NOT NULL AND code IS NOT NULL AND at IS NOT NULL")
    ends = both.agg(F.min("at").alias("low"), F.max("at").alias("high"))
    low, high = F.broadcast(ends).select("low").scalar(), F.broadcast(ends).select("high").scalar()  # one row
    cut = both.where(known).withColumn("b", F.floor((F.col("at") - low) * F.lit(float(buckets)) / (high - low + 1)).cast("int"))
    line = F.when(F.col("is_line") == 1, F.col("at"))
    before, after = Window.partitionBy(*kinds, "b").orderBy("at", "is_line"), Window.partitionBy(*kinds, "b").orderBy(F.col("at").desc(), F.col("is_line").desc())
    own = cut.select("*", F.max("high").over(before.rowsBetween(Window.unboundedPreceding, 0)).alias("reach"), F.min(line).over(after.rowsBetween(Window.unboundedPreceding, 0)).alias("next"))
    sums = cut.groupBy(*kinds, "b").agg(F.max("high").alias("h"), F.min(line).alias("l"))
    others = lambda *order: Window.partitionBy(*kinds).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select(*kinds, "b", F.max("h").over(others("b")).alias("h"), F.min("l").over(others(F.col("b").desc())).alias("l"))
    seen = own.join(keyed(carried), [*kinds, "b"])
    hit = F.when(F.col("is_line") == 1, F.greatest("reach", "h") >= F.col("at")).otherwise(F.least("next", "l") <= F.col("high"))
    left = seen.where(~F.coalesce(hit, F.lit(False))).select("file", "at", "code", "is_line").union(both.where(~known).select("file", "at", "code", "is_line"))
    return left.select("file", F.col("at").alias("line"), F.when(F.col("is_line") == 1, F.col("code")).otherwise(UNUSED).alias("code"))


# The rules that can be mended by replacing text: a pattern, and what stands in its place.
FIXES = {
    "SAFETY.CONSTRAINT_NOT_VALID": (r"(\bADD CONSTRAINT \S+ (?:CHECK|FOREIGN KEY)\b.*?)(\s*;?\s*)$", r"\1 NOT VALID\2"),
    "HYGIENE.PREFER_TEXT": (r"\b(?:VARCHAR|CHARACTER VARYING|CHAR) ?\(\s*\d+\s*\)", "text"),
    "HYGIENE.PREFER_BIGINT": (r"(?<=[\s,(])(?:INTEGER|INT4|INT2|INT|SMALLINT)\b", "bigint"),
}


def fixes(sql: str, code: str) -> list[tuple[int, int, str]]:
    """LNT-8, 10, 11. Replacements (start, end, text) that mend a statement which breaks a rule; none for rules that need a decision. Text in quotes stays."""
    if code not in FIXES:
        return []
    pattern, new = FIXES[code]
    same = "".join(t if k not in ("string", "dollar", "comment", "quoted") else t[0] + " " * (len(t) - 2) + t[-1:] for k, t, _ in tokens(sql))
    out = []
    for m in re.finditer(pattern, same, re.I | re.S):
        if code == "SAFETY.CONSTRAINT_NOT_VALID":
            if not re.search(r"\bNOT VALID\b", same, re.I):
                out.append((m.end(1), m.end(1), " NOT VALID"))
        else:
            out.append((m.start(), m.end(), new))
    return out


def mended(statements: DataFrame) -> DataFrame:
    """LNT-8, 10, 11, SRT-6. (id, sql) of the statements that a fix changes, all fixes applied from the highest offset down; an Arrow-batched map over the violations.

    A statement keeps its text while its rules are tried: nothing is joined, so that an id need not be its statement's alone.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_codes: dict = {}
        for batch in batches:
            new = []
            for s, codes in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                codes = tuple(codes)
                if codes not in by_codes:
                    by_codes[codes] = shaped(lambda s, codes=codes: apply_fixes(s, [f for c in codes for f in fixes(s, c)]))
                new.append(by_codes[codes](s))
            yield pa.record_batch([batch.column(0), pa.array(new, pa.string())], ["id", "sql"])

    return broken(statements, list(FIXES)).where(F.size("codes") > 0).select("id", "sql", F.sort_array("codes")).mapInArrow(each, StructType([statements.schema["id"], StructField("sql", StringType())]))


def enabled(base: list[str], enable: list[str] = (), disable: list[str] = ()) -> list[str]:
    """SET-4. Rules in force; an unknown code is an error."""
    known = {*RULES, STATEFUL, UNUSED}
    if unknown := {*base, *enable, *disable} - known:
        raise ValueError(f"unknown rules: {sorted(unknown)}")
    return sorted({*base, *enable} - {*disable})


def check(sql: str) -> list[dict]:
    """LNT-13 over one text: code, line, with directives applied and unused ones reported, by (line, code)."""
    found, pending, directives = [], {}, []
    for s in split_statements(sql):
        flat = re.sub(r"\s+", " ", bare(s["sql"])).strip().upper()
        outer = flat
        while (less := re.sub(r"\([^()]*\)", " ", outer)) != outer:
            outer = less
        for c, (yes, no) in RULES.items():
            try:  # a rule that fails does not stop the others
                if re.search(yes, flat) and not (no and re.search(no, outer)):
                    found.append({"code": c, "line": s["line"]})
            except re.error as e:
                found.append({"code": "META.RULE_FAILED", "line": s["line"], "rule": c, "reason": str(e)})
        if m := re.match(r"ALTER TABLE (?:ONLY )?(\S+) .*?ADD CONSTRAINT (\S+) .*NOT VALID", flat):
            pending[m[1], m[2]] = s["line"]
        elif m := re.match(r"ALTER TABLE (?:ONLY )?(\S+) (?:VALIDATE|DROP) CONSTRAINT (?:IF EXISTS )?(\S+)", flat):
            pending.pop((m[1], m[2]), None)
        elif m := re.match(r"DROP TABLE (?:IF EXISTS )?(\S+)", flat):
            pending = {k: v for k, v in pending.items() if k[0] != m[1]}
        for c in s["comments"]:
            if m := DIRECTIVE.search(c):
                directives.append({"scope": m["scope"] or "", "codes": set((m["codes"] or "").replace(",", " ").upper().split()), "line": s["line"], "used": False})
    found += [{"code": STATEFUL, "line": line} for line in pending.values()]

    def silenced(v: dict) -> bool:
        for d in directives:
            if (d["scope"] == "-file" or d["line"] == v["line"]) and (not d["codes"] or v["code"] in d["codes"]):
                d["used"] = True
                return True
        return False

    found = [v for v in found if not silenced(v)]
    found += [{"code": UNUSED, "line": d["line"]} for d in directives if not d["used"]]
    return sorted(found, key=lambda v: (v["line"], v["code"]))


def apply_fixes(sql: str, fixes: list[tuple[int, int, str]]) -> str:
    """SRT-6. Replacements (start, end, text), from the highest offset down; one that overlaps a later one is left out."""
    limit = len(sql)
    for start, end, text in sorted(fixes, reverse=True):
        if end <= limit:
            sql, limit = sql[:start] + text + sql[end:], start
    return sql

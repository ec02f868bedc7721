"""Extensions, platforms, rollback, structural checks and edge weights over the statement log."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lithic.functions.ddl import actions
from lithic.functions.shapes import shaped
from lithic.functions.sqltext import classify, plain

# What points to an extension, what an extension needs, and the order of extensions in a result.
INDICATORS = {
    "postgis": [r"\bst_[a-z0-9_]+ ?\(", r"\b(geometry|geography)\b ?\("],
    "earthdistance": [r"\bll_to_earth ?\(", r"\bearth_distance ?\("],
    "uuid-ossp": [r"\buuid_generate_v[0-9]\w* ?\("],
    "pg_trgm": [r"\bgin_trgm_ops\b", r"\bgist_trgm_ops\b", r"\bsimilarity ?\("],
    "pgcrypto": [r"\bgen_salt ?\(", r"\bcrypt ?\(", r"\bdigest ?\("],
    "btree_gin": [r"\bbtree_gin\b"],
    "cube": [r"\bcube ?\("],
}
NEEDS = {"earthdistance": "cube"}
ORDER = ["cube", "earthdistance", "postgis", "uuid-ossp", "pg_trgm", "pg_stat_statements", "btree_gin", "pgcrypto"]
IMAGES = {"postgis": "postgis/postgis:17-3.5", "": "postgres:17"}
#: ALTERs that cannot be folded into a CREATE, by the words that tell them.
SEPARATE = {
    "RLS": "ROW LEVEL SECURITY", "ALTER COLUMN": "ALTER COLUMN", "DROP COLUMN": "DROP COLUMN", "RENAME": "RENAME", "OWNER": "OWNER TO", "SCHEMA": "SET SCHEMA",
    "CONSTRAINT": "(DROP|VALIDATE|ALTER) CONSTRAINT", "INHERIT": "INHERIT", "SETTINGS": r"(SET|RESET) \(",
}


def required_extensions(statements: DataFrame) -> DataFrame:
    """ANC-1. Extensions that (id, sql) statements create or whose functions and types they use, with what these need, in order of installation."""
    text = F.lower("sql")
    named = F.regexp_extract(text, r'create extension (?:if not exists )?"?([a-z0-9_-]+)', 1)
    used = F.array_compact(F.array(*[F.when(text.rlike("|".join(marks)), F.lit(e)) for e, marks in INDICATORS.items()]))
    found = F.array_union(F.filter(F.array(named), lambda e: e != ""), used)
    needs = F.create_map(*[F.lit(x) for pair in NEEDS.items() for x in pair])
    needed = F.array_compact(F.transform(found, lambda e: F.try_element_at(needs, e)))
    return extension_order(statements.select(F.explode(F.array_union(found, needed)).alias("extension")).distinct())


def extension_order(extensions: DataFrame) -> DataFrame:
    """SRT-5. (extension, place): the fixed list first, all others together at place 1000, by name."""
    place = F.array_position(F.array(*map(F.lit, ORDER)), F.col("extension"))
    return extensions.select("extension", F.when(place > 0, place).otherwise(1000).cast("long").alias("place"))


def server_image(extensions: DataFrame) -> str:
    """The image of the scratch server that has all of them."""
    return IMAGES["postgis" if not extensions.where("extension = 'postgis'").isEmpty() else ""]


#: What tells an authentication service, as (rank, service, patterns that must all be found); the lowest rank counts.
AUTH_MARKS = [
    (1, "clerk", [r"(?i)\b(current_clerk_claims|clerk_user_id|current_clerk_user_id|clerk_is_admin)\("]),
    (1, "clerk", [r"auth\.jwt\(\)", r"'(o|org)'->>'id'"]),
    (2, "supabase", [r"auth\.users"]),
    (2, "supabase", [r"(?<!No legacy )auth\.uid\(\)"]),
    (3, "auth0", [r"(?i)auth0"]),
    (3, "auth0", [r'"sub"', r'"iss"']),
]
#: ANC-2. What stands in for each service's functions in a scratch database.
AUTH_STUBS = {
    "clerk": "CREATE SCHEMA IF NOT EXISTS auth;\nCREATE OR REPLACE FUNCTION auth.jwt() RETURNS jsonb LANGUAGE sql STABLE AS $$ SELECT '{}'::jsonb $$;\nCREATE OR REPLACE FUNCTION clerk_user_id() RETURNS text LANGUAGE sql STABLE AS $$ SELECT auth.jwt()->>'sub' $$;",
    "supabase": "CREATE SCHEMA IF NOT EXISTS auth;\nCREATE TABLE IF NOT EXISTS auth.users (id uuid PRIMARY KEY, email text);\nCREATE OR REPLACE FUNCTION auth.uid() RETURNS uuid LANGUAGE sql STABLE AS $$ SELECT NULL::uuid $$;",
    "auth0": "CREATE SCHEMA IF NOT EXISTS auth;\nCREATE OR REPLACE FUNCTION auth.jwt() RETURNS jsonb LANGUAGE sql STABLE AS $$ SELECT '{\"sub\": \"\", \"iss\": \"\"}'::jsonb $$;",
    "none": "",
}


def auth_service(sql: Column) -> Column:
    """ANC-2, PRJ-11. The authentication service that a text speaks to, none without any."""
    found = F.array_compact(F.array(*[F.when(reduce(Column.__and__, [sql.rlike(p) for p in marks]), F.struct(F.lit(rank).alias("rank"), F.lit(service).alias("service"))) for rank, service, marks in AUTH_MARKS]))
    return F.coalesce(F.array_min(found)["service"], F.lit("none"))


def auth_stub(statements: DataFrame) -> str:
    """ANC-2. The stub for the service that a history speaks to, the first by rank."""
    ranks = {service: rank for rank, service, _ in AUTH_MARKS}
    found = [r.service for r in statements.select(auth_service(F.col("sql")).alias("service")).distinct().collect()]  # four values at most
    return AUTH_STUBS[min((f for f in found if f in ranks), key=ranks.get, default="none")]


def dynamic_sql(sql: Column) -> Column:
    """PRJ-11. Whether a routine or DO block puts statements together at run time."""
    return sql.rlike(r"(?is)\bEXECUTE\s+(?!FUNCTION\b|PROCEDURE\b|ON\b)(format\s*\(|'|[a-z_]\w*\s*(\|\||;|USING\b|INTO\b)|quote_)")


def publication_members(log: DataFrame) -> DataFrame:
    """CR-10. Each (publication, table) of CREATE and ALTER PUBLICATION in the typed log once, at its first place; tables with their schema, or public."""
    rows = log.where("object_type = 'PUBLICATION' AND op IN ('CREATE', 'ALTER')").select("name", "pos", F.regexp_extract("sql", r"(?is)\b(?:FOR|ADD|SET)\s+TABLE\s+(?:ONLY\s+)?(.*?)\s*(?:WITH\s*\(.*\))?\s*;?\s*$", 1).alias("list"))
    member = rows.select(F.col("name").alias("publication"), "pos", F.explode(F.split("list", r"\s*,\s*")).alias("t")).where("t <> ''")
    full = F.lower(F.regexp_replace("t", r'"|\s*\(.*$', ""))
    return member.select("publication", F.when(F.contains(full, F.lit(".")), full).otherwise(F.concat(F.lit("public."), full)).alias("table"), "pos").groupBy("publication", "table").agg(F.min("pos").alias("pos"))


def separate_alters(statements: DataFrame) -> DataFrame:
    """CR-12. ALTERs (id, sql) that must stay apart from a CREATE, with the reasons."""
    upper = F.upper("sql")
    why = F.array_compact(F.array(*[F.when(upper.rlike(p), F.lit(k)) for k, p in SEPARATE.items()]))
    return statements.where(upper.startswith("ALTER")).select("id", F.array_join(F.array_sort(why), ",").alias("reasons")).where("reasons <> ''")


#: What an edge between objects of two kinds weighs more or less than 100, as (kind of the user, kind of the used, weight); None: any.
#: An edge to an extension, or from outside to a schema, or of a foreign key by name, is critical.
EDGE_WEIGHTS = [
    (None, "EXTENSION", 500),
    ("not SCHEMA", "SCHEMA", 500),
    ("either SCHEMA", None, 200),
    ("TABLE", "TABLE", 150),
    ("FUNCTION", "FUNCTION", -50),
    ("either VIEW", None, -30),
]


def edge_weight(src: Column, dst: Column, src_name: Column | None = None, dst_name: Column | None = None) -> Column:
    """GR-9. How much an edge matters, by the kinds of both objects and their names; the lightest of a cycle is taken out. Critical counts once."""
    none = F.lit("")
    foreign = F.contains(F.lower(F.coalesce(src_name if src_name is not None else none, none)), F.lit("foreign")) | F.contains(F.lower(F.coalesce(dst_name if dst_name is not None else none, none)), F.lit("foreign"))

    def holds(a: str | None, b: str | None) -> Column:
        if a and a.startswith("either "):
            return F.contains(src, F.lit(a[7:])) | F.contains(dst, F.lit(a[7:]))
        left = F.lit(True) if a is None else ~F.contains(src, F.lit(a[4:])) if a.startswith("not ") else F.contains(src, F.lit(a))
        return left & (F.contains(dst, F.lit(b)) if b else F.lit(True))

    critical = reduce(Column.__or__, [holds(a, b) for a, b, w in EDGE_WEIGHTS if w == 500], foreign)
    return reduce(Column.__add__, [F.when(holds(a, b), w).otherwise(0) for a, b, w in EDGE_WEIGHTS if w != 500], F.lit(100) + F.when(critical, 500).otherwise(0))


def removed_edges(cycles: DataFrame) -> DataFrame:
    """GR-9. From (cycle, src, dst, src_type, dst_type), the lightest edge of each cycle, the first by names of equals."""
    weight = edge_weight(F.col("src_type"), F.col("dst_type"), F.col("src"), F.col("dst"))
    return cycles.groupBy("cycle").agg(F.min(F.struct(weight.alias("weight"), "src", "dst")).alias("e")).select("cycle", "e.src", "e.dst", "e.weight")


def resolution(kind: Column) -> Column:
    """GR-14. What to do about a cycle of a kind."""
    return (
        F.when(kind == "simple", "keep the last definition").when(kind == "transient", "leave the object out").when(kind == "versioning", "keep the newest version")
        .when(kind == "dependency", "defer a foreign key to ALTER TABLE").when(kind == "complex", "review the history by hand").otherwise("nothing")
    )


def transaction_groups(log: DataFrame) -> DataFrame:
    """CR-13. Objects with more than two statements and how many transactions they need: one, and one for each statement outside."""
    return log.groupBy("k").agg(F.count(F.lit(1)).alias("n"), (F.count_if("no_txn") + F.max((~F.col("no_txn")).cast("long"))).alias("transactions")).where("n > 2")


@shaped
def rollback_statement(sql: str) -> str | None:
    """ANC-9. What takes a statement back, where that can be told from its text."""
    flat = plain(sql)
    row = classify(flat)
    if row["operation"] == "CREATE" and row["object_name"] and row["object_type"] not in ("TRIGGER", "POLICY", "RULE"):
        kind = {"MATERIALIZED_VIEW": "MATERIALIZED VIEW", "FOREIGN_TABLE": "FOREIGN TABLE", "ENUM": "TYPE"}.get(row["object_type"], row["object_type"])
        name = ".".join(filter(None, (row["schema_name"], row["object_name"])))
        concurrent = " CONCURRENTLY" if re.match(r"CREATE (UNIQUE )?INDEX CONCURRENTLY", flat, re.I) else ""
        return f"DROP {kind}{concurrent} IF EXISTS {name}{row['function_signature']};"
    if row["operation"] == "CREATE" and row["dependencies"]:
        return f"DROP {row['object_type']} IF EXISTS {row['object_name']} ON {row['dependencies'][0]};"
    if m := re.match(r"GRANT (.+) TO (.+?)( WITH GRANT OPTION)?$", flat, re.I):
        return f"REVOKE {m[1]} FROM {m[2]};"
    (schema, table), todo = actions(flat)
    head = f"ALTER TABLE {schema + '.' if schema else ''}{table} "
    back = []
    for a in reversed(todo):
        one = {
            "ADD": f"DROP COLUMN {a['name']}", "ADD_CONSTRAINT": f"DROP CONSTRAINT {a['name']}" if a["name"] else None, "RENAME": f"RENAME COLUMN {a['value']} TO {a['name']}", "NOT_NULL": f"ALTER COLUMN {a['name']} DROP NOT NULL",
            "NULLABLE": f"ALTER COLUMN {a['name']} SET NOT NULL", "ENABLE": "DISABLE ROW LEVEL SECURITY", "DISABLE": "ENABLE ROW LEVEL SECURITY", "FORCE": "NO FORCE ROW LEVEL SECURITY", "NO FORCE": "FORCE ROW LEVEL SECURITY",
        }.get(a["kind"])
        if a["kind"] == "RENAME_TABLE":
            return f"ALTER TABLE {schema + '.' if schema else ''}{a['name']} RENAME TO {table};"
        if one is None:
            return None
        back.append(one)
    return f"{head}{', '.join(back)};" if back else None


def rollback_plan(log: DataFrame) -> DataFrame:
    """ANC-9. (k, pos, step, action, statement) of a typed log, the last statement first: what takes each back, or null where that is to be done by hand (MANUAL) or from a backup (RESTORE).

    Steps count within an object: no order over all of a history is made.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.set_column(3, "statement", pa.array([rollback_statement(s) for s in batch.column(3).to_pylist()], pa.string()))

    made = log.select("k", "pos", "op", F.col("sql").alias("statement")).mapInArrow(each, "k string, pos long, op string, statement string")
    action = F.when(F.col("op").isin("DROP", "DELETE", "TRUNCATE", "UPDATE"), "RESTORE").when(F.col("statement").isNotNull(), "REVERT").otherwise("MANUAL")
    step = F.row_number().over(Window.partitionBy("k").orderBy(F.col("pos").desc())).cast("long")
    return made.select("k", "pos", step.alias("step"), action.alias("action"), "statement")


def repaired_policies(sql: str) -> str:
    """ANC-5. DROP POLICY without its table takes the table of the CREATE POLICY of the same name."""
    tables = {m[1]: m[2] for m in re.finditer(r"CREATE\s+POLICY\s+(\S+)\s+ON\s+([\w.\"]+)", sql, re.I)}
    return re.sub(r"(DROP\s+POLICY\s+(?:IF\s+EXISTS\s+)?)([\w\"]+)(\s*;)", lambda m: f"{m[1]}{m[2]} ON {tables[m[2]]}{m[3]}" if m[2] in tables else m[0], sql, flags=re.I)


def placed_after_create(create: str, inserts: list[tuple[int, str]]) -> str:
    """ANC-11. ALTER texts behind a CREATE, in the order of their history positions."""
    return "\n".join([create.rstrip(";") + ";", *[t.rstrip(";") + ";" for _, t in sorted(inserts)]])

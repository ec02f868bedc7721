"""Plans of stateful folds over parsed histories: enums, columns, row security, conditional DDL, access control."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithic.operators import evolution, folds, lifecycle, normalize, validate
from lithic.sources.checkpoints import settled

from .base import Plans, once
from .histories import dealt, parsed

P = Plans()

#: A history of enums: every brand is a type, every part of it adds a label, some twice; one part in fifty drops and creates the type anew.
ENUM_TEXT = """SELECT p_partkey AS seq, 'part' AS filename, concat(CASE WHEN p_partkey % 50 = 0 THEN concat('DROP TYPE app.e_', replace(p_brand, '#', '_'), '; CREATE TYPE app.e_', replace(p_brand, '#', '_'), ' AS ENUM (''base''); ') ELSE '' END,
  'ALTER TYPE app.e_', replace(p_brand, '#', '_'), ' ADD VALUE IF NOT EXISTS ''l', p_size % 20, '''') AS content FROM {part}"""


def enum_labels(files: DataFrame) -> DataFrame:
    log = settled(parsed(files).select("k", "object_type", "op", "pos", "schema", "name", "sql"))
    made = evolution.enums(log).select("k", "labels", F.col("pos").alias("since"))
    alters = evolution.enum_alters(log).groupBy("k").agg(F.sort_array(F.collect_list(F.struct("pos", "kind", "label", "anchor"))).alias("a"))
    known = alters.join(made, "k", "left").select("k", F.coalesce("labels", F.array().cast("array<string>")).alias("labels"), F.filter("a", lambda x: x["pos"] > F.coalesce(F.col("since"), F.lit(-1))).alias("a"))
    return known.select("k", F.array_join(folds.enum_fold(F.col("labels"), F.col("a")), ",").alias("labels"))


P.frame("enum_fold", enum_labels, (ENUM_TEXT,), """
WITH e AS (SELECT 'app.e_' || lower(replace(p_brand, '#', '_')) || '::TYPE' AS k, 'l' || (p_size % 20) AS label, p_partkey AS pos, p_partkey % 50 = 0 AS anew FROM {part}),
s AS (SELECT k, max(pos) FILTER (anew) AS since FROM e GROUP BY k), f AS (SELECT e.k, label, min(pos) AS pos, since FROM e JOIN s ON e.k = s.k WHERE since IS NULL OR pos >= since GROUP BY e.k, label, since)
SELECT k, CASE WHEN max(since) IS NULL THEN '' ELSE 'base,' END || string_agg(label, ',' ORDER BY pos) AS labels FROM f GROUP BY k""")
P.frame("column_lifecycle", lambda log: folds.column_fold(settled(evolution.column_events(log))), oracle="""
WITH a AS (SELECT * FROM {columns}), names AS (SELECT DISTINCT "table", "column" FROM a WHERE "column" <> ''),
c AS (SELECT * FROM a WHERE action IN ('ADD', 'DROP', 'TYPE', 'DEFAULT', 'NOT_NULL') UNION ALL SELECT a."table", n."column", pos, 'DROP', '' FROM a JOIN names n ON a."table" = n."table" WHERE action = 'GONE'),
l AS (SELECT *, coalesce(sum(CASE WHEN action = 'DROP' THEN 1 ELSE 0 END) OVER (PARTITION BY "table", "column" ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS life FROM c),
e AS (SELECT "table", "column", life, arg_max(value, pos) FILTER (action IN ('ADD', 'TYPE')) AS type, arg_max(value, pos) FILTER (action = 'DEFAULT') AS d, count(*) FILTER (action = 'NOT_NULL') = 0 AS nullable,
  bool_or(action = 'DROP') AS dropped, count(*) AS changes FROM l GROUP BY "table", "column", life)
SELECT "table", "column", type, d AS "default", nullable, CASE WHEN dropped THEN 'dropped' WHEN life > 0 THEN 'readded' ELSE 'active' END AS status, changes FROM e QUALIFY row_number() OVER (PARTITION BY "table", "column" ORDER BY life DESC) = 1""")
P.frame("rls_state", lambda log: folds.rls_state(evolution.column_events(log).where("action IN ('ENABLE', 'DISABLE', 'FORCE', 'NO FORCE')")), oracle="""
SELECT "table", bool_or(action = 'ENABLE') AS enabled, FALSE AS forced FROM {columns} WHERE action IN ('ENABLE', 'NO FORCE') GROUP BY ALL""")
P.frame("conditional_state", lambda log: folds.conditional_state(log.withColumn("if_exists", F.col("sql").rlike(r"(?i)\bIF\s+(NOT\s+)?EXISTS\b"))), oracle="""
WITH o AS (SELECT k, pos, op, if_exists AS ie, lag(op) OVER (PARTITION BY k ORDER BY pos) AS before FROM {log} WHERE op IN ('CREATE', 'DROP'))
SELECT l.k, coalesce(arg_max(o.op, o.pos) = 'CREATE', FALSE) AS should_exist, coalesce(bool_or(o.op = 'CREATE' AND before = 'CREATE' AND NOT ie), FALSE) AS use_replace
FROM (SELECT DISTINCT k FROM {log}) l LEFT JOIN o ON l.k = o.k GROUP BY l.k""")


#: What permissions are read from.
GIVEN = ("k", "pos", "op", "object_type", "sql", "grantees", "privileges")


def entries(log: DataFrame) -> DataFrame:
    """Grants and revokes as acl_replay reads them."""
    return lifecycle.permissions(log).where("grantee IS NOT NULL").select("k", "pos", "grantee", F.col("op").alias("action"), "option")


def other_entries(log: DataFrame) -> DataFrame:
    """Another state of the same objects: some entries went to another grantee, some have the other option."""
    n = (F.col("pos") / 1024).cast("long")
    given = entries(log)
    grantee = F.when(n % 5 == 0, F.concat(F.lit("q"), F.substring("grantee", 2, 9))).otherwise(F.col("grantee"))
    return given.select("k", "pos", grantee.alias("grantee"), "action", F.when((n % 3 == 0) & (F.col("action") == "GRANT"), ~F.col("option")).otherwise(F.col("option")).alias("option"))


ACL_LOG = "(SELECT k, pos, grantee, op AS action, option FROM {log} WHERE op IN ('GRANT', 'REVOKE'))"
OTHER = "(SELECT k, pos, CASE WHEN event_id % 5 = 0 THEN 'q' || substr(grantee, 2) ELSE grantee END AS grantee, op AS action, CASE WHEN event_id % 3 = 0 AND op = 'GRANT' THEN NOT option ELSE option END AS option FROM {log} WHERE op IN ('GRANT', 'REVOKE'))"
NET = """(SELECT k, grantee, last_opt IS NOT NULL AND last_opt > coalesce(last_revoke, -1) AS grant_option FROM (
  SELECT k, grantee, max(pos) FILTER (action = 'GRANT') AS last_grant, max(pos) FILTER (action = 'GRANT' AND option) AS last_opt, max(pos) FILTER (action = 'REVOKE') AS last_revoke FROM ACL GROUP BY k, grantee)
  WHERE last_grant > coalesce(last_revoke, -1))"""
P.frame("acl_net_state", once(lambda log: folds.acl_replay(entries(log)), *GIVEN), oracle=f"SELECT * FROM {NET.replace('ACL', ACL_LOG)}")
P.frame("grant_script", once(lambda log: folds.grant_script(folds.acl_replay(other_entries(log)), folds.acl_replay(entries(log))), *GIVEN), oracle=f"""
WITH c AS (SELECT * FROM {NET.replace('ACL', OTHER)}), w AS (SELECT * FROM {NET.replace('ACL', ACL_LOG)}),
o AS (SELECT k, grantee, CASE WHEN w.grant_option IS NULL THEN 'REVOKE' WHEN c.grant_option IS NULL THEN CASE WHEN w.grant_option THEN 'GRANT WITH GRANT OPTION' ELSE 'GRANT' END
  WHEN w.grant_option AND NOT c.grant_option THEN 'GRANT WITH GRANT OPTION' WHEN NOT w.grant_option AND c.grant_option THEN 'REVOKE GRANT OPTION FOR' END AS verb FROM c FULL JOIN w USING (k, grantee))
SELECT k, verb, string_agg(grantee, ',' ORDER BY grantee) AS grantees FROM o WHERE verb IS NOT NULL GROUP BY k, verb""")
LIVES = "(SELECT k, schema, pos AS born, died FROM (SELECT k, schema, op, pos, lead(pos) OVER (PARTITION BY k ORDER BY pos) AS died FROM {log} WHERE op IN ('CREATE', 'DROP') AND object_type = 'TABLE') l WHERE op = 'CREATE')"
tables = lambda log: log.where("object_type = 'TABLE'")
P.frame("bulk_grant_interval", once(lambda log: folds.bulk_grants(folds.lifetimes(tables(log)).withColumn("schema", F.split("k", r"\.")[0]), log.where("object_type = 'SCHEMA' AND op = 'GRANT'").select("schema", "pos")), "k", "object_type", "op", "schema", "pos"), oracle=f"""
SELECT l.k, g.pos FROM {LIVES} l JOIN (SELECT schema, pos FROM {{log}} WHERE object_type = 'SCHEMA') g ON l.schema = g.schema AND l.born < g.pos AND (l.died IS NULL OR l.died > g.pos)""")
P.frame("default_privilege_asof", once(lambda log: folds.as_of(log.where("op = 'CREATE'").select("schema", "pos"), log.where("op = 'ALTER'").select("schema", "pos", "duration"), "schema", "duration"), "op", "schema", "pos", "duration"), oracle="""
SELECT c.schema, c.pos, a.duration FROM (SELECT schema, pos FROM {log} WHERE op = 'CREATE') c ASOF LEFT JOIN (SELECT schema, pos, duration FROM {log} WHERE op = 'ALTER') a ON c.schema = a.schema AND c.pos > a.pos""")
#: SET ROLE stands before some of the day's statements, RESET ROLE before others.
ROLE_TEXT = """SELECT event_id AS seq, CAST(CAST(ts AS DATE) AS STRING) AS filename, concat(CASE WHEN event_type = 'signup' THEN concat('SET ROLE r_', user_id % 7, '; ') WHEN event_type = 'error' AND user_id % 2 = 0 THEN 'RESET ROLE; ' ELSE '' END,
  'GRANT SELECT ON t_', user_id, ' TO reader') AS content FROM {events}"""


def grantors(files: DataFrame) -> DataFrame:
    log = settled(parsed(files).select("file", "pos", "op", "sql"))
    role = F.regexp_extract("sql", r'(?i)^\s*SET\s+(?:LOCAL\s+|SESSION\s+)?(?:ROLE|SESSION\s+AUTHORIZATION)\s+"?([\w$]+)', 1)
    switches = log.where(F.col("sql").rlike(r"(?i)^\s*(SET\s+(LOCAL\s+|SESSION\s+)?(ROLE|SESSION\s+AUTHORIZATION)|RESET\s+(ROLE|SESSION\s+AUTHORIZATION))\b"))
    return folds.role_at(log.where("op = 'GRANT'"), switches.select("file", "pos", F.when(~F.lower(role).isin("", "none", "default"), role).alias("role")))


P.frame("set_role", grantors, (ROLE_TEXT,), """
WITH e AS (SELECT CAST(CAST(ts AS DATE) AS STRING) AS file, event_id * 1024 AS place, event_type = 'signup' OR event_type = 'error' AND user_id % 2 = 0 AS sw, CASE WHEN event_type = 'signup' THEN 'r_' || (user_id % 7) ELSE '' END AS role FROM {events})
SELECT g.file, g.place + CASE WHEN g.sw THEN 16 ELSE 0 END AS pos, nullif(s.role, '') AS role FROM e g ASOF LEFT JOIN (SELECT file, place AS since, role FROM e WHERE sw) s ON g.file = s.file AND g.place >= s.since""")


def revokes(log: DataFrame) -> DataFrame:
    rows = lifecycle.permissions(tables(log)).where("op = 'REVOKE'")
    return rows.select(F.split("k", "::")[0].alias("table"), "grantee", "privilege", (F.col("pos") * 1000).alias("pos"))


P.frame("column_revoke_cascade", once(lambda log: folds.column_revokes(revokes(log), folds.column_lives(settled(evolution.column_events(log)))), *GIVEN, "schema", "name"), oracle="""
WITH a AS (SELECT * FROM {columns}), names AS (SELECT DISTINCT "table", "column" FROM a WHERE "column" <> ''),
c AS (SELECT "table", "column", pos, action FROM a WHERE action IN ('ADD', 'DROP') UNION ALL SELECT a."table", n."column", pos, 'DROP' FROM a JOIN names n ON a."table" = n."table" WHERE action = 'GONE'),
l AS (SELECT "table", "column", action, pos AS born, lead(pos) OVER (PARTITION BY "table", "column" ORDER BY pos) AS died FROM c),
r AS (SELECT schema || '.t_' || user_id AS "table", grantee, pos * 1000 AS pos FROM {log} WHERE op = 'REVOKE' AND object_type = 'TABLE')
SELECT r."table", l."column", grantee, 'SELECT' AS privilege, pos FROM r JOIN l ON r."table" = l."table" AND action = 'ADD' AND born < pos AND (died IS NULL OR died > pos)""")

def owners(log: DataFrame) -> DataFrame:
    """Each function's first owner and its last."""
    given = log.where("op = 'ALTER'").select("k", "pos", F.regexp_extract("sql", r"(?i)\bOWNER\s+TO\s+(\S+?)\s*;?$", 1).alias("new")).where("new <> ''")
    return given.groupBy("k").agg(F.min_by("new", "pos").alias("old"), F.max_by("new", "pos").alias("new"))


P.frame("owner_merge", once(lambda log: folds.owner_merged(folds.acl_replay(entries(log)), owners(log)), *GIVEN), oracle=f"""
WITH o AS (SELECT k, arg_min('r_' || (v % 7), pos) AS old, arg_max('r_' || (v % 7), pos) AS new FROM {{log}} WHERE op = 'ALTER' AND object_type = 'FUNCTION' GROUP BY k)
SELECT n.k, CASE WHEN grantee = old THEN new ELSE grantee END AS grantee, bool_or(grant_option) AS grant_option, count(*) AS n FROM {NET.replace('ACL', ACL_LOG)} n LEFT JOIN o ON n.k = o.k GROUP BY 1, 2""")
P.frame("initial_acl", once(lambda log: folds.initial_acl(log.where("op = 'CREATE'").select("k", "object_type", "schema", "pos"), log.where("op = 'GRANT' AND object_type = 'FUNCTION'").select("object_type", "schema", F.explode("grantees").alias("grantee"), F.lit("EXECUTE").alias("privilege"), "pos")), "k", "object_type", "op", "schema", "pos", "grantees"), oracle="""
WITH d AS (SELECT schema, grantee, min(pos) AS since FROM {log} WHERE op = 'GRANT' AND object_type = 'FUNCTION' GROUP BY ALL)
SELECT k, pos, d.grantee, 'EXECUTE' AS privilege FROM {log} l JOIN d ON l.schema = d.schema AND pos > since WHERE op = 'CREATE' AND object_type = 'FUNCTION'""")

#: Every nation is a database; its customers' tables and a column of theirs are renamed, and one in three moves to another schema.
RENAMES = """SELECT concat('n', c_nationkey) AS database, c_custkey * 8 + s.n AS seq, 0 AS stmt_idx, CASE s.n WHEN 0 THEN concat('CREATE TABLE t_', c_custkey, ' (id int, name text)') WHEN 1 THEN concat('CREATE VIEW v_', c_custkey, ' AS SELECT name FROM t_', c_custkey, ' WHERE name <> ''name''')
  WHEN 2 THEN concat('ALTER TABLE t_', c_custkey, ' RENAME COLUMN name TO full_name') WHEN 3 THEN concat('ALTER TABLE t_', c_custkey, ' RENAME TO c_', c_custkey) WHEN 4 THEN CASE WHEN c_custkey % 3 = 0 THEN concat('ALTER TABLE c_', c_custkey, ' SET SCHEMA app') ELSE 'SELECT 1' END
  ELSE concat('INSERT INTO ', CASE WHEN c_custkey % 3 = 0 THEN 'app.' ELSE '' END, 'c_', c_custkey, ' (full_name) SELECT x.name FROM t_x x') END AS sql FROM {customer}, (SELECT explode(array(0, 1, 2, 3, 4, 5)) AS n) s"""
P.frame("normalised_history", lambda log: normalize.normalised_log(dealt(log)), (RENAMES,), """
WITH c AS (SELECT c_custkey AS k, 'n' || c_nationkey AS database, CASE WHEN c_custkey % 3 = 0 THEN 'app.c_' ELSE 'c_' END || c_custkey AS t, c_custkey % 3 = 0 AS moved FROM {customer})
SELECT database, k * 8 + n AS seq, 0 AS stmt_idx, CASE n WHEN 0 THEN 'CREATE TABLE ' || t || ' (id int, full_name text)' WHEN 1 THEN 'CREATE VIEW v_' || k || ' AS SELECT full_name AS name FROM ' || t || ' WHERE full_name <> ''name''' WHEN 2 THEN '' WHEN 3 THEN ''
  WHEN 4 THEN CASE WHEN moved THEN '' ELSE 'SELECT 1' END ELSE 'INSERT INTO ' || t || ' (full_name) SELECT x.name FROM t_x x' END AS sql FROM c, (SELECT unnest(range(6)) AS n)""")
P.frame("modernised_statements", validate.modernise, oracle="""
SELECT k, pos, CASE WHEN object_type = 'FUNCTION' THEN 'CREATE ' || CASE WHEN v % 2 = 1 THEN 'OR REPLACE ' ELSE '' END || 'FUNCTION ' || schema || '.f_' || user_id || '(a int, b text DEFAULT ''x;'') RETURNS int LANGUAGE sql VOLATILE AS $f$ SELECT ' || v || '; $f$'
  ELSE 'ALTER TABLE ' || schema || '.t_' || user_id || ' ALTER COLUMN ' || col || ' TYPE varchar(' || v || ') USING ' || col || '::varchar(' || v || ')' END AS sql FROM {log} WHERE object_type = 'FUNCTION' AND op = 'CREATE' OR action = 'TYPE'""")
P.frame("structure_findings", once(validate.structure, "k", "pos", "op", "object_type", "schema", "name", "dependencies", "sql"), ("{graph_log}",), """
SELECT 'app.o_' || o_orderkey || '::TABLE' AS k, unnest(['NO_PRIMARY_KEY', 'FOREIGN_KEY_WITHOUT_INDEX']) AS finding FROM {orders}""")
P.frame("postflight_findings", once(lambda log: validate.after(log.where("object_type = 'TABLE'")), "k", "object_type", "sql"), oracle="SELECT k, 'DROPS' AS finding FROM {log} WHERE object_type = 'TABLE' AND op = 'DROP'")

QUERIES, ORACLE_SQL = P.queries, P.oracle

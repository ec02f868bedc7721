"""Plans over statement texts and types."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithic.functions import pgtypes
from lithic.operators import extras, lint, parse, plugins

from .base import Plans
from .histories import dealt, parsed

P = Plans()

P.frame(
    "statement_log",
    lambda log: log.select("pos", "object_type", "op", "schema", "name", "category", "function_signature", F.array_join("grantees", ",").alias("grantees"), F.array_join("privileges", ",").alias("privileges"), "if_not_exists"),
    oracle="""SELECT pos, object_type, op, schema, CASE object_type WHEN 'INDEX' THEN 'i_' || event_id WHEN 'SCHEMA' THEN schema WHEN 'FUNCTION' THEN 'f_' || user_id ELSE 't_' || user_id END AS name,
  CASE WHEN is_data THEN 'data' ELSE plain_category END AS category, CASE object_type WHEN 'FUNCTION' THEN '(integer,text)' ELSE '' END AS function_signature, coalesce(grantee, '') AS grantees,
  CASE WHEN grantee IS NULL THEN '' WHEN object_type = 'FUNCTION' THEN 'EXECUTE' ELSE 'SELECT' END AS privileges, if_exists AND op = 'CREATE' AS if_not_exists FROM {log}""",
)
P.frame("lock_levels", lambda log: log.select("pos", "lock", "no_txn", "duration"), oracle="SELECT pos, lock, no_txn, duration FROM {log}")
P.frame("lint_predicates", lambda log: lint.violations(log.select(F.col("pos").alias("id"), "sql")), oracle="""
SELECT pos AS id, unnest(CASE WHEN object_type = 'TABLE' AND op = 'DROP' THEN ['BREAKING.DROP_TABLE'] WHEN action = 'DROP' THEN ['BREAKING.DROP_COLUMN'] WHEN action = 'TYPE' THEN ['BREAKING.TYPE_CHANGE', 'HYGIENE.PREFER_TEXT']
  WHEN object_type = 'TABLE' AND op = 'CREATE' THEN ['HYGIENE.PREFER_BIGINT'] ELSE [] END) AS code FROM {log}""")
P.frame("lint_fixes", lambda log: lint.mended(log.select(F.col("pos").alias("id"), "sql")), oracle="""
SELECT pos AS id, CASE WHEN op = 'CREATE' THEN 'CREATE TABLE ' || CASE WHEN if_exists THEN 'IF NOT EXISTS ' ELSE '' END || t || ' (id bigint PRIMARY KEY, ' || col || ' bigint DEFAULT ' || v || ')' ELSE 'ALTER TABLE ' || t || ' ALTER COLUMN ' || col || ' TYPE text' END AS sql
FROM (SELECT *, schema || '.t_' || user_id AS t FROM {log} l WHERE object_type = 'TABLE') WHERE op = 'CREATE' OR action = 'TYPE'""")
FOUND = "SELECT o_orderpriority AS file, o_orderkey AS line, CASE o_orderkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END AS code FROM {orders}"
DIRECTIVES = "SELECT o_orderpriority AS file, o_orderkey AS low, o_orderkey + o_custkey % 3 AS high, CASE o_custkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'D' END AS code FROM {orders} WHERE o_orderstatus = 'F'"
P.frame("lint_suppression", lint.suppressed, (FOUND, DIRECTIVES), f"""
WITH v AS ({FOUND}), d AS ({DIRECTIVES}), s AS (SELECT v.file AS vf, v.line AS vl, d.file AS df, d.low AS dl FROM v JOIN d ON v.file = d.file AND v.code = d.code AND v.line BETWEEN d.low AND d.high)
SELECT file, line, code FROM v WHERE NOT EXISTS (SELECT 1 FROM s WHERE vf = file AND vl = line) UNION ALL SELECT file, low, 'META.UNUSED_IGNORE_DIRECTIVE' FROM d WHERE NOT EXISTS (SELECT 1 FROM s WHERE df = file AND dl = low)""")

TYPES = ["smallint", "int4", "bigint", "numeric(10,2)", "real", "double precision", "varchar(20)", "character", "text", "date", "timestamp without time zone", "timestamp with time zone", "boolean", "json", "jsonb", "uuid"]


def type_cast_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pgtypes.lattice(spark, TYPES)


P.queries["type_cast_lattice"] = type_cast_lattice
#: The server's casts, written down by themselves: numbers widen by rank, texts by kind, times by precision.
P.oracle["type_cast_lattice"] = """
WITH t(name, n, family, rank) AS (VALUES ('smallint', 'smallint', 'number', 1), ('int4', 'integer', 'number', 2), ('bigint', 'bigint', 'number', 3), ('numeric(10,2)', 'numeric', 'number', 4), ('real', 'real', 'number', 5),
  ('double precision', 'double precision', 'number', 6), ('varchar(20)', 'character varying', 'text', 2), ('character', 'character', 'text', 1), ('text', 'text', 'text', 3), ('date', 'date', 'time', 1),
  ('timestamp without time zone', 'timestamp without time zone', 'time', 2), ('timestamp with time zone', 'timestamp with time zone', 'time', 3), ('boolean', 'boolean', 'boolean', 1), ('json', 'json', 'json', 1), ('jsonb', 'jsonb', 'json', 2), ('uuid', 'uuid', 'uuid', 1)),
k AS (SELECT x.name AS source, y.name AS target, x.n AS a, y.n AS b, CASE
    WHEN x.n = y.n THEN 'same'
    WHEN x.family = 'number' AND y.family = 'number' AND x.rank < y.rank THEN 'implicit'
    WHEN x.family = 'text' AND y.family = 'text' AND x.rank < y.rank THEN 'implicit'
    WHEN x.family = 'time' AND y.family = 'time' AND y.rank = x.rank + 1 THEN 'implicit'
    WHEN (x.n, y.n) IN (('bigint', 'integer'), ('bigint', 'smallint'), ('integer', 'smallint'), ('double precision', 'real'), ('double precision', 'numeric'), ('real', 'numeric')) THEN 'assignment'
    WHEN x.family = 'text' AND y.family = 'text' THEN 'assignment'
    WHEN x.family = 'time' AND y.family = 'time' AND x.rank > y.rank THEN 'assignment'
    WHEN x.family = y.family AND x.family IN ('number', 'time', 'json') THEN 'explicit'
    WHEN y.n IN ('text', 'character varying') THEN 'explicit'
    WHEN x.n IN ('text', 'character varying') AND y.name = y.n THEN 'explicit' ELSE 'none' END AS kind FROM t x, t y)
SELECT source, target, kind, kind = 'explicit' AND (a, b) IN (('numeric', 'integer'), ('numeric', 'smallint'), ('numeric', 'bigint')) AS lossy,
  'ALTER COLUMN c TYPE ' || target || CASE WHEN kind = 'explicit' THEN ' USING c::' || target ELSE '' END AS ddl, kind <> 'none' AS reversible FROM k"""
P.frame("type_facts", lambda t: t.select("name", pgtypes.normalised(F.col("name")).alias("normal"), pgtypes.size(F.col("name")).alias("size"), pgtypes.dimensions(F.col("name")).alias("dims")), ("SELECT name FROM (VALUES ('INT4'), ('numeric(10,2)'), ('text[]'), ('bool'), ('int8[][]'), ('timestamp')) t(name)",), """
SELECT * FROM (VALUES ('INT4', 'integer', 4, 0), ('numeric(10,2)', 'numeric', -1, 0), ('text[]', 'text[]', -1, 1), ('bool', 'boolean', 1, 0), ('int8[][]', 'int8[][]', -1, 2), ('timestamp', 'timestamp', 8, 0)) t(name, normal, size, dims)""")

#: Every line item adds its supplier's and its part's table to its order's publication, many of them twice.
PUBLICATIONS = "SELECT l_orderkey * 8 + l_linenumber AS seq, 'lineitem' AS filename, concat('ALTER PUBLICATION p_', l_orderkey % 50, ' ADD TABLE app.s_', l_suppkey, ', part_', l_partkey % 97) AS content FROM {lineitem}"
P.frame("publication_dedup", lambda files: extras.publication_members(parsed(files)), (PUBLICATIONS,), """
WITH m AS (SELECT 'p_' || (l_orderkey % 50) AS publication, (l_orderkey * 8 + l_linenumber) * 1024 AS pos, l_suppkey AS s, l_partkey % 97 AS p FROM {lineitem})
SELECT publication, 'app.s_' || s AS "table", min(pos) AS pos FROM m GROUP BY ALL UNION ALL SELECT publication, 'public.part_' || p, min(pos) FROM m GROUP BY ALL""")
#: What suppliers say of platforms, extensions and ALTERs.
SAYS = """SELECT s_suppkey AS id, CASE s_suppkey % 10 WHEN 0 THEN 'CREATE EXTENSION IF NOT EXISTS "uuid-ossp"' WHEN 1 THEN 'SELECT earth_distance(a, b)' WHEN 2 THEN 'SELECT crypt(a, b), auth.uid() FROM auth.users' WHEN 3 THEN 'SELECT first_name, cost_center FROM t'
  WHEN 4 THEN 'SELECT clerk_user_id(), auth.uid()' WHEN 5 THEN 'ALTER TABLE a OWNER TO b' WHEN 6 THEN 'ALTER TABLE a DROP CONSTRAINT c' WHEN 7 THEN 'ALTER TABLE a ADD COLUMN d varchar(191)' WHEN 8 THEN 'INSERT INTO _prisma_migrations VALUES (1)' ELSE 'SELECT st_area(g)' END AS sql FROM {supplier}"""
P.frame("required_extensions", extras.required_extensions, (SAYS,), """
WITH k AS (SELECT DISTINCT s_suppkey % 10 AS k FROM {supplier}) SELECT e.name AS extension, CAST(e.place AS BIGINT) AS place FROM k JOIN (VALUES (0, 'uuid-ossp', 4), (1, 'earthdistance', 2), (1, 'cube', 1), (2, 'pgcrypto', 8), (9, 'postgis', 3)) e(k, name, place) ON k.k = e.k""")
P.frame("auth_service", lambda s: s.select("id", extras.auth_service(F.col("sql")).alias("service")), (SAYS,), "SELECT s_suppkey AS id, CASE s_suppkey % 10 WHEN 4 THEN 'clerk' WHEN 2 THEN 'supabase' ELSE 'none' END AS service FROM {supplier}")
P.frame("separate_alters", extras.separate_alters, (SAYS,), "SELECT s_suppkey AS id, CASE s_suppkey % 10 WHEN 5 THEN 'OWNER' ELSE 'CONSTRAINT' END AS reasons FROM {supplier} WHERE s_suppkey % 10 IN (5, 6)")
P.frame("plugin_detection", plugins.detected, (SAYS,), """
WITH n AS (SELECT count(*) FILTER (s_suppkey % 10 = 4) AS clerk, count(*) FILTER (s_suppkey % 10 IN (2, 4)) AS supa, count(*) FILTER (s_suppkey % 10 IN (7, 8)) AS prisma, count(DISTINCT s_suppkey % 10) FILTER (s_suppkey % 10 IN (7, 8)) AS marks,
  count(*) FILTER (s_suppkey % 10 = 8) AS sure, count(*) FILTER (s_suppkey % 10 = 2) AS users FROM {supplier})
SELECT 'clerk' AS plugin, 100 AS priority, clerk AS statements, least(clerk, 1) AS marks, clerk > 0 AS found, clerk > 0 AS certain FROM n UNION ALL SELECT 'supabase', 90, supa, least(supa, 1) + least(users, 1), supa > 0, FALSE FROM n UNION ALL
SELECT 'prisma', 80, prisma, marks, prisma > 0, sure > 0 FROM n UNION ALL SELECT 'drizzle', 70, 0, 0, FALSE, FALSE FROM n""")
P.frame("rollback_plan", extras.rollback_plan, oracle="""
WITH l AS (SELECT *, schema || CASE object_type WHEN 'FUNCTION' THEN '.f_' ELSE '.t_' END || user_id AS o FROM {log}),
s AS (SELECT *, CASE WHEN object_type = 'FUNCTION' THEN CASE op WHEN 'CREATE' THEN 'DROP FUNCTION IF EXISTS ' || o || '(integer,text);' WHEN 'GRANT' THEN 'REVOKE EXECUTE ON FUNCTION ' || o || '(int, text) FROM ' || grantee || ';' END
  WHEN object_type = 'SCHEMA' THEN 'REVOKE SELECT ON ALL TABLES IN SCHEMA ' || schema || ' FROM ' || grantee || ';' WHEN object_type = 'INDEX' THEN 'DROP INDEX CONCURRENTLY IF EXISTS i_' || event_id || ';'
  WHEN op = 'CREATE' THEN 'DROP TABLE IF EXISTS ' || o || ';' WHEN op = 'GRANT' THEN 'REVOKE SELECT ON ' || o || ' FROM ' || grantee || ';' WHEN action = 'ADD' THEN 'ALTER TABLE ' || o || ' DROP COLUMN ' || col || ';'
  WHEN action = 'NOT_NULL' THEN 'ALTER TABLE ' || o || ' ALTER COLUMN ' || col || ' DROP NOT NULL;' WHEN action = 'ENABLE' THEN 'ALTER TABLE ' || o || ' DISABLE ROW LEVEL SECURITY;' WHEN action = 'NO FORCE' THEN 'ALTER TABLE ' || o || ' FORCE ROW LEVEL SECURITY;' END AS statement FROM l)
SELECT k, pos, row_number() OVER (PARTITION BY k ORDER BY pos DESC) AS step, CASE WHEN op = 'DROP' THEN 'RESTORE' WHEN statement IS NOT NULL THEN 'REVERT' ELSE 'MANUAL' END AS action, statement FROM s""")
EDGES = "SELECT s_nationkey AS cycle, concat('o', CAST(s_suppkey AS STRING)) AS src, concat(CASE WHEN s_suppkey % 11 = 0 THEN 'foreign_' ELSE 'o' END, CAST(s_suppkey + 1 AS STRING)) AS dst, CASE s_suppkey % 4 WHEN 0 THEN 'TABLE' WHEN 1 THEN 'VIEW' WHEN 2 THEN 'FUNCTION' ELSE 'SCHEMA' END AS src_type, CASE s_suppkey % 5 WHEN 0 THEN 'TABLE' WHEN 1 THEN 'VIEW' WHEN 2 THEN 'FUNCTION' WHEN 3 THEN 'SCHEMA' ELSE 'EXTENSION' END AS dst_type FROM {supplier}"
P.frame("removed_edges", extras.removed_edges, (EDGES,), f"""
WITH w AS (SELECT cycle, src, dst, 100 + CASE WHEN dst LIKE 'foreign%' OR dst_type = 'EXTENSION' OR dst_type = 'SCHEMA' AND src_type <> 'SCHEMA' THEN 500 ELSE 0 END + CASE WHEN src_type = 'SCHEMA' OR dst_type = 'SCHEMA' THEN 200 ELSE 0 END
  + CASE WHEN src_type = 'TABLE' AND dst_type = 'TABLE' THEN 150 ELSE 0 END - CASE WHEN src_type = 'FUNCTION' AND dst_type = 'FUNCTION' THEN 50 ELSE 0 END - CASE WHEN src_type = 'VIEW' OR dst_type = 'VIEW' THEN 30 ELSE 0 END AS weight FROM ({EDGES}))
SELECT cycle, src, dst, weight FROM w QUALIFY row_number() OVER (PARTITION BY cycle ORDER BY weight, src, dst) = 1""")
P.frame("transaction_groups", extras.transaction_groups, oracle="""
SELECT k, count(*) AS n, CAST(count(*) FILTER (no_txn) + max(CASE WHEN no_txn THEN 0 ELSE 1 END) AS BIGINT) AS transactions FROM {log} GROUP BY k HAVING count(*) > 2""")
P.frame("parse_errors", lambda s: parse.errors(parse.statement_log(dealt(s).select(F.col("id").alias("seq"), F.lit("supplier").alias("filename"), F.col("sql").alias("content")))), (SAYS,), """
SELECT s_suppkey AS seq, 0 AS stmt_idx, 1 AS line, 'INFO' AS severity, 'QUERY' AS category, 'leave queries out of a history' AS suggestion FROM {supplier} WHERE s_suppkey % 10 IN (1, 2, 3, 4, 9)""")

QUERIES, ORACLE_SQL = P.queries, P.oracle

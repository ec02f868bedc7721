"""Plans over parsed histories: lifecycles, redundancy, planning; and differences of snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from lithic.operators import dependencies, diff, evolution, lifecycle, planner
from lithic.sources.checkpoints import settled

from .base import Plans, once

P = Plans()

P.frame("lifecycle_histories", lifecycle.histories, oracle="""
SELECT k, object_type, count(*) AS n, string_agg(op, '>' ORDER BY pos) AS ops, min(pos) AS first_pos, max(pos) AS last_pos FROM {log} GROUP BY k, object_type""")

P.frame("final_state", lifecycle.final_states, oracle="""
WITH e AS (SELECT k, object_type, arg_max(op, pos) AS last_op, max(pos) FILTER (op = 'CREATE') AS last_create,
  max(pos) FILTER (op NOT IN ('GRANT', 'REVOKE', 'COMMENT')) AS last_def, arg_max(op, pos) FILTER (op NOT IN ('GRANT', 'REVOKE', 'COMMENT')) AS last_def_op FROM {log} GROUP BY k, object_type),
f AS (SELECT k, object_type, CASE WHEN object_type = 'TABLE' AND last_op = 'DROP' THEN NULL WHEN object_type = 'TABLE' AND last_create IS NOT NULL THEN last_create WHEN last_def_op <> 'DROP' THEN last_def END AS final_pos FROM e)
SELECT * FROM f WHERE final_pos IS NOT NULL""")

P.frame("distinct_alters", lifecycle.distinct_alters, oracle="""
SELECT k, pos, row_number() OVER (PARTITION BY k ORDER BY pos) AS n FROM (
  SELECT k, min(pos) AS pos FROM {log} WHERE op = 'ALTER' GROUP BY k, CASE WHEN object_type = 'FUNCTION' THEN grantee_of ELSE action || CASE WHEN action IN ('ENABLE', 'NO FORCE') THEN '' ELSE col END || CASE WHEN action = 'TYPE' THEN CAST(v AS STRING) ELSE '' END END)""".replace("grantee_of", "CAST(v % 7 AS STRING)"))

P.frame("redundancy", lifecycle.redundancy, oracle="""
WITH s AS (SELECT *, lead(op) OVER w AS next_op, row_number() OVER w AS rn FROM {log} WINDOW w AS (PARTITION BY k ORDER BY pos)),
c AS (SELECT k, count(*) AS n, max(CASE WHEN rn = 1 THEN op END) AS first_op, count(*) FILTER (rn > 1 AND op = 'ALTER') AS alters,
  count(DISTINCT file) FILTER (rn > 1 AND op = 'ALTER') AS files, coalesce(bool_or(is_data) FILTER (rn > 1), FALSE) AS data,
  count(*) FILTER (op = 'DROP' AND next_op = 'CREATE') AS pairs, count(*) FILTER (op = 'CREATE') AS creates FROM s GROUP BY k HAVING count(*) > 1),
p AS (SELECT *, CASE WHEN first_op = 'CREATE' AND alters > 0 AND NOT data THEN 'CREATE_ALTER_SEQUENCE' WHEN pairs > 0 THEN 'DROP_CREATE_SEQUENCE' WHEN creates > 1 THEN 'DUPLICATE_OPERATIONS' END AS pattern FROM c)
SELECT k, pattern, CASE pattern WHEN 'CREATE_ALTER_SEQUENCE' THEN alters WHEN 'DROP_CREATE_SEQUENCE' THEN 1 ELSE creates - 1 END AS statements_reduced,
  CASE pattern WHEN 'CREATE_ALTER_SEQUENCE' THEN files WHEN 'DROP_CREATE_SEQUENCE' THEN 2 ELSE creates END AS files_affected,
  CASE pattern WHEN 'CREATE_ALTER_SEQUENCE' THEN alters * 2 WHEN 'DROP_CREATE_SEQUENCE' THEN 3 ELSE (creates - 1) * 5 END AS lines_reduced FROM p WHERE pattern IS NOT NULL""")

P.frame("lifecycle_stats", lifecycle.statistics, oracle="""
WITH l AS (SELECT *, CASE WHEN is_data THEN 'data' ELSE plain_category END AS category, CASE WHEN op IN ('CREATE', 'DROP') THEN op WHEN op IN ('GRANT', 'REVOKE') THEN 'PERMISSION' WHEN is_data THEN 'DATA' ELSE 'ALTER' END AS change FROM {log})
SELECT 'type' AS dimension, object_type AS value, count(*) AS statements, count(DISTINCT k) AS objects FROM l GROUP BY ALL UNION ALL
SELECT 'category', category, count(*), count(DISTINCT k) FROM l GROUP BY ALL UNION ALL SELECT 'operation', op, count(*), count(DISTINCT k) FROM l GROUP BY ALL UNION ALL
SELECT 'change', change, count(*), count(DISTINCT k) FROM l GROUP BY ALL UNION ALL SELECT 'all', '', count(*), count(DISTINCT k) FROM l""")
P.frame("highest_risk", lifecycle.highest_risk, oracle="""
SELECT k, CASE max(r) WHEN 1 THEN 'LOW' WHEN 2 THEN 'MEDIUM' WHEN 3 THEN 'HIGH' ELSE 'CRITICAL' END AS risk, max(r) AS risk_rank
FROM (SELECT k, CAST(list_position(['LOW', 'MEDIUM', 'HIGH', 'CRITICAL'], risk) AS BIGINT) AS r FROM {log}) GROUP BY k""")
P.frame("create_conflicts", lifecycle.create_conflicts, oracle="SELECT k, count(*) FILTER (op = 'CREATE') > 1 AS conflict, bool_or(is_data) AS has_data FROM {log} GROUP BY k")
P.frame("net_permissions", once(lambda log: lifecycle.net_permissions(lifecycle.permissions(log)), "k", "pos", "op", "sql", "grantees", "privileges"), oracle="""
WITH l AS (SELECT k, grantee, CASE object_type WHEN 'FUNCTION' THEN 'EXECUTE' ELSE 'SELECT' END AS privilege, max(pos) AS pos, arg_max(op, pos) AS op FROM {log} WHERE op IN ('GRANT', 'REVOKE') GROUP BY ALL),
r AS (SELECT k, max(pos) AS reset FROM {log} WHERE op IN ('CREATE', 'DROP') GROUP BY k)
SELECT l.k, grantee, privilege, pos FROM l LEFT JOIN r ON l.k = r.k WHERE op = 'GRANT' AND (reset IS NULL OR pos > reset)""")
P.frame("history_position", lifecycle.history_positions, oracle="SELECT k, coalesce(max(pos) FILTER (op = 'CREATE'), min(pos)) AS position FROM {log} GROUP BY k")
P.frame("drop_create_pairs", lifecycle.drop_create_pairs, oracle="""
SELECT k, pos, next_pos FROM (SELECT k, pos, op, lead(op) OVER w AS next_op, lead(pos) OVER w AS next_pos FROM {log} WINDOW w AS (PARTITION BY k ORDER BY pos)) WHERE op = 'DROP' AND next_op = 'CREATE'""")
P.frame("type_changes", lambda log: lifecycle.type_changes(evolution.column_events(log)), oracle="""
SELECT "table", "column", pos, old_type, new_type FROM (SELECT "table", "column", pos, lag(t) OVER (PARTITION BY "table", "column" ORDER BY pos) AS old_type, t AS new_type
  FROM (SELECT "table", "column", pos, CASE WHEN action <> 'DROP' THEN value END AS t FROM {columns} WHERE action IN ('ADD', 'TYPE', 'DROP'))) WHERE old_type <> new_type""")
P.frame("type_usage", lambda log: evolution.type_usage(evolution.column_events(log)), oracle="""
SELECT value AS type, count(*) AS n, count(DISTINCT ("table", "column")) AS columns FROM {columns} WHERE action IN ('ADD', 'TYPE') GROUP BY value""")
P.frame("data_concat", lifecycle.data_concat, oracle="""
SELECT k, string_agg('INSERT INTO s' || (user_id % 10) || '.t_' || user_id || ' VALUES (' || event_id || ', ''x;y'');', chr(10) ORDER BY pos) AS sql FROM {log} WHERE is_data GROUP BY k""")
P.frame("insert_before_use", lifecycle.last_insert, oracle="""
SELECT * FROM (SELECT k, pos, op, max(CASE WHEN op = 'INSERT' THEN pos END) OVER (PARTITION BY k ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_insert FROM {log}) WHERE op <> 'INSERT'""")
P.frame("warning_dedup", lambda log: lifecycle.warning_counts(log.select(F.col("risk").alias("severity"), F.col("object_type").alias("category"), F.concat_ws(" ", "op", "k").alias("message"))), oracle="""
SELECT risk AS severity, object_type AS category, count(DISTINCT (op, k)) AS n FROM {log} GROUP BY ALL""")
P.frame("validation_metrics", lambda runs: lifecycle.validation_metrics(runs), ("SELECT o_orderpriority AS file, o_totalprice AS seconds, o_orderstatus <> 'P' AS ok FROM {orders}",), """
SELECT o_orderpriority AS file, count(*) AS total, count(*) FILTER (o_orderstatus <> 'P') AS succeeded, round(avg(o_totalprice), 6) AS mean, max(o_totalprice) AS longest,
  round(100.0 * count(*) FILTER (o_orderstatus <> 'P') / count(*), 6) AS success_rate FROM {orders} GROUP BY 1""")
P.frame("savings_summary", once(lifecycle.savings_summary, "k", "pos", "op", "file", "is_data"), oracle=None)
P.frame("history_compaction", once(lambda log: lifecycle.compacted(log, 20), "k", "pos"), oracle="""
SELECT k, pos FROM {log} QUALIFY count(*) OVER (PARTITION BY k) <= 20 OR pos = min(pos) OVER (PARTITION BY k) OR pos = max(pos) OVER (PARTITION BY k)""")
P.frame("ddl_cycles", lifecycle.ddl_cycles, oracle="""
WITH c AS (SELECT k, count(*) FILTER (op = 'CREATE') AS c, count(*) FILTER (op = 'DROP') AS d, count(*) FILTER (op = 'ALTER') AS a, count(*) FILTER (op IN ('GRANT', 'REVOKE')) AS g FROM {log} GROUP BY k),
f AS (SELECT *, CASE WHEN c > 1 AND d > 1 THEN 'complex' WHEN c > 0 AND d > 0 AND a = 0 THEN 'transient' WHEN d > 0 THEN 'simple' WHEN c > 1 THEN 'versioning' ELSE 'none' END AS kind FROM c)
SELECT k, kind, CASE kind WHEN 'complex' THEN 'HIGH' WHEN 'transient' THEN 'MEDIUM' WHEN 'simple' THEN 'MEDIUM' ELSE 'LOW' END AS severity, d > 0 AND g = 0 AS optimisable FROM f""")

BATCHES = """WITH e AS (SELECT *, CASE WHEN no_txn OR coalesce(lag(no_txn) OVER (PARTITION BY file ORDER BY pos), TRUE) THEN 1 ELSE 0 END AS edge FROM {log}),
b AS (SELECT *, lock = 'ACCESS_EXCLUSIVE' AS ae, CAST(sum(edge) OVER (PARTITION BY file ORDER BY pos) AS BIGINT) AS batch FROM e)"""
P.frame("tx_batches", planner.batch_summary, oracle=BATCHES + """
SELECT file, batch, count(*) AS n, arg_max(lock, list_position(['NONE', 'ACCESS_SHARE', 'ROW_SHARE', 'ROW_EXCLUSIVE', 'SHARE_UPDATE_EXCLUSIVE', 'SHARE', 'SHARE_ROW_EXCLUSIVE', 'EXCLUSIVE', 'ACCESS_EXCLUSIVE'], lock)) AS max_lock,
  arg_max(duration, list_position(['FAST', 'MEDIUM', 'SLOW'], duration)) AS max_duration, bool_or(no_txn) AS no_txn FROM b GROUP BY file, batch""")
P.frame("lock_conflicts", planner.lock_conflicts, oracle=BATCHES + """
SELECT file, severity, count(*) AS n FROM (
  SELECT x.file, CASE WHEN x.batch <> y.batch THEN 'LOW' WHEN x.ae AND y.ae THEN 'HIGH' WHEN x.no_txn <> y.no_txn THEN 'MEDIUM' END AS severity
  FROM b x JOIN b y ON x.file = y.file AND x.k = y.k AND (x.batch = y.batch AND x.pos < y.pos OR x.batch + 1 = y.batch)) WHERE severity IS NOT NULL GROUP BY file, severity""")
P.frame("tx_warnings", planner.batch_warnings, oracle=BATCHES + """,
s AS (SELECT file, batch, count(*) AS n, bool_or(ae) AS ae, bool_or(duration = 'SLOW') AS slow, count(DISTINCT k) FILTER (op = 'ALTER' AND object_type = 'TABLE') AS altered, count(*) FILTER (no_txn) AS concurrent FROM b GROUP BY file, batch)
SELECT file, batch, unnest(list_filter([CASE WHEN n > 50 THEN 'MANY_STATEMENTS' END, CASE WHEN slow THEN 'SLOW' END, CASE WHEN ae THEN 'ACCESS_EXCLUSIVE' END, CASE WHEN altered > 1 THEN 'SEVERAL_TABLES' END,
  CASE WHEN concurrent > 5 THEN 'MANY_CONCURRENT' END], lambda x: x IS NOT NULL)) AS warning FROM s""")
P.frame("pending_constraints", lambda log: dependencies.pending_constraints(settled(dependencies.constraint_events(log))), ("{order_log}",), """
WITH e AS (SELECT 'public.c_' || o_custkey || '::TABLE' AS k, 'k_' || (o_orderkey % 3) AS name, o_orderkey * 1024 AS pos, o_orderstatus AS s FROM {orders}),
g AS (SELECT k, max(pos) AS gone FROM e WHERE s NOT IN ('O', 'F') GROUP BY k), l AS (SELECT k, name, max(pos) AS pos, arg_max(s, pos) AS s FROM e WHERE s IN ('O', 'F') GROUP BY k, name)
SELECT l.k, name, pos FROM l LEFT JOIN g ON l.k = g.k WHERE s = 'O' AND (gone IS NULL OR gone < pos)""")

EXPECTED = "SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM {customer} WHERE c_custkey % 10 <> 1"
ACTUAL = "SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_name END AS c_name, CASE WHEN c_custkey % 11 = 0 THEN c_nationkey + 1 ELSE c_nationkey END AS c_nationkey, c_mktsegment FROM {customer} WHERE c_custkey % 10 <> 2"
P.frame("catalog_diff", lambda e, a: diff.catalog_diff(e, a, ["c_custkey"], ["c_name", "c_nationkey", "c_mktsegment"]), (EXPECTED, ACTUAL), f"""
WITH e AS ({EXPECTED}), a AS ({ACTUAL})
SELECT c_custkey, 'missing' AS change, '' AS property FROM e WHERE c_custkey NOT IN (SELECT c_custkey FROM a) UNION ALL
SELECT c_custkey, 'unexpected', '' FROM a WHERE c_custkey NOT IN (SELECT c_custkey FROM e) UNION ALL
SELECT e.c_custkey, 'changed', 'c_name' FROM e JOIN a USING (c_custkey) WHERE e.c_name IS DISTINCT FROM a.c_name UNION ALL
SELECT e.c_custkey, 'changed', 'c_nationkey' FROM e JOIN a USING (c_custkey) WHERE e.c_nationkey IS DISTINCT FROM a.c_nationkey UNION ALL
SELECT e.c_custkey, 'changed', 'c_mktsegment' FROM e JOIN a USING (c_custkey) WHERE e.c_mktsegment IS DISTINCT FROM a.c_mktsegment""")
#: Whole order lines on both sides; on the right, some orders have another priority.
LEFT = "SELECT concat(CAST(o_orderkey AS STRING), '|', CAST(o_custkey AS STRING), '|', o_orderpriority) AS line FROM {orders}"
RIGHT = "SELECT concat(CAST(o_orderkey AS STRING), '|', CAST(o_custkey AS STRING), '|', CASE WHEN o_orderkey % 7 = 0 THEN 'CHANGED' ELSE o_orderpriority END) AS line FROM {orders}"
SETS = f"SELECT 'left' AS side, line FROM (({LEFT}) EXCEPT ({RIGHT})) UNION ALL SELECT 'right', line FROM (({RIGHT}) EXCEPT ({LEFT}))"
P.frame("line_set_diff", diff.line_difference, (LEFT, RIGHT), SETS)
P.frame("diff_topk", lambda a, b: diff.truncated(diff.line_difference(a, b), 25), (LEFT, RIGHT), f"""
WITH d AS ({SETS}), f AS (SELECT side, line FROM d ORDER BY side, line LIMIT 25)
SELECT side, line FROM f UNION ALL SELECT '~', 'omitted ' || (count(*) - 25) FROM d HAVING count(*) > 25""")
EXT_E = "SELECT n_name AS name, n_regionkey AS version FROM {nation} WHERE n_nationkey % 4 <> 0"
EXT_A = "SELECT n_name AS name, CASE WHEN n_nationkey % 6 = 1 THEN n_regionkey + 1 ELSE n_regionkey END AS version FROM {nation} WHERE n_nationkey % 5 <> 0"
P.frame("extension_compare", lambda e, a: diff.extension_differences(e, a, ["ALGERIA", "BRAZIL", "CHINA"]), (EXT_E, EXT_A), f"""
WITH e AS ({EXT_E}), a AS ({EXT_A}), pre AS (SELECT unnest(['ALGERIA', 'BRAZIL', 'CHINA']) AS name)
SELECT name, 'missing' AS finding FROM e WHERE name NOT IN (SELECT name FROM a) AND name NOT IN (SELECT name FROM pre) UNION ALL
SELECT name, 'unexpected' FROM a WHERE name NOT IN (SELECT name FROM e) AND name NOT IN (SELECT name FROM pre) UNION ALL SELECT e.name, 'version' FROM e JOIN a USING (name) WHERE e.version <> a.version""")
ORDERED = "SELECT n_regionkey, n_name, n_nationkey AS place FROM {nation} WHERE n_nationkey % 7 <> 0"
REORDERED = "SELECT n_regionkey, n_name, CASE WHEN n_regionkey % 2 = 0 THEN -n_nationkey ELSE n_nationkey END AS place FROM {nation} WHERE n_nationkey % 9 <> 1"
P.frame("column_order_drift", lambda e, a: diff.order_drift(e, a, "n_regionkey", "n_name", "place"), (ORDERED, REORDERED), f"""
WITH e AS ({ORDERED}), a AS ({REORDERED}), s AS (SELECT e.n_regionkey, e.n_name, e.place AS ep, a.place AS ap FROM e JOIN a USING (n_regionkey, n_name)),
l AS (SELECT n_regionkey, string_agg(n_name, ',' ORDER BY ep) AS expected_order, string_agg(n_name, ',' ORDER BY ap) AS actual_order FROM s GROUP BY n_regionkey) SELECT * FROM l WHERE expected_order <> actual_order""")
LINES = "SELECT p_brand AS model, concat(p_type, '|', p_name) AS line FROM {part}"
P.frame("model_fingerprint", lambda x: diff.fingerprint(x, "model"), (LINES,), f"SELECT model, sha256(string_agg(line, chr(10) ORDER BY line)) AS fingerprint, count(*) AS n_lines FROM ({LINES}) GROUP BY model")
P.frame("numbered_names", lambda x: diff.numbered(x, "p_type", "p_partkey"), ("{part}",), """
SELECT p_partkey, p_type, p_type || CASE WHEN n = 0 THEN '' ELSE CAST(n AS STRING) END AS unique_name FROM (SELECT p_partkey, p_type, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) - 1 AS n FROM part)""")
P.frame("signatures", lambda x: x.select("p_partkey", diff.signature(F.lit("part"), F.col("p_name"), F.concat_ws("  ", "p_brand", "p_type")).alias("line")), ("{part}",), r"""
SELECT p_partkey, 'part|' || p_name || '|sha256:' || substr(sha256(trim(regexp_replace(lower(p_brand || '  ' || p_type), '\s+', ' ', 'g'))), 1, 32) AS line FROM part""")
SCOPED = "SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'ROLE' WHEN 'MACHINERY' THEN 'PRIVILEGES' ELSE 'TABLE' END AS kind, concat('s', c_nationkey) AS schema FROM {customer}"
P.frame("scope_filter", lambda c: diff.in_scope(c, [f"s{k}" for k in range(12)], privileges=True), (SCOPED,), f"SELECT * FROM ({SCOPED}) WHERE kind <> 'ROLE' AND CAST(substr(schema, 2) AS INT) < 12")

QUERIES, ORACLE_SQL = P.queries, P.oracle
ORACLE_SQL["savings_summary"] = f"""WITH r AS ({ORACLE_SQL['redundancy']}) SELECT count(*) AS objects, CAST(coalesce(sum(statements_reduced), 0) AS BIGINT) AS saved, (SELECT count(*) FROM events) AS statements,
  round(100.0 * coalesce(sum(statements_reduced), 0) / (SELECT count(*) FROM events), 4) AS percent FROM r"""

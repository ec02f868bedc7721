"""Plans over dependencies: graphs of keys, and what parsed histories use, provide and drop."""

from __future__ import annotations

from pyspark.sql import functions as F

from lithic.operators import dependencies, evolution, extras, graph, lifecycle, parse, rules
from lithic.sources.checkpoints import settled

from .base import Plans, once
from .histories import parsed

P = Plans()
#: What the operators of dependencies read of a log.
USED = ("k", "object_type", *dependencies.KEY, "pos", "op", "schema", "name", "uses")

#: Dependencies without cycles, two of each part on parts with at most half its key, and one of each supplier on any, with cycles. Keys are whole.
DAG = """SELECT p_partkey AS src, (p_partkey * 13 + p_size) % CAST(floor(p_partkey / 2) + 1 AS BIGINT) AS dst FROM {part} WHERE p_partkey > 0
UNION SELECT p_partkey, (p_partkey * 7 + p_size) % CAST(floor(p_partkey / 3) + 1 AS BIGINT) FROM {part} WHERE p_partkey > 0"""
CYCLIC = "SELECT s_suppkey AS src, CAST(floor(abs(s_acctbal) * 100) AS BIGINT) % (SELECT count(*) FROM {supplier}) AS dst FROM {supplier}"
REACH = f"WITH RECURSIVE e AS ({CYCLIC}), r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src)"
COMPONENTS = "n AS (SELECT src AS node FROM e UNION SELECT dst FROM e), c AS (SELECT node, least(node, coalesce(min(x.dst), node)) AS component FROM n LEFT JOIN (SELECT a.src, a.dst FROM r a JOIN r b ON a.src = b.dst AND a.dst = b.src) x ON n.node = x.src GROUP BY node)"

P.frame("dep_levels", graph.levels, (DAG,), f"""
WITH RECURSIVE e AS ({DAG}), n AS (SELECT src AS node FROM e UNION SELECT dst FROM e), p AS (
  SELECT node, 0 AS level FROM n WHERE node NOT IN (SELECT src FROM e) UNION SELECT e.src, p.level + 1 FROM p JOIN e ON e.dst = p.node)
SELECT node, CAST(max(level) AS BIGINT) AS level FROM p GROUP BY node""")
P.frame("reachability", graph.reachability, (CYCLIC,), f"{REACH} SELECT src, dst FROM r")
P.frame("scc", graph.strong_components, (CYCLIC,), f"{REACH}, {COMPONENTS} SELECT node, component FROM c")
P.frame("cyclic_nodes", graph.cyclic_nodes, (CYCLIC,), f"{REACH} SELECT src AS node FROM r WHERE src = dst")
P.frame("deferred_fks", graph.deferred_edges, (CYCLIC,), f"{REACH}, {COMPONENTS} SELECT DISTINCT e.src, e.dst FROM e JOIN c a ON e.src = a.node JOIN c b ON e.dst = b.node WHERE a.component = b.component")
P.frame("cycle_breakers", graph.cycle_breakers, (CYCLIC, "SELECT s_suppkey AS node, -s_suppkey AS position FROM {supplier}"), f"""
{REACH}, {COMPONENTS}, p AS (SELECT s_suppkey AS node, -s_suppkey AS position FROM supplier)
SELECT component, arg_min(c.node, (position, c.node)) AS first FROM c JOIN p ON c.node = p.node WHERE c.node IN (SELECT src FROM r WHERE src = dst) GROUP BY component""")

#: What the graph's history means: customers are tables app.c_, orders tables app.o_ with an index each and views app.v_ of every fifth.
BORN = """c AS (SELECT 'app.c_' || c_custkey AS t, c_acctbal < 0 AS gone FROM {customer}), o AS (SELECT o_orderkey AS id, 'app.c_' || o_custkey AS t, o_orderkey % 5 = 0 AS view FROM {orders})"""
P.frame("dropped_tables_filter", once(lambda log: dependencies.without_dropped(log).select("k", "op"), *USED), ("{graph_log}",), f"""
WITH {BORN}, d AS (SELECT t FROM c WHERE gone) SELECT t || '::TABLE' AS k, 'CREATE' AS op FROM c WHERE NOT gone UNION ALL SELECT 'app.o_' || id || '::TABLE', 'CREATE' FROM o UNION ALL
SELECT 'app.i_' || id || '::INDEX', 'CREATE' FROM o WHERE t NOT IN (SELECT t FROM d) UNION ALL SELECT 'app.v_' || id || '::VIEW', 'CREATE' FROM o WHERE view AND t NOT IN (SELECT t FROM d)""")
P.frame("dropped_references", once(lambda log: dependencies.without_dropped_references(log).where("startswith(name, 'o_')").select("k", F.regexp_extract("sql", r"REFERENCES (\S+?)[ (]", 1).alias("refers_to")), *USED, "sql"), ("{graph_log}",), f"""
WITH {BORN} SELECT 'app.o_' || id || '::TABLE' AS k, CASE WHEN c.gone THEN '' ELSE o.t END AS refers_to FROM o JOIN c ON o.t = c.t""")
P.frame("dependency_edges", once(dependencies.edges, *USED), ("{graph_log}",), f"""
WITH {BORN} SELECT 'app.o_' || id || '::TABLE' AS src, t || '::TABLE' AS dst FROM o UNION SELECT 'app.i_' || id || '::INDEX', t || '::TABLE' FROM o UNION SELECT 'app.v_' || id || '::VIEW', t || '::TABLE' FROM o WHERE view""")
P.frame("dependency_match", once(lambda log: dependencies.matches(log).groupBy("class", "object_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("dst").alias("providers")), *USED), ("{graph_log}",), f"""
WITH {BORN} SELECT 'table' AS class, 'TABLE' AS object_type, count(*) AS n, count(DISTINCT t) AS providers FROM o UNION ALL SELECT 'table', 'INDEX', count(*), count(DISTINCT t) FROM o UNION ALL SELECT 'table', 'VIEW', count(*), count(DISTINCT t) FROM o WHERE view""")
P.frame("fk_unique_index", lambda log: evolution.unique_targets(settled(evolution.keys(log))), ("{graph_log}",), """
SELECT 'app.o_' || o_orderkey AS "table", 'c' AS columns, 'app.c_' || o_custkey AS ref_table, CASE o_orderkey % 2 WHEN 0 THEN 'id' ELSE 'code' END AS ref_columns, 1 AS targets FROM {orders}""")
#: Some customers' tables are never created.
PARTIAL = """SELECT c_custkey AS seq, 'customer' AS filename, concat('CREATE TABLE c_', c_custkey, ' (id bigint)') AS content FROM {customer} WHERE c_nationkey % 3 <> 0 UNION ALL
  SELECT 1000000000 + o_orderkey, 'orders', concat('CREATE VIEW v_', o_orderkey, ' AS SELECT id, auth.uid() AS u FROM c_', o_custkey, ' JOIN auth.users ON TRUE') FROM {orders}"""
P.frame("orphan_dependencies", lambda files: once(dependencies.never_created, *USED)(parsed(files)), (PARTIAL,), """
SELECT DISTINCT 'table' AS class, 'public.c_' || o_custkey AS full FROM {orders} JOIN {customer} ON o_custkey = c_custkey WHERE c_nationkey % 3 = 0""")
P.frame("orphan_functions", once(lambda log: dependencies.without_orphans(log).select("k", "pos"), "k", "pos", "op", "object_type"), oracle="""
SELECT k, pos FROM {log} WHERE object_type <> 'FUNCTION' OR k IN (SELECT k FROM {log} WHERE op = 'CREATE')""")
P.frame("privilege_split", lambda log: log.select("pos", dependencies.privilege_owned(F.col("sql"), F.col("op"), F.col("object_type")).alias("privilege_owned")), oracle="""
SELECT pos, op IN ('GRANT', 'REVOKE') OR object_type = 'FUNCTION' AND op = 'ALTER' AS privilege_owned FROM {log}""")
P.frame("orphaned_index", once(lambda log: dependencies.orphaned_indexes(log, evolution.column_events(log).withColumn("pos", F.floor(F.col("pos") / 1000))), "k", "pos", "op", "object_type", "schema", "name", "dependencies", "sql"), oracle="""
SELECT DISTINCT i.k, i.col AS "column" FROM {log} i JOIN {log} d ON i.user_id = d.user_id AND i.col = d.col AND d.pos > i.pos WHERE i.object_type = 'INDEX' AND d.action = 'DROP'""")
#: Every supplier is a table whose ids come from its own sequence or from its predecessor's.
SEQUENCES = """SELECT s_suppkey AS seq, 'supplier' AS filename, concat('CREATE SEQUENCE app.q_', s_suppkey, '; CREATE TABLE app.t_', s_suppkey, ' (id bigint DEFAULT nextval(''app.q_', CASE WHEN s_nationkey % 2 = 0 THEN s_suppkey ELSE s_suppkey - 1 END,
  '''::regclass)); ALTER SEQUENCE app.q_', s_suppkey, ' OWNED BY app.t_', s_suppkey, '.id') AS content FROM {supplier}"""
P.frame("sequence_dependencies", lambda files: once(dependencies.edges, *USED)(parsed(files)), (SEQUENCES,), """
WITH s AS (SELECT s_suppkey AS k, CASE WHEN s_nationkey % 2 = 0 THEN s_suppkey ELSE s_suppkey - 1 END AS q FROM {supplier})
SELECT 'app.t_' || k || '::TABLE' AS src, 'app.q_' || q || '::SEQUENCE' AS dst FROM s WHERE q IN (SELECT k FROM s) UNION ALL SELECT 'app.q_' || k || '::SEQUENCE', 'app.t_' || k || '::TABLE' FROM s""")
#: Nations are enums, some of them alike.
ENUMS = """SELECT n_nationkey AS seq, 'nation' AS filename, concat('CREATE TYPE s', n_regionkey % 2, '.mood_', n_nationkey % 4, CASE n_nationkey % 3 WHEN 0 THEN '' WHEN 1 THEN '_enum' ELSE '_status' END, ' AS ENUM (''a'', ''b', n_nationkey % 2, ''')') AS content FROM {nation}"""
E_ROWS = """e AS (SELECT sch, name, arg_max(labels, pos) AS labels FROM (SELECT 's' || (n_regionkey % 2) AS sch, 'mood_' || (n_nationkey % 4) || CASE n_nationkey % 3 WHEN 0 THEN '' WHEN 1 THEN '_enum' ELSE '_status' END AS name, n_nationkey % 2 AS labels, n_nationkey AS pos FROM {nation}) GROUP BY sch, name),
s AS (SELECT *, regexp_replace(name, '_(enum|type|status)$', '') AS stem FROM e), p AS (SELECT a.sch AS schema, a.name AS kept, b.name AS merged FROM s a JOIN s b ON a.sch = b.sch AND a.labels = b.labels AND (a.stem <> a.name, a.name) < (b.stem <> b.name, b.name)
  AND (starts_with(a.name, b.name) OR starts_with(b.name, a.name) OR a.stem = b.stem))"""
P.frame("duplicate_enums", lambda files: evolution.similar_enums(settled(evolution.enums(parsed(files)))), (ENUMS,), f"WITH {E_ROWS} SELECT * FROM p")
P.frame("merged_enums", lambda files: evolution.merged_enums(settled(parsed(files)), "aggressive"), (ENUMS,), f"WITH {E_ROWS} SELECT *, TRUE AS done FROM p")
EXTENSIONS = "SELECT CASE n_nationkey WHEN 1 THEN 'postgis' WHEN 2 THEN 'pgcrypto' WHEN 3 THEN 'cube' ELSE lower(n_name) END AS extension FROM {nation}"
P.frame("extension_order", extras.extension_order, (EXTENSIONS,), f"SELECT extension, CAST(CASE extension WHEN 'postgis' THEN 3 WHEN 'pgcrypto' THEN 8 WHEN 'cube' THEN 1 ELSE 1000 END AS BIGINT) AS place FROM ({EXTENSIONS})")
P.frame("consolidation", lambda log: rules.consolidate(settled(log)).select("k", "rule", "n_before"), oracle="""
WITH g AS (SELECT k, user_id, max(pos) AS gone_at FROM {log} WHERE op IN ('CREATE', 'DROP') AND object_type = 'TABLE' GROUP BY k, user_id HAVING arg_max(op, pos) = 'DROP'),
l AS (SELECT l.* FROM {log} l LEFT JOIN g ON l.k = g.k WHERE NOT is_data AND (g.k IS NULL OR l.pos > gone_at)),
i AS (SELECT l.* FROM l LEFT JOIN g ON l.user_id = g.user_id AND l.object_type = 'INDEX' AND l.pos < gone_at WHERE g.k IS NULL),
f AS (SELECT * FROM i WHERE (object_type <> 'FUNCTION' OR k IN (SELECT k FROM i WHERE op = 'CREATE')) AND op NOT IN ('GRANT', 'REVOKE')),
s AS (SELECT k, any_value(object_type) AS t, count(*) AS n_before, coalesce(max(pos) FILTER (op = 'DROP'), -1) AS d, coalesce(max(pos) FILTER (op = 'CREATE'), -1) AS c FROM f GROUP BY k)
SELECT k, CASE WHEN t = 'TABLE' AND c > d THEN 'create_alter' WHEN t = 'FUNCTION' AND c > d THEN 'replaced' ELSE 'default' END AS rule, n_before FROM s WHERE NOT (d >= 0 AND c < d)""")

QUERIES, ORACLE_SQL = P.queries, P.oracle

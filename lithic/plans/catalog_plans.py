"""Catalog queries over a snapshot made from the driver's tables: customers are relations, orders their columns and constraints, parts indexes and policies, suppliers routines."""

from __future__ import annotations

from lithic.sources import catalog

from .base import Plans, for_duckdb, frame

P = Plans()

SNAPSHOT = {
    "pg_namespace": "SELECT r_regionkey AS oid, CASE r_regionkey WHEN 3 THEN 'pg_catalog' WHEN 4 THEN 'pg_toast' WHEN 0 THEN 'public' ELSE lower(r_name) END AS nspname FROM {region}",
    "pg_extension": "SELECT n_nationkey AS oid, lower(n_name) AS extname, concat('1.', n_nationkey) AS extversion, CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE n_regionkey END AS extnamespace FROM {nation}",
    "pg_depend": "SELECT c_custkey AS objid, CASE WHEN c_custkey % 2 = 0 THEN 'e' ELSE 'a' END AS deptype, 90 AS refobjid FROM {customer} WHERE c_custkey % 17 = 0",
    "pg_class": """SELECT c_custkey AS oid, concat('t_', c_custkey) AS relname, CASE c_custkey % 8 WHEN 3 THEN 'p' WHEN 4 THEN 'v' WHEN 5 THEN 'm' WHEN 6 THEN 'S' WHEN 7 THEN 'i' ELSE 'r' END AS relkind, c_nationkey % 5 AS relnamespace,
  c_custkey % 4 = 0 AS relrowsecurity, c_custkey % 16 = 0 AS relforcerowsecurity FROM {customer}""",
    "pg_attribute": """SELECT o_custkey AS attrelid, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS attnum, concat('c_', o_orderkey) AS attname, o_orderkey % 25 AS atttypid, o_orderkey % 3 = 0 AS attnotnull,
  CASE o_orderkey % 11 WHEN 0 THEN 'a' WHEN 1 THEN 'd' ELSE '' END AS attidentity, CASE WHEN o_orderkey % 13 = 0 THEN 's' ELSE '' END AS attgenerated, o_orderkey % 19 = 0 AS dropped FROM {orders}""",
    "pg_attrdef": "SELECT o_custkey AS adrelid, 1 AS adnum, concat('d', min(o_orderkey)) AS adsrc FROM {orders} GROUP BY o_custkey",
    "pg_type": "SELECT n_nationkey AS oid, concat('ty_', n_nationkey) AS typname, CASE n_nationkey % 4 WHEN 0 THEN 'b' WHEN 1 THEN 'e' WHEN 2 THEN 'd' ELSE 'c' END AS typtype, n_regionkey AS typnamespace, CASE WHEN n_nationkey % 4 = 2 THEN n_nationkey - 2 END AS typbasetype FROM {nation}",
    "pg_enum": "SELECT s_nationkey AS enumtypid, s_suppkey AS enumsortorder, concat('l', s_suppkey) AS enumlabel FROM {supplier} WHERE s_nationkey % 4 = 1",
    "pg_constraint": """SELECT o_orderkey AS oid, concat('k_', o_orderkey) AS conname, CASE o_orderkey % 4 WHEN 0 THEN 'p' WHEN 1 THEN 'f' WHEN 2 THEN 'u' ELSE 'c' END AS contype, o_custkey AS conrelid, CASE WHEN o_orderkey % 4 = 1 THEN o_custkey % 100 + 1 END AS confrelid,
  'a' AS confupdtype, CASE WHEN o_orderkey % 4 = 1 THEN CASE o_orderkey % 3 WHEN 0 THEN 'c' WHEN 1 THEN 'n' ELSE 'a' END END AS confdeltype, o_orderkey % 5 <> 0 AS convalidated FROM {orders}""",
    "pg_constraint_key": "SELECT l_orderkey AS conid, l_linenumber % 2 = 0 AS foreign_side, min(l_linenumber) AS place, l_linenumber AS attnum FROM {lineitem} GROUP BY l_orderkey, l_linenumber",
    "pg_index": "SELECT p_partkey AS indexrelid, p_partkey % 150 AS indrelid, p_partkey % 2 = 0 AS indisunique, p_partkey % 10 = 0 AS indisprimary, CASE WHEN p_partkey % 7 = 0 THEN 'x > 0' END AS indpred FROM {part}",
    "pg_trigger": "SELECT event_id AS oid, user_id AS tgrelid, concat('tg_', event_id) AS tgname, event_id % 32 AS tgtype, event_id % 9 = 0 AS internal, concat('EXECUTE FUNCTION ', event_type, '()') AS def FROM {events}",
    "pg_policy": "SELECT p_partkey AS oid, p_partkey % 150 AS polrelid, concat('po_', p_partkey) AS polname, CASE p_partkey % 3 WHEN 0 THEN 'r' WHEN 1 THEN '*' ELSE 'a' END AS polcmd, p_partkey % 2 = 0 AS polpermissive, CASE WHEN p_partkey % 5 <> 0 THEN concat('q', p_size) END AS qual FROM {part}",
    "pg_policy_role": "SELECT l_partkey AS polid, l_suppkey % 12 AS roleid, min(l_orderkey * 8 + l_linenumber) * 12 + l_suppkey % 12 AS place FROM {lineitem} GROUP BY l_partkey, l_suppkey % 12",
    "pg_roles": "SELECT n_nationkey AS oid, CASE WHEN n_nationkey % 6 = 5 THEN concat('pg_', lower(n_name)) ELSE lower(n_name) END AS rolname FROM {nation} WHERE n_nationkey > 0",
    "pg_proc": """SELECT s_suppkey AS oid, concat('f_', s_suppkey % 20) AS proname, s_nationkey % 5 AS pronamespace, CASE WHEN s_suppkey % 5 = 0 THEN 'p' ELSE 'f' END AS prokind, CASE s_suppkey % 3 WHEN 0 THEN 'i' WHEN 1 THEN 's' ELSE 'v' END AS provolatile,
  CASE WHEN s_suppkey % 2 = 0 THEN 'integer' ELSE 'text' END AS args, CASE WHEN s_suppkey % 5 <> 0 THEN 'text' END AS rettype, s_suppkey % 4 = 0 AS security FROM {supplier}""",
    "pg_sequence": "SELECT c_custkey AS seqrelid, 1 AS seqstart, c_custkey % 3 + 1 AS seqincrement, 1000 AS seqmax, c_custkey - 1 AS owner_rel, 1 AS owner_att FROM {customer} WHERE c_custkey % 8 = 6",
    "pg_views": "SELECT c_custkey AS oid, concat('SELECT  ', c_name, ' FROM t') AS definition FROM {customer} WHERE c_custkey % 8 IN (4, 5)",
    "pg_acl": """SELECT CASE o_orderkey % 3 WHEN 0 THEN 'relation' WHEN 1 THEN 'schema' ELSE 'routine' END AS kind, CASE o_orderkey % 3 WHEN 0 THEN o_custkey WHEN 1 THEN o_orderkey % 5 ELSE o_orderkey % 100 END AS oid, o_orderkey % 25 AS grantee,
  CASE WHEN o_orderkey % 2 = 0 THEN 'SELECT' ELSE 'UPDATE' END AS privilege, o_orderkey % 7 = 0 AS grantable FROM {orders}""",
    "pg_default_acl": "SELECT s_nationkey AS owner, CASE WHEN s_suppkey % 2 = 0 THEN 'TABLES' ELSE 'FUNCTIONS' END AS kind, s_suppkey % 25 AS grantee FROM {supplier}",
    "pg_description": "SELECT c_custkey AS objoid, 0 AS objsubid, CASE WHEN c_custkey % 4 <> 0 THEN c_name END AS description FROM {customer}",
    "pg_settings": "SELECT CASE r_regionkey WHEN 0 THEN 'server_version' WHEN 1 THEN 'search_path' ELSE lower(r_name) END AS name, concat('v', r_regionkey) AS setting FROM {region}",
}


def plan(name: str):
    tables, _ = catalog.CATALOG[name]

    def run(spark, sf_dir):
        return catalog.query(spark, {t: frame(spark, sf_dir, SNAPSHOT[t]) for t in tables}, name)

    sql = catalog.text(name)
    own = sql.removeprefix("WITH ") if sql.startswith("WITH ") else None
    ctes = ", ".join(f"{t} AS ({SNAPSHOT[t]})" for t in tables)
    P.queries[name], P.oracle[name] = run, for_duckdb(f"WITH {ctes}, {own}" if own else f"WITH {ctes} {sql}")


for _name in catalog.CATALOG:
    plan(_name)

QUERIES, ORACLE_SQL = P.queries, P.oracle

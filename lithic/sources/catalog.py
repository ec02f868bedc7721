"""Stored catalog snapshots (SRC-5..7) and the queries over them (CAT-1..6): one Parquet table for each of the server's catalog tables, by name."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: Each query's catalog tables and its text, for Spark; {sha}(x) is the SHA-256 of x in hexadecimal digits.
CATALOG: dict[str, tuple[tuple[str, ...], str]] = {}
#: The catalog tables that a snapshot may have.
TABLES = [
    "pg_namespace", "pg_extension", "pg_depend", "pg_class", "pg_attribute", "pg_attrdef", "pg_type", "pg_enum", "pg_constraint", "pg_constraint_key", "pg_index", "pg_trigger", "pg_policy", "pg_policy_role", "pg_roles", "pg_proc",
    "pg_sequence", "pg_views", "pg_acl", "pg_default_acl", "pg_description", "pg_settings",
]


def catalog(name: str, *tables: str, sql: str) -> None:
    CATALOG[name] = (tables, sql)


def read_snapshot(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """A snapshot's tables by name, of those that the folder has as <name>.parquet."""
    fs = spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    there = [t for t in TABLES if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{t}.parquet"))]
    return {t: spark.read.parquet(f"{folder}/{t}.parquet") for t in there}


def write_snapshot(snapshot: dict[str, DataFrame], folder: str) -> None:
    for name, df in snapshot.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


def text(name: str) -> str:
    """A query's text over tables of the catalog's names."""
    sql = CATALOG[name][1].strip()
    return "WITH " + sql[1:].strip() if sql.startswith(",") else sql


def query(spark: SparkSession, snapshot: dict[str, DataFrame], name: str) -> DataFrame:
    """A query over a snapshot. Its tables are known to the session only while the query is analysed. The server's concat passes over nulls; Spark's does not."""
    tables, _ = CATALOG[name]
    if missing := set(tables) - set(snapshot):
        raise ValueError(f"the snapshot lacks {sorted(missing)}")
    for t in tables:
        snapshot[t].createOrReplaceTempView(t)
    try:
        return spark.sql(re.sub(r"\{sha\}\((\w+)\)", r"sha2(\1, 256)", re.sub(r"\bconcat\(", "concat_ws('', ", text(name))))
    finally:
        for t in tables:
            spark.catalog.dropTempView(t)


USER = "nspname NOT IN ('pg_catalog', 'information_schema') AND nspname NOT LIKE 'pg_%' AND NOT EXISTS (SELECT 1 FROM pg_depend d WHERE d.objid = n.oid AND d.deptype = 'e')"
OWN = "NOT EXISTS (SELECT 1 FROM pg_depend d WHERE d.objid = c.oid AND d.deptype = 'e')"
RELATIONS, COLUMNS = ("pg_namespace", "pg_depend", "pg_class"), ("pg_namespace", "pg_depend", "pg_class", "pg_attribute", "pg_attrdef", "pg_type")

catalog("catalog_schemas", "pg_namespace", "pg_depend", sql=f" SELECT nspname FROM pg_namespace n WHERE {USER}")
catalog("catalog_extensions", "pg_namespace", "pg_extension", sql=" SELECT extname, extversion, coalesce(nspname, '') AS schema_name FROM pg_extension e LEFT JOIN pg_namespace n ON n.oid = e.extnamespace")
catalog("catalog_tables", *RELATIONS, sql=f" SELECT nspname, relname, relkind FROM pg_class c JOIN pg_namespace n ON n.oid = c.relnamespace WHERE relkind IN ('r', 'p') AND {OWN}")
catalog("catalog_columns", *COLUMNS, sql=f""" SELECT nspname, relname, attname, attnum, typname, NOT attnotnull AS nullable, coalesce(adsrc, '') AS default_value,
  CASE attidentity WHEN 'a' THEN 'ALWAYS' WHEN 'd' THEN 'BY DEFAULT' ELSE '' END AS identity, attgenerated <> '' AS generated
FROM pg_class c JOIN pg_namespace n ON n.oid = c.relnamespace JOIN pg_attribute a ON a.attrelid = c.oid JOIN pg_type t ON t.oid = a.atttypid LEFT JOIN pg_attrdef d ON d.adrelid = a.attrelid AND d.adnum = a.attnum
WHERE relkind IN ('r', 'p') AND NOT dropped AND {OWN}""")
catalog("catalog_constraints", "pg_class", "pg_attribute", "pg_constraint", "pg_constraint_key", sql=""", keys AS (SELECT k.conid, k.foreign_side, listagg(a.attname, ',') WITHIN GROUP (ORDER BY k.place) AS cols
  FROM pg_constraint_key k JOIN pg_constraint c ON c.oid = k.conid JOIN pg_attribute a ON a.attnum = k.attnum AND a.attrelid = CASE WHEN k.foreign_side THEN c.confrelid ELSE c.conrelid END GROUP BY k.conid, k.foreign_side)
SELECT t.relname, conname, CASE contype WHEN 'p' THEN 'PRIMARY KEY' WHEN 'f' THEN 'FOREIGN KEY' WHEN 'u' THEN 'UNIQUE' WHEN 'c' THEN 'CHECK' ELSE contype END AS kind, coalesce(own.cols, '') AS cols, coalesce(f.relname, '') AS references_table,
  coalesce(theirs.cols, '') AS references_cols, CASE confdeltype WHEN 'c' THEN 'CASCADE' WHEN 'n' THEN 'SET NULL' WHEN 'a' THEN 'NO ACTION' ELSE '' END AS on_delete, convalidated
FROM pg_constraint c JOIN pg_class t ON t.oid = c.conrelid LEFT JOIN pg_class f ON f.oid = c.confrelid LEFT JOIN keys own ON own.conid = c.oid AND NOT own.foreign_side LEFT JOIN keys theirs ON theirs.conid = c.oid AND theirs.foreign_side""")
catalog("catalog_indexes", "pg_class", "pg_attribute", "pg_index", sql=""" SELECT t.relname AS table_name, i.relname AS index_name, indisunique, indisprimary, coalesce(indpred, '') AS predicate, listagg(a.attname, ',') WITHIN GROUP (ORDER BY a.attnum) AS cols
FROM pg_index x JOIN pg_class i ON i.oid = x.indexrelid JOIN pg_class t ON t.oid = x.indrelid LEFT JOIN pg_attribute a ON a.attrelid = x.indexrelid GROUP BY t.relname, i.relname, indisunique, indisprimary, indpred""")
catalog("catalog_triggers", "pg_class", "pg_trigger", sql=r""" SELECT relname, tgname, CASE WHEN tgtype & 2 = 2 THEN 'BEFORE' ELSE 'AFTER' END AS timing, CASE WHEN tgtype & 1 = 1 THEN 'ROW' ELSE 'STATEMENT' END AS level,
  concat(CASE WHEN tgtype & 4 = 4 THEN 'I' ELSE '' END, CASE WHEN tgtype & 8 = 8 THEN 'D' ELSE '' END, CASE WHEN tgtype & 16 = 16 THEN 'U' ELSE '' END) AS events, regexp_extract(def, 'FUNCTION ([a-z_]+)', 1) AS fn
FROM pg_trigger g JOIN pg_class c ON c.oid = g.tgrelid WHERE NOT internal""")
catalog("catalog_policies", "pg_class", "pg_policy", "pg_policy_role", "pg_roles", sql=""" SELECT relname, polname, CASE polcmd WHEN 'r' THEN 'SELECT' WHEN '*' THEN 'ALL' ELSE polcmd END AS command, polpermissive, coalesce(qual, '') AS qual, listagg(coalesce(rolname, 'public'), ',') WITHIN GROUP (ORDER BY place) AS roles
FROM pg_policy p JOIN pg_class c ON c.oid = p.polrelid JOIN pg_policy_role x ON x.polid = p.oid LEFT JOIN pg_roles r ON r.oid = x.roleid GROUP BY relname, polname, polcmd, polpermissive, qual""")
catalog("catalog_row_security", "pg_class", sql=" SELECT relname, coalesce(relrowsecurity, FALSE) AS enabled, coalesce(relforcerowsecurity, FALSE) AS forced FROM pg_class WHERE relkind IN ('r', 'p')")
catalog("catalog_views", *RELATIONS, "pg_views", sql=f" SELECT nspname, relname, relkind = 'm' AS materialized, definition FROM pg_class c JOIN pg_namespace n ON n.oid = c.relnamespace JOIN pg_views v ON v.oid = c.oid WHERE {OWN}")
catalog("catalog_functions", "pg_namespace", "pg_proc", sql=" SELECT nspname, concat(proname, '(', args, ')') AS signature, CASE prokind WHEN 'p' THEN 'PROCEDURE' ELSE 'FUNCTION' END AS kind, CASE provolatile WHEN 'i' THEN 'IMMUTABLE' WHEN 's' THEN 'STABLE' ELSE 'VOLATILE' END AS volatility, security, coalesce(rettype, '') AS returns FROM pg_proc p JOIN pg_namespace n ON n.oid = p.pronamespace")
catalog("catalog_sequences", "pg_class", "pg_attribute", "pg_sequence", sql=" SELECT c.relname, seqstart, seqincrement, seqmax, concat(o.relname, '.', a.attname) AS owned_by FROM pg_sequence s JOIN pg_class c ON c.oid = s.seqrelid LEFT JOIN pg_class o ON o.oid = s.owner_rel LEFT JOIN pg_attribute a ON a.attrelid = s.owner_rel AND a.attnum = s.owner_att")
catalog("catalog_types", "pg_namespace", "pg_type", "pg_enum", sql=""", labels AS (SELECT enumtypid, listagg(enumlabel, ',') WITHIN GROUP (ORDER BY enumsortorder) AS labels FROM pg_enum GROUP BY enumtypid)
SELECT n.nspname, t.typname, CASE t.typtype WHEN 'e' THEN 'ENUM' WHEN 'd' THEN 'DOMAIN' WHEN 'c' THEN 'COMPOSITE' ELSE 'BASE' END AS kind, coalesce(labels, '') AS labels, coalesce(b.typname, '') AS base FROM pg_type t JOIN pg_namespace n ON n.oid = t.typnamespace LEFT JOIN labels l ON l.enumtypid = t.oid LEFT JOIN pg_type b ON b.oid = t.typbasetype WHERE n.nspname <> 'pg_catalog'""")
catalog("catalog_comments", "pg_class", "pg_attribute", "pg_proc", "pg_description", sql=""", objects AS (SELECT 'relation' AS kind, oid, 0 AS sub, relname AS name FROM pg_class UNION ALL SELECT 'column', attrelid, attnum, attname FROM pg_attribute WHERE NOT dropped UNION ALL SELECT 'routine', oid, 0, proname FROM pg_proc)
SELECT kind, name, description FROM objects o JOIN pg_description d ON d.objoid = o.oid AND d.objsubid = o.sub WHERE description IS NOT NULL""")
catalog("catalog_privileges", "pg_namespace", "pg_class", "pg_proc", "pg_roles", "pg_acl", sql=""", named AS (SELECT 'relation' AS kind, oid, relname AS name FROM pg_class UNION ALL SELECT 'schema', oid, nspname FROM pg_namespace UNION ALL SELECT 'routine', oid, concat(proname, '(', args, ')') FROM pg_proc)
SELECT kind, name, grantee, listagg(privilege, ',') WITHIN GROUP (ORDER BY privilege) AS privileges FROM (SELECT DISTINCT n.kind, n.name, coalesce(rolname, 'PUBLIC') AS grantee, concat(privilege, CASE WHEN grantable THEN '*' ELSE '' END) AS privilege
  FROM pg_acl a JOIN named n ON n.kind = a.kind AND n.oid = a.oid LEFT JOIN pg_roles r ON r.oid = a.grantee) p GROUP BY kind, name, grantee""")
catalog("catalog_signature", *COLUMNS, "pg_views", sql=""" SELECT concat('column|', nspname, '.', relname, '.', attname, '|', typname) AS line FROM pg_class c JOIN pg_namespace n ON n.oid = c.relnamespace JOIN pg_attribute a ON a.attrelid = c.oid JOIN pg_type t ON t.oid = a.atttypid WHERE relkind IN ('r', 'p') AND NOT dropped
UNION ALL SELECT concat('view|', relname, '|sha256:', substr(sha2_hex, 1, 32)) FROM (SELECT relname, {sha}(definition) AS sha2_hex FROM pg_views v JOIN pg_class c ON c.oid = v.oid) s""")
catalog("catalog_emptiness", *RELATIONS, "pg_type", "pg_proc", sql=f""" SELECT EXISTS (SELECT 1 FROM pg_class c WHERE {OWN}) OR EXISTS (SELECT 1 FROM pg_proc) OR EXISTS (SELECT 1 FROM pg_type WHERE typtype = 'e') AS has_objects""")
catalog("catalog_roles", "pg_roles", sql=" SELECT rolname FROM pg_roles WHERE rolname NOT LIKE 'pg_%'")
catalog("catalog_search", "pg_namespace", "pg_class", sql=" SELECT nspname, relname FROM (SELECT nspname, relname, row_number() OVER (PARTITION BY relname ORDER BY CASE nspname WHEN 'app' THEN 1 WHEN 'public' THEN 2 ELSE 3 END) AS rn FROM pg_class c JOIN pg_namespace n ON n.oid = c.relnamespace WHERE relname LIKE '%users%') s WHERE rn = 1")
catalog("catalog_flat", "pg_namespace", "pg_class", "pg_proc", "pg_type", sql=""" SELECT CASE relkind WHEN 'r' THEN 'table' WHEN 'p' THEN 'table' WHEN 'v' THEN 'view' WHEN 'm' THEN 'materialized view' WHEN 'S' THEN 'sequence' ELSE 'index' END AS kind, concat(nspname, '.', relname) AS name FROM pg_class c JOIN pg_namespace n ON n.oid = c.relnamespace
UNION ALL SELECT 'function', concat(nspname, '.', proname, '(', args, ')') FROM pg_proc p JOIN pg_namespace n ON n.oid = p.pronamespace UNION ALL SELECT 'type', concat(nspname, '.', typname) FROM pg_type t JOIN pg_namespace n ON n.oid = t.typnamespace WHERE nspname <> 'pg_catalog'""")

catalog("server_version", "pg_settings", sql=" SELECT setting AS version FROM pg_settings WHERE name = 'server_version'")
catalog("search_path", "pg_settings", sql=" SELECT setting AS search_path FROM pg_settings WHERE name = 'search_path'")
catalog("signature_extensions", "pg_extension", sql=" SELECT concat('extension|', extname, '|', extversion) AS line FROM pg_extension")
catalog("signature_constraints", "pg_namespace", "pg_class", "pg_constraint", sql=" SELECT concat('constraint|', nspname, '.', relname, '.', conname, '|', contype, '|', convalidated) AS line FROM pg_constraint k JOIN pg_class c ON c.oid = k.conrelid JOIN pg_namespace n ON n.oid = c.relnamespace")
catalog("signature_indexes", "pg_namespace", "pg_class", "pg_index", sql=""" SELECT concat('index|', nspname, '.', i.relname, '|', t.relname, '|', indisunique, '|', coalesce(indpred, '')) AS line
FROM pg_index x JOIN pg_class i ON i.oid = x.indexrelid JOIN pg_class t ON t.oid = x.indrelid JOIN pg_namespace n ON n.oid = i.relnamespace WHERE NOT indisprimary""")
catalog("signature_views", *RELATIONS, "pg_views", sql=f""" SELECT concat('view|', nspname, '.', relname, '|sha256:', substr({{sha}}(definition), 1, 32)) AS line FROM pg_views v JOIN pg_class c ON c.oid = v.oid JOIN pg_namespace n ON n.oid = c.relnamespace WHERE relkind IN ('v', 'm') AND {OWN}""")
catalog("signature_functions", "pg_namespace", "pg_proc", sql=" SELECT DISTINCT concat('function|', nspname, '.', proname, '(', args, ')|', prokind, '|', provolatile, '|', coalesce(rettype, '')) AS line FROM pg_proc p JOIN pg_namespace n ON n.oid = p.pronamespace WHERE prokind IN ('f', 'p')")
catalog("signature_triggers", "pg_namespace", "pg_class", "pg_trigger", sql=" SELECT concat('trigger|', nspname, '.', relname, '.', tgname, '|', tgtype, '|', def) AS line FROM pg_trigger g JOIN pg_class c ON c.oid = g.tgrelid JOIN pg_namespace n ON n.oid = c.relnamespace WHERE NOT internal")
catalog("signature_policies", "pg_namespace", "pg_class", "pg_policy", sql=" SELECT concat('policy|', nspname, '.', relname, '.', polname, '|', polcmd, '|', polpermissive, '|', coalesce(qual, '')) AS line FROM pg_policy p JOIN pg_class c ON c.oid = p.polrelid JOIN pg_namespace n ON n.oid = c.relnamespace")
catalog("signature_policy_roles", "pg_class", "pg_policy", "pg_policy_role", "pg_roles", sql=""" SELECT relname, polname, listagg(role, ',') WITHIN GROUP (ORDER BY role) AS roles FROM (
  SELECT DISTINCT relname, polname, coalesce(rolname, 'public') AS role FROM pg_policy p JOIN pg_class c ON c.oid = p.polrelid LEFT JOIN pg_policy_role x ON x.polid = p.oid LEFT JOIN pg_roles r ON r.oid = x.roleid) s GROUP BY relname, polname""")
catalog("signature_sequences", "pg_namespace", "pg_class", "pg_attribute", "pg_sequence", sql=""" SELECT concat_ws('|', 'sequence', concat(nspname, '.', c.relname), CAST(seqstart AS STRING), CAST(seqincrement AS STRING), CAST(seqmax AS STRING), concat(o.relname, '.', a.attname)) AS line
FROM pg_sequence s JOIN pg_class c ON c.oid = s.seqrelid JOIN pg_namespace n ON n.oid = c.relnamespace LEFT JOIN pg_class o ON o.oid = s.owner_rel LEFT JOIN pg_attribute a ON a.attrelid = s.owner_rel AND a.attnum = s.owner_att""")
catalog("signature_types", "pg_namespace", "pg_type", "pg_enum", "pg_depend", sql=""", labels AS (SELECT enumtypid, listagg(enumlabel, ',') WITHIN GROUP (ORDER BY enumsortorder) AS labels FROM pg_enum GROUP BY enumtypid)
SELECT concat('type|', nspname, '.', t.typname, '|', t.typtype, '|', coalesce(labels, ''), '|', coalesce(b.typname, '')) AS line FROM pg_type t JOIN pg_namespace n ON n.oid = t.typnamespace LEFT JOIN labels l ON l.enumtypid = t.oid LEFT JOIN pg_type b ON b.oid = t.typbasetype
WHERE t.typtype IN ('e', 'd', 'c') AND NOT EXISTS (SELECT 1 FROM pg_depend d WHERE d.objid = t.oid AND d.deptype = 'e')""")
catalog("signature_relations", *RELATIONS, sql=f" SELECT concat('relation|', nspname, '.', relname, '|', relkind, '|', relrowsecurity, '|', relforcerowsecurity) AS line FROM pg_class c JOIN pg_namespace n ON n.oid = c.relnamespace WHERE relkind IN ('r', 'p', 'v', 'm', 'f') AND {OWN}")
catalog("object_privileges", "pg_class", "pg_proc", "pg_acl", sql=""" SELECT kind, name, listagg(entry, ',') WITHIN GROUP (ORDER BY entry) AS acl FROM (SELECT DISTINCT a.kind, o.name, concat(grantee, '=', privilege) AS entry FROM pg_acl a JOIN (
  SELECT 'relation' AS kind, oid, relname AS name FROM pg_class UNION ALL SELECT 'routine', oid, concat(proname, '(', args, ')') FROM pg_proc) o ON o.kind = a.kind AND o.oid = a.oid) s GROUP BY kind, name""")
catalog("reset_schemas", "pg_namespace", "pg_depend", sql=f" SELECT concat('DROP SCHEMA \"', nspname, '\" CASCADE') AS statement FROM pg_namespace n WHERE {USER} AND nspname <> 'public'")
catalog("reset_objects", *RELATIONS, "pg_type", "pg_proc", sql=f""" SELECT 1 AS phase, concat('DROP ', CASE relkind WHEN 'v' THEN 'VIEW' WHEN 'm' THEN 'MATERIALIZED VIEW' WHEN 'S' THEN 'SEQUENCE' ELSE 'TABLE' END, ' IF EXISTS ', relname, ' CASCADE') AS statement FROM pg_class c WHERE relkind IN ('r', 'p', 'v', 'm', 'S') AND {OWN}
UNION ALL SELECT DISTINCT 2, concat('DROP ', CASE prokind WHEN 'p' THEN 'PROCEDURE' ELSE 'FUNCTION' END, ' IF EXISTS ', proname, '(', args, ') CASCADE') FROM pg_proc UNION ALL SELECT 3, concat('DROP TYPE IF EXISTS ', typname, ' CASCADE') FROM pg_type WHERE typtype IN ('e', 'd', 'c')""")
catalog("reset_default_acls", "pg_default_acl", "pg_roles", sql=""" SELECT concat('ALTER DEFAULT PRIVILEGES FOR ROLE ', owner, ' REVOKE ALL ON ', kind, ' FROM ', grantees) AS statement FROM (
  SELECT o.rolname AS owner, kind, listagg(g.rolname, ', ') WITHIN GROUP (ORDER BY g.rolname) AS grantees FROM (SELECT DISTINCT owner AS owner_id, kind, grantee FROM pg_default_acl) d JOIN pg_roles o ON o.oid = d.owner_id JOIN pg_roles g ON g.oid = d.grantee GROUP BY o.rolname, kind) s""")
catalog("column_types", "pg_class", "pg_attribute", "pg_type", sql=" SELECT relname, attname, typname FROM pg_attribute a JOIN pg_class c ON c.oid = a.attrelid JOIN pg_type t ON t.oid = a.atttypid WHERE NOT dropped")
catalog("schema_checksum", "pg_namespace", "pg_class", "pg_attribute", sql=""" SELECT nspname, {sha}(definition) AS checksum FROM (SELECT nspname, listagg(line, ';') WITHIN GROUP (ORDER BY line) AS definition FROM (
  SELECT nspname, concat(relname, '.', attname, ':', atttypid) AS line FROM pg_attribute a JOIN pg_class c ON c.oid = a.attrelid JOIN pg_namespace n ON n.oid = c.relnamespace WHERE NOT dropped) l GROUP BY nspname) s""")
#: CAT-1, SRC-6. The queries whose lines together are a catalog's signature.
SIGNATURE = ["signature_extensions", "signature_relations", "signature_constraints", "signature_indexes", "signature_views", "signature_functions", "signature_triggers", "signature_policies", "signature_sequences", "signature_types"]


def signature(spark: SparkSession, snapshot: dict[str, DataFrame]) -> DataFrame:
    """CAT-1, SRC-6. All lines of a snapshot's signature, each once."""
    lines = [query(spark, snapshot, name) for name in SIGNATURE]
    out = lines[0]
    for other in lines[1:]:
        out = out.union(other)
    return out.distinct()

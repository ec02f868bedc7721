"""Histories made from the driver's tables: every row is a migration with a statement in it. Spark reads the texts; the SQL tells what they say.

``events`` are the lives of tables and functions, ``orders`` those of constraints, ``customer`` and ``orders`` a graph of
foreign keys. The library parses the texts; the DuckDB views below say from the same columns what a text means, without any text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithic.operators import lifecycle, parse

_V, _T, _F = "CAST(floor(value) AS BIGINT)", "concat('s', user_id % 10, '.t_', user_id)", "concat('s', user_id % 10, '.f_', user_id)"
#: The statement that an event stands for.
EVENT_TEXT = f"""CASE WHEN user_id % 4 = 3 THEN CASE event_type
    WHEN 'signup' THEN concat('CREATE ', CASE WHEN {_V} % 2 = 1 THEN 'OR REPLACE ' ELSE '' END, 'FUNCTION ', {_F}, '(a int, b text DEFAULT ''x;'') RETURNS int LANGUAGE sql AS $f$ SELECT ', {_V}, '; $f$')
    WHEN 'click' THEN concat('ALTER FUNCTION ', {_F}, '(int, text) OWNER TO r_', {_V} % 7)
    WHEN 'purchase' THEN CASE WHEN event_id % 3 = 0 THEN concat('REVOKE EXECUTE ON FUNCTION ', {_F}, '(int, text) FROM r_', {_V} % 7) ELSE concat('GRANT EXECUTE ON FUNCTION ', {_F}, '(int, text) TO r_', {_V} % 7, CASE WHEN {_V} > 60 THEN ' WITH GRANT OPTION' ELSE '' END) END
    WHEN 'view' THEN concat('COMMENT ON FUNCTION ', {_F}, '(int, text) IS ''', {_V}, '''')
    ELSE concat('DROP FUNCTION IF EXISTS ', {_F}, '(int, text)') END
  ELSE CASE event_type
    WHEN 'signup' THEN concat('CREATE TABLE ', CASE WHEN event_id % 6 = 0 THEN 'IF NOT EXISTS ' ELSE '' END, {_T}, ' (id bigint PRIMARY KEY, c_', {_V} % 7, ' integer DEFAULT ', {_V}, ')')
    WHEN 'click' THEN concat('ALTER TABLE ', {_T}, CASE {_V} % 4 WHEN 0 THEN concat(' ADD COLUMN c_', {_V} % 7, ' text') WHEN 1 THEN concat(' ALTER COLUMN c_', {_V} % 7, ' TYPE varchar(', {_V}, ')')
      WHEN 2 THEN concat(' DROP COLUMN c_', {_V} % 7) ELSE concat(' ALTER COLUMN c_', {_V} % 7, ' SET NOT NULL') END)
    WHEN 'purchase' THEN CASE WHEN {_V} > 90 THEN concat('GRANT SELECT ON ALL TABLES IN SCHEMA s', user_id % 10, ' TO r_', {_V} % 7) WHEN event_id % 3 = 0 THEN concat('REVOKE SELECT ON ', {_T}, ' FROM r_', {_V} % 7)
      ELSE concat('GRANT SELECT ON ', {_T}, ' TO r_', {_V} % 7, CASE WHEN {_V} > 60 THEN ' WITH GRANT OPTION' ELSE '' END) END
    WHEN 'view' THEN CASE WHEN user_id % 5 = 0 THEN concat('INSERT INTO ', {_T}, ' VALUES (', event_id, ', ''x;y'')') WHEN event_id % 4 = 0 THEN concat('CREATE INDEX CONCURRENTLY i_', event_id, ' ON ', {_T}, ' (id, c_', {_V} % 7, ')')
      WHEN event_id % 4 = 1 THEN concat('ALTER TABLE ', {_T}, ' ENABLE ROW LEVEL SECURITY') WHEN event_id % 4 = 2 THEN concat('ALTER TABLE ', {_T}, ' NO FORCE ROW LEVEL SECURITY') ELSE concat('COMMENT ON TABLE ', {_T}, ' IS ''it''''s; ', {_V}, '''') END
    ELSE concat('DROP TABLE ', CASE WHEN {_V} % 2 = 0 THEN 'IF EXISTS ' ELSE '' END, {_T}, ' CASCADE') END END"""
#: What an event's statement means, from its columns. For DuckDB only.
EVENT_LOG = """(SELECT event_id * 1024 AS pos, file, event_id, user_id, v, kind AS object_type, op, op = 'INSERT' AS is_data, cond AS if_exists, schema,
  CASE kind WHEN 'INDEX' THEN schema || '.i_' || event_id WHEN 'SCHEMA' THEN schema WHEN 'FUNCTION' THEN schema || '.f_' || user_id || '(integer,text)' ELSE schema || '.t_' || user_id END || '::' || kind AS k,
  CASE WHEN kind = 'TABLE' AND op <> 'COMMENT' OR kind = 'TABLE' THEN 'tables' WHEN kind = 'INDEX' THEN 'indexes' WHEN kind = 'SCHEMA' THEN 'schemas' ELSE 'functions' END AS plain_category,
  CASE WHEN op = 'DROP' THEN 'HIGH' WHEN op = 'REVOKE' OR kind IN ('TABLE', 'INDEX') THEN 'MEDIUM' ELSE 'LOW' END AS risk,
  CASE WHEN op = 'INSERT' THEN 'ROW_EXCLUSIVE' WHEN kind = 'INDEX' THEN 'SHARE_UPDATE_EXCLUSIVE' WHEN op = 'CREATE' THEN 'NONE' ELSE 'ACCESS_EXCLUSIVE' END AS lock,
  kind = 'INDEX' AS no_txn, CASE WHEN kind = 'INDEX' OR kind = 'TABLE' AND event_type = 'click' AND v % 4 = 1 THEN 'SLOW' WHEN op = 'INSERT' THEN 'MEDIUM' ELSE 'FAST' END AS duration,
  CASE WHEN op IN ('GRANT', 'REVOKE') THEN 'r_' || (v % 7) END AS grantee, op = 'GRANT' AND v > 60 AND kind <> 'SCHEMA' AS option,
  CASE WHEN kind <> 'TABLE' THEN NULL WHEN event_type = 'click' THEN CASE v % 4 WHEN 0 THEN 'ADD' WHEN 1 THEN 'TYPE' WHEN 2 THEN 'DROP' ELSE 'NOT_NULL' END WHEN op = 'ALTER' THEN CASE event_id % 4 WHEN 1 THEN 'ENABLE' ELSE 'NO FORCE' END END AS action, 'c_' || (v % 7) AS col
 FROM (SELECT *, CASE WHEN user_id % 4 = 3 THEN 'FUNCTION' WHEN event_type = 'view' AND user_id % 5 <> 0 AND event_id % 4 = 0 THEN 'INDEX' WHEN event_type = 'purchase' AND v > 90 THEN 'SCHEMA' ELSE 'TABLE' END AS kind,
   CASE event_type WHEN 'signup' THEN 'CREATE' WHEN 'click' THEN 'ALTER' WHEN 'purchase' THEN CASE WHEN event_id % 3 = 0 AND (user_id % 4 = 3 OR v <= 90) THEN 'REVOKE' ELSE 'GRANT' END
     WHEN 'view' THEN CASE WHEN user_id % 4 = 3 THEN 'COMMENT' WHEN user_id % 5 = 0 THEN 'INSERT' WHEN event_id % 4 = 0 THEN 'CREATE' WHEN event_id % 4 = 3 THEN 'COMMENT' ELSE 'ALTER' END ELSE 'DROP' END AS op,
   CASE event_type WHEN 'signup' THEN user_id % 4 <> 3 AND event_id % 6 = 0 WHEN 'error' THEN user_id % 4 = 3 OR v % 2 = 0 ELSE FALSE END AS cond
  FROM (SELECT *, CAST(floor(value) AS BIGINT) AS v, CAST(CAST(ts AS DATE) AS STRING) AS file, 's' || (user_id % 10) AS schema FROM {events}) e) e)"""
#: Column events of the same history: table, column, pos, action, value.
COLUMN_LOG = f"""(SELECT schema || '.t_' || user_id AS "table", c.col AS "column", pos * 1000 + c.n AS pos, c.action, c.value FROM (SELECT * FROM {EVENT_LOG} l WHERE object_type = 'TABLE') l,
  LATERAL (SELECT unnest(CASE op WHEN 'CREATE' THEN [{{'col': 'id', 'n': 0, 'action': 'ADD', 'value': 'bigint'}}, {{'col': 'id', 'n': 1, 'action': 'NOT_NULL', 'value': ''}}, {{'col': l.col, 'n': 2, 'action': 'ADD', 'value': 'integer'}},
      {{'col': l.col, 'n': 3, 'action': 'DEFAULT', 'value': CAST(v AS STRING)}}]
    WHEN 'DROP' THEN [{{'col': '', 'n': 0, 'action': 'GONE', 'value': ''}}]
    WHEN 'ALTER' THEN [{{'col': CASE WHEN l.action IN ('ENABLE', 'NO FORCE') THEN '' ELSE l.col END, 'n': 0, 'action': l.action, 'value': CASE l.action WHEN 'ADD' THEN 'text' WHEN 'TYPE' THEN 'varchar(' || v || ')' ELSE '' END}}] ELSE [] END, recursive := true)) c)"""

#: Statements on constraints: an order adds one NOT VALID to its customer's table, validates one, or drops the table.
ORDER_TEXT = """CASE o_orderstatus WHEN 'O' THEN concat('ALTER TABLE c_', o_custkey, ' ADD CONSTRAINT k_', o_orderkey % 3, ' CHECK (a > ', o_orderkey, ') NOT VALID')
  WHEN 'F' THEN concat('ALTER TABLE c_', o_custkey, ' VALIDATE CONSTRAINT k_', o_orderkey % 3) ELSE concat('DROP TABLE c_', o_custkey) END"""
#: Foreign keys: a customer is a table, and goes in the end if its balance is negative; an order is a table that refers to it, in one of two ways, with an index and, for some, a view.
GRAPH_TEXT = {
    "customer": """SELECT c_custkey AS seq, 'customer' AS filename, concat('CREATE TABLE app.c_', c_custkey, ' (id bigint PRIMARY KEY, code text, UNIQUE (code))') AS content FROM {customer} UNION ALL
      SELECT 2000000000 + c_custkey, 'customer', concat('DROP TABLE app.c_', c_custkey, ' CASCADE') FROM {customer} WHERE c_acctbal < 0""",
    "orders": """SELECT 1000000000 + o_orderkey AS seq, 'orders' AS filename, concat('CREATE TABLE app.o_', o_orderkey, ' (id bigint, c bigint',
        CASE WHEN o_orderkey % 2 = 0 THEN concat(' REFERENCES app.c_', o_custkey, '(id) ON DELETE CASCADE') ELSE '' END, CASE WHEN o_orderkey % 2 = 1 THEN concat(', CONSTRAINT fk_', o_orderkey, ' FOREIGN KEY (c) REFERENCES app.c_', o_custkey, ' (code)') ELSE '' END, '); ',
        'CREATE INDEX i_', o_orderkey, ' ON app.c_', o_custkey, ' (code)', CASE WHEN o_orderkey % 5 = 0 THEN concat('; CREATE VIEW app.v_', o_orderkey, ' AS SELECT count(*) AS n FROM app.c_', o_custkey) ELSE '' END) AS content FROM {orders}""",
}


def dealt(rows: DataFrame) -> DataFrame:
    """Rows dealt out to all cores, in three rounds of tasks or more: the driver's tables are single files."""
    return rows.repartition(max(3 * rows.sparkSession.sparkContext.defaultParallelism, rows.rdd.getNumPartitions()))


def files(spark: SparkSession, sf_dir: str, table: str, text: str, seq: str, name: str) -> DataFrame:
    return dealt(spark.read.parquet(f"{sf_dir}/{table}.parquet")).select(F.expr(seq).cast("long").alias("seq"), F.expr(name).alias("filename"), F.expr(text).alias("content"))


def parsed(texts: DataFrame) -> DataFrame:
    """The typed log of a history (seq, filename, content), parsed by all tasks."""
    return lifecycle.typed(parse.statement_log(dealt(texts)))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The typed log of the events' history."""
    return lifecycle.typed(parse.statement_log(files(spark, sf_dir, "events", EVENT_TEXT, "event_id", "CAST(CAST(ts AS DATE) AS STRING)")))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.typed(parse.statement_log(files(spark, sf_dir, "orders", ORDER_TEXT, "o_orderkey", "o_orderpriority")))


def graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .base import for_spark

    text = " UNION ALL ".join(f"({t})" for t in GRAPH_TEXT.values())
    return parsed(spark.sql(for_spark(text, sf_dir)))


SOURCES = {"{log}": events, "{order_log}": orders, "{graph_log}": graph}

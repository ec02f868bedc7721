"""What grows with the input: shapes of texts, joins of parsed rows, ranges, closures and renames."""

import random
import time

import pytest
from pyspark.sql import functions as F

from lithic.functions import ddl, shapes
from lithic.functions.sqltext import classify, split_statements, uses
from lithic.operators import dependencies, evolution, extras, folds, graph, lifecycle, lint, normalize, parse, validate
from lithic.plans import histories
from lithic.sources import catalog

ODD = [
    "CREATE TABLE a_1.t_{n} (id bigint, c_{m} int4 DEFAULT {n}, x varchar({m})); DROP TABLE t_{n}, t_{m}",
    "CREATE TABLE t_{n} (id int REFERENCES t_{n}(id), CONSTRAINT k_{m} FOREIGN KEY (a_{n}, b_{m}) REFERENCES app.c_{m} (x_{n}, y_{m}))",
    'CREATE TABLE "T {n}" (id int)', "SELECT {n} FROM t_{m}", "COMMENT ON TABLE t_{n} IS 'it''s {m}; 100% of %s'", "-- {n}\nDROP TABLE t_{n}",
    "CREATE FUNCTION f_{n}(a int8, b_{m} text DEFAULT 'x;{n}') RETURNS int LANGUAGE sql AS $f$ SELECT {m}; $f$", "GRANT SELECT ON t_{n}, t_{m} TO r_{n}, r_{m} WITH GRANT OPTION",
    "ALTER TABLE t_{n} ADD COLUMN c_{m} numeric({m}, 2), VALIDATE CONSTRAINT k_{n}, ADD CONSTRAINT k_{m} CHECK (a > {n}) NOT VALID", "CREATE VIEW v_{n} AS WITH w{m} AS (SELECT 1) SELECT * FROM w{n}, t_{m}",
    "CREATE SEQUENCE q_{n}; CREATE TABLE t_{n} (id bigint DEFAULT nextval('app.q_{m}'::regclass)); ALTER SEQUENCE q_{n} OWNED BY t_{n}.id_{m}", "CREATE TABLE t_" + "x" * 70 + "{n} (id int)", "GRANT SELECT ON t TO some_long_name_of_a_role_that_goes_on_and_on_to_the_end.r_{n}",
    "CREATE INDEX i_{n} ON t_{m} (lower(c_{n}), 1.5, {m})", "INSERT INTO e{n} VALUES (E'\\n{m}', 1e5, qz0qz, 731{m}731)", "ALTER TABLE t_{n} ALTER COLUMN c_{m} TYPE varchar({n})", "CREATE UNIQUE INDEX u_{n} ON t_{m} (a_{n})", "",
]


@pytest.mark.parametrize("fn", [parse.statements, ddl.column_events, ddl.actions, ddl.sound, evolution.statement_keys, dependencies.constraint_actions, extras.rollback_statement, normalize._flat])
def test_shapes_give_what_each_text_gives(fn):
    some = random.Random(1)
    for text in ODD * 30:
        n = some.choice([0, 7, 12, 99, 1234567, "9" * 19, "9" * 22])
        text = text.replace("{n}", str(n)).replace("{m}", str(some.choice([n, 3, 55, 4711])))
        assert fn(text) == fn.__wrapped__(text), text


def test_statements_of_one_shape_are_read_once(monkeypatch):
    asked = []
    monkeypatch.setattr(parse, "classify", lambda s: asked.append(s) or classify(s))
    monkeypatch.setattr(parse, "statements", shapes.shaped(parse.statements.__wrapped__))
    for n in range(1000):
        text = f"CREATE TABLE app.t_{n} (id bigint DEFAULT {n + 5000}); DROP TABLE app.t_{n}"
        got = parse.statements(text)
        assert [(r[4], len(r[3]), r[6], r[8]) for r in got] == [(s["sql"], s["offset"], classify(s["sql"])["operation"], f"t_{n}") for s in split_statements(text)]
        assert [r[-1] for r in got] == [uses(s["sql"]) for s in split_statements(text)]
    assert len(asked) <= 6


def typed(spark, *texts):
    return lifecycle.typed(parse.statement_log(spark.createDataFrame([(k, "f", t) for k, t in enumerate(texts)], "seq long, filename string, content string")))


def test_parsed_rows_are_not_broadcast(spark):
    """By the planner's guess, a few MB of compressed rows would be sent to every task, which are hundreds of MB once they are parsed."""
    log = typed(spark, "CREATE TABLE t_1 (id int PRIMARY KEY)", "CREATE VIEW v_1 AS SELECT 1 FROM t_1", "CREATE TABLE o_1 (id int REFERENCES t_1 (id))", "CREATE INDEX i_1 ON t_1 (id)")
    for df in (dependencies.edges(log), dependencies.never_created(log), dependencies.without_dropped(log), dependencies.without_dropped_references(log), evolution.unique_targets(evolution.keys(log)), validate.structure(log)):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    fixed = lint.mended(log.select(F.col("pos").alias("id"), "sql"))
    assert "Join" not in fixed._jdf.queryExecution().executedPlan().toString()


def test_a_fix_is_its_statements_own(spark):
    df = spark.createDataFrame([(1, "CREATE TABLE t (a varchar(9))"), (1, "DROP TABLE t"), (2, "CREATE TABLE u (a smallint)")], "id int, sql string")
    assert sorted(map(tuple, lint.mended(df).collect())) == [(1, "CREATE TABLE t (a text)"), (2, "CREATE TABLE u (a bigint)")]


def test_histories_of_queries_are_dealt_out(spark):
    files = spark.range(100).coalesce(1).selectExpr("id AS seq", "'f' AS filename", "concat('CREATE TABLE t_', id, ' (id int)') AS content")
    assert histories.parsed(files).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_suppression_against_brute_force(spark):
    some = random.Random(2)
    file = lambda: some.choice(["a", "b", None])
    code = lambda: some.choice(["X", "Y"])
    found = [(file(), some.choice([*range(60), None]), code()) for _ in range(120)]
    directives = [(file(), low := some.randrange(60), some.choice([low, low + 1, low + 9, low - 1, None]), code()) for _ in range(40)]
    hit = lambda v, d: v[0] is not None and v[0] == d[0] and v[2] == d[3] and v[1] is not None and d[2] is not None and d[1] <= v[1] <= d[2]
    want = [v for v in found if not any(hit(v, d) for d in directives)] + [(d[0], d[1], lint.UNUSED) for d in directives if not any(hit(v, d) for v in found)]
    f, d = spark.createDataFrame(found, "file string, line long, code string"), spark.createDataFrame(directives, "file string, low long, high long, code string")
    for buckets in (1, 7, 64):
        assert sorted(map(repr, map(tuple, lint.suppressed(f, d, buckets).collect()))) == sorted(map(repr, want))


def test_suppression_makes_no_pairs(spark):
    found = spark.range(100000).selectExpr("'f' AS file", "id AS line", "'A' AS code")
    directives = spark.range(100000).selectExpr("'f' AS file", "id AS low", "id + id % 2 - 1 AS high", "'A' AS code")
    began = time.perf_counter()
    assert lint.suppressed(found, directives).count() == 50000 + 50000  # took 10^10 comparisons of pairs
    assert time.perf_counter() - began < 60


def test_bulk_grants_against_brute_force(spark):
    some = random.Random(3)
    lives = [(some.choice("ab"), f"k{k}", born := some.randrange(1000), some.choice([None, born + some.randrange(1, 400)])) for k in range(60)]
    grants = [(some.choice("abc"), some.randrange(-50, 1050)) for _ in range(60)]
    want = sorted((k, p) for s, k, b, e in lives for g, p in grants if s == g and b < p and (e is None or e > p))
    df, g = spark.createDataFrame(lives, "schema string, k string, born long, died long"), spark.createDataFrame(grants, "schema string, pos long")
    for buckets in (1, 5, 64):
        assert sorted(map(tuple, folds.bulk_grants(df, g, buckets).collect())) == want


def test_reachability_exchanges_no_pairs(spark):
    some = random.Random(4)
    edges = {(f"n{some.randrange(40)}", f"n{some.randrange(40)}") for _ in range(60)} | {("a", "a"), ("x", "y"), ("y", "z")}
    paths = set(edges)
    while len(more := paths | {(a, d) for a, b in paths for c, d in edges if b == c}) > len(paths):
        paths = more
    df = spark.createDataFrame([*edges, ("x", None), ("x", "y")], "src string, dst string")
    assert sorted(map(tuple, graph.reachability(df).collect())) == sorted(paths)
    assert sorted(map(tuple, graph._joined(graph.edge_set(df)).collect())) == sorted(paths)
    assert graph.reachability(df.limit(0)).count() == 0
    assert "Join" not in graph.reachability(df)._jdf.queryExecution().executedPlan().toString()


def test_catalog_concat_passes_over_nulls(spark):
    tables = {
        "pg_class": spark.sql("SELECT * FROM VALUES (1, 's', 7), (2, 't', 7) v(oid, relname, relnamespace)"), "pg_attribute": spark.sql("SELECT 9 AS attrelid, 1 AS attnum, 'a' AS attname"),
        "pg_sequence": spark.sql("SELECT 1 AS seqrelid, 1 AS seqstart, 2 AS seqincrement, 9 AS seqmax, 2 AS owner_rel, 1 AS owner_att"), "pg_namespace": spark.sql("SELECT 7 AS oid, 'app' AS nspname"),
    }
    assert [r.owned_by for r in catalog.query(spark, tables, "catalog_sequences").collect()] == ["t."]
    assert [r.line for r in catalog.query(spark, tables, "signature_sequences").collect()] == ["sequence|app.s|1|2|9|t."]


def test_renames_do_not_search_all_names():
    texts = lambda n: [t for k in range(n) for t in (f"CREATE TABLE t_{k} (id int)", f"CREATE FUNCTION f_{k}(a int) RETURNS int LANGUAGE sql AS 'SELECT 1'")] + [f"ALTER TABLE t_{k} RENAME TO c_{k}" for k in range(n)][::-1]
    out = normalize.normalise(texts(300))
    assert out[0] == "CREATE TABLE c_0 (id int)" and out[-1] == ""
    took = []
    for n in (1000, 4000):
        began = time.perf_counter()
        normalize.normalise(texts(n))
        took.append(time.perf_counter() - began)
    assert took[1] < 8 * took[0]


def test_names_keep_their_order():
    names = normalize.Names()
    a, b, c = (normalize.Entity("routine", "public", "f", made=True) for _ in range(3))
    names["routine", "public", "f(integer)"], names["routine", "public", "f(text)"] = a, b
    assert names.all("routine", "public", "f") == [a, b] and names.place[id(b)] == ("routine", "public", "f(text)")
    names["routine", "public", "f(integer)"] = c
    assert names.all("routine", "public", "f")[0] is c and id(a) not in names.place
    del names["routine", "public", "f(integer)"]
    assert names.all("routine", "public", "f")[0] is b and names.pop(("routine", "x", "f()"), None) is None

from hypothesis import given, settings
from hypothesis import strategies as st

from lithic.functions import sqltext as t
from lithic.operators import extras, graph, lint, normalize
from lithic.sources import sinks


def test_split_keeps_quotes_bodies_and_comments():
    got = t.split_statements("-- a\nSELECT 'x;y'; CREATE FUNCTION f() RETURNS int LANGUAGE sql AS $b$ SELECT 1; $b$;\n/* z; */ DROP TABLE \"a;b\"")
    assert [s["line"] for s in got] == [2, 2, 3]
    assert got[0]["comments"] == ["a"] and got[2]["comments"] == ["z;"]
    assert got[2]["sql"] == 'DROP TABLE "a;b"'


@given(st.lists(st.sampled_from(["SELECT 1", "DROP TABLE a", "INSERT INTO b VALUES ('x;')", "DO $$ BEGIN; END $$"]), max_size=6))
@settings(max_examples=30, deadline=None)
def test_split_round_trip(parts):
    assert [s["sql"] for s in t.split_statements(";\n".join(parts))] == parts


def test_classify():
    c = t.classify("ALTER TABLE app.Users ADD CONSTRAINT c FOREIGN KEY (a) REFERENCES Other(id)")
    assert (c["object_type"], c["operation"], c["schema_name"], c["object_name"], c["dependencies"]) == ("TABLE", "ALTER", "app", "users", ["other"])
    assert t.classify("CREATE UNIQUE INDEX CONCURRENTLY i ON t (a)")["dependencies"] == ["t"]
    assert t.classify("EXPLAIN x")["object_name"].startswith("verbatim_statement_")
    assert t.signature("a int, OUT b text, c varchar(3) DEFAULT 'x', double precision") == "(integer,character varying,double precision)"


def test_names():
    assert t.identifier('"A""b"') == 'A"b' and t.identifier("AbC") == "abc"
    assert len(t.object_name("a" * 60, "b" * 60, "fkey").encode()) <= 63
    taken = {"t_key"}
    assert [t.unique_name("t_key", taken) for _ in range(2)] == ["t_key1", "t_key2"]
    assert t.split_list("a, f(b, c), 'd,e'") == ["a", "f(b, c)", "'d,e'"]
    assert t.balanced("f(a(')'), b) c", 1) == "a(')'), b"


def test_do_block():
    got = t.static_ddl("DO $$ BEGIN IF NOT EXISTS (SELECT 1) THEN CREATE TYPE mood AS ENUM ('a'); END IF; EXECUTE 'DROP TABLE x'; END $$")
    assert got == ["CREATE TYPE mood AS ENUM ('a')"]


def test_lint():
    codes = lambda s: [v["code"] for v in lint.check(s)]
    assert codes("ALTER TABLE t DROP COLUMN a;") == ["BREAKING.DROP_COLUMN"]
    assert codes("DELETE FROM t") == ["SAFETY.MISSING_WHERE"]
    assert codes("CREATE TABLE t (id bigint, name text);") == []
    assert codes("-- lithic:ignore BREAKING.DROP_TABLE\nDROP TABLE t;") == []
    assert codes("-- lithic:ignore SAFETY.MISSING_WHERE\nDROP TABLE t;") == ["BREAKING.DROP_TABLE", "META.UNUSED_IGNORE_DIRECTIVE"]
    assert codes("ALTER TABLE t ADD CONSTRAINT c CHECK (a > 0) NOT VALID;") == ["SAFETY.CONSTRAINT_VALIDATE_FLOW"]
    assert codes("ALTER TABLE t ADD CONSTRAINT c CHECK (a > 0) NOT VALID; ALTER TABLE t VALIDATE CONSTRAINT c;") == []
    assert lint.apply_fixes("abcdef", [(0, 1, "X"), (3, 5, "Y"), (4, 6, "Z")]) == "XbcdZ"


def test_normalise_renames():
    got = normalize.normalise(["CREATE TABLE profiles (id int, bio text)", "ALTER TABLE profiles RENAME COLUMN bio TO about", "ALTER TABLE profiles RENAME TO accounts", "INSERT INTO accounts (about) VALUES ('x')", "DROP TABLE accounts", "CREATE TABLE profiles (n int)"])
    assert got == ["CREATE TABLE accounts (id int, about text)", "", "", "INSERT INTO accounts (about) VALUES ('x')", "DROP TABLE accounts", "CREATE TABLE profiles (n int)"]


def test_topological_order():
    assert graph.topological_order([("b", "a"), ("c", "a"), ("a", "z")], ["m"]) == ["m", "z", "a", "b", "c"]


def test_sinks(tmp_path):
    assert sinks.quoted("order") == '"order"' and sinks.quoted("users") == "users"
    sinks.write_text(str(tmp_path / "x" / "a.sql"), "SELECT 1")
    assert (tmp_path / "x" / "a.sql").read_text() == "SELECT 1"
    assert sinks.grant(["SELECT"], "t", ["b", "a"], True) == "GRANT SELECT ON t TO a, b WITH GRANT OPTION;"


def test_rollback_and_repairs():
    assert extras.rollback_statement("CREATE UNIQUE INDEX CONCURRENTLY i ON t (a)") == "DROP INDEX CONCURRENTLY IF EXISTS i;"
    assert extras.rollback_statement("ALTER TABLE t RENAME COLUMN a TO b") == "ALTER TABLE t RENAME COLUMN b TO a;"
    assert extras.rollback_statement("GRANT SELECT ON t TO a WITH GRANT OPTION;") == "REVOKE SELECT ON t FROM a;"
    assert extras.rollback_statement("DROP TABLE t") is None
    assert extras.repaired_policies("CREATE POLICY p ON t; DROP POLICY p;") == "CREATE POLICY p ON t; DROP POLICY p ON t;"
    assert extras.placed_after_create("CREATE TABLE t ()", [(2, "B"), (1, "A;")]) == "CREATE TABLE t ();\nA;\nB;"

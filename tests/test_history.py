"""Whole histories as text: what a server would have in the end is what the baseline makes."""

import pytest

from lithic.functions import ddl, scopes
from lithic.functions import sqltext as t
from lithic.operators import dependencies, evolution, lifecycle, lint, parse, plugins, rules, validate
from lithic.operators.normalize import normalise
from lithic.sources import log as sources
from lithic.streaming import ingest


def typed(spark, *texts):
    return lifecycle.typed(parse.statement_log(sources.history_from_map(spark, dict(enumerate(texts)))))


def baseline(spark, *texts, level="standard"):
    return rules.render(rules.consolidate(typed(spark, *texts), level))


def test_columns_are_folded_into_their_own_bracket():
    assert ddl.fold(["CREATE TABLE t (id int, s text) WITH (fillfactor=70)", "ALTER TABLE t ADD COLUMN q int"]) == ["CREATE TABLE t (id int, s text, q int) WITH (fillfactor=70)"]
    assert ddl.fold(["CREATE TABLE t (n numeric(10,2))", "ALTER TABLE t ADD m numeric(5,1) DEFAULT 0, ADD CONSTRAINT c CHECK (m > 0)", "ALTER TABLE t ADD k text"]) == ["CREATE TABLE t (n numeric(10,2), m numeric(5,1) DEFAULT 0, CONSTRAINT c CHECK (m > 0), k text)"]
    assert ddl.fold(["CREATE TABLE t (a int)", "ALTER TABLE t ADD b int", "ALTER TABLE t ALTER a TYPE bigint", "ALTER TABLE t ADD c int"]) == ["CREATE TABLE t (a int, b int)", "ALTER TABLE t ALTER a TYPE bigint", "ALTER TABLE t ADD c int"]
    assert ddl.fold(["CREATE TABLE t (a int)", "ALTER TABLE t ADD CONSTRAINT c CHECK (a > 0) NOT VALID"])[1:] == ["ALTER TABLE t ADD CONSTRAINT c CHECK (a > 0) NOT VALID"]


def test_column_lifecycle_is_folded_where_it_can_be():
    history = ["CREATE TABLE t (a int NOT NULL, b text DEFAULT 'x;)', c int)", "ALTER TABLE t ALTER a TYPE bigint, ALTER a DROP NOT NULL", "ALTER TABLE t ALTER b SET DEFAULT 'y'", "ALTER TABLE t DROP COLUMN c", "ALTER TABLE t ADD d int, ALTER d SET NOT NULL"]
    assert ddl.fold(history, True) == ["CREATE TABLE t (a bigint, b text DEFAULT 'y', d int NOT NULL)"]
    assert ddl.fold(["CREATE TABLE t (a int, b int GENERATED ALWAYS AS (a * 2) STORED)", "ALTER TABLE t DROP COLUMN a"], True)[1:] == ["ALTER TABLE t DROP COLUMN a"]
    assert ddl.fold(["CREATE TABLE t (a text)", "ALTER TABLE t ALTER a TYPE int USING a::int"], True)[1:] == ["ALTER TABLE t ALTER a TYPE int USING a::int"]
    assert ddl.derived_names(ddl.parse_create("CREATE TABLE t (id int PRIMARY KEY, e text UNIQUE CHECK (e <> ''), x int REFERENCES y, UNIQUE (e, x))")) == ["t_pkey", "t_e_key", "t_e_check", "t_x_fkey", "t_e_x_key"]


def test_statement_lists_are_one_row_for_each_object(spark):
    log = typed(spark, "DROP TABLE a, b.c CASCADE; GRANT SELECT, UPDATE ON t1, t2 TO x, y; CREATE UNIQUE INDEX ON t (a); WITH q AS (SELECT 1) INSERT INTO z SELECT * FROM q; SELECT setval('s', 3)")
    rows = [(r.op, r.object_type, r.schema, r.name, r.is_data) for r in log.orderBy("pos").collect()]
    assert rows == [("DROP", "TABLE", "public", "a", False), ("DROP", "TABLE", "b", "c", False), ("GRANT", "TABLE", "public", "t1", False), ("GRANT", "TABLE", "public", "t2", False), ("CREATE", "INDEX", "public", "", False), ("INSERT", "TABLE", "public", "z", True), ("SETVAL", "SEQUENCE", "public", "s", True)]


def test_what_belongs_to_a_dropped_table_goes_with_it(spark):
    text = baseline(
        spark, "CREATE TABLE a (id int PRIMARY KEY); CREATE INDEX i ON a (id); CREATE VIEW v AS SELECT id FROM a; CREATE VIEW w AS SELECT id FROM v; COMMENT ON TABLE a IS 'x';",
        "CREATE TABLE b (id int, a_id int REFERENCES a(id) ON DELETE CASCADE NOT NULL, CONSTRAINT f FOREIGN KEY (id) REFERENCES a); ALTER TABLE b ADD CONSTRAINT g FOREIGN KEY (a_id) REFERENCES a;",
        "DROP TABLE a CASCADE; ALTER TABLE b DROP CONSTRAINT g; CREATE INDEX j ON b (id)",
    )
    assert text == "-- TABLES\nCREATE TABLE b (id int, a_id int NOT NULL);\n\n-- INDEXES\nCREATE INDEX j ON b (id);\n"


def test_a_recreated_table_stays(spark):
    text = baseline(spark, "CREATE TABLE a (x int); CREATE INDEX old ON a (x); DROP TABLE a; CREATE TABLE a (y int); CREATE INDEX i ON a (y); CREATE TABLE IF NOT EXISTS a (z int)")
    assert "CREATE TABLE a (y int);" in text and "CREATE INDEX i ON a (y);" in text and "z int" not in text and "x int" not in text


def test_schemas_keep_equal_names_apart(spark):
    text = baseline(spark, "CREATE TABLE users (id int); CREATE TABLE public.users2 (id int); CREATE TABLE s.users (id int); ALTER TABLE public.users ADD a int; ALTER TABLE s.users ADD b int; DROP TABLE users2")
    assert "CREATE TABLE users (id int, a int);" in text and "CREATE TABLE s.users (id int, b int);" in text and "users2" not in text
    assert text.index("CREATE SCHEMA IF NOT EXISTS s;") < text.index("s.users")


def test_everything_stands_behind_what_it_uses(spark):
    text = baseline(
        spark, "CREATE TABLE t (id int DEFAULT f(1), m mood, n int DEFAULT nextval('q')); CREATE FUNCTION f(a int) RETURNS int LANGUAGE sql IMMUTABLE AS $$ SELECT 1 $$; CREATE TYPE mood AS ENUM ('a'); CREATE SEQUENCE q;"
        "CREATE VIEW w AS SELECT * FROM v; CREATE VIEW v AS SELECT id FROM t; CREATE TABLE late (id int REFERENCES early); CREATE TABLE early (id int PRIMARY KEY)",
    )
    order = ["CREATE TYPE mood", "CREATE SEQUENCE q", "CREATE FUNCTION f", "CREATE TABLE t", "CREATE VIEW v", "CREATE VIEW w"]
    assert [text.index(x) for x in order] == sorted(text.index(x) for x in order) and text.index("TABLE early") < text.index("TABLE late")


def test_enums_views_functions_and_row_security(spark):
    text = baseline(
        spark, "CREATE TYPE mood AS ENUM ('a', 'it''s'); ALTER TYPE mood ADD VALUE 'c' BEFORE 'it''s'; ALTER TYPE mood RENAME VALUE 'a' TO 'z'; COMMENT ON TYPE mood IS 'm'; CREATE VIEW v AS SELECT 1; DROP VIEW v; CREATE VIEW v AS SELECT 2;"
        "CREATE TABLE t (id int); ALTER TABLE t ENABLE ROW LEVEL SECURITY; ALTER TABLE t FORCE ROW LEVEL SECURITY; ALTER TABLE t DISABLE ROW LEVEL SECURITY; COMMENT ON FUNCTION missing(int) IS 'x'; GRANT EXECUTE ON FUNCTION missing(int) TO a",
    )
    assert "CREATE TYPE mood AS ENUM ('z', 'c', 'it''s');\n" in text and "CREATE OR REPLACE VIEW v AS SELECT 2;" in text and "SELECT 1" not in text and "missing" not in text
    assert "ENABLE" not in text and "DISABLE ROW LEVEL SECURITY" in text and "FORCE ROW LEVEL SECURITY" in text


def test_recovery_and_provenance(spark):
    log = typed(spark, "CREATE TABLE t (id int); ALTER TABLE t ADD a int")
    results = rules.consolidate(log)
    broken = results.withColumn("sql", results.sql.substr(1, 20))
    assert [r.sql for r in rules.recovered(log, broken).collect()] == ["CREATE TABLE t (id int);\nALTER TABLE t ADD a int"]
    assert {(r.seq, r.stmt_idx, r.k) for r in rules.provenance(log, results).collect()} == {(0, 0, "public.t::TABLE"), (0, 1, "public.t::TABLE")}
    again = parse.again(parse.statement_log(sources.history_from_map(spark, {0: "CREATE TABLE t (id int); DROP VIEW v"})), spark.createDataFrame([(0, 0, 0, "CREATE VIEW x AS SELECT 1"), (0, 1, 0, "")], "seq long, stmt_idx int, part int, sql string"))
    assert [(r.seq, r.stmt_idx, r.object_type, r.object_name, r.filename) for r in again.collect()] == [(0, 0, "VIEW", "x", "migration_0")]


def test_data_operations_follow_their_tables(spark):
    log = typed(spark, "CREATE TABLE child (p int REFERENCES parent); CREATE TABLE parent (id int PRIMARY KEY); INSERT INTO child VALUES (1); INSERT INTO parent VALUES (1); UPDATE child SET p = 1")
    assert rules.data_sql(log) == "INSERT INTO parent VALUES (1);\nINSERT INTO child VALUES (1);\nUPDATE child SET p = 1;\n"


RENAMED = [
    "CREATE TABLE profiles (id int, bio text CHECK (bio <> ''))", "CREATE VIEW v AS SELECT * FROM profiles", "CREATE VIEW w AS SELECT p.bio FROM profiles p WHERE bio = 'bio'", "COMMENT ON COLUMN profiles.bio IS 'bio'", "GRANT SELECT (bio) ON profiles TO bio",
    "CREATE INDEX i ON profiles (lower(bio)) WHERE bio IS NOT NULL", "CREATE POLICY p ON profiles USING (bio = current_user)", "CREATE TRIGGER t BEFORE UPDATE OF bio ON profiles FOR EACH ROW WHEN (NEW.bio <> OLD.bio) EXECUTE FUNCTION f()",
    "CREATE FUNCTION g() RETURNS int LANGUAGE sql AS $$ SELECT count(bio) FROM profiles; $$", "ALTER TABLE profiles RENAME COLUMN bio TO about", "ALTER TABLE profiles RENAME TO accounts", "DROP TABLE accounts", "CREATE TABLE profiles (bio int)", "INSERT INTO profiles (bio) VALUES (1)",
]


def test_names_are_final_everywhere():
    assert normalise(RENAMED) == [
        "CREATE TABLE accounts (id int, about text CHECK (about <> ''))", "CREATE VIEW v AS SELECT id, about AS bio FROM accounts", "CREATE VIEW w AS SELECT p.about AS bio FROM accounts p WHERE about = 'bio'", "COMMENT ON COLUMN accounts.about IS 'bio'",
        "GRANT SELECT (about) ON accounts TO bio", "CREATE INDEX i ON accounts (lower(about)) WHERE about IS NOT NULL", "CREATE POLICY p ON accounts USING (about = current_user)",
        "CREATE TRIGGER t BEFORE UPDATE OF about ON accounts FOR EACH ROW WHEN (NEW.about <> OLD.about) EXECUTE FUNCTION f()", "CREATE FUNCTION g() RETURNS int LANGUAGE sql AS $$ SELECT count(about) FROM accounts; $$", "", "", "DROP TABLE accounts",
        "CREATE TABLE profiles (bio int)", "INSERT INTO profiles (bio) VALUES (1)",
    ]


def test_schemas_move_and_rename():
    got = normalise(["CREATE SCHEMA a", "CREATE TABLE a.t (id int)", "CREATE TABLE b.t (id int, users text)", "CREATE TABLE users (id int REFERENCES a.t (id))", "ALTER TABLE a.t RENAME TO u", "ALTER TABLE users SET SCHEMA app", "INSERT INTO app.users VALUES (1)", "ALTER SCHEMA a RENAME TO z", "SELECT users FROM b.t", "SET search_path TO app", "DELETE FROM users"])
    assert got == ["CREATE SCHEMA z", "CREATE TABLE z.u (id int)", "CREATE TABLE b.t (id int, users text)", "CREATE TABLE app.users (id int REFERENCES z.u (id))", "", "", "INSERT INTO app.users VALUES (1)", "", "SELECT users FROM b.t", "SET search_path TO app", "DELETE FROM users"]


def test_types_labels_routines_and_strangers():
    assert normalise(["CREATE TYPE mood AS ENUM ('ok', 'sad')", "CREATE TABLE e (m mood DEFAULT 'sad')", "INSERT INTO e VALUES ('sad'::mood)", "ALTER TYPE mood RENAME VALUE 'sad' TO 'blue'", "ALTER TYPE mood RENAME TO feeling"]) == ["CREATE TYPE feeling AS ENUM ('ok', 'blue')", "CREATE TABLE e (m feeling DEFAULT 'blue')", "INSERT INTO e VALUES ('blue'::feeling)", "", ""]
    assert normalise(["ALTER TABLE other RENAME TO another", "SELECT * FROM another"]) == ["ALTER TABLE other RENAME TO another", "SELECT * FROM another"]
    assert normalise(["CREATE SEQUENCE s", "CREATE TABLE q (id int DEFAULT nextval('s'))", "ALTER SEQUENCE s RENAME TO s2", "CREATE FUNCTION f(int) RETURNS int LANGUAGE sql AS 'SELECT 1'", "SELECT f(1)", "ALTER FUNCTION f(int) RENAME TO h"]) == ["CREATE SEQUENCE s2", "CREATE TABLE q (id int DEFAULT nextval('s2'))", "", "CREATE FUNCTION h(int) RETURNS int LANGUAGE sql AS 'SELECT 1'", "SELECT h(1)", ""]


def test_scopes_hide_outer_names():
    history = ["CREATE TABLE users (id int, name text)", "CREATE TABLE posts (id int, user_id int)", "SELECT name FROM (SELECT name AS users FROM users) x", "WITH users AS (SELECT 1 AS name) SELECT name FROM users", "SELECT (SELECT name FROM posts WHERE user_id = users.id) FROM users", "SELECT count(*) FROM unknown, users WHERE name = 'a'", "ALTER TABLE users RENAME COLUMN name TO full_name"]
    assert normalise(history)[2:6] == ["SELECT name FROM (SELECT full_name AS users FROM users) x", "WITH users AS (SELECT 1 AS name) SELECT name FROM users", "SELECT (SELECT full_name AS name FROM posts WHERE user_id = users.id) FROM users", "SELECT count(*) FROM unknown, users WHERE full_name = 'a'"]
    assert scopes.read_tables("WITH x AS (SELECT a FROM t1) INSERT INTO s.t2 (a) SELECT a FROM x JOIN t3 u ON u.id = x.a WHERE EXISTS (SELECT 1 FROM t4 WHERE t4.a = x.a) UNION SELECT b FROM t5") == ["t1", "s.t2", "t3", "t4", "t5"]


def test_lint_sees_the_statement_and_mends_it(spark):
    codes = lambda s: [v["code"] for v in lint.check(s)]
    assert codes("ALTER TABLE t DROP a") == ["BREAKING.DROP_COLUMN"] and codes("ALTER TABLE t DROP CONSTRAINT a") == []
    assert codes("UPDATE t SET a = (SELECT b FROM c WHERE d)") == ["SAFETY.MISSING_WHERE"] and codes("UPDATE t SET a = 1 WHERE b IN (SELECT 1)") == []
    rows = spark.createDataFrame([(1, "UPDATE t SET a = (SELECT b FROM c WHERE (d))"), (2, "ALTER TABLE t ADD CONSTRAINT c CHECK (a > 'NOT VALID')"), (3, "CREATE TABLE t (a INT, b varchar( 20 ) DEFAULT 'varchar(3)')")], "id long, sql string")
    assert {(r.id, r.code) for r in lint.violations(rows).collect()} == {(1, "SAFETY.MISSING_WHERE"), (2, "SAFETY.CONSTRAINT_NOT_VALID"), (3, "HYGIENE.PREFER_TEXT"), (3, "HYGIENE.PREFER_BIGINT")}
    assert {r.id: r.sql for r in lint.mended(rows).collect()} == {2: "ALTER TABLE t ADD CONSTRAINT c CHECK (a > 'NOT VALID') NOT VALID", 3: "CREATE TABLE t (a bigint, b text DEFAULT 'varchar(3)')"}


def test_validation_and_modernising(spark):
    log = typed(spark, "CREATE TABLE t (id int, u int REFERENCES gone); CREATE UNLOGGED TABLE \"Big\" (id int PRIMARY KEY); EXPLAIN x; CREATE INDEX ON t (u)")
    assert {(r.k, r.finding) for r in validate.structure(log).collect()} == {("public.t::TABLE", "NO_PRIMARY_KEY"), ("public.Big::TABLE".lower().replace("table", "TABLE"), "UNLOGGED")} | {(r.k, r.finding) for r in validate.structure(log).where("finding = 'NAME_NEEDS_QUOTES'").collect()}
    assert {r.finding for r in validate.before(log).collect()} == {"UNKNOWN_STATEMENT", "NEVER_CREATED"}
    assert validate.modernised("DELETE FROM t WHERE a = 1", ("dml_to_select",)) == "SELECT count(*) FROM t WHERE a = 1" and validate.modernised("DROP TABLE t") == "DROP TABLE t" and validate.modernised("DROP TABLE t", ("drop_to_comment",)) == "-- DROP TABLE t"
    assert ddl.sound("SELECT ('a)' || $x$ ( $x$)") and not ddl.sound("SELECT (1") and not ddl.sound("SELECT 'a")


def test_plugins_by_priority_and_conflict(spark):
    log = typed(spark, "CREATE POLICY p ON t USING (clerk_user_id() = id); CREATE POLICY q ON t FOR SELECT TO b, a USING (auth.uid() = id); CREATE POLICY r ON t FOR SELECT TO a, b USING (true); CREATE TABLE _prisma_migrations (id int)")
    assert [p.name for p in plugins.active(log)] == ["clerk", "prisma"]
    enriched = plugins.PLUGINS[2].enriched(plugins.PLUGINS[0].enriched(log))
    assert {(r.name, tuple(r.patterns), r.preserved) for r in enriched.where("size(patterns) > 0").collect()} == {("p", ("clerk:functions",), True), ("_prisma_migrations", ("prisma:migrations",), True)}
    assert [tuple(r) for r in plugins.merged_policies(log).collect()] == [("t", "SELECT", "a,b", 2)]


def test_enum_merging_by_level(spark):
    log = typed(spark, "CREATE TYPE status AS ENUM ('a', 'b'); CREATE TYPE status_enum AS ENUM ('a', 'b'); CREATE TYPE s.status_type AS ENUM ('a', 'b'); CREATE TYPE other AS ENUM ('a', 'b')")
    done = {level: [(r.kept, r.merged, r.done) for r in evolution.merged_enums(log, level).collect()] for level in rules.LEVELS}
    assert done == {"paranoid": [], "conservative": [("status", "status_enum", False)], "standard": [("status", "status_enum", True)], "aggressive": [("status", "status_enum", True)]}


def test_uses_and_progress():
    assert t.uses("CREATE TABLE a.t (id int DEFAULT nextval('a.q'), m app.mood REFERENCES b.u(id), d int DEFAULT f(1))")[0] == "table:b.u" and {"function:f", "sequence:a.q", "type:app.mood"} <= set(t.uses("CREATE TABLE a.t (id int DEFAULT nextval('a.q'), m app.mood, d int DEFAULT f(1))"))
    with pytest.raises(ValueError):
        t.known_value("operation", "MERGE")
    p = ingest.Progress(10, began=0.0)
    p.update("parse", 5)
    assert p.share == 0.25 and p.seconds_left(now=10) == 30 and ingest.settings(64, 1000)["spark.sql.files.maxPartitionBytes"] == "8m"

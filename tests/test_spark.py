import pytest
from pyspark.sql import functions as F

from lithic.operators import folds, normalize, parse, rules
from lithic.sources import log as sources
from lithic.streaming import ingest


def test_enum_fold(spark):
    df = spark.sql("SELECT array('a','b') AS l, array(named_struct('kind','ADD','label','c','anchor',''), named_struct('kind','BEFORE','label','x','anchor','b'), named_struct('kind','AFTER','label','y','anchor','b'), named_struct('kind','RENAME','label','z','anchor','a'), named_struct('kind','AFTER','label','w','anchor','none')) AS a")
    assert df.select(folds.enum_fold(F.col("l"), F.col("a")).alias("v")).first().v == ["z", "x", "b", "y", "c", "w"]


def test_history_to_baseline(spark, tmp_path):
    (tmp_path / "1_a.sql").write_text("CREATE TABLE t (id int);\nCREATE VIEW v AS SELECT 1;\nCREATE TABLE gone (x int);")
    (tmp_path / "2_b.sql").write_text("ALTER TABLE t ADD COLUMN name text;\nALTER TABLE t ADD COLUMN price numeric;\nALTER TABLE t OWNER TO me;\nCREATE OR REPLACE VIEW v AS SELECT 2;\nDROP TABLE gone;\nINSERT INTO t VALUES (1);")
    (tmp_path / "notes.txt").write_text("x")
    files = sources.read_history(spark, str(tmp_path))
    assert sources.should_stream(files) == (False, "")
    log = parse.statement_log(files).cache()
    text = rules.render(rules.consolidate(log))
    assert "CREATE TABLE t (id int, name text, price numeric);\nALTER TABLE t OWNER TO me;" in text.replace(";;", ";")
    assert "SELECT 2" in text and "SELECT 1" not in text and "gone" not in text
    assert rules.data_sql(log) == "INSERT INTO t VALUES (1);\n"
    registry = rules.Registry(rules.LADDER)
    names = lambda level: {r.name for r in registry.chosen(level)}
    assert names("paranoid") <= names("conservative") <= names("standard") <= names("aggressive")
    registry.disable("create_alter")
    assert "create_alter" not in names("standard") and {r.name for r in registry.chosen("aggressive", category="types")} == {"enum"}
    with pytest.raises(ValueError):
        registry.disable("no such rule")


def test_streamed_log_equals_batch(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for k in range(3):
        (src / f"{k}_m.sql").write_text(f"CREATE TABLE t{k} (id int); DROP TABLE t{k};")
    ingest.stream_log(spark, str(src), str(tmp_path / "out"), str(tmp_path / "cp"), 1).awaitTermination()
    streamed = spark.read.parquet(str(tmp_path / "out"))
    batch = parse.statement_log(sources.read_history(spark, str(src)))
    key = ["seq", "stmt_idx", "sql", "object_name"]
    assert sorted(map(tuple, streamed.select(key).collect())) == sorted(map(tuple, batch.select(key).collect()))


def test_normalised_log(spark):
    df = spark.createDataFrame([("d", 1, 0, "CREATE TABLE a (x int)"), ("d", 2, 0, "ALTER TABLE a RENAME TO b"), ("e", 1, 0, "DROP TABLE a")], "database string, seq long, stmt_idx int, sql string")
    assert {(r.database, r.seq, r.sql) for r in normalize.normalised_log(df).collect()} == {("d", 1, "CREATE TABLE b (x int)"), ("d", 2, ""), ("e", 1, "DROP TABLE a")}


def test_acl_replay_option(spark):
    df = spark.createDataFrame([(1, 1, 7, "GRANT", True), (1, 2, 7, "GRANT", False), (1, 3, 8, "GRANT", True), (1, 4, 8, "REVOKE", True), (1, 5, 9, "GRANT", False), (1, 6, 9, "REVOKE", False)], "k int, pos int, grantee int, action string, option boolean")
    assert {(r.grantee, r.grant_option) for r in folds.acl_replay(df).collect()} == {(7, True), (8, False)}


def test_delegated_grants(spark):
    from lithic.operators import acl

    rows = [
        ("t", "TABLE", 1, "CREATE", "me", None, None, None), ("t", "TABLE", 2, "GRANT", "me", "a", "SELECT", True), ("t", "TABLE", 3, "GRANT", "a", "b", "SELECT", False), ("t", "TABLE", 4, "GRANT", "b", "c", "SELECT", False),
        ("t", "TABLE", 5, "GRANT", "me", "d", "SELECT", False), ("u", "TABLE", 1, "CREATE", "me", None, None, None), ("u", "TABLE", 2, "GRANT", "me", "a", "UPDATE", True), ("u", "TABLE", 3, "GRANT", "a", "b", "UPDATE", False),
        ("u", "TABLE", 4, "REVOKE", "me", "a", "UPDATE", False), ("f", "FUNCTION", 1, "CREATE", "me", None, None, None), ("g", "TABLE", 1, "CREATE", "me", None, None, None), ("g", "TABLE", 2, "DROP", None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "object string, kind string, pos int, action string, grantor string, grantee string, privilege string, option boolean")
    net = acl.replay(df)
    assert {tuple(r) for r in net.collect()} == {("t", "a", "SELECT", True), ("t", "b", "SELECT", False), ("t", "d", "SELECT", False), ("f", "public", "EXECUTE", False)}
    assert "GRANT SELECT ON t TO b, d;" in acl.privileges_section(net, ["b", "a"])

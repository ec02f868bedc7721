"""Sinks: baseline text, configuration, provenance, catalog snapshots, metrics and backups (SNK-1, 4..7)."""

from __future__ import annotations

import hashlib
import json
import os
import re
import tempfile

from pyspark.sql import DataFrame

#: Words that must be quoted as names.
RESERVED = frozenset("all and any array as asc case cast check column constraint create default desc distinct do else end except false for foreign from grant group having in initially intersect into limit not null offset on only or order primary references select some table then to true union unique user using when where with".split())


def quoted(name: str) -> str:
    """A name as it must be written: quotes only where needed."""
    return name if re.fullmatch(r"[a-z_][a-z0-9_$]*", name) and name not in RESERVED else '"' + name.replace('"', '""') + '"'


def create_table(name: str, columns: list[tuple[str, str]], constraints: list[str] = ()) -> str:
    lines = [f"    {quoted(c)} {t}" for c, t in columns] + [f"    {c}" for c in constraints]
    return f"CREATE TABLE {quoted(name)} (\n" + ",\n".join(lines) + "\n);"


def grant(privileges: list[str], name: str, grantees: list[str], option: bool = False) -> str:
    return f"GRANT {', '.join(sorted(privileges))} ON {quoted(name)} TO {', '.join(map(quoted, sorted(grantees)))}" + " WITH GRANT OPTION;" * option + ";" * (not option)


def write_text(path: str, content: str) -> None:
    """Writes a file in one step: a reader sees the old content or the new one."""
    folder = os.path.dirname(path) or "."
    os.makedirs(folder, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=folder)
    with os.fdopen(handle, "w") as f:
        f.write(content)
    os.replace(name, path)


def write_provenance(path: str, output_sql: str, mappings: DataFrame) -> None:
    """The provenance map: the output, its hash, and which statements went where (as many rows as the history has statements)."""
    rows = [r.asDict() for r in mappings.orderBy("seq", "stmt_idx").toLocalIterator()]
    write_text(path, json.dumps({"output_sql": output_sql, "output_hash": hashlib.sha256(output_sql.encode()).hexdigest(), "mappings": rows}))


def snapshot_json(lines: DataFrame, server_version: str, contract: int = 1) -> str:
    """A versioned catalog signature."""
    return json.dumps({"contract_version": contract, "server_version": server_version, "signature": [r.line for r in lines.orderBy("line").toLocalIterator()]})


def prometheus(metrics: dict[str, float], prefix: str = "lithic") -> str:
    return "".join(f"# TYPE {prefix}_{k} gauge\n{prefix}_{k} {v}\n" for k, v in sorted(metrics.items()))


def metrics_json(metrics: dict[str, float]) -> str:
    return json.dumps(dict(sorted(metrics.items())))


def write_output(folder: str, output_sql: str, config: dict, mappings: DataFrame, data_sql: str = "") -> None:
    """SNK-1, SNK-3. The baseline, the data operations where there are any, the configuration and the provenance map."""
    write_text(os.path.join(folder, "000_baseline.sql"), output_sql)
    if data_sql:
        write_text(os.path.join(folder, "010_data.sql"), data_sql)
    write_text(os.path.join(folder, "config.json"), json.dumps(config, indent=2, sort_keys=True))
    write_provenance(os.path.join(folder, "provenance.json"), output_sql, mappings)


def create_index(name: str, table: str, columns: list[str], unique: bool = False, where: str = "", concurrently: bool = False) -> str:
    return f"CREATE {'UNIQUE ' * unique}INDEX {'CONCURRENTLY ' * concurrently}{quoted(name)} ON {quoted(table)} ({', '.join(map(quoted, columns))})" + (f" WHERE {where}" if where else "") + ";"


def create_function(name: str, arguments: list[tuple[str, str]], returns: str, body: str, language: str = "sql", volatility: str = "", security: str = "") -> str:
    """PRJ-16. With the volatility and security that are given, and a tag for the body that the body does not have."""
    tag, n = "$$", 0
    while tag in body:
        n += 1
        tag = f"$body{n}$"
    options = " ".join(x for x in (f"LANGUAGE {language}", volatility, f"SECURITY {security}" if security else "") if x)
    return f"CREATE FUNCTION {quoted(name)}({', '.join(f'{quoted(a)} {t}' for a, t in arguments)}) RETURNS {returns} {options} AS {tag}{body}{tag};"


def drop(kind: str, name: str, cascade: bool = False) -> str:
    return f"DROP {kind} IF EXISTS {quoted(name)}{' CASCADE' * cascade};"


def revoke(privileges: list[str], name: str, grantees: list[str], option_only: bool = False, cascade: bool = False) -> str:
    return f"REVOKE {'GRANT OPTION FOR ' * option_only}{', '.join(sorted(privileges))} ON {quoted(name)} FROM {', '.join(map(quoted, sorted(grantees)))}{' CASCADE' * cascade};"


def write_backup(snapshot: dict[str, DataFrame], folder: str, label: str, keep: int = 5) -> list[str]:
    """SNK-7. A snapshot under a label, and of all labels the last ``keep`` by name; returns those that went. The folder is one that the cluster shares."""
    from lithic.sources.catalog import write_snapshot

    write_snapshot(snapshot, f"{folder}/{label}")
    spark = next(iter(snapshot.values())).sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    old = sorted(x.getPath().getName() for x in fs.listStatus(path(folder)) if x.isDirectory())[:-keep]
    for name in old:
        fs.delete(path(f"{folder}/{name}"), True)
    return old


#: PRJ-5. Words that became reserved later than in version 9, by the version.
NEWLY_RESERVED = {"lateral": 9.3, "tablesample": 9.5, "system_user": 16}


def reserved(version: float = 17) -> frozenset:
    """PRJ-5. The words that must be quoted as names on a server of a version."""
    return frozenset(w for w in RESERVED | set(NEWLY_RESERVED) if NEWLY_RESERVED.get(w, 0) <= version)

"""PostgreSQL statements as rows: splitting, classification, names, locks, lint. Text in, plain values out; no grammar is claimed beyond this."""

from __future__ import annotations

import re
from collections.abc import Iterator

TOKEN = re.compile(
    r"(?P<comment>--[^\n]*|/\*.*?(?:\*/|\Z))|(?P<dollar>\$(?P<tag>\w*)\$.*?(?:\$(?P=tag)\$|\Z))|(?P<string>(?:\bE)?'(?:[^'\\]|''|\\.)*(?:'|\Z))|(?P<quoted>\"(?:[^\"]|\"\")*(?:\"|\Z))"
    r"|(?P<word>[A-Za-z_][\w$]*)|(?P<number>\d[\w.]*)|(?P<space>\s+)|(?P<other>.)",
    re.S | re.I,
)
NAME = r"(?:\"(?:[^\"]|\"\")+\"|[A-Za-z_][\w$]*)"
QUALIFIED = rf"({NAME}(?:\s*\.\s*{NAME})*)"
IF = r"(?:IF\s+(?:NOT\s+)?EXISTS\s+)?"

# Object kinds by the words that name them, and the categories they belong to.
KINDS = {
    "MATERIALIZED VIEW": "MATERIALIZED_VIEW", "FOREIGN TABLE": "FOREIGN_TABLE", "EVENT TRIGGER": "EVENT_TRIGGER", "TABLE": "TABLE", "INDEX": "INDEX", "VIEW": "VIEW",
    "FUNCTION": "FUNCTION", "PROCEDURE": "PROCEDURE", "AGGREGATE": "AGGREGATE", "TRIGGER": "TRIGGER", "SEQUENCE": "SEQUENCE", "SCHEMA": "SCHEMA", "EXTENSION": "EXTENSION",
    "TYPE": "TYPE", "DOMAIN": "DOMAIN", "POLICY": "POLICY", "PUBLICATION": "PUBLICATION", "SUBSCRIPTION": "SUBSCRIPTION", "ROLE": "ROLE", "USER": "ROLE", "RULE": "RULE",
    "OPERATOR": "OPERATOR", "COLLATION": "COLLATION", "CAST": "CAST", "STATISTICS": "STATISTIC", "SERVER": "SERVER",
}
KIND_WORDS = "|".join(map(re.escape, KINDS))
CATEGORIES = {
    "EXTENSION": "extensions", "SCHEMA": "schemas", "ENUM": "types", "TYPE": "types", "DOMAIN": "types", "SEQUENCE": "tables", "TABLE": "tables", "INDEX": "indexes", "VIEW": "views",
    "MATERIALIZED_VIEW": "views", "FUNCTION": "functions", "PROCEDURE": "functions", "TRIGGER": "triggers", "POLICY": "policies",
}


def tokens(sql: str) -> Iterator[tuple[str, str, int]]:
    """(kind, text, offset)."""
    for m in TOKEN.finditer(sql):
        kind = m.lastgroup if m.lastgroup != "tag" else "dollar"
        yield ("dollar" if m["dollar"] is not None else kind), m[0], m.start()


def split_statements(sql: str) -> list[dict]:
    """PRJ-1. Statements with offset, line and the comments before or in them; semicolons in quotes, bodies and BEGIN ATOMIC stay."""
    out, start, comments, atomic, words = [], None, [], 0, []

    def close(end: int) -> None:
        nonlocal start, comments, atomic, words
        if start is not None:
            text = sql[start:end].strip()
            out.append({"sql": text, "offset": start, "line": sql.count("\n", 0, start) + 1, "comments": comments})
            comments = []
        start, atomic, words = None, 0, []

    for kind, text, at in tokens(sql):
        if kind == "comment":
            comments.append(text.strip("-/* \n"))
        elif kind == "other" and text == ";" and not atomic:
            close(at)
        elif kind != "space":
            start = at if start is None else start
            if kind == "word":
                words.append(text.upper())
                atomic += words[-2:] == ["BEGIN", "ATOMIC"] or bool(atomic and words[-1] == "CASE")
                atomic -= bool(atomic and words[-1] == "END")
    close(len(sql))
    return out


def bare(sql: str) -> str:
    """Without comments and string contents, for tests on keywords."""
    return "".join({"comment": " ", "string": "''", "dollar": "$$$$"}.get(k, t) for k, t, _ in tokens(sql))


def plain(sql: str) -> str:
    """Without comments and a last semicolon, white space outside quotes as single spaces."""
    parts = [" " if k in ("comment", "space") else t for k, t, _ in tokens(sql)]
    out, last = [], " "
    for t in parts:
        if t != " " or last != " ":
            out.append(t)
        last = t
    return "".join(out).strip().rstrip(";").rstrip()


def singles(sql: str) -> list[str]:
    """PRJ-2. A statement on a list of objects as one statement for each: DROP TABLE a, b and GRANT ... ON a, b TO c."""
    flat = plain(sql)
    if m := re.match(rf"(DROP (?:{KIND_WORDS})\b(?: CONCURRENTLY)? {IF})(.+?)( CASCADE| RESTRICT)?$", flat, re.I | re.S):
        names = split_list(m[2])
        return [f"{m[1]}{n}{m[3] or ''}" for n in names] if len(names) > 1 else [sql]
    if m := re.match(r"((?:GRANT|REVOKE) .+? ON (?!ALL )(?:(?:TABLE|SEQUENCE|FUNCTION|PROCEDURE|ROUTINE|SCHEMA|TYPE|DOMAIN) )?)(.+)( (?:TO|FROM) .+)$", flat, re.I | re.S):
        names = split_list(m[2])
        return [f"{m[1]}{n}{m[3]}" for n in names] if len(names) > 1 else [sql]
    return [sql]


def identifier(name: str) -> str:
    """PRJ-4. Unquoted names in lower case, quoted ones without quotes; 63 bytes at most."""
    name = name.strip()
    name = name[1:-1].replace('""', '"') if name.startswith('"') and name.endswith('"') and len(name) > 1 else name.lower()
    return name.encode()[:63].decode(errors="ignore")


def qualified(name: str) -> tuple[str, str]:
    """(schema, name); the schema is empty where none is named."""
    parts = [identifier(p) for p in re.findall(NAME, name)]
    return (parts[-2] if len(parts) > 1 else "", parts[-1] if parts else "")


def object_name(name1: str, name2: str, label: str) -> str:
    """STR-4. name1_name2_label within 63 bytes, the longer of both names cut first."""
    a, b, extra = name1.encode(), name2.encode(), len(label) + bool(label) + bool(name2)
    while len(a) + len(b) + extra > 63:
        a, b = (a[:-1], b) if len(a) > len(b) else (a, b[:-1])
    parts = [a.decode(errors="ignore"), b.decode(errors="ignore"), label]
    return "_".join(p for p in parts if p)


def unique_name(base: str, taken: set[str]) -> str:
    """WIN-6. The base, or the base with the first number behind it that is free."""
    name, k = base, 0
    while name in taken:
        k += 1
        name = f"{base}{k}"
    taken.add(name)
    return name


def balanced(text: str, start: int) -> str:
    """PRJ-17. What the bracket at ``start`` encloses, quotes respected; empty if it is not closed."""
    depth = 0
    for kind, t, at in tokens(text[start:]):
        if kind == "other" and t in "()":
            depth += 1 if t == "(" else -1
            if depth == 0:
                return text[start + 1 : start + at]
    return ""


def split_list(text: str) -> list[str]:
    """Elements between commas on the top level."""
    out, depth, last = [], 0, 0
    for kind, t, at in tokens(text):
        if kind == "other" and t in "([":
            depth += 1
        elif kind == "other" and t in ")]":
            depth -= 1
        elif kind == "other" and t == "," and not depth:
            out.append(text[last:at].strip())
            last = at + 1
    return [x for x in [*out, text[last:].strip()] if x]


def signature(arguments: str) -> str:
    """PRJ-6. "(integer,text)" of a function's argument list; defaults, names and OUT arguments do not count."""
    short = {"int": "integer", "int4": "integer", "int8": "bigint", "int2": "smallint", "bool": "boolean", "varchar": "character varying"}
    out = []
    for a in split_list(arguments):
        words = re.split(r"\s+DEFAULT\s+|\s*=", a, flags=re.I)[0].split()
        if words and words[0].upper() in ("IN", "OUT", "INOUT", "VARIADIC"):
            if words.pop(0).upper() == "OUT":
                continue
        kind = " ".join(words).lower()
        multi = ("double precision", "character varying", "timestamp with", "timestamp without", "time with", "time without", "bit varying")
        if len(words) > 1 and not kind.startswith(multi):
            kind = " ".join(words[1:]).lower()
        kind = re.sub(r"\([^)]*\)", "", kind).strip()
        out.append(short.get(kind, kind))
    return f"({','.join(out)})"


def classify(sql: str) -> dict:
    """PRJ-2, PRJ-3, PRJ-7, PRJ-8. Type, operation, schema, name, category, dependencies, grantees and privileges of one statement."""
    flat = re.sub(r"\s+", " ", bare(sql)).strip()
    up = flat.upper()
    row = {"object_type": "VERBATIM", "operation": "UNKNOWN", "schema_name": "", "object_name": "", "is_data_op": False, "if_not_exists": "IF NOT EXISTS" in up, "function_signature": "", "dependencies": [], "grantees": [], "privileges": []}

    def named(m: re.Match, group: int = 1) -> None:
        row["schema_name"], row["object_name"] = qualified(m[group])

    data = flat
    if re.match(r"WITH\b", flat, re.I) and (inner := re.search(r"\) ?(?=(?:INSERT INTO|UPDATE|DELETE FROM)\b)", flat, re.I)):
        data = flat[inner.end() :]  # the statement behind its common table expressions
    if re.match(r"SELECT (?:pg_catalog ?\. ?)?setval ?\(", flat, re.I):
        row |= {"object_type": "SEQUENCE", "operation": "SETVAL", "is_data_op": True}
        if m := re.search(r"setval ?\( ?'([^']+)'", plain(sql), re.I):
            row["schema_name"], row["object_name"] = qualified(m[1])
    elif m := re.match(rf"(INSERT INTO|UPDATE|DELETE FROM|TRUNCATE(?: TABLE)?|COPY|REFRESH MATERIALIZED VIEW)(?: CONCURRENTLY)?(?: ONLY)? {QUALIFIED}", data, re.I):
        op = m[1].upper().split()[0]
        row |= {"object_type": "MATERIALIZED_VIEW" if op == "REFRESH" else "TABLE", "operation": op, "is_data_op": True}
        named(m, 2)
    elif m := re.match(r"DO\b", flat, re.I):
        row |= {"object_type": "DO_BLOCK", "operation": "EXECUTE", "object_name": "do_block"}
    elif m := re.match(r"(GRANT|REVOKE)(?: GRANT OPTION FOR)? (.+?) ON (?:ALL )?(?:(TABLES?|SEQUENCES?|FUNCTIONS?|SCHEMA|TYPE|DATABASE) )?(?:IN SCHEMA )?" + QUALIFIED + r".*? (?:TO|FROM) (.+?)(?: WITH GRANT OPTION| CASCADE| RESTRICT)?$", flat, re.I):
        bulk = re.search(r" ON ALL \w+ IN SCHEMA ", flat, re.I)
        row |= {"object_type": "SCHEMA" if bulk else (m[3] or "TABLE").upper().rstrip("S"), "operation": m[1].upper()}
        row["privileges"] = [re.sub(r"\s*\(.*", "", p).upper() for p in split_list(m[2])]
        row["grantees"] = [identifier(g) for g in split_list(m[5])]
        named(m, 4)
    elif m := re.match(rf"COMMENT ON ({KIND_WORDS}|COLUMN|CONSTRAINT) {QUALIFIED}", flat, re.I):
        row |= {"object_type": KINDS.get(m[1].upper(), m[1].upper()), "operation": "COMMENT"}
        named(m, 2)
    elif m := re.match(rf"(CREATE|ALTER|DROP)(?: OR REPLACE)?(?: (?:TEMP|TEMPORARY|UNLOGGED|UNIQUE|RECURSIVE|CONSTRAINT|GLOBAL|LOCAL))* ({KIND_WORDS})\b(?: CONCURRENTLY)? ?{IF}(?:ONLY )?{QUALIFIED}?", flat, re.I):
        row |= {"object_type": KINDS[m[2].upper()], "operation": m[1].upper()}
        if m[3] and not (row["object_type"] == "INDEX" and m[3].upper() == "ON"):
            named(m, 3)
        if row["object_type"] in ("TRIGGER", "POLICY", "INDEX", "RULE") and (on := re.search(rf"\bON (?:ONLY )?{QUALIFIED}", flat, re.I)):
            row["dependencies"].append(".".join(filter(None, qualified(on[1]))))
        if row["object_type"] == "TYPE" and re.search(r"\bAS ENUM\b|\b(ADD|RENAME) VALUE\b", up):
            row["object_type"] = "ENUM"
        if row["object_type"] in ("FUNCTION", "PROCEDURE") and "(" in flat:
            row["function_signature"] = signature(balanced(flat, flat.index("(")))
    if row["object_type"] in ("FUNCTION", "PROCEDURE") and (m := re.search(rf"\b(?:FUNCTION|PROCEDURE) {IF}{QUALIFIED} ?(\()", flat, re.I)):
        row["function_signature"] = signature(balanced(flat, m.start(2)))
    row["dependencies"] += [".".join(filter(None, qualified(x))) for x in re.findall(rf"\bREFERENCES {QUALIFIED}", flat, re.I)]
    if row["object_type"] in ("VIEW", "MATERIALIZED_VIEW") and row["operation"] == "CREATE":
        ctes = {identifier(x) for x in re.findall(rf"(?:WITH|,) (?:RECURSIVE )?({NAME}) AS \(", flat, re.I)}
        used = [qualified(x) for x in re.findall(rf"\b(?:FROM|JOIN) (?:ONLY |LATERAL )?{QUALIFIED}", flat, re.I)]
        row["dependencies"] += [".".join(filter(None, q)) for q in used if q[0] or q[1] not in ctes]
    row["dependencies"] = list(dict.fromkeys(row["dependencies"]))
    if row["object_type"] == "VERBATIM":
        import hashlib

        row["object_name"] = "verbatim_statement_" + hashlib.sha256(sql.encode()).hexdigest()[:12]
    row["category"] = "data" if row["is_data_op"] else CATEGORIES.get(row["object_type"], "other")
    return row


#: Words before a bracket that call no function, and words of types that are no names.
NO_CALL = frozenset(
    "and any array as between by case cast check coalesce collate column conflict constraint default distinct do else end except exclude exists extract filter foreign from function generated group having in index inherits"
    " insert into join key lateral like limit not null of on only or over partition policy primary procedure references returning returns row select set some table then trigger type union unique update using values view when where with within"
    " bit char character decimal dec double float interval nchar numeric precision time timestamp varchar varying varbit".split()
)


def uses(sql: str) -> list[str]:
    """PRJ-7, GR-11, GR-12. What a statement speaks of, as class:name with a dot before a schema's names: tables, functions, types and sequences.

    Names of common table expressions and of the built-in types and functions are among them; a join with what exists leaves them out.
    """
    flat = plain(sql)
    quiet = "".join({"string": "''", "dollar": "$$$$"}.get(k, t) for k, t, _ in tokens(flat))
    ctes = {identifier(x) for x in re.findall(rf"(?:\bWITH|,) (?:RECURSIVE )?({NAME})(?: ?\([^)]*\))? AS (?:NOT MATERIALIZED |MATERIALIZED )?\(", quiet, re.I)}
    found = []

    def add(kind: str, name: str) -> None:
        schema, base = qualified(name)
        if base and (schema or base not in ctes):
            found.append(f"{kind}:{schema + '.' if schema else ''}{base}")

    for x in re.findall(rf"\b(?:REFERENCES|FROM|JOIN|INTO|UPDATE|INHERITS ?\(|PARTITION OF|LIKE|USING) (?:ONLY |LATERAL )?{QUALIFIED}(?! ?\.)", quiet.replace("INHERITS (", "INHERITS ( "), re.I):
        if x.upper() not in ("SELECT", "SET", "VALUES"):
            add("table", x)
    if m := re.search(rf"^CREATE (?:UNIQUE |OR REPLACE |CONSTRAINT )*(?:INDEX|TRIGGER|POLICY|RULE)\b.*? ON (?:ONLY )?{QUALIFIED}", quiet, re.I):
        add("table", m[1])
    for x in re.findall(rf"({NAME}(?: ?\. ?{NAME})*) ?\(", quiet):
        if qualified(x)[1] not in NO_CALL or "." in x:
            add("function", x)
    for x in re.findall(rf"(?:::|\bRETURNS (?:SETOF )?|\bAS )({NAME}(?: ?\. ?{NAME})*)", quiet, re.I):
        add("type", x)
    for x in re.findall(r"\b(?:nextval|currval|setval) ?\( ?'([^']+)'", flat, re.I) + re.findall(r"'([^']+)' ?:: ?regclass", flat, re.I):
        add("sequence", x)
    if m := re.match(rf"CREATE(?: \w+)* TABLE {IF}{QUALIFIED} ?\(", quiet, re.I):
        for part in split_list(balanced(quiet, m.end() - 1)):
            if c := re.match(rf"{NAME} ({NAME}(?: ?\. ?{NAME})*)", part):
                add("type", c[1])
    elif c := re.match(rf"ALTER TABLE .*\b(?:ADD (?:COLUMN )?{IF}{NAME}|TYPE) ({NAME}(?: ?\. ?{NAME})*)", quiet, re.I):
        add("type", c[1])
    if m := re.search(rf"\bOWNED BY {QUALIFIED}", quiet, re.I):
        if "." in m[1]:
            add("table", m[1].rsplit(".", 1)[0])
    return list(dict.fromkeys(found))


def static_ddl(block: str) -> list[str]:
    """PRJ-12. The DDL statements in a DO block's body; those put together at run time are left out."""
    body = next((t[t.index("$", 1) + 1 : t.rindex("$", 0, len(t) - 1)] for k, t, _ in tokens(block) if k == "dollar" and t.count("$") >= 4), "")
    found = []
    for s in split_statements(body):
        text = re.sub(r"^(?:DECLARE\b.*?\bBEGIN|BEGIN|IF\b.*?\bTHEN|ELSE|EXCEPTION\b.*)\s+", "", s["sql"], flags=re.S | re.I)
        text = re.sub(r"^(?:IF\b.*?\bTHEN|BEGIN|ELSE)\s+", "", text, flags=re.S | re.I)
        if re.match(r"(CREATE|ALTER|DROP|GRANT|REVOKE|COMMENT)\b", text, re.I):
            found.append(text)
    return found


def modernised(line: str) -> str:
    """ANC-4. A function without volatility becomes VOLATILE by name, where LANGUAGE ends its options."""
    if re.search(r"\b(IMMUTABLE|STABLE|VOLATILE)\b", line, re.I) or not re.search(r"\bCREATE\s+(OR\s+REPLACE\s+)?FUNCTION\b", line, re.I):
        return line
    return re.sub(r"(\bLANGUAGE\s+\w+)", r"\1 VOLATILE", line, count=1, flags=re.I)


#: STR-5. The operations of a statement.
OPERATIONS = ["CREATE", "ALTER", "DROP", "GRANT", "REVOKE", "COMMENT", "INSERT", "UPDATE", "DELETE", "TRUNCATE", "COPY", "REFRESH", "SETVAL", "EXECUTE", "UNKNOWN"]


def known_value(kind: str, value: str) -> str:
    """STR-5. The value, if it is one of the object types, operations or categories; otherwise an error that lists those."""
    allowed = {"object_type": sorted({*KINDS.values(), "ENUM", "DO_BLOCK", "VERBATIM", "COLUMN", "CONSTRAINT", "DATABASE"}), "operation": OPERATIONS, "category": sorted({*CATEGORIES.values(), "data", "other"})}[kind]
    if value not in allowed:
        raise ValueError(f"{value!r} is no {kind}: {', '.join(allowed)}")
    return value

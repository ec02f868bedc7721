"""Tables as DDL describes them: CREATE TABLE taken apart, ALTER TABLE as actions, and one applied to the other. Text in, text out."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from lithic.functions.shapes import shaped
from lithic.functions.sqltext import IF, NAME, QUALIFIED, balanced, bare, identifier, object_name, plain, qualified, split_list, tokens

CREATE = re.compile(rf"CREATE(?: (?:TEMP|TEMPORARY|UNLOGGED|GLOBAL|LOCAL))* TABLE {IF}{QUALIFIED} ?\(", re.I)
ALTER = re.compile(rf"ALTER TABLE {IF}(?:ONLY )?{QUALIFIED} (.*)$", re.I | re.S)
#: The words that begin a table constraint, and those that end a column's type.
CONSTRAINT = re.compile(r"(CONSTRAINT|PRIMARY KEY|UNIQUE|CHECK|FOREIGN KEY|EXCLUDE|LIKE)\b", re.I)
AFTER_TYPE = re.compile(r"\b(CONSTRAINT|NOT NULL|NULL|DEFAULT|PRIMARY KEY|UNIQUE|CHECK|REFERENCES|GENERATED|COLLATE|STORAGE|COMPRESSION|DEFERRABLE|INITIALLY|USING)\b", re.I)


@dataclass
class Element:
    """A column or a table constraint. name is folded; empty for an unnamed constraint."""

    kind: str
    name: str
    text: str


@dataclass
class Table:
    schema: str
    name: str
    head: str
    elements: list[Element]
    tail: str
    dropped: list[str] = field(default_factory=list)

    def column(self, name: str) -> Element | None:
        return next((e for e in self.elements if e.kind == "column" and e.name == name), None)

    def render(self) -> str:
        return f"{self.head}({', '.join(e.text for e in self.elements)}){self.tail}"


def outside(sql: str, pattern: str) -> re.Match | None:
    """A pattern's first match outside strings, found in the text without their contents but of equal length."""
    same = "".join(t if k not in ("string", "dollar", "comment") else t[0] + " " * (len(t) - 2) + t[-1:] for k, t, _ in tokens(sql))
    return re.search(pattern, same, re.I)


def element(text: str) -> Element:
    text = text.strip()
    if m := CONSTRAINT.match(text):
        named = re.match(rf"CONSTRAINT ({NAME})", text, re.I)
        return Element("like" if m[1].upper() == "LIKE" else "constraint", identifier(named[1]) if named else "", text)
    m = re.match(NAME, text)
    return Element("column", identifier(m[0]) if m else "", text)


def parse_create(sql: str) -> Table | None:
    """TYP-8, NM-6. A CREATE TABLE with a column list, or None for anything else (CREATE TABLE AS, PARTITION OF, other statements)."""
    flat = plain(sql)
    m = CREATE.match(flat)
    if not m:
        return None
    at = m.end() - 1
    body = balanced(flat, at)
    if not body.strip():
        return None
    schema, name = qualified(m[1])
    return Table(schema, name, flat[:at], [element(x) for x in split_list(body)], flat[at + len(body) + 2 :])


def column_type(text: str) -> str:
    """The type in a column's definition, in lower case and with single spaces."""
    rest = text[re.match(NAME, text).end() :].strip()
    cut = outside(rest, AFTER_TYPE.pattern)
    return re.sub(r"\s*,\s*", ",", re.sub(r"\s+", " ", rest[: cut.start()] if cut else rest)).strip().lower()


def column_default(text: str) -> str | None:
    """The default in a column's definition."""
    m = outside(text, r"\bDEFAULT ")
    if not m:
        return None
    rest = text[m.end() :]
    cut = outside(rest, r"(?<!^)\b(CONSTRAINT|NOT NULL|NULL|PRIMARY KEY|UNIQUE|CHECK|REFERENCES|GENERATED|COLLATE)\b")
    return (rest[: cut.start()] if cut else rest).strip()


@shaped
def actions(sql: str) -> tuple[tuple[str, str], list[dict]]:
    """((schema, table), actions) of an ALTER TABLE: each with kind, name, value and text; what is not known has kind OTHER."""
    m = ALTER.match(plain(sql).rstrip("; "))
    if not m:
        return ("", ""), []
    out = []
    for text in split_list(m[2]):
        found = next(((kind, x) for kind, p in ACTIONS if (x := re.match(p, text, re.I | re.S))), None)
        if not found:
            out.append({"kind": "OTHER", "name": "", "value": "", "text": text})
            continue
        kind, x = found
        groups = [*x.groups(""), "", ""]
        out.append({"kind": kind, "name": identifier(groups[0]) if groups[0] else "", "value": groups[1].strip(), "text": text})
    return qualified(m[1]), out


_COLUMN = rf"(?:COLUMN )?(?:IF (?:NOT )?EXISTS )?({NAME})"
#: The forms of ALTER TABLE that are followed, in the order in which they are tried.
ACTIONS = [
    ("ADD_CONSTRAINT", rf"ADD (?=CONSTRAINT|PRIMARY|UNIQUE|CHECK|FOREIGN|EXCLUDE)(?:CONSTRAINT ({NAME}) )?(.*)$"),
    ("ADD", rf"ADD {_COLUMN} (.*)$"),
    ("DROP_CONSTRAINT", rf"DROP CONSTRAINT (?:IF EXISTS )?({NAME})( CASCADE| RESTRICT)?$"),
    ("DROP", rf"DROP {_COLUMN}( CASCADE| RESTRICT)?$"),
    ("VALIDATE", rf"VALIDATE CONSTRAINT ({NAME})$"),
    ("TYPE", rf"ALTER {_COLUMN} (?:SET DATA )?TYPE (.*)$"),
    ("DEFAULT", rf"ALTER {_COLUMN} SET DEFAULT (.*)$"),
    ("NO_DEFAULT", rf"ALTER {_COLUMN} DROP DEFAULT$"),
    ("NOT_NULL", rf"ALTER {_COLUMN} SET NOT NULL$"),
    ("NULLABLE", rf"ALTER {_COLUMN} DROP NOT NULL$"),
    ("RENAME_CONSTRAINT", rf"RENAME CONSTRAINT ({NAME}) TO ({NAME})$"),
    ("RENAME_TABLE", rf"RENAME TO ({NAME})$"),
    ("RENAME", rf"RENAME {_COLUMN} TO ({NAME})$"),
    ("ENABLE", r"ENABLE ROW LEVEL SECURITY$"),
    ("DISABLE", r"DISABLE ROW LEVEL SECURITY$"),
    ("NO FORCE", r"NO FORCE ROW LEVEL SECURITY$"),
    ("FORCE", r"FORCE ROW LEVEL SECURITY$"),
    ("OWNER", rf"OWNER TO ({NAME})$"),
    ("SET_SCHEMA", rf"SET SCHEMA ({NAME})$"),
]


def _without(text: str, pattern: str) -> str:
    m = outside(text, pattern)
    return re.sub(r"\s+", " ", text[: m.start()] + text[m.end() :]).strip() if m else text


def apply(table: Table, a: dict, columns: bool = False) -> bool:
    """CR-3 and, with ``columns``, CR-4 and CR-5: an action folded into the CREATE. False, and no change, where it has to stay a statement of its own."""
    kind, name, value = a["kind"], a["name"], a["value"]
    here = table.column(name) if name else None
    exists = re.match(r"(?:ADD|DROP) (?:COLUMN )?IF (?:NOT )?EXISTS", a["text"], re.I)
    if kind == "ADD":
        if here:
            return bool(exists)
        if outside(value, r"\bNOT VALID\b"):
            return False
        table.elements.append(Element("column", name, f"{a['text'][a['text'].index(value) - 1 - _name_length(a['text'], value) : ].strip()}"))
        return True
    if kind == "ADD_CONSTRAINT":
        if outside(a["text"], r"\bNOT VALID\b") or re.search(r"\bUSING INDEX\b", a["text"], re.I) or name and any(e.name == name and e.kind == "constraint" for e in table.elements):
            return False
        table.elements.append(Element("constraint", name, re.sub(r"^ADD ", "", a["text"], flags=re.I)))
        return True
    if not columns:
        return False
    if kind == "DROP":
        if here is None:
            return bool(exists)
        used = re.compile(rf"(?<![\w$\"]){re.escape(name)}(?![\w$\"])", re.I)
        dependent = [e for e in table.elements if e is not here and e.kind == "constraint" and used.search(e.text)]
        if any(not re.search(r"\b(UNIQUE|PRIMARY KEY|FOREIGN KEY|CHECK)\b", e.text, re.I) for e in dependent) or len([e for e in table.elements if e.kind == "column"]) < 2:
            return False
        if any(e is not here and e.kind == "column" and used.search(bare(e.text)[len(e.name) :]) for e in table.elements):
            return False  # a generated column or a check of another column speaks of it
        table.elements = [e for e in table.elements if e is not here and e not in dependent]
        table.dropped.append(name)
        return True
    if kind == "DROP_CONSTRAINT":
        left = [e for e in table.elements if not (e.kind == "constraint" and e.name == name)]
        found = len(left) < len(table.elements)
        table.elements = left
        return found or bool(re.match(r"DROP CONSTRAINT IF EXISTS", a["text"], re.I) and not derived(table, name))
    if here is None:
        return False
    if kind == "TYPE":
        if re.search(r"\bUSING\b", bare(value), re.I) or re.search(r"\b(GENERATED|serial)\b", bare(here.text), re.I):
            return False
        first = re.match(NAME, here.text)[0]
        rest = here.text[len(first) :].strip()
        cut = outside(rest, AFTER_TYPE.pattern)
        here.text = " ".join(x for x in (first, value, rest[cut.start() :] if cut else "") if x)
        return True
    if kind in ("DEFAULT", "NO_DEFAULT"):
        if re.search(r"\bGENERATED\b", bare(here.text), re.I):
            return False
        old = column_default(here.text)
        if old is not None:
            here.text = _without(here.text, rf"\bDEFAULT .{{{len(old)}}}")
        if kind == "DEFAULT":
            first = re.match(NAME, here.text)[0]
            rest = here.text[len(first) :].strip()
            cut = outside(rest, AFTER_TYPE.pattern)
            head, tail = (rest[: cut.start()].strip(), rest[cut.start() :]) if cut else (rest, "")
            here.text = " ".join(x for x in (first, head, "DEFAULT", value, tail) if x)
        return True
    if kind in ("NOT_NULL", "NULLABLE"):
        if kind == "NULLABLE" and re.search(r"\b(PRIMARY KEY|IDENTITY)\b", bare(here.text), re.I):
            return False
        here.text = _without(here.text, r"(?<!SET )\bNOT NULL\b") + (" NOT NULL" if kind == "NOT_NULL" else "")
        return True
    return False


def _name_length(text: str, value: str) -> int:
    """Characters of the column's name before its definition in an ADD action."""
    return len(re.search(rf"({NAME}) $", text[: text.index(value)])[1])


def derived(table: Table, name: str) -> bool:
    """NM-10. Whether a name is one that the server would give to an unnamed constraint of the table."""
    return name in derived_names(table)


def derived_names(table: Table) -> list[str]:
    """NM-10. The names of unnamed constraints: table_pkey, table_column_key, table_column_check, table_column_fkey."""
    out = []
    for e in table.elements:
        t = bare(e.text)
        if e.kind == "column":
            kinds = [("PRIMARY KEY", "pkey", False), ("UNIQUE", "key", True), ("CHECK", "check", True), ("REFERENCES", "fkey", True)]
            out += [object_name(table.name, e.name if with_column else "", label) for word, label, with_column in kinds if re.search(rf"\b{word}\b", t, re.I) and not re.search(rf"\bCONSTRAINT {NAME} {word}\b", t, re.I)]
        elif e.kind == "constraint" and not e.name:
            columns = [identifier(c) for c in split_list(balanced(e.text, e.text.index("(")))] if "(" in e.text else []
            label = next((x for w, x in (("PRIMARY KEY", "pkey"), ("UNIQUE", "key"), ("FOREIGN KEY", "fkey"), ("CHECK", "check")) if t.upper().startswith(w)), "excl")
            out.append(object_name(table.name, "_".join(columns) if label in ("key", "fkey") else "", label))
    return out


def fold(statements: list[str], columns: bool = False) -> list[str]:
    """The CREATE TABLE, with the ALTERs that follow folded in up to the first that cannot be, and what is left after it.

    CR-16: where the result does not read as a table any more, the statements are returned as they are.
    """
    table = parse_create(statements[0]) if statements else None
    if table is None:
        return statements
    rest: list[str] = []
    for s in statements[1:]:
        (schema, name), todo = actions(s)
        if rest or name != table.name or not todo:
            rest.append(s)
            continue
        left = []
        for a in todo:
            if left or not apply(table, a, columns):
                left.append(a["text"])
        if left:
            rest.append(f"ALTER TABLE {schema + '.' if schema else ''}{table_word(s)} {', '.join(left)}")
    made = table.render()
    again = parse_create(made)
    return [made, *rest] if sound(made) and again and [e.text for e in again.elements] == [e.text for e in table.elements] else statements


def table_word(sql: str) -> str:
    """The table's own name in an ALTER TABLE, as it is written."""
    return re.findall(NAME, ALTER.match(plain(sql).rstrip("; "))[1])[-1]


@shaped
def sound(sql: str) -> bool:
    """CR-16, ANC-6. Brackets and quotes are closed, and there is one statement."""
    depth = 0
    for kind, t, _ in tokens(sql):
        if kind == "other" and t in "([{":
            depth += 1
        elif kind == "other" and t in ")]}":
            depth -= 1
        elif kind == "string" and not re.fullmatch(r"E?'(?:[^'\\]|''|\\.)*'", t, re.S | re.I) or kind == "quoted" and not (len(t) > 1 and t.endswith('"')) or kind == "dollar" and not re.fullmatch(r"(\$\w*\$).*\1", t, re.S):
            return False
        if depth < 0:
            return False
    return depth == 0


@shaped
def column_events(sql: str) -> list[tuple[str, str, str, str]]:
    """AGG-9, AGG-18. (table, column, action, value) of a CREATE or ALTER TABLE; the table with its schema, or public."""
    if table := parse_create(sql):
        name = f"{table.schema or 'public'}.{table.name}"
        out = []
        for e in table.elements:
            if e.kind == "column":
                out.append((name, e.name, "ADD", column_type(e.text)))
                if (d := column_default(e.text)) is not None:
                    out.append((name, e.name, "DEFAULT", d))
                if outside(e.text, r"\b(NOT NULL|PRIMARY KEY)\b"):
                    out.append((name, e.name, "NOT_NULL", ""))
        return out
    (schema, table_name), todo = actions(sql)
    name, out = f"{schema or 'public'}.{table_name}", []
    for a in todo:
        if a["kind"] == "ADD":
            out.append((name, a["name"], "ADD", column_type(f"{a['name'] or 'x'} {a['value']}" if re.fullmatch(r"[a-z_][\w$]*", a["name"]) else f"x {a['value']}")))
            if (d := column_default(f"x {a['value']}")) is not None:
                out.append((name, a["name"], "DEFAULT", d))
            if outside(a["value"], r"\b(NOT NULL|PRIMARY KEY)\b"):
                out.append((name, a["name"], "NOT_NULL", ""))
        elif a["kind"] == "TYPE":
            out.append((name, a["name"], "TYPE", column_type(f"x {a['value']}")))
        elif a["kind"] in ("DROP", "DEFAULT", "NOT_NULL", "NULLABLE"):
            out.append((name, a["name"], a["kind"], a["value"]))
        elif a["kind"] == "NO_DEFAULT":
            out.append((name, a["name"], "DEFAULT", ""))
        elif a["kind"] == "RENAME":
            out.append((name, a["name"], "RENAME", identifier(a["value"])))
        elif a["kind"] in ("ENABLE", "DISABLE", "FORCE", "NO FORCE"):
            out.append((name, "", a["kind"], ""))
    return out


def without_references(sql: str, gone: set[str]) -> str:
    """FLT-5. A CREATE or ALTER TABLE without its foreign keys to tables in ``gone`` (schema.name); empty if nothing of an ALTER is left."""

    def lost(text: str) -> bool:
        m = outside(text, rf"\bREFERENCES {QUALIFIED}")
        if not m:
            return False
        schema, name = qualified(re.match(rf"REFERENCES {QUALIFIED}", text[m.start() :], re.I)[1])
        return f"{schema or 'public'}.{name}" in gone

    def cut(text: str) -> str:
        tail = rf"(?:\bCONSTRAINT {NAME} )?\bREFERENCES {QUALIFIED}(?: ?\([^)]*\))?(?: MATCH \w+| ON (?:DELETE|UPDATE) (?:CASCADE|RESTRICT|NO ACTION|SET (?:NULL|DEFAULT)(?: ?\([^)]*\))?)| (?:NOT )?DEFERRABLE| INITIALLY \w+)*"
        return _without(text, tail)

    if table := parse_create(sql):
        if not any(lost(e.text) for e in table.elements):
            return sql
        kept = [e if not lost(e.text) else Element(e.kind, e.name, cut(e.text)) for e in table.elements if not (lost(e.text) and e.kind == "constraint")]
        return Table(table.schema, table.name, table.head, kept, table.tail).render()
    (schema, name), todo = actions(sql)
    left = [cut(a["text"]) if lost(a["text"]) else a["text"] for a in todo if not (lost(a["text"]) and a["kind"] == "ADD_CONSTRAINT")]
    if not todo or left == [a["text"] for a in todo]:
        return sql
    return f"{plain(sql)[: ALTER.match(plain(sql)).start(2)]}{', '.join(left)}" if left else ""

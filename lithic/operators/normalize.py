"""Rename normalisation of an ordered history (NM-1..11, QS-1..8): statements speak of objects by their final names.

Pass 1 walks the history and learns what every table, column, type, label, routine and schema is called in the end. Pass 2
walks it again through the same changes and writes every name in its final form. Only objects that the history creates are
followed; renames of others stay as they are. What the walk knows is kept as the changes that each statement makes, not as
a copy for each statement. The walk depends on the order of all statements of a database, so it is one sequential fold
for each ``database`` key by ``applyInPandas``: a history has thousands of statements, and databases run in parallel.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame

from lithic.functions import ddl
from lithic.functions.scopes import Column, Entity, Relation, Statement, quoted
from lithic.functions.shapes import shaped
from lithic.functions.sqltext import IF, NAME, QUALIFIED, balanced, identifier, plain, qualified, signature, singles, split_list, split_statements, tokens

RELATION = "TABLE|FOREIGN TABLE|VIEW|MATERIALIZED VIEW|INDEX|SEQUENCE"
KIND = rf"({RELATION}|TYPE|DOMAIN|SCHEMA|FUNCTION|PROCEDURE|ROUTINE)"
RENAME = re.compile(rf"^ALTER {KIND} {IF}(?:ONLY )?{QUALIFIED}(\([^)]*\))? RENAME (?:TO ({NAME})|(COLUMN |ATTRIBUTE |VALUE |CONSTRAINT )?({NAME}|'(?:[^']|'')*') TO ({NAME}|'(?:[^']|'')*'))(?: CASCADE| RESTRICT)?$", re.I)
MOVE = re.compile(rf"^ALTER {KIND} {IF}{QUALIFIED}(\([^)]*\))? SET SCHEMA ({NAME})$", re.I)
CREATE = re.compile(rf"^CREATE (?:OR REPLACE )?(?:(?:TEMP|TEMPORARY|UNLOGGED|UNIQUE|RECURSIVE) )*{KIND} (?:CONCURRENTLY )?{IF}{QUALIFIED}", re.I)
DROP = re.compile(rf"^DROP {KIND} (?:CONCURRENTLY )?{IF}{QUALIFIED}(\([^)]*\))?( CASCADE| RESTRICT)?$", re.I)


def family(kind: str) -> str:
    """Objects of one family share a namespace."""
    kind = kind.upper()
    return "type" if kind in ("TYPE", "DOMAIN") else "schema" if kind == "SCHEMA" else "routine" if kind in ("FUNCTION", "PROCEDURE", "ROUTINE") else "relation"


class Names(dict):
    """(family, schema, name) -> entity, with the places of entities, and names and routines by themselves, each in the order in which they came."""

    def __init__(self) -> None:
        self.place: dict[int, tuple] = {}
        self.like: dict[tuple, dict[tuple, None]] = {}

    @staticmethod
    def likes(key: tuple[str, str, str]) -> list[tuple]:
        kind, schema, name = key
        return [(kind,), (kind, name), *([(kind, schema, name.split("(")[0])] if kind == "routine" else [])]

    def __setitem__(self, key: tuple[str, str, str], e: Entity) -> None:
        if key in self:
            self.place.pop(id(self[key]), None)
        super().__setitem__(key, e)
        self.place[id(e)] = key
        for x in self.likes(key):
            self.like.setdefault(x, {})[key] = None

    def __delitem__(self, key: tuple[str, str, str]) -> None:
        self.pop(key)

    def pop(self, key: tuple[str, str, str], default: Entity | None = None) -> Entity | None:
        if key not in self:
            return default
        e = super().pop(key)
        if self.place.get(id(e)) == key:
            del self.place[id(e)]
        for x in self.likes(key):
            del self.like[x][key]
        return e

    def all(self, *like: str) -> list[Entity]:
        """Those of a family, of a family and name, or the routines of a schema and name."""
        return [self[key] for key in self.like.get(like, ())]


class Namespace:
    """NM-2. What names mean now: (family, schema, name) -> entity, with a search path."""

    def __init__(self) -> None:
        self.now = Names()
        self.was: dict[int, tuple[str, str]] = {}
        self.columns: dict[int, dict[str, Column]] = {}
        self.path = ["public"]

    def key(self, kind: str, schema: str, name: str) -> tuple[str, str, str]:
        if kind == "schema":
            return kind, "", name
        if schema:
            return kind, schema, name
        return next(((kind, s, name) for s in self.path if (kind, s, name) in self.now), (kind, self.path[0], name))

    def get(self, kind: str, schema: str, name: str) -> Entity | None:
        return self.now.get(self.key(kind, schema, name))

    # ---- as a catalogue of scopes ----

    def relation(self, schema: str, name: str) -> Entity | None:
        e = self.get("relation", schema, name)
        return e if e is not None and e.made else None

    def type(self, schema: str, name: str) -> Entity | None:
        e = self.get("type", schema, name)
        return e if e is not None and e.made else None

    def routine(self, schema: str, name: str) -> Entity | None:
        e = next(iter(self.now.all("routine", schema or self.path[0], name)), None)
        return e if e is not None and e.made else None

    def schema_then(self, e: Entity, name: str) -> str:
        """The schema in which the search path finds a bare name now: where the entity lies elsewhere in the end, its schema is written."""
        return next((s for s in self.path if (e.kind, s, name) in self.now), self.path[0])


def _change(space: Namespace, k: int, flat: str, making: bool, entities: dict) -> str:
    """What statement k does to the namespace. ``making``: pass 1, which makes entities and moves final names; pass 2 finds them again.

    Returns "gone" for a statement that only renames what the history has created: nothing is left to do for it.
    """
    if m := re.match(rf"^SET (?:LOCAL |SESSION )?search_path (?:TO|=) (.+)$", flat, re.I):
        found = [identifier(x.strip("'")) for x in split_list(m[1])]
        space.path = [x for x in found if x not in ("pg_catalog", "$user", "default")] or ["public"]
        return ""
    if m := RENAME.match(flat):
        kind, (schema, name) = family(m[1]), qualified(m[2])
        routine = kind == "routine" and m[3]
        e = space.get(kind, schema, name + (signature(m[3][1:-1]) if routine else ""))
        if m[4]:
            return _rename(space, kind, e, identifier(m[4]), making, signature(m[3][1:-1]) if routine else "")
        old, new = (identifier(x) if not x.startswith("'") else x[1:-1].replace("''", "'") for x in (m[6], m[7]))
        if e is None or not e.made or (m[5] or "").strip().upper() == "CONSTRAINT" or old not in e.columns:
            return ""
        cell = e.columns[old]
        e.columns = {(new if c == old else c): x for c, x in e.columns.items()}
        if making:
            cell.name = new
            e.altered = k[0]
        return "gone"
    if m := MOVE.match(flat):
        kind, (schema, name), new = family(m[1]), qualified(m[2]), identifier(m[4])
        name += signature(m[3][1:-1]) if kind == "routine" and m[3] else ""
        key = space.key(kind, schema, name)
        e = space.now.pop(key, None)
        if e is None:
            return ""
        space.now[kind, new, name] = e
        if making and e.made:
            e.schema = new
        return "gone" if e.made else ""
    if m := DROP.match(flat):
        kind, (schema, name) = family(m[1]), qualified(m[2])
        if kind == "schema":
            for key in [x for x in space.now if x[1] == name or x == (kind, "", name)]:
                del space.now[key]
        else:
            space.now.pop(space.key(kind, schema, name + (signature(m[3][1:-1]) if kind == "routine" and m[3] else "")), None)
        return ""
    if m := CREATE.match(flat):
        kind, (schema, name) = family(m[1]), qualified(m[2])
        if m[1].upper() == "INDEX" and (on := re.search(rf"\bON (?:ONLY )?{QUALIFIED}", flat, re.I)):
            if m[2].upper() == "ON":
                return ""
            schema = qualified(on[1])[0] or schema
        if kind == "routine":
            at = flat.index("(") if "(" in flat else -1
            name += signature(balanced(flat, at)) if at > 0 else ""
        key = ("schema", "", name) if kind == "schema" else (kind, schema or space.path[0], name)
        if key in space.now and (re.search(r"\bIF NOT EXISTS\b", flat, re.I) or re.match(r"CREATE OR REPLACE", flat, re.I)):
            return ""
        if making:
            entities[k] = Entity(kind, key[1], name.split("(")[0], made=True)
            _members(entities[k], m[1].upper(), flat, space)
        e = entities[k]
        if not making:
            e.columns = dict(e.first)
        space.now[key] = e
        return ""
    (schema, table), todo = ddl.actions(flat)
    e = space.get("relation", schema, table) if todo else None
    if e is not None and e.made:
        for n, a in enumerate(todo):
            if a["kind"] == "ADD" and a["name"] not in e.columns:
                if making:
                    entities[k, n] = Column(a["name"])
                e.columns[a["name"]] = entities[k, n]
            elif a["kind"] == "DROP":
                e.columns.pop(a["name"], None)
            if making and a["kind"] in ("ADD", "DROP"):
                e.altered = k[0]
    if making and (m := re.match(rf"ALTER TYPE {QUALIFIED} ADD VALUE {IF}'((?:[^']|'')*)'", flat, re.I)):
        e = space.get("type", *qualified(m[1]))
        if e is not None:
            entities[k, "label"] = Column(m[2].replace("''", "'"))
    if (k, "label") in entities:
        m = re.match(rf"ALTER TYPE {QUALIFIED} ADD VALUE", flat, re.I)
        e = space.get("type", *qualified(m[1]))
        if e is not None:
            e.columns.setdefault(entities[k, "label"].name if making else _label(flat), entities[k, "label"])
    return ""


def _label(flat: str) -> str:
    return re.search(r"ADD VALUE (?:IF NOT EXISTS )?'((?:[^']|'')*)'", flat, re.I)[1].replace("''", "'")


def _rename(space: Namespace, kind: str, e: Entity | None, new: str, making: bool, arguments: str) -> str:
    if e is None:
        return ""
    key = space.now.place[id(e)]
    del space.now[key]
    if kind == "schema":
        space.now["schema", "", new] = e
        for other in [x for x in space.now if x[1] == key[2]]:
            moved = space.now.pop(other)
            space.now[other[0], new, other[2]] = moved
            if making and moved.made:
                moved.schema = new
        space.path = [new if s == key[2] else s for s in space.path]
    else:
        space.now[kind, key[1], new + arguments] = e
    if making and e.made:
        e.name = new
    return "gone" if e.made else ""


def _members(e: Entity, kind: str, flat: str, space: Namespace) -> None:
    """NM-6, NM-8. Columns of tables, attributes of composite types, labels of enums."""
    if table := ddl.parse_create(flat):
        for x in table.elements:
            if x.kind == "column":
                e.columns[x.name] = Column(x.name)
        e.whole = not any(x.kind == "like" for x in table.elements) and not re.search(r"\bINHERITS ?\(", table.tail, re.I)
    elif kind == "TYPE" and (m := re.search(r"\bAS ENUM ?\(", flat, re.I)):
        for x in split_list(balanced(flat, m.end() - 1)):
            label = x.strip()[1:-1].replace("''", "'")
            e.columns[label] = Column(label)
    elif kind == "TYPE" and (m := re.search(r"\bAS ?\(", flat, re.I)):
        for x in split_list(balanced(flat, m.end() - 1)):
            if n := re.match(NAME, x):
                e.columns[identifier(n[0])] = Column(identifier(n[0]))
    e.first = dict(e.columns)


class Rewriter:
    """Pass 2 for one statement: every name in its final form (NM-3)."""

    def __init__(self, space: Namespace, k: int) -> None:
        self.space, self.k = space, k

    def sql(self, text: str) -> str:
        s = Statement(text, self.space, self.k)
        first = s.word(0)
        if first in ("insert", "update", "delete", "select", "with", "values"):
            s.any(0, len(s), [], {})
        elif first in ("create", "alter", "drop", "comment", "grant", "revoke", "truncate", "refresh"):
            self.ddl(s, text)
        return s.render()

    def ddl(self, s: Statement, text: str) -> None:
        words = [s.word(n) for n in range(min(len(s), 12))]
        n = next((i for i, w in enumerate(words) if w in KINDS), None)
        if words[0] in ("grant", "revoke"):
            on = next((i for i in range(len(s)) if s.word(i) == "on"), None)
            if on is not None:
                self.privileges(s, on)
            return
        if words[0] == "comment":
            self.comment(s)
            return
        if n is None and words[0] == "truncate":
            s.relation(s.dotted(2 if words[1] == "table" else 1, len(s)))
            return
        if n is None:
            return
        kind, n = words[n], n + 1
        while s.word(n) in ("concurrently", "if", "not", "exists", "only"):
            n += 1
        if kind in ("policy", "trigger", "rule"):
            on = next((i for i in range(n, len(s)) if s.word(i) == "on"), None)
            if on is not None:
                parts = s.dotted(on + 1, len(s))
                here = self.target(s, parts)
                scopes = [[here, Relation("new", here.entity), Relation("old", here.entity)]] if kind != "policy" else [[here]]  # QS-7
                if kind == "trigger":
                    before = next((i for i in range(n, on) if s.word(i) == "of"), None)
                    if before is not None:
                        s.expressions(before + 1, on, [[here]], {})
                self.rest(s, parts[-1] + 1, scopes, text)
            return
        if kind == "index":
            on = next((i for i in range(n, len(s)) if s.word(i) == "on"), None)
            if on is None or words[0] != "create":
                if s.is_name(n):
                    s.relation(s.dotted(n, len(s)))
                return
            if s.is_name(n) and n < on:
                e = self.space.get("relation", "", identifier(s.text(n))) or next(iter(self.space.now.all("relation", identifier(s.text(n)))), None)
                if e is not None and e.made and e.name != identifier(s.text(n)):
                    s.put(n, quoted(e.name))
            start = on + 2 if s.word(on + 1) == "only" else on + 1
            parts = s.dotted(start, len(s))
            here = self.target(s, parts)
            s.expressions(parts[-1] + 1, len(s), [[here]], {})
            return
        if not (n < len(s) and s.raw[s.at[n]][0] in ("word", "quoted")):
            return
        parts = s.dotted(n, len(s))
        after = parts[-1] + 1
        if kind == "schema":
            e = self.space.get("schema", "", identifier(s.text(n)))
            if e is not None and e.made and e.name != identifier(s.text(n)):
                s.put(n, quoted(e.name))
            return
        if kind in ("type", "domain"):
            e = s.type_name(parts)
            self.labels(s, after, e)
            for i in range(after, len(s)):
                if s.is_name(i) and s.text(i + 1) != "(" and s.text(i - 1) != ".":
                    s.type_name(s.dotted(i, len(s)))
            return
        if kind in ("function", "procedure", "routine"):
            close = s.close.get(after)
            name = identifier(s.text(parts[-1])) + (signature(text[text.index("(") + 1 : _closing(text, text.index("("))]) if "(" in text else "")
            schema = identifier(s.text(parts[-2])) if len(parts) > 1 else ""
            e = self.space.get("routine", schema, name)
            if e is not None and e.made:
                s.rename(parts, e, schema, identifier(s.text(parts[-1])))
            for i in range(after, len(s)):
                if s.is_name(i) and s.text(i - 1) != "." and (close is None or i < close or s.word(i - 1) in ("returns", "setof")):
                    s.type_name(s.dotted(i, len(s)))
                if s.raw[s.at[i]][0] == "dollar":
                    s.put(i, self.body(s.text(i)))
            return
        here = self.target(s, parts)
        if kind in ("view", "table") and any(s.word(i) == "as" for i in s.level(after, len(s))) and words[0] == "create":  # views, CREATE TABLE AS
            at = next(i for i in s.level(after, len(s)) if s.word(i) == "as")
            s.view = True
            s.any(at + 1, len(s), [], {})
            return
        self.rest(s, after, [[here]], text)

    def target(self, s: Statement, parts: list[int]) -> Relation:
        name = identifier(s.text(parts[-1]))
        here = Relation(name, s.relation(parts))
        here.old = (parts, name)
        return here

    def rest(self, s: Statement, n: int, scopes: list, text: str) -> None:
        """What follows the name of a table: columns and constraints, with keys of other tables, types, defaults and checks."""
        i = n
        while i < len(s):
            if s.word(i) == "references" and s.is_name(i + 1):
                parts = s.dotted(i + 1, len(s))
                there = self.target(s, parts)
                i = parts[-1] + 1
                if s.text(i) == "(" and i in s.close:
                    s.expressions(i + 1, s.close[i], [[there]], {})
                    i = s.close[i] + 1
                continue
            if s.word(i) in ("execute",) and s.word(i + 1) in ("function", "procedure"):
                s.routine(s.dotted(i + 2, len(s)))
                return
            if s.text(i) == "(" and i in s.close:
                inner = i + 1
                if s.word(inner) in ("select", "with"):
                    s.query(inner, s.close[i], scopes, {})
                    i = s.close[i] + 1
                    continue
            if s.raw[s.at[i]][0] == "string":
                s.literal(i, len(s))
                self.enum_default(s, i)
            elif s.is_name(i) and s.text(i - 1) != ".":
                parts = s.dotted(i, len(s))
                if s.text(parts[-1] + 1) == "(" and s.word(i - 1) not in ("references",) and len(parts) >= 1 and self.space.routine(*s._named(parts)) is not None:
                    s.routine(parts)
                elif len(parts) > 1:
                    before = [s.text(p) for p in parts]
                    s.qualified_column(parts, scopes)
                    if before == [s.text(p) for p in parts]:
                        s.type_name(parts)
                elif self.type_place(s, i):
                    s.type_name(parts)
                else:
                    s.bare_column(i, scopes, None)
                i = parts[-1] + 1
                continue
            i += 1

    @staticmethod
    def type_place(s: Statement, i: int) -> bool:
        """Whether a bare name stands where a column's type does: behind a name that begins an element, or behind TYPE."""
        if s.word(i - 1) == "type":
            return True
        return i >= 2 and s.is_name(i - 1) and (s.text(i - 2) in ("(", ",") or s.word(i - 2) in ("column", "add", "exists"))

    def enum_default(self, s: Statement, n: int) -> None:
        """QS-5. A label as the default of a column of an enum's type."""
        if s.word(n - 1) != "default":
            return
        for i in range(n - 2, max(n - 8, 0), -1):
            if s.text(i) in (",", "("):
                break
            if s.is_name(i):
                e = next((x for x in self.space.now.all("type") if x.made and identifier(s.text(i)) in (x.name,)), None) or self.space.type("", identifier(s.text(i)))
                inner = s.text(n)[1:-1].replace("''", "'")
                if e is not None and inner in e.columns:
                    s.put(n, "'" + e.columns[inner].name.replace("'", "''") + "'")
                return

    def labels(self, s: Statement, n: int, e: Entity | None) -> None:
        if e is None:
            return
        for i in range(n, len(s)):
            kind, t = s.raw[s.at[i]]
            name = t[1:-1].replace("''", "'") if kind == "string" else identifier(t) if kind in ("word", "quoted") else ""
            if name in e.columns and e.columns[name].name != name and (kind == "string" or s.text(i - 1) in ("(", ",") or s.word(i - 1) == "attribute"):
                new = e.columns[name].name
                s.put(i, "'" + new.replace("'", "''") + "'" if kind == "string" else quoted(new))

    def privileges(self, s: Statement, on: int) -> None:
        stop = next((i for i in range(on, len(s)) if s.word(i) in ("to", "from")), len(s))
        n = on + 1
        kind = s.word(n) if s.word(n) in ("table", "sequence", "function", "procedure", "schema", "type", "domain") else "table"
        n += s.word(n) == kind and s.word(n) != ""
        if s.word(on + 1) == "all":
            n, kind = stop - 1, "schema"
        if kind == "schema":
            e = self.space.get("schema", "", identifier(s.text(n)))
            if e is not None and e.made:
                s.put(n, quoted(e.name))
        elif kind in ("type", "domain"):
            s.type_name(s.dotted(n, stop))
        elif kind in ("function", "procedure"):
            s.routine(s.dotted(n, stop))
        elif s.is_name(n):
            here = self.target(s, s.dotted(n, stop))
            s.expressions(0, on, [[here]], {})  # column privileges

    def comment(self, s: Statement) -> None:
        kind = s.word(2)
        n = 4 if kind == "materialized" else 3
        if not (n < len(s)):
            return
        parts = s.dotted(n, len(s))
        if kind == "column" and len(parts) > 1:
            column = parts[-1]
            e = s.relation(parts[:-1])
            name = identifier(s.text(column))
            if e is not None and name in e.columns and e.columns[name].name != name:
                s.put(column, quoted(e.columns[name].name))
        elif kind in ("table", "view", "materialized", "sequence", "index"):
            s.relation(parts)
        elif kind in ("type", "domain"):
            s.type_name(parts)
        elif kind in ("function", "procedure"):
            s.routine(parts)
        else:
            on = next((i for i in range(n, len(s)) if s.word(i) == "on"), None)
            if on is not None:
                s.relation(s.dotted(on + 1, len(s)))

    def body(self, text: str) -> str:
        """NM-9. A routine's body between dollar quotes: the statements in it, each by itself."""
        m = re.fullmatch(r"(\$\w*\$)(.*)\1", text, re.S)
        if not m:
            return text
        out, last = [], 0
        for part in split_statements(m[2]):
            out += [m[2][last : part["offset"]], self.inner(part["sql"])]
            last = part["offset"] + len(part["sql"])
        return m[1] + "".join(out) + m[2][last:] + m[1]

    def inner(self, sql: str) -> str:
        """A statement of a body: what stands before its first INSERT, UPDATE, DELETE, SELECT or WITH is control flow."""
        m = re.search(r"\b(INSERT\s+INTO|UPDATE|DELETE\s+FROM|SELECT|WITH)\b", sql, re.I)
        return sql[: m.start()] + self.sql(sql[m.start() :]) if m else sql


KINDS = frozenset("table view index sequence type domain schema function procedure routine policy trigger rule".split())


def _closing(text: str, at: int) -> int:
    return at + 1 + len(balanced(text, at))


@shaped
def _flat(sql: str) -> list[str]:
    return [plain(x) for x in singles(sql)]


def normalise(statements: list[str]) -> list[str]:
    """NM-1. The statements in final names; empty where nothing is left to do. A statement on a list of objects is followed object by object."""
    entities: dict = {}
    flat = [_flat(s) for s in statements]
    for making in (True, False):
        space, out = Namespace(), []
        for k, s in enumerate(statements):
            if not making:
                before = Rewriter(space, k)
            gone = [False] * len(flat[k])
            if making:
                for n, f in enumerate(flat[k]):
                    _change(space, (k, n), f, True, entities)
                continue
            creates = CREATE.match(flat[k][0])
            if not creates:
                written = before.sql(s)
            for n, f in enumerate(flat[k]):
                gone[n] = _change(space, (k, n), f, False, entities) == "gone"
            if creates:  # its own name and columns are known from now on
                written = before.sql(s)
            out.append("" if all(gone) else written)
    return out


def normalised_log(log: DataFrame) -> DataFrame:
    """(database, seq, stmt_idx, sql) with sql in final names; statements that only rename become empty."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["seq", "stmt_idx"])
        return pdf.assign(sql=normalise(pdf["sql"].tolist()))

    return log.select("database", "seq", "stmt_idx", "sql").groupBy("database").applyInPandas(one, "database string, seq long, stmt_idx int, sql string")

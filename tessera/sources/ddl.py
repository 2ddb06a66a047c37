"""A reader of CREATE TABLE and CREATE INDEX statements.

Contents are normalised to one line: single blanks, upper-case keywords and
types, no comments. Only that much is normalised: types keep their spelling.
"""

from __future__ import annotations

import re

TOKEN = re.compile(
    r"(?P<skip>\s+|--[^\n]*|/\*.*?(?:\*/|\Z))|(?P<name>\"(?:[^\"]|\"\")*\"|`[^`]*`)|(?P<text>'(?:[^']|'')*'|\$(?P<tag>\w*)\$.*?\$(?P=tag)\$)|(?P<word>[^\W\d][\w$]*)|(?P<number>\d[\d.]*)|(?P<sign>::|<>|<=|>=|!=|.)", re.S
)
#: words that begin a table constraint, and those that end a column's type
TABLE_RULES = frozenset("CONSTRAINT PRIMARY FOREIGN UNIQUE CHECK EXCLUDE LIKE PERIOD".split())
COLUMN_RULES = frozenset("NOT NULL DEFAULT PRIMARY UNIQUE REFERENCES CHECK CONSTRAINT COLLATE GENERATED AUTO_INCREMENT COMMENT ON STORED".split())
KEYWORDS = frozenset(
    "CREATE TABLE TEMP TEMPORARY UNLOGGED IF NOT EXISTS NULL DEFAULT PRIMARY KEY UNIQUE REFERENCES FOREIGN CHECK CONSTRAINT ON DELETE UPDATE CASCADE RESTRICT SET NO ACTION GENERATED ALWAYS BY AS IDENTITY STORED "
    "COLLATE COMMENT TRUE FALSE AND OR IN IS LIKE BETWEEN CURRENT_TIMESTAMP CURRENT_DATE PARTITION RANGE LIST HASH USING WITH INDEX "
    "BIGINT INT INTEGER SMALLINT SERIAL BIGSERIAL TEXT VARCHAR CHAR CHARACTER VARYING DATE TIMESTAMP TIMESTAMPTZ TIME ZONE WITHOUT BOOLEAN BOOL DECIMAL NUMERIC JSON JSONB UUID BYTEA DOUBLE PRECISION REAL FLOAT".split()
)


def _tokens(text: str) -> list[tuple[str, str]]:
    return [(m.group(), "name" if m.lastgroup == "name" else m.lastgroup if m.lastgroup != "tag" else "text") for m in TOKEN.finditer(text) if m.lastgroup != "skip"]


def _statements(tokens: list[tuple[str, str]]) -> list[list[tuple[str, str]]]:
    out: list[list] = [[]]
    depth = 0
    for t in tokens:
        depth += (t[0] == "(") - (t[0] == ")")
        if t[0] == ";" and depth <= 0:
            out.append([])
            depth = 0
        else:
            out[-1].append(t)
    return [s for s in out if s]


def _plain(t: tuple[str, str]) -> str:
    return t[0][1:-1].replace('""', '"') if t[1] == "name" else t[0]


def _text(tokens: list[tuple[str, str]]) -> str:
    out = ""
    before = ""
    for value, kind in tokens:
        shown = value.upper() if kind == "word" and value.upper() in KEYWORDS else value
        # VARCHAR(32), DECIMAL(18, 2), NOW(), but NOT NULL and KEY (a)
        glued = not out or before in ("(", ".", "::", "[") or value in (")", ",", ".", "::", "[", "]") or value == "(" and before and (before.upper() not in ("KEY", "UNIQUE", "CHECK", "REFERENCES", "AS", "IN", "BY", "USING", "INCLUDE", "WITH", "DEFAULT", "TABLE") and kind == "sign" and before[-1:].isalnum())
        out += ("" if glued else " ") + shown
        before = value
    return out


def _name(tokens: list[tuple[str, str]], i: int) -> tuple[str, int]:
    """The last part of a dotted name at i, and the place after it."""
    name = _plain(tokens[i])
    while i + 2 < len(tokens) and tokens[i + 1][0] == ".":
        i += 2
        name = _plain(tokens[i])
    return name, i + 1


def _definitions(tokens: list[tuple[str, str]]) -> list[list[tuple[str, str]]]:
    out: list[list] = [[]]
    depth = 0
    for t in tokens:
        depth += (t[0] in "([") - (t[0] in ")]")
        if t[0] == "," and not depth:
            out.append([])
        else:
            out[-1].append(t)
    return [d for d in out if d]


def parse(path: str, content: str) -> tuple[list[dict], list[dict]]:
    """Items and symbols of one file, as dicts of their columns."""
    tables, indexes = [], {}
    for s in _statements(_tokens(content)):
        up = [t[0].upper() if t[1] == "word" else t[0] for t in s]
        if up[0] != "CREATE":
            continue
        i = 1
        while i < len(s) and up[i] in ("OR", "REPLACE", "GLOBAL", "LOCAL", "TEMP", "TEMPORARY", "UNLOGGED", "UNIQUE"):
            i += 1
        what = up[i] if i < len(s) else ""
        i += 1
        i += up[i : i + 1] == ["CONCURRENTLY"]
        if up[i : i + 3] == ["IF", "NOT", "EXISTS"]:
            i += 3
        if what == "INDEX" and "ON" in up[i:]:
            at = up.index("ON", i)
            name = _name(s, i)[0] if at > i else ""
            at += 1 + (up[at + 1 : at + 2] == ["ONLY"])
            if at < len(s):
                indexes.setdefault(_name(s, at)[0], []).append(name)
        elif what == "TABLE" and i < len(s):
            name, j = _name(s, i)
            if j < len(s) and s[j][0] == "(":
                depth, k = 0, j
                while k < len(s):
                    depth += (s[k][0] == "(") - (s[k][0] == ")")
                    k += 1
                    if not depth:
                        break
                columns = [d for d in _definitions(s[j + 1 : k - 1]) if d[0][1] == "name" or d[0][0].upper() not in TABLE_RULES]
            else:
                columns = []
            tables.append((name, s, columns))
    items, symbols = [], []
    for name, statement, columns in tables:
        base = {"asset_type": "db_schema", "source_type": "db_schema", "path": path, "table_name": name}
        at = next((i for i, t in enumerate(statement) if t[0] == "("), len(statement))
        whole = _text(statement[:at]) + (" " + _text(statement[at:]) if at < len(statement) else "")
        named = [_plain(d[0]) for d in columns]
        meta = {"symbol_type": "table", "table": name, "columns": " ".join(named), "indexes": " ".join(indexes.get(name, []))}
        items.append(base | {"id": f"db_schema:{path}:{name}", "title": name, "content": whole, "summary": f"数据库表 {name}。", "metadata": meta, "symbol_type": "table"})
        symbols.append({"symbol_id": f"sql:table:{name}", "path": path, "language": "sql", "kind": "table", "name": name, "qualified_name": name, "source_item_id": items[-1]["id"]})
        for column, d in zip(named, columns):
            end = next((i for i in range(1, len(d)) if d[i][0].upper() in COLUMN_RULES), len(d))
            full = f"{name}.{column}"
            meta = {"symbol_type": "column", "table": name, "column": column, "data_type": _text(d[1:end])}
            items.append(base | {"id": f"db_schema:{path}:{full}", "title": full, "content": _text(d), "summary": f"数据库字段 {full}。", "metadata": meta, "symbol_type": "column", "column_name": column})
            symbols.append({"symbol_id": f"sql:column:{full}", "path": path, "language": "sql", "kind": "column", "name": column, "qualified_name": full, "source_item_id": items[-1]["id"]})
    return items, symbols

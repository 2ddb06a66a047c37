"""A scanner for the declarations of a Java source text."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

#: the texts by the mark that opens them, or in a group that mark where it closes nowhere; of three quotes, the first two then are an empty text
TEXTS = {'""': r'"""(?:[^"\\]|\\.|"(?!""))*+"""|(""(?="))', '"': r'"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"|(")', "'": r"'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'|(')"}
INSIDE = {q: re.compile(rf"[^{q}\\\n]*+(?:\\.[^{q}\\\n]*+)*+", re.S) for q in "\"'"}
TYPE_WORDS = {"class": "class", "interface": "interface", "enum": "enum", "record": "record"}
MODIFIERS = frozenset("public protected private static final abstract native synchronized transient volatile strictfp default sealed".split())
CLOSE = {"(": ")", "[": "]", "{": "}", "<": ">"}
#: the words at which something may begin, in code and outside of types
CODE_STOPS = frozenset([*TYPE_WORDS, "@", "new", "{"])
FILE_STOPS = frozenset([*TYPE_WORDS, *MODIFIERS, "@", "non", "package", "import", "{"])
#: what a text with a type has
TYPE = re.compile(r"\b(?:class|interface|enum|record)\b")


@cache
def _token(barred: frozenset[str]) -> re.Pattern[str]:
    """A token; group 1 is a comment, any other the mark of a text that closes nowhere. Barred marks open no text."""
    texts = [x for mark, x in TEXTS.items() if mark not in barred]
    return re.compile("|".join([r"[^\W\d]\w*", r"(//[^\n]*|/\*.*?(?:\*/|\Z))", *texts, r"\$[\w$]*", r"\d[\w.]*", r"\.\.\.|->|::|\S"]), re.S)


def _spans(text: str) -> list[tuple[int, int]]:
    """Where the tokens other than comments lie.

    Where a text closes nowhere, neither does one that the same mark, escaped,
    would open on the way to where it had to close: that isn't tried again.
    """
    out: list[tuple[int, int]] = []
    barred: dict[str, int] = {}
    i, more = 0, True
    while more:
        more = False
        barred = {mark: end for mark, end in barred.items() if end > i}
        limit = min(barred.values(), default=len(text))
        for m in _token(frozenset(barred)).finditer(text, i):
            i = m.start()
            if more := i >= limit:
                break
            group = m.lastindex
            if group == 1:
                continue
            out.append(m.span())
            if group:
                mark, i = m.group(), m.end()
                end = INSIDE[mark].match(text, i).end() if mark in INSIDE else len(text)
                if more := text.find("\\" + mark, i, end) >= 0:
                    barred[mark] = end
                    break
    return out


@dataclass
class Declaration:
    kind: str
    name: str
    start: int
    end: int
    annotations: list[str]
    parameters: list[str] = field(default_factory=list)
    names: list[str] = field(default_factory=list)
    #: of a type: what it encloses, in order of the text
    types: list["Declaration"] = field(default_factory=list)
    methods: list["Declaration"] = field(default_factory=list)
    members: list["Declaration"] = field(default_factory=list)
    path: tuple[str, ...] = ()


class Scanner:
    """Reads types, methods, constructors and fields; bodies only for the types and anonymous classes within."""

    def __init__(self, text: str):
        self.text = text
        self.types: list[Declaration] = []
        self.package = ""
        self.spans = _spans(text) if TYPE.search(text) else []
        self.size = len(self.spans)
        #: with some empty ones behind, for what looks ahead
        self.words = [text[a:b] for a, b in self.spans] + [""] * 8
        self.line_starts = [0, *(m.end() for m in re.finditer("\n", text))] if self.spans else [0]
        self.code_stops = [i for i, w in enumerate(self.words) if w in CODE_STOPS]
        self.closings: dict[str, dict[int, int]] = {}
        self.arguments: dict[int, int] | None = None
        self._file()

    def line(self, offset: int) -> int:
        return bisect.bisect_right(self.line_starts, offset)

    def word(self, i: int) -> str:
        return self.words[i] if 0 <= i < self.size else ""

    def is_name(self, i: int) -> bool:
        c = self.word(i)[:1]
        return c in ("$", "_") or c.isalnum() and not c.isdecimal()

    def close(self, i: int) -> int:
        """The place after the bracket that closes the one at i."""
        left = self.words[i]
        if left not in self.closings:
            right, opened, found = CLOSE[left], [], {}
            for j, w in enumerate(self.words):
                if w == left:
                    opened.append(j)
                elif w == right and opened:
                    found[opened.pop()] = j + 1
            self.closings[left] = found
        return self.closings[left].get(i, self.size)

    def _file(self) -> None:
        i = 0
        for stop in [j for j, w in enumerate(self.words) if w in FILE_STOPS]:
            if stop < i:
                continue
            i = stop
            w = self.word(i)
            if w == "package" and not self.package:
                j = i + 1
                while self.word(j) not in (";", ""):
                    j += 1
                self.package = "".join(self.words[i + 1 : j])
                i = j + 1
            elif w == "import":
                while self.word(i) not in (";", ""):
                    i += 1
                i += 1
            else:
                i = self._member(i, None, ())

    def _modifiers(self, i: int) -> tuple[int, list[str]]:
        names = []
        while True:
            w = self.word(i)
            if w == "@" and self.word(i + 1) != "interface":
                j = i + 2
                while self.word(j) == ".":
                    j += 2
                names.append("".join(self.words[i + 1 : j]))
                i = self.close(j) if self.word(j) == "(" else j
            elif w in MODIFIERS and not (w == "default" and self.word(i + 1) in (":", "->")):
                i += 1
            elif w == "non" and self.word(i + 1) == "-":
                i += 3
            else:
                return i, names

    def _type_at(self, i: int) -> str:
        w = self.word(i)
        if w == "@" and self.word(i + 1) == "interface":
            return "annotation_type"
        if w == "record":
            return "record" if self.is_name(i + 1) and self.word(i + 2) in ("(", "<") else ""
        return TYPE_WORDS.get(w, "") if self.is_name(i + 1) and self.word(i - 1) != "." else ""

    def _type(self, first: int, i: int, kind: str, notes: list[str], outer: Declaration | None, path: tuple[str, ...], limit: int | None = None) -> int:
        """A type; in code, its head ends at the limit or an enclosing bracket at the latest."""
        i += 2 if kind == "annotation_type" else 1
        name = self.word(i)
        out = Declaration(kind, name, self.spans[first][0], 0, notes, path=path)
        self.types.append(out)
        if outer:
            outer.types.append(out)
        ends = ("{", ";") if limit is None else ("{", ";", "}", ")")
        limit = self.size if limit is None else limit
        while i < limit and self.words[i] not in ends:
            i = min(self.close(i), limit) if self.words[i] == "(" else i + 1
        if i < limit and self.words[i] == "{":
            i = self._body(i, out, (*path, name), kind)
        out.end = self.spans[min(i, self.size) - 1][1]
        return i

    def _body(self, i: int, owner: Declaration, path: tuple[str, ...], kind: str) -> int:
        """Members between braces; i is at the opening one."""
        i += 1
        direct = True
        if kind == "enum":
            direct = False
            while self.word(i) not in (";", "}", ""):
                w = self.word(i)
                if w == "{":
                    i = self._body(i, owner, path, "anonymous")
                elif w == "(":
                    i = self._code(i, owner, path)
                else:
                    i += 1
            i += self.word(i) == ";"
        while self.word(i) not in ("}", ""):
            i = self._member(i, owner, path, kind, direct and kind != "anonymous")
        return min(i + 1, self.size)

    def _code(self, i: int, owner: Declaration | None, path: tuple[str, ...]) -> int:
        """Through a bracketed run of code, reading local types and anonymous classes, none of it twice."""
        end = read = self.close(i)
        limit = end - 1 if i in self.closings[self.words[i]] else end
        bodies: set[int] = set()
        i += 1
        while True:
            k = bisect.bisect_left(self.code_stops, i)
            if k == len(self.code_stops) or self.code_stops[k] >= end - 1:
                return read
            i = self.code_stops[k]
            if kind := self._type_at(i):
                first = i
                while self.word(first - 1) in MODIFIERS:
                    first -= 1
                i = self._type(first, i, kind, [], owner, path, limit)
                read = max(read, i)
            elif self.word(i) == "new":
                i += 1
                while self.is_name(i) or self.word(i) in (".", "<"):
                    i = self.close(i) if self.word(i) == "<" else i + 1
                if self.word(i) == "(":
                    bodies.add(self.close(i))
            elif owner and i in bodies:
                i = self._body(i, owner, path, "anonymous")
                read = max(read, i)
            else:
                i += 1

    def _member(self, i: int, owner: Declaration | None, path: tuple[str, ...], kind: str = "", direct: bool = True) -> int:
        first = i
        i, notes = self._modifiers(i)
        if found := self._type_at(i):
            return self._type(first, i, found, notes, owner, path)
        w = self.word(i)
        if w == "{":
            return self._code(i, owner, path)
        if w in (";", ",", "}", "") or owner is None:
            return i + 1
        if w == "<":
            i = self.close(i)
        j, depth = i, 0
        while self.word(j) not in ("", "}") and (depth or self.word(j) not in ("(", "=", ";", ",", "{")):
            depth += (self.word(j) == "<") - (self.word(j) == ">")
            j = max(self._modifiers(j)[0], j + 1) if self.word(j) == "@" else j + 1
        sign, name = self.word(j), self.word(j - 1)
        if sign == "(" and self.is_name(j - 1) or sign == "{" and j == i + 1 and kind == "record":
            after = self.close(j) if sign == "(" else j
            parameters = self._parameters(j + 1, after - 1) if sign == "(" else []
            while self.word(after) not in ("{", ";", "}", ""):
                after = self.close(after) if self.word(after) == "(" else after + 1
            what = "constructor" if j == i + 1 else "method"
            out = Declaration(what, name, self.spans[first][0], 0, notes, parameters)
            if what == "method" and kind != "annotation_type":
                owner.methods.append(out)
            if direct and kind != "annotation_type":
                owner.members.append(out)
            after = self._code(after, owner, path) if self.word(after) == "{" else after + (self.word(after) == ";")
            out.end = self.spans[after - 1][1]
            return after
        names = [name]
        while self.word(j) not in (";", "}", ""):
            if self.word(j) in ("(", "{", "["):
                j = self._code(j, owner, path) if self.word(j) != "[" else self.close(j)
            elif self.word(j) == "new":
                j = self._expression_new(j, owner, path)
            else:
                if self.word(j) == "<" and self.is_name(j - 1) and (k := self._type_arguments(j)):
                    j = k
                    continue
                if self.word(j) == "," and self.is_name(j + 1) and self.word(j + 2) in ("=", ",", ";", "["):
                    names.append(self.word(j + 1))
                j += 1
        j += self.word(j) == ";"
        out = Declaration("field", names[0], self.spans[first][0], self.spans[min(j, self.size) - 1][1], notes, names=[n for n in names if n])
        if direct and kind in ("class", "record"):
            owner.members.append(out)
        return max(j, first + 1)

    def _type_arguments(self, i: int) -> int:
        """The place after < ... > at i if it can be type arguments, else 0."""
        if self.arguments is None:
            opened, self.arguments = [], {}
            for j, w in enumerate(self.words):
                if w == "<":
                    opened.append(j)
                elif w == ">" and opened:
                    self.arguments[opened.pop()] = j + 1
                elif opened and w not in (">", ",", ".", "?", "[", "]", "&") and not self.is_name(j):
                    opened.clear()
        return self.arguments.get(i, 0)

    def _expression_new(self, i: int, owner: Declaration, path: tuple[str, ...]) -> int:
        i += 1
        while self.is_name(i) or self.word(i) in (".", "<"):
            i = self.close(i) if self.word(i) == "<" else i + 1
        if self.word(i) == "(":
            i = self._code(i, owner, path)
            if self.word(i) == "{":
                i = self._body(i, owner, path, "anonymous")
        return i

    def _parameters(self, i: int, end: int) -> list[str]:
        """Types of the parameters between i and end; variable ones have none."""
        out = []
        while i < end:
            i = self._modifiers(i)[0]
            j, depth = i, 0
            while j < end and (depth or self.word(j) != ","):
                depth += (self.word(j) in "(<[") - (self.word(j) in ")>]")
                j += 1
            name = j - 1
            while name > i and self.word(name) in ("[", "]"):
                name -= 1
            if name > i and self.word(name) != "this" and "..." not in self.words[i:name]:
                out.append(self.text[self.spans[i][0] : self.spans[name - 1][1]])
            i = j + 1
        return out


def _lines(scanner: Scanner, d: Declaration) -> tuple[int, int]:
    return scanner.line(d.start), scanner.line(max(d.start, d.end - 1))


def _signature(text: str) -> str:
    kept = [x.strip() for x in text.split("{", 1)[0].strip().splitlines()]
    return " ".join(" ".join(x for x in kept if not x.startswith("@")).split())


# The summaries are scored text.
SUMMARIES = {"method": "Java 方法 {}。", "constructor": "Java 构造器 {}。", "field": "Java 字段 {}。"}


def parse(path: str, content: str, texts: bool = True) -> tuple[list[dict], list[dict]]:
    """Items and symbols of one file, as dicts of their columns; without texts, items have no content and no metadata.

    The content of an item are its whole lines, so that those of a long line grow with its square.
    """
    s = Scanner(content)
    lines = content.splitlines() if texts else []
    items: list[dict] = []

    def item(d: Declaration, symbol: str, summary: str) -> None:
        top, low = _lines(s, d)
        if texts:
            text = "\n".join(lines[top - 1 : low]).strip()
            meta = {"language": "java", "symbol_type": d.kind, "annotations": " ".join(d.annotations), "signature": _signature(content[d.start : d.end])}
        else:
            text = meta = None
        items.append(
            {"id": f"code:{path}:{symbol}", "asset_type": "code", "title": symbol, "content": text, "summary": summary, "metadata": meta, "source_type": "code", "path": path, "start_line": top, "end_line": low, "symbol": symbol, "language": "java", "symbol_type": d.kind}
        )

    def all_methods(t: Declaration) -> Iterator[Declaration]:
        found = [*t.methods, *(m for x in t.types for m in all_methods(x))]
        return iter(sorted(found, key=lambda m: m.start))

    symbols: list[dict] = []
    for t in s.types:
        item(t, t.name, f"Java {t.kind} {t.name}。")
        for m in all_methods(t):
            item(m, f"{t.name}.{m.name}", SUMMARIES["method"].format(f"{t.name}.{m.name}"))
        for d in t.members:
            if d.kind == "constructor":
                symbol = f"{t.name}.<init>({', '.join(d.parameters)})"
                item(d, symbol, SUMMARIES["constructor"].format(symbol))
            elif d.kind == "field":
                for name in d.names:
                    item(d, f"{t.name}.{name}", SUMMARIES["field"].format(f"{t.name}.{name}"))
    ids = {x["symbol"]: x["id"] for x in items}

    def symbol_row(d: Declaration, kind: str, name: str, qualified: str, key: str) -> None:
        top, low = _lines(s, d)
        symbols.append({"symbol_id": f"java:{kind}:{qualified}", "path": path, "language": "java", "kind": kind, "name": name, "qualified_name": qualified, "start_line": top, "end_line": low, "source_item_id": ids.get(key)})

    for t in s.types:
        whole = ".".join([*([s.package] if s.package else []), *t.path, t.name])
        symbol_row(t, t.kind, t.name, whole, t.name)
        for d in t.members:
            types = ", ".join(d.parameters)
            if d.kind == "method":
                symbol_row(d, "method", d.name, f"{whole}.{d.name}({types})", f"{t.name}.{d.name}")
            elif d.kind == "constructor":
                symbol_row(d, "constructor", d.name, f"{whole}.<init>({types})", f"{t.name}.<init>({types})")
            else:
                for name in d.names:
                    symbol_row(d, "field", name, f"{whole}.{name}", f"{t.name}.{name}")
    return items, sorted(symbols, key=lambda x: (x["qualified_name"], x["kind"]))

"""Symbols, imports and calls of Go and Java files in a table, by their tokens.

Comments and literals are read as such, so braces inside them mean nothing; brackets are matched
in one pass, an unmatched one closes at the end.  There is no grammar: declarations are told by
the few tokens around them, which also works in files that do not compile.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "path string, language string, kind string, name string, container string, param_types string, param_count int, return_type string, receiver string, caller string, alias string, line int, end_line int"
FIELDS = [x.strip().split(" ")[0] for x in SCHEMA.split(",")]
TOKEN = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|(?P<text>\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?|`[^`]*`?)|(?P<word>[^\W\d]\w*)|(?P<number>\d[\w.]*)|(?P<mark>\.\.\.|[^\w\s])", re.DOTALL)
#: Words before a bracket that are no calls.
GO_WORDS = frozenset("append cap clear close complex copy delete imag len make max min new panic print println real recover break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())
JAVA_WORDS = frozenset("abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while".split())
JAVA_MODIFIERS = frozenset("public private protected static final abstract native synchronized strictfp default".split())
OPEN, CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}


class Source:
    """A file's tokens without comments, where each bracket closes, and in which brackets each token lies."""

    def __init__(self, text: str):
        self.text = text
        found = [m for m in TOKEN.finditer(text) if m.lastgroup]
        self.kind, self.value = [m.lastgroup for m in found], [m.group() for m in found]
        self.start, self.end = [m.start() for m in found], [m.end() for m in found]
        self.lines = [m.start() for m in re.finditer("\n", text)]
        n = len(found)
        self.partner, self.inside, stack = [n] * n, [-1] * n, []
        for i, v in enumerate(self.value):
            if self.kind[i] == "mark" and v in CLOSE and stack and OPEN[self.value[stack[-1]]] == v:
                self.partner[stack[-1]] = i
                self.partner[i] = stack.pop()
            self.inside[i] = stack[-1] if stack else -1
            if self.kind[i] == "mark" and v in OPEN:
                stack.append(i)

    def at(self, i: int) -> str:
        return self.value[i] if 0 <= i < len(self.value) else ""

    def line(self, i: int) -> int:
        return bisect_right(self.lines, self.start[min(i, len(self.start) - 1)] - 1) + 1

    def words(self, a: int, b: int) -> str | None:
        """The text of tokens [a, b), with white space as one space."""
        return re.sub(r"\s+", " ", self.text[self.start[a] : self.end[b - 1]]) if a < b else None

    def parts(self, a: int, b: int) -> list[tuple[int, int]]:
        """Tokens [a, b) cut at the commas that are in no bracket, angle brackets included."""
        out, first, angle, i = [], a, 0, a
        while i < b:
            v = self.value[i]
            if v in OPEN and self.kind[i] == "mark":
                i = min(self.partner[i], b - 1)
            angle += (v == "<") - (v == ">")
            if v == "," and not angle:
                out.append((first, i))
                first = i + 1
            i += 1
        return [*out, (first, b)] if first < b else out

    def receiver(self, i: int) -> str | None:
        """What stands before the dot that comes before token ``i``: names joined by dots."""
        a = i - 1
        while self.at(a) == "." and a > 0 and self.kind[a - 1] == "word":
            a -= 2
        return self.words(a + 1, i - 1)


def row(s: Source, i: int, j: int, kind: str, name: str, **more) -> dict:
    return {"kind": kind, "name": name, "line": s.line(i), "end_line": s.line(j), **more}


def calls(s: Source, a: int, b: int, caller: str, skipped: frozenset) -> Iterator[dict]:
    """The calls among tokens [a, b): plain, of a member, or of a constructor after ``new``."""
    for i in range(a, b):
        if s.kind[i] != "word" or s.value[i] in skipped:
            continue
        after = i + 1
        made = s.at(i - 1) == "new"
        if made:
            while s.at(after) == "." and s.kind[after + 1 : after + 2] == ["word"]:
                after += 2
            i = after - 1
            if s.at(after) == "<":
                depth = 1
                while depth and after + 1 < b:
                    after += 1
                    depth += (s.at(after) == "<") - (s.at(after) == ">")
                after += 1
        if s.at(after) != "(":
            continue
        beyond = s.at(s.partner[after] + 1)
        if made:
            yield row(s, i, i, "constructor-call", s.value[i], caller=caller)
        elif s.at(i - 1) == ".":
            if s.at(i - 2) != "new":
                yield row(s, i, i, "member-call", s.value[i], receiver=s.receiver(i), caller=caller)
        elif s.at(i - 1) != "func" and not (beyond == "{" and s.kind[i - 1] == "word" and s.at(i - 1) not in skipped):
            yield row(s, i, i, "call", s.value[i], caller=caller)


def go_parameters(s: Source, a: int, b: int) -> tuple[str | None, int]:
    """Types and number of a parameter list; a name without a type has the type that follows."""
    parts = s.parts(a, b)
    named = any(y - x > 1 and s.kind[x] == "word" and s.value[x] not in ("map", "chan", "func", "interface", "struct") and s.at(x + 1) != "." for x, y in parts)
    types: list[str] = []
    waiting = 0
    for x, y in parts:
        if named and y - x == 1:
            waiting += 1
            continue
        told = s.words(x + named, y)
        types += [told] * (waiting + 1)
        waiting = 0
    return ", ".join(types) or None, len(types)


def go_import(s: Source, a: int) -> tuple[dict, int]:
    """The import whose path or alias is token ``a``, and the token after it."""
    named = s.kind[a] != "text"
    path = s.at(a + named).strip('"`')
    return row(s, a, a, "import", path.rsplit("/", 1)[-1], container=path, alias=s.value[a] if named else None), a + named + 1


def go_type(s: Source, i: int) -> dict:
    """The type whose name is token ``i``."""
    told = s.at(i + 1)
    body = i + 2 if told in ("struct", "interface") and s.at(i + 2) == "{" else None
    end = s.partner[body] if body is not None else i + 1
    return row(s, i, end, {"struct": "class", "interface": "interface"}.get(told, "type_alias"), s.value[i])


def go(text: str) -> Iterator[dict]:
    s = Source(text)
    n, i = len(s.value), 0
    while i < n:
        v = s.value[i]
        if s.inside[i] >= 0 or v not in ("import", "type", "func") or s.kind[i] != "word" or i + 1 >= n:
            i += 1
        elif v == "import":
            if s.at(i + 1) != "(":
                found, i = go_import(s, i + 1)
                yield found
                continue
            end, i = s.partner[i + 1], i + 2
            while i < min(end, n):
                found, i = go_import(s, i)
                yield found
        elif v == "type":
            if s.at(i + 1) == "(":
                group = i + 1
                for k in range(group + 1, min(s.partner[group], n)):
                    if s.inside[k] == group and s.kind[k] == "word" and s.line(k) > s.line(k - 1):
                        yield go_type(s, k)
                i = s.partner[group]
            else:
                yield go_type(s, i + 1)
                i += 2
        else:
            container, k = None, i + 1
            if s.at(k) == "(":
                owner = [x for x in range(k + 1, min(s.partner[k], n)) if s.kind[x] == "word"]
                container = s.value[owner[1] if len(owner) > 1 else owner[0]] if owner else None
                k = s.partner[k] + 1
            name, opened = s.at(k), k + 1
            if s.at(opened) == "[":
                opened = s.partner[opened] + 1
            if s.at(opened) != "(" or s.kind[k] != "word":
                i += 1
                continue
            closed = s.partner[opened]
            body = closed + 1
            while body < n and s.value[body] != "{" and s.line(body) == s.line(closed):
                body = s.partner[body] + 1 if s.value[body] in OPEN else body + 2 if s.value[body] in ("interface", "struct") and s.at(body + 1) == "{" else body + 1
            has_body = s.at(body) == "{"
            end = min(s.partner[body], n) if has_body else closed
            types, count = go_parameters(s, opened + 1, min(closed, n))
            yield row(s, i, end, "method" if container else "function", name, container=container, param_types=types, param_count=count, return_type=s.words(closed + 1, min(body, n)))
            if has_body:
                yield from calls(s, body + 1, end, name, GO_WORDS)
            i = max(i + 1, end if has_body else closed)


def java_parameters(s: Source, a: int, b: int) -> tuple[str | None, int]:
    types = []
    for x, y in s.parts(a, b):
        while s.at(x) == "@" or s.at(x) == "final":
            x += 1 if s.at(x) == "final" else 2
            x = s.partner[x] + 1 if s.at(x) == "(" else x
        types.append(s.words(x, y - 1) if y - x > 1 else s.words(x, y))
    return ", ".join(types) or None, len(types)


def java_result(s: Source, i: int) -> str | None:
    """The type before the method name at token ``i``, without modifiers, annotations and type parameters."""
    a = i
    while a > 0 and s.at(a - 1) not in (";", "{", "}") and s.line(a - 1) >= s.line(i) - 3:
        a -= 1
    while a < i and (s.at(a) in JAVA_MODIFIERS or s.at(a) in "@<"):
        if s.at(a) == "@":
            a += 2
            a = s.partner[a] + 1 if s.at(a) == "(" else a
        elif s.at(a) == "<":
            depth = 1
            while depth and a + 1 < i:
                a += 1
                depth += (s.at(a) == "<") - (s.at(a) == ">")
            a += 1
        else:
            a += 1
    return s.words(a, i)


def java(text: str) -> Iterator[dict]:
    s = Source(text)
    n, bodies = len(s.value), {}
    for i in range(n):
        v = s.value[i]
        if s.kind[i] != "word":
            continue
        if v == "import" and s.inside[i] < 0:
            end = next((k for k in range(i, n) if s.value[k] == ";"), n)
            named = [k for k in range(i + 1, end) if s.kind[k] == "word"]
            stop = end - 2 if s.at(end - 1) == "*" else end
            if named:
                yield row(s, i, i, "import", s.value[named[-1]], container=s.words(i + 1, stop))
        elif v in ("class", "interface", "enum", "record") and s.at(i - 1) != "." and s.kind[i + 1 : i + 2] == ["word"]:
            body = next((k for k in range(i + 2, n) if s.value[k] in "{;" and s.inside[k] == s.inside[i]), n)
            if s.at(body) == "{":
                bodies[body] = s.value[i + 1]
                yield row(s, i, s.partner[body], {"record": "class"}.get(v, v), s.value[i + 1], container=bodies.get(s.inside[i]))
        elif s.inside[i] in bodies and s.at(i + 1) == "(" and v not in JAVA_WORDS and s.at(i - 1) not in ("@", ".", "=", "new", ","):
            owner, closed = bodies[s.inside[i]], s.partner[i + 1]
            after = closed + 1
            if s.at(after) == "throws":
                after = next((k for k in range(after, n) if s.value[k] in "{;"), n)
            typed = s.kind[i - 1] == "word" or s.at(i - 1) in (">", "]")
            if s.at(after) not in ("{", ";") or not (v == owner or typed):
                continue
            end = min(s.partner[after], n) if s.at(after) == "{" else after
            types, count = java_parameters(s, i + 2, min(closed, n))
            yield row(s, i, end, "method", v, container=owner, param_types=types, param_count=count, return_type=None if v == owner else java_result(s, i))
            yield from calls(s, after + 1, end, v, JAVA_WORDS)


LANGUAGES = {"go": go, "java": java}


def symbols(files: DataFrame) -> DataFrame:
    """Rows of ``SCHEMA`` for the Go and Java files of (path, content), by the path's ending."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: dict[str, list] = {f: [] for f in FIELDS}
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                language = path.rsplit(".", 1)[-1]
                for found in LANGUAGES[language](text or ""):
                    for f in FIELDS:
                        columns[f].append(found.get(f))
                    columns["path"][-1], columns["language"][-1] = path, language
            kinds = {f: pa.int32() if f in ("param_count", "line", "end_line") else pa.string() for f in FIELDS}
            yield pa.RecordBatch.from_arrays([pa.array(columns[f], kinds[f]) for f in FIELDS], FIELDS)

    known = F.regexp_extract("path", r"\.([a-z]+)$", 1).isin(*LANGUAGES)
    spread = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a small file is one task, whatever its rows cost
    return files.where(known).select("path", "content").repartition(spread, "path").mapInArrow(parse, SCHEMA)

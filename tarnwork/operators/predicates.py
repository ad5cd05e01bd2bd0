"""Filter clauses as column expressions.

A list of clauses is a conjunction; the values of a clause are a disjunction.  An empty
value list matches nothing; a None among the values matches null; ranges include both ends.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwork.functions.text import text_filter
from tarnwork.schemas import AVAILABILITY, EVENT_TYPES, SURFACES


class FilterError(ValueError):
    """A clause that cannot be meant; ``code`` is stable."""

    def __init__(self, code: str, detail: str = ""):
        super().__init__(f"{code}: {detail}" if detail else code)
        self.code = code


def every(clauses: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, clauses, F.lit(True))


def one_of(column: str, values: Sequence) -> Column:
    known = [v for v in values if v is not None]
    parts = ([F.col(column).isin(known)] if known else []) + ([F.col(column).isNull()] if None in values else [])
    return reduce(lambda a, b: a | b, parts) if parts else F.lit(False)


def closed_range(column: str, low=None, high=None) -> Column:
    if low is not None and high is not None and low > high:
        raise FilterError("RANGE_REVERSED", f"{low} > {high}")
    return every(([F.col(column) >= low] if low is not None else []) + ([F.col(column) <= high] if high is not None else []))


def allowed(values: Sequence, known: Sequence, code: str) -> Sequence:
    if unknown := [v for v in values if v not in known]:
        raise FilterError(code, ", ".join(map(str, unknown)))
    return values


def available(values: Sequence[str]) -> Column:
    """Any of the named stores; naming both is no restriction."""
    chosen = set(allowed(values, AVAILABILITY, "AVAILABILITY_UNKNOWN"))
    if len(chosen) == len(AVAILABILITY):
        return F.lit(True)
    return F.col(next(iter(chosen))) if chosen else F.lit(False)


def event_type(values: Sequence[str]) -> Column:
    return one_of("type", allowed(values, EVENT_TYPES, "TYPE_UNKNOWN"))


def surface(values: Sequence[str]) -> Column:
    return one_of("surface", allowed(values, SURFACES, "SURFACE_UNKNOWN"))


def contains_text(column: str, text: str) -> Column:
    return F.col(column).rlike(text_filter(text))


def under(column: str, prefixes: Sequence[str]) -> Column:
    """Paths that start with one of the prefixes; no prefixes are no restriction."""
    return reduce(lambda a, b: a | b, (F.col(column).startswith(p) for p in prefixes)) if prefixes else F.lit(True)


def wildcard(column: str, pattern: str) -> Column:
    """``*`` for any run and ``?`` for one character, over the whole value."""
    like = pattern.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_").replace("*", "%").replace("?", "_")
    return F.col(column).like(like)


def parse_query(text: str) -> tuple[str, dict[str, list[str]]]:
    """The free text of a query, and its ``path: lang: kind: name:`` fields."""
    fields: dict[str, list[str]] = {}
    free = []
    for word in text.split():
        key, mark, value = word.partition(":")
        if mark and value and key in ("path", "lang", "kind", "name"):
            fields.setdefault(key, []).append(value)
        else:
            free.append(word)
    return " ".join(free), fields


#: Shapes of secrets.
SECRETS = (
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    r"\b(sk|ghp|github_pat)_[A-Za-z0-9_-]{16,}\b",
    r"(?i)\b(api[_ -]?key|access[_ -]?token|password|secret)\s*[:=]\s*\S{8,}",
)


def secret_shaped(column: str) -> Column:
    return reduce(lambda a, b: a | b, (F.col(column).rlike(p) for p in SECRETS))


def _any(column: Column, *, inside: tuple[str, ...] = (), ends: tuple[str, ...] = ()) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(column, F.lit(x)) for x in inside] + [F.endswith(column, F.lit(x)) for x in ends])


def test_file(path: str, language: str) -> Column:
    """Whether a path looks like a test's by the custom of its language; other languages have none."""
    p, lower = F.col(path), F.lower(path)
    name = F.substring_index(path, "/", -1)
    #: What paths of tests contain or end with, by language.
    rules = {
        ("rust",): _any(p, inside=("/tests/",), ends=("_test.rs",)),
        ("python",): _any(p, inside=("/tests/", "test_", "_test.py"), ends=("tests.py",)),
        ("javascript", "typescript", "tsx", "jsx"): _any(p, inside=(".test.", ".spec.", "__tests__")),
        ("go",): _any(p, ends=("_test.go",)),
        ("java",): F.startswith(name, F.lit("Test")) | F.endswith(name, F.lit("Test.java")),
        ("c", "cpp"): _any(lower, inside=("/test_", "/tests/", "_tests.c", "_tests.cpp"), ends=("_test.c", "_test.cpp", "_test.cc", "_test.cxx")),
    }
    out = F.lit(False)
    for languages, rule in rules.items():
        out = F.when(F.col(language).isin(*languages), rule).otherwise(out)
    return out


def authorized(rows: DataFrame, grants: DataFrame, on: str) -> DataFrame:
    """Rows whose key is granted."""
    return rows.join(grants.select(on).distinct(), on, "left_semi")

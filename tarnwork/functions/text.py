"""Text functions as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A code-ish token: a run of word characters, or up to eight CJK characters.
TOKEN = r"[A-Za-z0-9_]+|[\x{3400}-\x{9FFF}\x{3040}-\x{30FF}\x{AC00}-\x{D7AF}]{1,8}"
MAX_QUERY_TOKENS = 12


def tokens(text: Column | str) -> Column:
    """Code-ish tokens in lower case, in order."""
    return F.transform(F.regexp_extract_all(F.col(text) if isinstance(text, str) else text, F.lit(TOKEN), F.lit(0)), lambda t: F.lower(t))


def token_count(text: Column | str) -> Column:
    """How many tokens a text has, without making them."""
    return F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(TOKEN))


def query_tokens(text: Column | str) -> Column:
    """The distinct tokens of a query, twelve at most, first ones first."""
    return F.slice(F.array_distinct(tokens(text)), 1, MAX_QUERY_TOKENS)


def overlap(query: Column, document: Column) -> Column:
    """Share of the query's tokens, repeated ones too, that the document has."""
    return F.when(F.size(query) == 0, F.lit(0.0)).otherwise(F.size(F.filter(query, lambda t: F.array_contains(document, t))) / F.size(query))


def split_identifier(text: str) -> list[str]:
    """Parts of a camel-case or snake-case identifier (driver side, for queries)."""
    parts = re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+", text)
    return [p.lower() for p in parts]


def expand_query(text: str) -> list[str]:
    """Query tokens followed by the parts of compound ones, each once."""
    found = re.findall(r"[A-Za-z0-9_]+", text)
    return list(dict.fromkeys([t.lower() for t in found] + [p for t in found for p in split_identifier(t) if p != t.lower()]))[:MAX_QUERY_TOKENS]


def expanded(text: Column | str) -> Column:
    """The same for a column of queries."""
    found = F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9_]+"), F.lit(0))
    parts = lambda t: F.filter(F.transform(F.regexp_extract_all(t, F.lit(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+"), F.lit(0)), F.lower), lambda p: p != F.lower(t))
    return F.slice(F.array_distinct(F.concat(F.transform(found, F.lower), F.flatten(F.transform(found, parts)))), 1, MAX_QUERY_TOKENS)


def unicode_tokens(text: Column | str) -> Column:
    """Lower-case runs of letters and digits of any script."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def collapse(text: Column | str) -> Column:
    """White-space runs as one space, ends trimmed."""
    return F.btrim(F.regexp_replace(text, r"\s+", " "))


def utf16_length(text: Column | str) -> Column:
    """Length in UTF-16 units: code points, and one more for each astral one."""
    return F.length(text) + F.length(F.regexp_replace(text, r"[^\x{10000}-\x{10FFFF}]", ""))


def token_estimate(text: Column | str, overhead: int = 4) -> Column:
    """Tokens of a message: a quarter of its length rounded up, plus an overhead."""
    return F.ceil(utf16_length(text) / 4) + overhead


def graph_token_estimate(text: Column | str) -> Column:
    """Tokens of a code snippet: a quarter of its bytes, ten at least."""
    return F.greatest(F.floor(F.octet_length(text) / 4), F.lit(10))


def content_hash(text: Column | str) -> Column:
    """First 16 hex digits of the SHA-256."""
    return F.substring(F.sha2(F.col(text) if isinstance(text, str) else text, 256), 1, 16)


def ascii_lower(text: Column | str) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def base_name(path: Column | str) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def stem(path: Column | str) -> Column:
    """Base name without its last extension."""
    return F.regexp_replace(base_name(path), r"(.)\.[^.]*$", "$1")


def preview(text: Column | str, limit: int) -> Column:
    """The text, or its start and how much more there is."""
    c = F.col(text) if isinstance(text, str) else text
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(F.substring(c, 1, limit), F.lit("… (+"), (F.length(c) - limit).cast("string"), F.lit(" more chars)")))


def pruned(text: Column | str, head: int, tail: int, marker: str) -> Column:
    """Head, marker and tail of a long text; a text that this would not shorten is kept."""
    c = F.col(text) if isinstance(text, str) else text
    return F.when(F.length(c) <= head + tail + len(marker), c).otherwise(F.concat(F.left(c, F.lit(head)), F.lit(marker), F.right(c, F.lit(tail))))


def first_words(text: Column | str, n: int) -> Column:
    return F.array_join(F.slice(F.split(collapse(text), " "), 1, n), " ")


def clean_title(text: Column | str) -> Column:
    """A title without terminal sequences, control and direction marks, white space collapsed."""
    c = F.regexp_replace(text, r"\x1b\][^\x07\x1b]*(\x07|\x1b\\)?|\x1b\[[0-?]*[ -/]*[@-~]", "")
    c = F.regexp_replace(c, r"[\x{202A}-\x{202E}\x{2066}-\x{2069}\x{200E}\x{200F}]", "")
    return collapse(F.regexp_replace(c, r"[\x00-\x1F\x7F-\x9F]", " "))


def like_text(text: str) -> str:
    """A literal as part of a LIKE pattern with the escape character backslash."""
    return re.sub(r"([\\%_])", r"\\\1", text)


def text_filter(text: str) -> str:
    """A regular expression for a literal, any case, any white space between its parts."""
    parts = text.split()
    if not parts:
        raise ValueError("TEXT_FILTER_EMPTY")
    return "(?iu)" + r"\s+".join(r"\Q" + p.replace(r"\E", r"\E\\E\Q") + r"\E" for p in parts)


def snippet(text: Column, at: Column, limit: int) -> Column:
    """``limit`` code points around the match at 1-based position ``at``, cut ends marked.

    Marks count towards the limit; without a match the text's start is taken.
    """
    n, body = F.length(text), limit - 2
    start = F.greatest(at, F.lit(1)) - body // 2
    mark = F.lit("…")
    middle = F.concat(mark, F.substring(text, start, F.lit(body)), mark)
    made = F.when(start <= 1, F.concat(F.left(text, F.lit(limit - 1)), mark)).when(start + body > n, F.concat(mark, F.right(text, F.lit(limit - 1)))).otherwise(middle)
    return F.when(n <= limit, text).otherwise(made)


#: Literal kinds in order of priority, with their patterns.
LITERAL_KINDS = (
    ("route", r"^/"),
    ("url", r"https?://[^\s'\"]+"),
    ("topic", r"(?i)[-.](topic|events)\z"),
    ("queue", r"(?i)([-.]queue|[-.]fifo|^queue[-.]|^fifo[-.])"),
    ("env_key", r"^[A-Z][A-Z0-9_]{2,}\z"),
    ("config_key", r"^[a-z][a-z0-9]*(\.[a-z][a-z0-9]*)+\z"),
    ("sql", r"(?i)\b(from|join|update|into|table)\s+[A-Za-z_]\w*"),
    ("error_string", r"(?i)\b(error|failed|failure|invalid|unauthorized|forbidden|timeout|not found)\b"),
    ("log_key", r"(?i)(trace|logger|log|event)"),
)
#: Fixed value: shorter literals, in bytes, have no kind.
LEAST_LITERAL = 3


def literal_kind(text: Column | str) -> Column:
    """The first kind whose pattern is found, or null."""
    c = F.col(text) if isinstance(text, str) else text
    out = F.when(F.octet_length(c) < LEAST_LITERAL, F.lit(None).cast("string"))
    for kind, pattern in LITERAL_KINDS:
        out = out.when(c.rlike(pattern), kind)
    return out

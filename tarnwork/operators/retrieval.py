"""Ranked lanes, fusion, rerank, budgets and paging.

A lane is (query_id, doc_id, score).  Scores are rounded before they are ordered, so that
equal ones tie in every engine; ties end with the id.
"""

from __future__ import annotations

import base64
import hashlib
import json
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwork.functions.text import query_tokens, token_count, tokens
from tarnwork.operators.prefix import running
from tarnwork.storage import stored

#: Fusion constant and lane weights.
FUSION_K = 50
LANE_WEIGHTS = {"lexical": 1.1, "grep": 0.8, "graph": 0.6, "literal": 0.9, "vector": 0.9}
#: Our own choice: usual BM25 constants, one field.
BM25_K1, BM25_B = 1.2, 0.75
RERANK_WINDOW = 40
OVERLAP_WEIGHT = 0.35
DIGITS = 9


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, token) of (query_id, text)."""
    return queries.select("query_id", F.explode(query_tokens("text")).alias("token"))


def lexical(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, doc_id, score, matched): BM25 over the documents, and how many query tokens each has.

    Tokens that no query has leave before anything is shuffled or counted, and the postings of
    the others are stored once, for document frequencies and for scores.
    """
    terms = query_terms(queries)
    wanted = stored(terms.select("token").distinct(), "wanted-tokens")
    totals = docs.select(token_count("text").alias("length")).agg(F.count("*").alias("docs"), F.avg("length").alias("mean"))
    # a generator of one row binds the tokens, so that a text is split once
    bound = F.transform(F.array(tokens("text")), lambda t: F.struct(F.size(t).alias("length"), t.alias("t")))
    each = docs.select("doc_id", F.explode(bound).alias("b")).select("doc_id", "b.length", F.explode("b.t").alias("token"))
    found = stored(each.join(wanted, "token", "left_semi").groupBy("doc_id", "length", "token").agg(F.count("*").alias("tf")), "wanted-postings")
    df = found.groupBy("token").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = F.col("tf") * (BM25_K1 + 1) / (F.col("tf") + BM25_K1 * (1 - BM25_B + BM25_B * F.col("length") / F.col("mean")))
    scored = found.join(df, "token").join(F.broadcast(totals)).select("doc_id", "token", (idf * norm).alias("part"))  # one row of totals
    spread = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # postings are few, but each meets all queries with its token
    return terms.join(scored.repartition(spread, "doc_id"), "token").groupBy("query_id", "doc_id").agg(F.round(F.sum("part"), DIGITS).alias("score"), F.count("*").alias("matched"))


def grep(docs: DataFrame, needle: str, most: int) -> DataFrame:
    """Documents that contain a literal, any case, newest id first."""
    return docs.where(F.contains(F.lower("text"), F.lit(needle.lower()))).orderBy(F.desc("doc_id")).limit(most).select("doc_id")


def ranked(lane: DataFrame, most: int | None = None) -> DataFrame:
    """Adds rank by score, ties by id; with ``most`` only the first ones."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    out = lane.withColumn("rank", F.row_number().over(w))
    return out if most is None else out.where(F.col("rank") <= most)


def fuse(lanes: dict[str, DataFrame], k: int = FUSION_K) -> DataFrame:
    """(query_id, doc_id, fused): reciprocal rank fusion of ranked lanes."""
    parts = [lane.select("query_id", "doc_id", (F.lit(LANE_WEIGHTS[name]) / (k + F.col("rank"))).alias("part")) for name, lane in lanes.items()]
    return reduce(DataFrame.unionByName, parts).groupBy("query_id", "doc_id").agg(F.round(F.sum("part"), DIGITS).alias("fused"))


def top(rows: DataFrame, score: str, n: int, key: str = "doc_id") -> DataFrame:
    """The n best of each query, with their rank."""
    w = Window.partitionBy("query_id").orderBy(F.desc(score), key)
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def overlap_lane(some: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, doc_id, score): the share of the query's tokens that each candidate of ``lexical`` has."""
    asked = query_terms(queries).groupBy("query_id").agg(F.count("*").alias("asked"))
    return some.join(asked, "query_id").select("query_id", "doc_id", F.round(F.col("matched") / F.col("asked"), DIGITS).alias("score"))


def lexical_lane(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """The first 200 of each query by ``lexical``, ranked and stored."""
    return stored(ranked(lexical(docs, queries), 200), "lexical-lane")


def hybrid(docs: DataFrame, queries: DataFrame, n: int = 10, some: DataFrame | None = None) -> DataFrame:
    """Lexical and token-overlap lanes, fusion, overlap rerank, best n of each query; ``some`` is the lexical lane if it is there already."""
    some = lexical_lane(docs, queries) if some is None else some
    hits = overlap_lane(some, queries)
    best = top(fuse({"lexical": some, "grep": ranked(hits)}), "fused", RERANK_WINDOW).drop("place")
    final = best.join(hits, ["query_id", "doc_id"]).withColumn("score", F.round(F.col("fused") + OVERLAP_WEIGHT * F.col("score"), DIGITS))
    return top(final, "score", n).select("query_id", "doc_id", "score", F.col("place").cast("bigint").alias("place"))


#: What each sign adds when candidates are ranked anew, in this order.
RERANK_TERMS = {
    "symbol-exact": 0.18,
    "path-prefix": 0.05,
    "doc-file": 0.08,
    "working-set-boost": 0.22,
    "recent-file": 0.12,
    "pinned-context": 0.2,
    "overlay-neighbor": 0.1,
}
STAGE_WEIGHT, STAGE_CAP = 0.04, 0.25
#: Names of project documents at the top of a tree.
PROJECT_DOCS = ("README", "DESIGN", "ARCHITECTURE", "CHANGELOG", "CONTRIBUTING", "LICENSE", "ADR", "DECISIONS")


def project_doc(path: str) -> Column:
    """Whether a path is project documentation in Markdown."""
    lower, depth = F.lower(path), F.size(F.split(path, "/"))
    name = F.regexp_replace(F.upper(F.substring_index(path, "/", -1)), r"\.MD$", "")
    folder = F.startswith(lower, F.lit("docs/")) | F.startswith(lower, F.lit("doc/")) | F.contains(lower, F.lit("/adr/")) | F.contains(lower, F.lit("/adrs/"))
    return F.endswith(lower, F.lit(".md")) & (((depth <= 2) & name.isin(*PROJECT_DOCS)) | folder)


def rerank(candidates: DataFrame, signs: dict[str, Column], lane: str = "lexical") -> DataFrame:
    """(query_id, doc_id, score, trace, reasons): additive rerank of (query_id, doc_id, rank, fused, overlap, stage).

    The trace lists every part of the score in order; the score is its sum.  ``signs`` tells for
    each of ``RERANK_TERMS`` whether a candidate has it.
    """
    part = lambda name, value: F.struct(F.lit(name).alias("part"), value.cast("double").alias("value"))
    staged = F.col("stage") > 0
    parts = [part(f"rrf:{lane}", F.col("fused")), part("overlap", F.col("overlap") * OVERLAP_WEIGHT)]
    parts += [F.when(signs[k], part(f"boost:{k}", F.lit(v))) for k, v in RERANK_TERMS.items() if k in signs]
    parts.append(F.when(staged, part("boost:stage-a", F.least(F.col("stage") * STAGE_WEIGHT, F.lit(STAGE_CAP)))))
    reasons = [F.concat(F.lit(f"{lane}@"), F.col("rank").cast("string"))] + [F.when(signs[k], k) for k in RERANK_TERMS if k in signs and k != "path-prefix"]
    told = candidates.withColumns({"trace": F.filter(F.array(*parts), lambda x: x.isNotNull()), "reasons": F.array_distinct(F.array_compact(F.array(*reasons)))})
    return told.select("query_id", "doc_id", F.round(F.aggregate("trace", F.lit(0.0), lambda s, x: s + x["value"]), DIGITS).alias("score"), "trace", "reasons")


def rank_decay(rank: Column, scale: float, floor: float) -> Column:
    return F.greatest(F.lit(floor), scale / (rank + 1))


#: Base of the summary layer; base, growth and limit of the neighbour layer; divisors and limit of the graph score.
SUMMARY_BASE = 1.4
NEIGHBOUR_BASE, NEIGHBOUR_MORE, NEIGHBOUR_MOST = 0.8, 0.1, 1.2
DEGREES_BY, REFS_BY, MOST_REFS, GRAPH_MOST = 10, 100, 10, 0.4


def summary_layer(bm25: Column) -> Column:
    return SUMMARY_BASE + 1 / (1 + F.abs(bm25))


def neighbour_score(edges: Column, base: float = NEIGHBOUR_BASE, more: float = NEIGHBOUR_MORE, most: float = NEIGHBOUR_MOST) -> Column:
    """Capped accumulation: a base, a little for each further edge, and a limit."""
    return F.least(base + more * (edges - 1), F.lit(most))


def graph_score(inward: Column, outward: Column, refs: Column) -> Column:
    return F.least(F.log(inward + outward + 1.0) / DEGREES_BY + F.least(refs, F.lit(MOST_REFS)) / REFS_BY, F.lit(GRAPH_MOST))


def stage_boost(score: Column) -> Column:
    return F.least(score * STAGE_WEIGHT, F.lit(STAGE_CAP))


def within_budget(rows: DataFrame, group: str, order: str, size: str, budget: int) -> DataFrame:
    """The prefix of each group whose sizes stay within a budget, its first row in any case."""
    first = rows.groupBy(group).agg(F.min(order).alias("first")).withColumnRenamed(group, "owner")
    told = running(rows, [group], [order], F.col(size), "used").join(first, F.col(group).eqNullSafe(F.col("owner")))
    return told.where((F.col("used") <= budget) | (F.col(order) == F.col("first"))).drop("owner", "first")


def recall_and_rank(hits: DataFrame, relevant: DataFrame, at: int = 5) -> DataFrame:
    """One row: macro averages of recall at ``at`` and of the reciprocal rank of the first relevant hit."""
    good = hits.join(relevant.select("query_id", "doc_id"), ["query_id", "doc_id"])
    found = good.groupBy("query_id").agg(F.count_if(F.col("place") <= at).alias("found"), F.min("place").alias("first"))
    cases = relevant.groupBy("query_id").agg(F.count("*").alias("all")).join(found, "query_id", "left")
    return cases.agg(F.round(F.avg(F.coalesce(F.col("found") / F.col("all"), F.lit(0.0))), 6).alias("recall"), F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 6).alias("mrr"))


#: Scores of exact, prefix and inner matches of the name, of the path, and of subsequences.
EXACT, PREFIX, NAME, PATH, SUBSEQUENCE, DIRECTORY, LEAST_GAP = 1000, 900, 700, 500, 300, 25, 100


def fuzzy_path_score(path: Column, query: str, directory: Column) -> Column:
    """Matches of the name before matches of the path before subsequences of it; null for none.

    A subsequence is worth less the more characters of the path it skips, those before it included.
    """
    q, p = query.lower(), F.lower(path)
    if not q:
        return F.lit(0).cast("bigint")
    n = F.substring_index(p, "/", -1)
    # each character's first place after the one before: no backtracking
    steps = F.length(F.regexp_extract(p, "^" + "".join(f"[^\\x{{{ord(c):x}}}]*+\\x{{{ord(c):x}}}" for c in q), 0))
    gap = F.greatest(F.lit(0), LEAST_GAP - (steps - len(q)))
    score = F.when(n == q, EXACT).when(F.startswith(n, F.lit(q)), PREFIX).when(F.contains(n, F.lit(q)), NAME).when(F.contains(p, F.lit(q)), PATH).when(steps > 0, SUBSEQUENCE + gap)
    return (score + F.when(directory, DIRECTORY).otherwise(0)).cast("bigint")


#: Default numbers of hits by repository size.
TIERS = ((500, 5), (5_000, 10), (50_000, 15), (None, 20))


def default_hits(n_files: Column) -> Column:
    out = None
    for limit, k in TIERS:
        if limit is None:
            return out.otherwise(k)
        out = F.when(n_files < limit, k) if out is None else out.when(n_files < limit, k)
    return out


def request_fingerprint(request: dict) -> str:
    """Digest of a request that does not depend on the order of keys or of list members."""
    plain = {k: sorted(v, key=str) if isinstance(v, (list, tuple)) else v for k, v in request.items()}
    return hashlib.sha256(json.dumps(plain, sort_keys=True, default=str).encode()).hexdigest()[:16]


def cursor(key: list, request: dict, version: int) -> str:
    return base64.urlsafe_b64encode(json.dumps([key, request_fingerprint(request), version]).encode()).decode()


def read_cursor(text: str, request: dict, version: int) -> list:
    """The sort key of a cursor, if it belongs to this request and version."""
    key, print_, at = json.loads(base64.urlsafe_b64decode(text))
    if print_ != request_fingerprint(request):
        raise ValueError("CURSOR_REQUEST")
    if at != version:
        raise ValueError("CURSOR_STALE")
    return key


def page(rows: DataFrame, score: str, key: str, n: int, after: list | None = None) -> DataFrame:
    """One keyset page in descending score; a row more tells whether there is another page."""
    if after is not None:
        s, k = after
        rows = rows.where((F.col(score) < s) | ((F.col(score) == s) & (F.col(key) > k)))
    return rows.orderBy(F.desc(score), key).limit(n + 1)


def revision(rows: DataFrame, key: str, size: str) -> str:
    """A corpus revision: how many rows, of what size in all, up to which key."""
    return rows.agg(F.concat_ws(":", F.count("*").cast("string"), F.sum(size).cast("string"), F.max(key).cast("string"))).first()[0]


def guarded_page(rows: DataFrame, expected: str, make, key: str, size: str) -> DataFrame:
    """A page with the revision that it was made from; another revision than expected is an error."""
    now = revision(rows, key, size)
    if now != expected:
        raise ValueError(f"CORPUS_CHANGED: {expected} is now {now}")
    return make(rows).withColumn("revision", F.lit(now))


def phrase_spans(texts: DataFrame, phrases: DataFrame, keys: list[str]) -> DataFrame:
    """(phrase, *keys, spans): how often each phrase of (phrase), arrays of words, occurs in each text with words ``x``.

    Texts meet a phrase by all its words in a row, so that only occurrences are joined; equal phrases are looked up once.
    """
    wanted = stored(phrases.where("size(phrase) > 0").select("phrase").distinct(), "phrases")
    sizes = [r[0] for r in wanted.select(F.size("phrase")).distinct().collect()] or [1]  # a few lengths
    at = lambda n: F.transform(F.sequence(F.lit(1), F.size("x") - n + 1), lambda i: F.slice("x", i, F.lit(n)))
    runs = F.flatten(F.array(*(F.when(F.size("x") >= n, at(n)).otherwise(F.array().cast("array<array<string>>")) for n in sizes)))
    return texts.select(*keys, F.explode(runs).alias("phrase")).join(wanted, "phrase", "left_semi").groupBy("phrase", *keys).agg(F.count("*").alias("spans"))


def phrase_hits(texts: DataFrame, phrases: DataFrame, keys: list[str]) -> DataFrame:
    """(query_id, *keys, spans): the same for each of (query_id, phrase)."""
    return phrases.join(phrase_spans(texts, phrases, keys), "phrase").select("query_id", *keys, "spans")

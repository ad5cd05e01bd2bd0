"""Retrieval, ranking, vectors, chunking, and workspace queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tarnwork.functions import text as tx
from tarnwork.operators import chunks, retrieval as r, vectors as v
from tarnwork.operators.prefix import running
from tarnwork.plans.registry import query
from tarnwork.sources import workspace
from tarnwork.sources.tables import FILES_SQL, files, table
from tarnwork.storage import stored

TOKEN = r"[A-Za-z0-9_]+|[\x{3400}-\x{9FFF}\x{3040}-\x{30FF}\x{AC00}-\x{D7AF}]{1,8}"
TOKENS = rf"list_transform(regexp_extract_all(text, '{TOKEN}'), lambda t: lower(t))"
DISTINCT = "list_transform(list_filter(list_transform(x, lambda t, i: {'t': t, 'k': list_position(x, t) = i}), lambda s: s.k), lambda s: s.t)"
QUERIES_SQL = f"q AS (SELECT item_id AS query_id, list_slice({DISTINCT}, 1, 12) AS q FROM (SELECT item_id, {TOKENS} AS x FROM benchmark)), terms AS (SELECT query_id, unnest(q) AS token FROM q)"
LEXICAL_SQL = f"""{QUERIES_SQL}, d AS (SELECT doc_id, {TOKENS} AS d FROM documents), post AS (SELECT doc_id, any_value(len) AS length, token, count(*) AS tf FROM (SELECT doc_id, len(d) AS len, unnest(d) AS token FROM d) GROUP BY doc_id, token),
totals AS (SELECT count(*) AS docs, avg(len(d)) AS mean FROM d), df AS (SELECT token, count(*) AS df FROM post GROUP BY token),
lex AS (SELECT query_id, doc_id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * (tf * (1.2 + 1) / (tf + 1.2 * (1 - 0.75 + 0.75 * length / mean)))), 9) AS score FROM terms JOIN post USING (token) JOIN df USING (token), totals GROUP BY query_id, doc_id),
cand AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM lex) WHERE rank <= 200)"""
HYBRID_SQL = f"""WITH {LEXICAL_SQL},
hits AS (SELECT s.query_id, s.doc_id, round(len(list_filter(q.q, lambda t: list_contains(d.d, t))) / len(q.q), 9) AS overlap FROM cand s JOIN q USING (query_id) JOIN d USING (doc_id)),
lane AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, doc_id) AS rank FROM hits),
fused AS (SELECT query_id, doc_id, round(sum(part), 9) AS fused FROM (SELECT query_id, doc_id, CAST(1.1 AS DOUBLE) / (50 + rank) AS part FROM cand UNION ALL SELECT query_id, doc_id, CAST(0.8 AS DOUBLE) / (50 + rank) FROM lane) GROUP BY query_id, doc_id),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, doc_id) AS p FROM fused) WHERE p <= 40),
final AS (SELECT b.query_id, b.doc_id, round(b.fused + 0.35 * h.overlap, 9) AS score FROM best b JOIN hits h ON b.query_id = h.query_id AND b.doc_id = h.doc_id)"""
PLACED = ", placed AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS place FROM final)"


def _docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "text")


def _queries(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


@query("rnk_hybrid_retrieval", HYBRID_SQL + PLACED + " SELECT query_id, doc_id, score, place FROM placed WHERE place <= 10")
def _(spark, d):
    return r.hybrid(_docs(spark, d), _queries(spark, d))


@query("rnk01_tokens", f"SELECT doc_id, {TOKENS} AS tokens FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.tokens("text").alias("tokens"))


@query("rnk02_query_tokens", f"WITH {QUERIES_SQL} SELECT query_id, q AS tokens FROM q")
def _(spark, d):
    return _queries(spark, d).select("query_id", tx.query_tokens("text").alias("tokens"))


@query("rnk03_query_expansion")
def _(spark, d):
    names = _queries(spark, d).select("query_id", F.split("text", " ").alias("w")).select("query_id", F.concat(F.get("w", F.lit(0)), F.initcap(F.get("w", F.lit(1))), F.lit(" "), F.get("w", F.lit(2)), F.lit("_"), F.get("w", F.lit(3))).alias("text"))
    return names.select("query_id", tx.expanded("text").alias("tokens"))


@query("rnk04_lexical_lane", f"WITH {LEXICAL_SQL} SELECT query_id, doc_id, score FROM cand WHERE rank <= 20")
def _(spark, d):
    return r.ranked(r.lexical(_docs(spark, d), _queries(spark, d)), 20).select("query_id", "doc_id", "score")


@query("rnk05_grep_lane", "SELECT doc_id FROM documents WHERE contains(lower(text), 'license') ORDER BY doc_id DESC LIMIT 20000")
def _(spark, d):
    return r.grep(_docs(spark, d), "License", 20_000)


@query("rnk09_vector_lane", "WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), s AS (SELECT q.vec_id AS query_id, e.vec_id, round(list_dot_product(q.v, e.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(e.v, e.v))), 6) AS score FROM e, e q WHERE q.vec_id % 50 = 0) SELECT query_id, vec_id, score, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM s WHERE score > 0) WHERE place <= 10")
def _(spark, d):
    e = table(spark, d, "embeddings")
    return v.nearest(e, e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 10)


SCALED = "WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), s AS (SELECT vec_id, v, CASE WHEN list_max(list_transform(v, lambda x: abs(x))) > 0 THEN list_max(list_transform(v, lambda x: abs(x))) / 127 ELSE 1.0 END AS scale FROM e), z AS (SELECT vec_id, v, scale, list_transform(v, lambda x: CAST(greatest(-127, least(127, floor(x / scale + 0.5))) AS INTEGER)) AS q, sqrt(list_dot_product(v, v)) AS norm FROM s)"


@query("rnk10_quantised_cosine", SCALED + " SELECT z.vec_id, round(z.scale * list_dot_product(CAST(z.q AS DOUBLE[]), o.v) / (o.norm * z.norm), 6) AS score FROM z, (SELECT v, norm FROM z WHERE vec_id = 3) o")
def _(spark, d):
    e = table(spark, d, "embeddings")
    one = e.where("vec_id = 3").select(v.floats("embedding").alias("o")).withColumn("on", v.norm(F.col("o")))
    return v.quantised_table(e).join(F.broadcast(one)).select("vec_id", F.round(v.quantised_cosine(F.col("q"), F.col("scale"), F.col("norm"), F.col("o"), F.col("on")), 6).alias("score"))  # one vector


@query("rnk11_int8_quantise", SCALED + " SELECT vec_id, q, round(scale, 9) AS scale, round(norm, 6) AS norm FROM z")
def _(spark, d):
    return v.quantised_table(table(spark, d, "embeddings")).select("vec_id", "q", F.round("scale", 9).alias("scale"), F.round("norm", 6).alias("norm"))


@query("rnk13_rank_fusion", HYBRID_SQL + " SELECT query_id, doc_id, fused FROM fused")
def _(spark, d):
    some = stored(r.ranked(r.lexical(_docs(spark, d), _queries(spark, d)), 200), "lexical-lane")
    return r.fuse({"lexical": some, "grep": r.ranked(r.overlap_lane(some, _queries(spark, d)))})


@query("rnk15_summary_layer", "SELECT item_id, round(1.4 + 1 / (1 + abs(CAST(length(text) AS DOUBLE) / 100)), 6) AS score FROM benchmark")
def _(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.round(r.summary_layer(F.length("text") / 100), 6).alias("score"))


@query("rnk17_fallback_layer", "SELECT doc_id FROM documents WHERE lang = 'en' ORDER BY doc_id LIMIT 5")
def _(spark, d):
    docs = table(spark, d, "documents")
    scored = docs.where("contains(text, 'no such literal at all')").select("doc_id")
    return docs.where("lang = 'en'").orderBy("doc_id").limit(5).select("doc_id") if scored.isEmpty() else scored


@query("rnk19_neighbour_layer", "SELECT o_custkey AS node, round(CAST(least(0.8 + 0.1 * (count(*) - 1), 1.2) AS DOUBLE), 6) AS score FROM orders GROUP BY o_custkey")
def _(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("node")).agg(F.round(r.neighbour_score(F.count("*")), 6).alias("score"))


@query("rnk20_overlap", f"WITH {QUERIES_SQL}, d AS (SELECT doc_id, {TOKENS} AS d FROM documents), o AS (SELECT q.query_id, doc_id, len(list_filter(q.q, lambda t: list_contains(d.d, t))) / len(q.q) AS share FROM d, q WHERE q.query_id % 50 = 0) SELECT query_id, doc_id, round(share, 9) AS score FROM o WHERE share > 0")
def _(spark, d):
    asked = _queries(spark, d).where("query_id % 50 = 0")
    return r.overlap_lane(r.lexical(_docs(spark, d), asked), asked)


SIGNS = {
    "symbol-exact": "list_contains(q, lower(symbol))", "path-prefix": "starts_with(path, 'docs/')", "doc-file": "ends_with(path, '.md')", "working-set-boost": "c.doc_id % 7 = 0",
    "recent-file": "c.doc_id % 11 = 0", "pinned-context": "c.doc_id % 13 = 0", "overlay-neighbor": "c.doc_id % 17 = 0",
}
ADDED = {"symbol-exact": 0.18, "path-prefix": 0.05, "doc-file": 0.08, "working-set-boost": 0.22, "recent-file": 0.12, "pinned-context": 0.2, "overlay-neighbor": 0.1}
RERANK_SQL = f"""WITH {LEXICAL_SQL},
named AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'docs/' || source || '.md' ELSE source || '/' || doc_id || '.py' END AS path, split_part(text, ' ', 1) AS symbol, CASE WHEN doc_id % 2 = 0 THEN n_chars / 1000 ELSE 0.0 END AS stage FROM documents),
c AS (SELECT * FROM cand WHERE rank <= 40),
parts AS (SELECT c.query_id, c.doc_id, c.rank, [1.1 / (50 + c.rank), 0.35 * len(list_filter(q, lambda t: list_contains(d, t))) / len(q)] || list_filter([{', '.join(f"CASE WHEN {w} THEN {ADDED[k]} END" for k, w in SIGNS.items())}, CASE WHEN stage > 0 THEN least(stage * 0.04, 0.25) END], lambda x: x IS NOT NULL) AS p,
  list_filter(['lexical@' || c.rank, {', '.join(f"CASE WHEN {w} THEN '{k}' END" for k, w in SIGNS.items() if k != 'path-prefix')}], lambda x: x IS NOT NULL) AS reasons
  FROM c JOIN named n ON n.doc_id = c.doc_id JOIN q USING (query_id) JOIN d ON d.doc_id = c.doc_id)
SELECT query_id, doc_id, round(list_sum(p), 6) AS score, len(p) AS n_parts, array_to_string(reasons, ',') AS reasons FROM parts"""


@query("rnk21_additive_rerank", RERANK_SQL)
def _(spark, d):
    docs, queries = table(spark, d, "documents"), _queries(spark, d)
    some = stored(r.ranked(r.lexical(_docs(spark, d), queries), 40), "lexical-lane")
    path = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("docs/"), "source", F.lit(".md"))).otherwise(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".py")))
    named = docs.select("doc_id", path.alias("path"), F.split_part("text", F.lit(" "), F.lit(1)).alias("symbol"), F.when(F.col("doc_id") % 2 == 0, F.col("n_chars") / 1000).otherwise(0.0).alias("stage"))
    asked = queries.select("query_id", tx.query_tokens("text").alias("q"))
    rows = some.join(named, "doc_id").join(asked, "query_id")
    rows = rows.select("query_id", "doc_id", "rank", "path", "symbol", "stage", "q", (1.1 / (50 + F.col("rank"))).alias("fused"), (F.col("matched") / F.size("q")).alias("overlap"))
    at = lambda k: F.col("doc_id") % k == 0
    signs = {
        "symbol-exact": F.array_contains("q", F.lower("symbol")), "path-prefix": F.startswith("path", F.lit("docs/")), "doc-file": r.project_doc("path"),
        "working-set-boost": at(7), "recent-file": at(11), "pinned-context": at(13), "overlay-neighbor": at(17),
    }
    done = r.rerank(rows, signs)
    return done.select("query_id", "doc_id", F.round("score", 6).alias("score"), F.size("trace").cast("bigint").alias("n_parts"), F.array_join("reasons", ",").alias("reasons"))


@query("rnk22_stage_boost", "SELECT doc_id, round(least(n_chars / 1000 * 0.04, 0.25), 6) AS boost FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.round(r.stage_boost(F.col("n_chars") / 1000), 6).alias("boost"))


@query("rnk30_snippets", "SELECT doc_id, CASE WHEN n <= 40 THEN text WHEN s <= 1 THEN left(text, 39) || '…' WHEN s + 38 > n THEN '…' || right(text, 39) ELSE '…' || substr(text, s, 38) || '…' END AS snippet FROM (SELECT doc_id, text, length(text) AS n, greatest(strpos(text, 'tion'), 1) - 19 AS s FROM documents)")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.snippet(F.col("text"), F.instr("text", "tion"), 40).alias("snippet"))


@query("rnk32_trigrams", "WITH g AS (SELECT DISTINCT p_partkey, unnest(list_transform(range(1, length(p_name) - 1), lambda i: substr(lower(p_name), i, 3))) AS gram FROM part) SELECT gram, count(*) AS n FROM g GROUP BY gram")
def _(spark, d):
    grams = F.transform(F.sequence(F.lit(1), F.length("p_name") - 2), lambda i: F.substring(F.lower("p_name"), i, F.lit(3)))
    return table(spark, d, "part").where("length(p_name) >= 3").select("p_partkey", F.explode(F.array_distinct(grams)).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


@query("rnk27_session_search", r"WITH t AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS x FROM conversations), m AS (SELECT conv_id, turn, len(x) AS n, len(list_filter(range(1, len(x)), lambda i: x[i] = 'of' AND x[i + 1] = 'the')) AS spans FROM t), b AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY spans DESC, n, turn) AS r FROM m WHERE spans > 0) SELECT conv_id, turn, spans FROM b WHERE r = 1")
def _(spark, d):
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    t = table(spark, d, "conversations").select("conv_id", "turn", words.alias("x"))
    spans = F.size(F.filter(F.arrays_zip(F.col("x").alias("a"), F.slice("x", F.lit(2), F.greatest(F.size("x"), F.lit(1))).alias("b")), lambda p: (p["a"] == "of") & (p["b"] == "the")))
    m = t.select("conv_id", "turn", F.size("x").alias("n"), spans.alias("spans")).where("spans > 0")
    w = Window.partitionBy("conv_id").orderBy(F.desc("spans"), "n", "turn")
    return m.withColumn("r", F.row_number().over(w)).where("r = 1").select("conv_id", "turn", "spans")


@query("rnk33_tiers", "SELECT source, CASE WHEN count(*) < 500 THEN 5 WHEN count(*) < 5000 THEN 10 WHEN count(*) < 50000 THEN 15 ELSE 20 END AS k FROM documents GROUP BY source")
def _(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n")).select("source", r.default_hits(F.col("n")).alias("k"))


@query("win04_rank_decay", "SELECT doc_id, round(greatest(0.1, 2.0 / (row_number() OVER (PARTITION BY lang ORDER BY doc_id) + 1)), 6) AS s FROM documents")
def _(spark, d):
    ranks = running(table(spark, d, "documents").select("lang", "doc_id"), ["lang"], ["doc_id"], name="place")
    return ranks.select("doc_id", F.round(r.rank_decay(F.col("place"), 2.0, 0.1), 6).alias("s"))


@query("srt03_top_window", "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 40")
def _(spark, d):
    return table(spark, d, "documents").orderBy(F.desc("n_chars"), "doc_id").limit(40).select("doc_id", "n_chars")


@query("srt05_budgeted_prefix", "SELECT lang, doc_id, used FROM (SELECT lang, doc_id, sum(n_chars) OVER (PARTITION BY lang ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS used, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM documents) WHERE used <= 30000 OR r = 1")
def _(spark, d):
    return r.within_budget(table(spark, d, "documents").select("lang", "doc_id", "n_chars"), "lang", "doc_id", "n_chars", 30000).select("lang", "doc_id", "used")


@query("srt07_keyset_page", "SELECT doc_id, n_chars FROM documents WHERE n_chars < 3000 OR (n_chars = 3000 AND doc_id > 10) ORDER BY n_chars DESC, doc_id LIMIT 21")
def _(spark, d):
    request = {"lang": ["en", "de"], "limit": 20}
    after = r.read_cursor(r.cursor([3000, 10], request, 1), {"limit": 20, "lang": ["de", "en"]}, 1)
    return r.page(table(spark, d, "documents").select("doc_id", "n_chars"), "n_chars", "doc_id", 20, after)


FUZZY_SQL = f"""WITH {FILES_SQL}, c AS (SELECT DISTINCT path, false AS dir FROM files UNION ALL SELECT DISTINCT regexp_replace(path, '/[^/]*$', ''), true FROM files WHERE contains(path, '/')),
n AS (SELECT path, dir, lower(path) AS p, lower(split_part(path, '/', -1)) AS name, length(regexp_extract(lower(path), '^[^1]*1[^2]*2')) AS steps FROM c),
s AS (SELECT path, dir, CASE WHEN name = '12' THEN 1000 WHEN starts_with(name, '12') THEN 900 WHEN contains(name, '12') THEN 700 WHEN contains(p, '12') THEN 500 WHEN steps > 0 THEN 300 + greatest(0, 100 - (steps - 2)) END + CASE WHEN dir THEN 25 ELSE 0 END AS score FROM n)
SELECT path, dir AS directory, score FROM s WHERE score IS NOT NULL ORDER BY score DESC, dir DESC, length(path), path LIMIT 100"""


@query("srt11_fuzzy_paths", FUZZY_SQL)
def _(spark, d):
    paths = files(spark, d).select("path")
    folders = paths.where(F.contains("path", F.lit("/"))).select(F.regexp_replace("path", "/[^/]*$", "").alias("path"))
    both = paths.distinct().withColumn("directory", F.lit(False)).unionByName(folders.distinct().withColumn("directory", F.lit(True)))
    scored = both.withColumn("score", r.fuzzy_path_score(F.col("path"), "12", F.col("directory"))).where("score is not null")
    return scored.orderBy(F.desc("score"), F.desc("directory"), F.length("path"), "path").limit(100)


@query("agg11_fusion_sum", "SELECT doc_id, round(sum(w / (50 + rk)), 9) AS fused FROM (SELECT doc_id, 1.1 AS w, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rk FROM documents UNION ALL SELECT doc_id, 0.9, row_number() OVER (ORDER BY doc_id) FROM labels) GROUP BY doc_id")
def _(spark, d):
    one = F.lit(0).alias("query_id")
    a = running(table(spark, d, "documents").select(one, "doc_id", (-F.col("n_chars")).alias("k")), [], ["k", "doc_id"], name="rank")
    b = running(table(spark, d, "labels").select(one, "doc_id"), [], ["doc_id"], name="rank")
    return r.fuse({"lexical": a, "vector": b}).select("doc_id", "fused")


@query("agg19_recall_mrr", HYBRID_SQL + PLACED + ", rel AS (SELECT q.query_id, s.doc_id FROM q JOIN cand s ON s.query_id = q.query_id AND s.rank = 1), good AS (SELECT rel.query_id, count(CASE WHEN place <= 5 THEN 1 END) AS found, min(place) AS first FROM rel JOIN placed p ON p.query_id = rel.query_id AND p.doc_id = rel.doc_id GROUP BY rel.query_id), c AS (SELECT query_id, count(*) AS n FROM rel GROUP BY query_id) SELECT round(avg(coalesce(found / n, 0)), 6) AS recall, round(avg(coalesce(1 / first, 0)), 6) AS mrr FROM c LEFT JOIN good USING (query_id)")
def _(spark, d):
    docs, queries = _docs(spark, d), _queries(spark, d)
    some = r.lexical_lane(docs, queries)  # texts are read once for both
    return r.recall_and_rank(r.hybrid(docs, queries, 40, some), some.where("rank = 1").select("query_id", "doc_id"))


@query("prj16_line_chunks", "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, CAST(unnest(range(len(string_split(text, chr(10))))) AS BIGINT) AS pos FROM documents), w AS (SELECT doc_id, pos // 8 AS win, string_agg(line, chr(10) ORDER BY pos) AS text, min(pos) + 1 AS start_line, max(pos) + 1 AS end_line FROM l GROUP BY doc_id, pos // 8) SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY win) - 1 AS chunk_index, start_line, end_line, text FROM w WHERE trim(text, ' \t\n') <> ''")
def _(spark, d):
    return chunks.by_lines(table(spark, d, "documents"), 8)


@query("prj17_file_documents", f"WITH {FILES_SQL} SELECT file_id, left(trim(string_split(replace(content, chr(13), ''), chr(10))[1]), 200) AS summary, left(replace(content, chr(13), ''), 1000) AS excerpt FROM files WHERE NOT contains(content, chr(0))")
def _(spark, d):
    return chunks.file_documents(files(spark, d))


@query("src10_ignore_rules", f"WITH {FILES_SQL} SELECT file_id FROM files WHERE NOT CASE WHEN regexp_matches(path, '^(.*/)?de/[^/]*9(/|$)') THEN true WHEN regexp_matches(path, '^(.*/)?de/[^/]*5(/|$)') THEN false WHEN regexp_matches(path, '^(.*/)?de/.*(/|$)') THEN true WHEN regexp_matches(path, '(^|/)[^/]*9(/|$)') THEN true ELSE false END")
def _(spark, d):
    return workspace.visible(files(spark, d), ["*9", "**/de/**", "# a comment", "!**/de/*5", "**/de/*9"]).select("file_id")


@query("src11_include_rules", f"WITH {FILES_SQL} SELECT file_id FROM files WHERE regexp_matches(path, '^(.*/)?en/[^/]*1(/|$)')")
def _(spark, d):
    return workspace.included(files(spark, d), ["**/en/*1"]).select("file_id")

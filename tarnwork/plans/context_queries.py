"""Queries over whole tables of hits, paths, requests and memories that share an index."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tarnwork.functions import text as tx
from tarnwork.operators import context, grams, memory, preselect
from tarnwork.plans.registry import query
from tarnwork.plans.retrieval_queries import TOKEN
from tarnwork.sources.tables import CALLS_SQL, calls, table
from tarnwork.storage import stored

SYMBOLS_SQL = "sym AS (SELECT p_partkey AS id, p_name AS name, 'src/m' || p_size || '.py' AS file, p_partkey % 400 AS line, p_size > 45 AS is_test FROM part)"
BUDGET_SQL = f"""WITH RECURSIVE {CALLS_SQL}, {SYMBOLS_SQL},
lim AS (SELECT CASE WHEN n < 500 THEN [3, 2, 2, 2, 20] WHEN n < 5000 THEN [5, 3, 3, 3, 25] WHEN n < 50000 THEN [7, 3, 3, 4, 25] ELSE [8, 4, 4, 5, 30] END AS k FROM (SELECT count(*) AS n FROM part)),
hits AS (SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY q DESC, id) AS INTEGER) AS rank FROM (SELECT l_suppkey AS query_id, l_partkey AS id, max(l_quantity) AS q FROM lineitem GROUP BY ALL)),
top AS (SELECT hits.*, k FROM hits, lim WHERE rank <= k[1]),
near AS (SELECT callee AS id, caller AS other, 0 AS side, row_number() OVER (PARTITION BY callee ORDER BY caller) AS place FROM calls UNION ALL SELECT caller, callee, 1, row_number() OVER (PARTITION BY caller ORDER BY callee) FROM calls),
tests AS (SELECT query_id, file, row_number() OVER (PARTITION BY query_id ORDER BY file) AS place, k FROM (SELECT DISTINCT query_id, sym.file, k FROM top JOIN calls ON callee = top.id JOIN sym ON sym.id = caller WHERE is_test)),
every AS (
  SELECT query_id, 2 * (rank - 1) + side AS section, place, CAST(other AS VARCHAR) AS node, CASE side WHEN 0 THEN 'caller: ' || o.name || ' → ' || s.name ELSE 'callee: ' || s.name || ' → ' || o.name END || ' (' || o.file || ':' || o.line || ')' AS text
  FROM top JOIN near USING (id) JOIN sym s ON s.id = near.id JOIN sym o ON o.id = other WHERE place <= k[2 + side]
  UNION ALL SELECT query_id, 2 * k[1], place, NULL, 'test file: ' || file FROM tests WHERE place <= k[4]),
items AS (SELECT *, greatest(octet_length(encode(text)) // 4, 10) AS cost, row_number() OVER (PARTITION BY query_id ORDER BY section, place) AS i FROM every),
scan AS (
  SELECT s_suppkey AS query_id, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS used, CAST(-1 AS BIGINT) AS stopped, CAST([] AS VARCHAR[]) AS tried, false AS kept, CAST((200 + s_suppkey % 7 * 100) * k[5] // 100 AS BIGINT) AS budget FROM supplier, lim
  UNION ALL
  SELECT query_id, i, CASE WHEN NOT passed AND used + cost <= budget THEN used + cost ELSE used END, CASE WHEN NOT passed AND used + cost > budget THEN section ELSE stopped END,
    CASE WHEN passed OR node IS NULL THEN tried ELSE list_append(tried, node) END, NOT passed AND used + cost <= budget, budget
  FROM (SELECT items.*, used, stopped, tried, budget, section = stopped OR coalesce(list_contains(tried, node), false) AS passed FROM scan JOIN items ON items.query_id = scan.query_id AND items.i = scan.i + 1))
SELECT items.query_id, CAST(section AS INTEGER) AS section, CAST(place AS INTEGER) AS place, node, text, CAST(cost AS BIGINT) AS cost, used FROM scan JOIN items ON items.query_id = scan.query_id AND items.i = scan.i WHERE kept"""


@query("rnk26_context_budget", BUDGET_SQL)
def _(spark, d):
    parts = table(spark, d, "part")
    symbols = parts.select(F.col("p_partkey").alias("symbol"), F.col("p_name").alias("name"), F.concat(F.lit("src/m"), F.col("p_size").cast("string"), F.lit(".py")).alias("file"), (F.col("p_partkey") % 400).alias("line"), (F.col("p_size") > 45).alias("is_test"))
    lines = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("query_id"), F.col("l_partkey").alias("symbol")).agg(F.max("l_quantity").alias("q"))
    limits = context.limits_for(parts.count())
    hits = lines.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("q"), "symbol"))).where(F.col("rank") <= limits.symbols)
    budgets = table(spark, d, "supplier").select(F.col("s_suppkey").alias("query_id"), (200 + F.col("s_suppkey") % 7 * 100).alias("tokens"))
    return context.enrich(hits, stored(calls(spark, d), "calls"), symbols, budgets, limits)


# --- requests ----------------------------------------------------------------------------------

#: Files by the parts' first word and brand; every fiftieth part asks, and every fiftieth after it asks for nothing known.
PRESELECT_SQL = rf"""WITH files AS (SELECT 'src/' || split_part(p_name, ' ', 1) || '/m' || regexp_extract(p_brand, '[0-9]+') || '_' || p_size || '.py' AS path, p_partkey AS id, p_name, p_type, split_part(p_name, ' ', 2) || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '_' || p_partkey % 50 END AS name FROM part),
summaries AS (SELECT path, string_agg(p_name || ' ' || p_type, ' ' ORDER BY id) AS text, max(id) AS indexed_at FROM files GROUP BY path),
req AS (SELECT id AS query_id, CASE id % 50 WHEN 0 THEN p_name || ' ' || p_type ELSE 'qqqq zz' END AS text FROM files WHERE id % 50 IN (0, 1)),
tok AS (SELECT query_id, list_transform(regexp_extract_all(text, '{TOKEN}'), lambda t: lower(t)) AS x FROM req),
dtok AS (SELECT path, list_transform(regexp_extract_all(text, '{TOKEN}'), lambda t: lower(t)) AS x FROM summaries),
terms AS (SELECT query_id, unnest(list_slice(list_distinct(x), 1, 12)) AS token FROM tok),
post AS (SELECT path, any_value(n) AS length, token, count(*) AS tf FROM (SELECT path, len(x) AS n, unnest(x) AS token FROM dtok) GROUP BY path, token),
totals AS (SELECT count(*) AS docs, avg(len(x)) AS mean FROM dtok), df AS (SELECT token, count(*) AS df FROM post GROUP BY token),
lex AS (SELECT query_id, path, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * (tf * (1.2 + 1) / (tf + 1.2 * (1 - 0.75 + 0.75 * length / mean)))), 9) AS score FROM terms JOIN post USING (token) JOIN df USING (token), totals GROUP BY query_id, path),
asked AS (SELECT query_id, unnest(list_slice(list_filter(x, lambda t: length(t) >= 3), 1, 8)) AS token FROM tok),
tk AS (SELECT DISTINCT token FROM asked),
bypath AS (SELECT token, path, row_number() OVER (PARTITION BY token ORDER BY path) AS p FROM tk, summaries WHERE contains(lower(path), token)),
byname AS (SELECT token, path, lower(name) = token AS same, row_number() OVER (PARTITION BY token ORDER BY path, name) AS p FROM tk, (SELECT DISTINCT path, name FROM files) WHERE contains(lower(name), token)),
lists AS (
  SELECT r.query_id, s.path, row_number() OVER (PARTITION BY r.query_id ORDER BY s.path) - 1 AS rank FROM req r JOIN summaries s ON s.indexed_at % 29 = r.query_id % 29 WHERE r.query_id % 50 = 0),
hits AS (
  SELECT query_id, path, greatest(2.0, 5.0 / (rank + 1)) AS score, 'working-set' AS layer FROM lists WHERE rank < 5 UNION ALL
  SELECT query_id, path, greatest(1.2, 3.5 / (rank + 1)), 'recent' FROM lists WHERE rank BETWEEN 0 AND 8 UNION ALL
  SELECT query_id, path, greatest(2.2, 4.0 / (rank + 1)), 'pinned' FROM lists WHERE rank < 1 UNION ALL
  SELECT query_id, path, greatest(1.5, 3.0 / (rank + 1)), 'dirty-buffer' FROM lists WHERE rank < 3 UNION ALL
  SELECT query_id, path, 1.4 + 1 / (1 + abs(score)), 'fts-summary' FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path) AS p FROM lex) WHERE p <= 40 UNION ALL
  SELECT query_id, path, 1.0, 'token-search' FROM asked JOIN bypath USING (token) WHERE p <= 20 UNION ALL
  SELECT query_id, path, CASE WHEN same THEN 2.0 ELSE 1.2 END, 'token-search' FROM asked JOIN byname USING (token) WHERE p <= 24),
every AS (SELECT * FROM hits UNION ALL SELECT query_id, path, 0.2, 'fallback-indexed' FROM req, (SELECT path FROM summaries ORDER BY indexed_at DESC, path LIMIT 40) WHERE query_id NOT IN (SELECT query_id FROM hits)),
summed AS (SELECT query_id, path, round(sum(CAST(score AS DOUBLE)), 9) AS score, array_to_string(list_sort(list_distinct(list(layer))), ',') AS layers FROM every GROUP BY query_id, path)"""


def _asking(spark, d):
    p = table(spark, d, "part")
    word = lambda k: F.split_part("p_name", F.lit(" "), F.lit(k))
    key = F.col("p_partkey")
    path = F.concat(F.lit("src/"), word(1), F.lit("/m"), F.regexp_extract("p_brand", "[0-9]+", 0), F.lit("_"), F.col("p_size").cast("string"), F.lit(".py"))
    name = F.concat(word(2), F.when(key % 3 == 0, "").otherwise(F.concat(F.lit("_"), (key % 50).cast("string"))))
    files = p.select(path.alias("path"), key.alias("id"), "p_name", "p_type", name.alias("name"))
    texts = F.transform(F.sort_array(F.collect_list(F.struct("id", F.concat("p_name", F.lit(" "), "p_type").alias("t")))), lambda x: x["t"])
    summaries = stored(files.groupBy("path").agg(F.array_join(texts, " ").alias("text"), F.max("id").alias("indexed_at")), "summaries")
    text = F.when(key % 50 == 0, F.concat("p_name", F.lit(" "), "p_type")).otherwise("qqqq zz")
    requests = stored(p.where("p_partkey % 50 in (0, 1)").select(key.alias("query_id"), text.alias("text")), "requests")
    return files, summaries, requests


@query("rnk16_token_search", PRESELECT_SQL + " SELECT query_id, path, round(sum(CAST(score AS DOUBLE)), 6) AS score, count(*) AS n FROM hits WHERE layer = 'token-search' GROUP BY query_id, path")
def _(spark, d):
    files, summaries, requests = _asking(spark, d)
    found = preselect.token_hits(requests, summaries.select("path"), files.select("path", "name").distinct())
    return found.groupBy("query_id", "path").agg(F.round(F.sum("score"), 6).alias("score"), F.count("*").alias("n"))


def _preselected(spark, d):
    files, summaries, requests = _asking(spark, d)
    turns = summaries.select("path", (F.col("indexed_at") % 29).alias("turn"))
    turns = turns.withColumn("rank", F.row_number().over(Window.partitionBy("turn").orderBy("path")) - 1).where("rank <= 8")  # the same for all requests of a turn
    listed = requests.where("query_id % 50 = 0").select("query_id", (F.col("query_id") % 29).alias("turn")).join(F.broadcast(turns), "turn")  # nine rows a turn
    listed = stored(listed.select("query_id", "path", "rank"), "lists")
    lists = {"working-set": listed.where("rank < 5"), "recent": listed, "pinned": listed.where("rank < 1"), "dirty-buffer": listed.where("rank < 3")}
    return preselect.preselect(requests, lists, summaries.select("path", "text"), files.select("path", "name").distinct(), summaries.select("path", "indexed_at"), 40)


@query("rnk14_preselect_layers", PRESELECT_SQL + " SELECT query_id, path, score, layers, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path) AS INTEGER) AS place FROM summed) WHERE place <= 40")
def _(spark, d):
    return _preselected(spark, d)


@query("rnk16_near_spellings", r"WITH n AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS name FROM conversations), w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS word FROM benchmark), c AS (SELECT word, name, len(word) AS a, len(name) AS b FROM w, n WHERE abs(len(word) - len(name)) <= 1) SELECT word, name, CASE WHEN word = name THEN 0 ELSE 1 END AS edits FROM c WHERE word = name OR (a = b AND list_sum(list_transform(range(1, CAST(a + 1 AS BIGINT)), lambda i: CASE WHEN word[i] = name[i] THEN 0 ELSE 1 END)) = 1) OR (a = b + 1 AND list_bool_or(list_transform(range(1, CAST(a + 1 AS BIGINT)), lambda i: left(word, CAST(i - 1 AS BIGINT)) || word[i + 1:] = name))) OR (b = a + 1 AND list_bool_or(list_transform(range(1, CAST(b + 1 AS BIGINT)), lambda i: left(name, CAST(i - 1 AS BIGINT)) || name[i + 1:] = word)))")
def _(spark, d):
    unique = lambda t, c: table(spark, d, t).select(F.explode(tx.unicode_tokens("text")).alias(c)).distinct()
    return grams.within_edits(unique("benchmark", "word"), unique("conversations", "name"))


# --- memories ------------------------------------------------------------------------------------

MEMORY_SQL = r"""WITH e AS (SELECT conv_id * 1000 + turn AS entry, lower(text) AS text, (turn % 5) / 4.0 AS importance, CASE role WHEN 'user' THEN 1.0 WHEN 'assistant' THEN 0.6 ELSE 0.4 END AS trust, coalesce(l.good, 0) AS positive, coalesce(l.toxic, 0) AS negative
  FROM conversations LEFT JOIN (SELECT doc_id, count(CASE WHEN quality = 1 THEN 1 END) AS good, count(CASE WHEN toxic = 1 THEN 1 END) AS toxic FROM labels GROUP BY doc_id) l ON l.doc_id = conv_id),
t AS (SELECT *, regexp_extract_all(text, '[\p{L}\p{N}]+') AS x FROM e),
q AS (SELECT entry AS query_id, list_slice(x, 2, 3) AS asked, substring(text, 4, 6) AS needle FROM t WHERE entry // 1000 % 50 = 0),
m AS (SELECT query_id, entry, CASE WHEN len(asked) > 0 AND list_has_all(x, asked) THEN 1 ELSE 0 END AS words, CASE WHEN length(needle) >= 3 AND contains(text, needle) THEN 1 ELSE 0 END AS inside, importance, trust, positive, negative FROM t, q),
s AS (SELECT query_id, entry, words, inside, round((0.6 * words + 0.4 * inside) * (0.5 + 0.3 * CAST(importance AS DOUBLE) + 0.2 * CAST(trust AS DOUBLE)) + 0.1 * (positive - negative) / (positive + negative + 1.0), 9) AS score FROM m WHERE words + inside > 0)
SELECT query_id, entry, words, inside, score, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entry) AS INTEGER) AS place FROM s) WHERE place <= 20"""


@query("rnk31_memory_search", MEMORY_SQL)
def _(spark, d):
    found = table(spark, d, "labels").groupBy(F.col("doc_id").alias("conv_id")).agg(F.count_if(F.col("quality") == 1).alias("positive"), F.count_if(F.col("toxic") == 1).alias("negative"))
    role = F.col("role")
    c = table(spark, d, "conversations").join(found, "conv_id", "left")
    entries = c.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("entry"), F.lower("text").alias("text"), ((F.col("turn") % 5) / 4).alias("importance"), F.when(role == "user", 1.0).when(role == "assistant", 0.6).otherwise(0.4).alias("trust"),
        F.coalesce("positive", F.lit(0)).alias("positive"), F.coalesce("negative", F.lit(0)).alias("negative"),
    )
    entries = stored(entries, "memories")
    asked = entries.where("entry div 1000 % 50 = 0").select(F.col("entry").alias("query_id"), F.slice(tx.unicode_tokens("text"), 2, 2).alias("words"), F.substring("text", 4, 6).alias("needle"))
    return memory.search(entries, stored(asked, "memory-requests"), 20)

"""Conflict review, redaction, pooled vectors, session search, zones and call kinds over whole tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tarnwork.functions import text as tx
from tarnwork.operators import graph, memory, migration, redaction, retrieval as r, vectors as v
from tarnwork.plans.code_queries import PHRASE_SQL
from tarnwork.plans.registry import query
from tarnwork.plans.retrieval_queries import SCALED
from tarnwork.plans.source_queries import GO_SOURCE, JAVA_SOURCE, _source
from tarnwork.sources import brace_symbols
from tarnwork.sources.tables import table
from tarnwork.storage import stored

NORMAL = r"lower(trim(regexp_replace({}, '\s+', ' ', 'g')))"
CONFLICTS_SQL = f"""WITH e AS (SELECT doc_id AS entry, lang AS scope, sha256({NORMAL.format('text')}) AS hash, {NORMAL.format("split_part(text, '.', 1)")} AS summary FROM documents),
d AS (SELECT scope, hash, min(entry) AS other, count(*) AS n FROM e GROUP BY scope, hash),
c AS (SELECT scope, summary, hash, min(entry) AS entry FROM e WHERE summary <> '' GROUP BY scope, summary, hash),
s AS (SELECT scope, summary, min(entry) AS other, count(*) AS n FROM c GROUP BY scope, summary)
SELECT entry, other, 'exact-duplicate' AS relation FROM e JOIN d ON e.scope IS NOT DISTINCT FROM d.scope AND e.hash = d.hash WHERE n > 1 AND entry <> other
UNION ALL SELECT entry, other, 'normalized-summary-collision' FROM c JOIN s ON c.scope IS NOT DISTINCT FROM s.scope AND c.summary = s.summary WHERE n > 1 AND entry <> other"""


def _entries(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("entry"), F.col("lang").alias("scope"), F.col("text").alias("content"), F.split_part("text", F.lit("."), F.lit(1)).alias("summary"))


@query("mem05_conflict_review", CONFLICTS_SQL)
def _(spark, d):
    entries = _entries(spark, d)
    return memory.conflicts(entries, entries.select("entry").limit(0)).select("entry", "other", "relation")


@query("ext06_semantic_conflicts")
def _(spark, d):
    e = stored(table(spark, d, "embeddings"), "embeddings")
    entries = e.select(F.col("vec_id").alias("entry"), F.lit("all").alias("scope"), F.col("vec_id").cast("string").alias("content"), F.lit("").alias("summary"))
    found = memory.conflicts(entries, entries.select("entry"), memory.opposed(e, "label", 0.2), "embeddings")
    return found.where("relation = 'semantic-conflict'").select("entry", "other", "score", "reasons", "detector")


REDACTED_SQL = """SELECT c_custkey AS id, '{"contact":{"api_key":"[secret]","phone":"' || CASE WHEN c_custkey % 3 = 0 THEN 'none' ELSE 'mail [mail]' END || '"},"id":' || c_custkey || ',"name":"' || c_name || '","notes":["Bearer [token] and x@y.z","plain ' || c_custkey || '",{"n":' || c_custkey || ',"token":"[secret]"},[],{}]}' AS json, CAST(CASE WHEN c_custkey % 3 = 0 THEN 3 ELSE 4 END AS BIGINT) AS hits FROM customer"""


@query("ext07_redaction", REDACTED_SQL)
def _(spark, d):
    k = F.col("c_custkey").cast("string")
    body = F.concat(
        F.lit('{"id": '), k, F.lit(', "name": "'), "c_name", F.lit('", "contact": {"phone": "'), F.when(F.col("c_custkey") % 3 == 0, "none").otherwise(F.concat(F.lit("mail bob"), k, F.lit("@x.org"))), F.lit('", "api_key": ["k'), k,
        F.lit('"]}, "notes": ["Bearer abc'), k, F.lit('.z and x@y.z", "plain '), k, F.lit('", {"token": {"v": 1}, "n": '), k, F.lit("}, [], {}]}"),
    )
    return redaction.redact(table(spark, d, "customer").select(F.col("c_custkey").alias("id"), body.alias("body")))


POOLED_SQL = SCALED + """, asked AS (SELECT vec_id AS query_id, v AS o, norm AS onorm FROM z WHERE vec_id % 50 = 0),
near AS (SELECT query_id, vec_id, round(list_dot_product(o, v) / (onorm * norm), 6) AS score FROM z, asked),
recalled AS (SELECT query_id, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS p FROM near WHERE score > 0) WHERE p <= 5),
pooled AS (SELECT query_id, vec_id, round(scale * list_dot_product(CAST(q AS DOUBLE[]), o) / (onorm * norm), 6) AS score FROM z JOIN asked ON vec_id - query_id BETWEEN 1 AND 40),
best AS (SELECT query_id, vec_id, max(score) AS score FROM (SELECT * FROM recalled UNION ALL SELECT * FROM pooled WHERE score > 0) GROUP BY query_id, vec_id)
SELECT query_id, vec_id, score, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM best) WHERE place <= 5"""


@query("rnk09_pooled_lane", POOLED_SQL)
def _(spark, d):
    e = table(spark, d, "embeddings")
    asked = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    pool = asked.select("query_id", F.explode(F.sequence(F.col("query_id") + 1, F.col("query_id") + 40)).alias("vec_id"))
    return v.lane(e, asked, pool, 5)


@query("rnk27_session_ranking", PHRASE_SQL.split("SELECT query_id, conv_id, turn, spans FROM m")[0] + " SELECT query_id, conv_id, turn, spans, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY spans DESC, n, conv_id, turn) AS place FROM m WHERE spans > 0) WHERE place <= 20")
def _(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", tx.unicode_tokens("text").alias("x")).withColumn("n", F.size("x"))
    phrases = stored(c.where("conv_id % 50 = 0 and turn = 0 and size(x) >= 3").select(F.col("conv_id").alias("query_id"), F.slice("x", F.lit(2), F.lit(2)).alias("phrase")), "asked-phrases")
    spans = r.phrase_spans(c, phrases, ["conv_id", "turn", "n"])
    place = F.row_number().over(Window.partitionBy("phrase").orderBy(F.desc("spans"), "n", "conv_id", "turn"))
    best = spans.withColumn("place", place).where("place <= 20")  # the same for all queries with this phrase
    return phrases.join(best, "phrase").select("query_id", "conv_id", "turn", "spans", "place")


ZONES = ("UTC", "Asia/Tokyo", "America/New_York", "Europe/Berlin", "Asia/Kolkata")


@query("dat02_zone_column", f"SELECT event_id, {list(ZONES)}[user_id % 5 + 1] AS zone, strftime(timezone({list(ZONES)}[user_id % 5 + 1], timezone('UTC', ts)), '%Y-%m-%d %H:%M') AS local FROM events")
def _(spark, d):
    zone = F.get(F.array(*map(F.lit, ZONES)), (F.col("user_id") % 5).cast("int"))
    e = table(spark, d, "events").select("event_id", zone.alias("zone"), F.col("ts").cast("timestamp").alias("ts"))
    return e.select("event_id", "zone", F.date_format(F.from_utc_timestamp("ts", F.col("zone")), "yyyy-MM-dd HH:mm").alias("local"))


SHAPES_SQL = "WITH f AS (SELECT 'src/f' || p_partkey || '.' || CASE WHEN p_partkey % 2 = 0 THEN 'go' ELSE 'java' END AS path, p_partkey % 2 = 0 AS go, p_size AS s FROM part) SELECT path, 'fmt.Println' AS call, 'constructor' AS kind FROM f WHERE go UNION ALL SELECT path, 'helper' || s, 'local' FROM f WHERE go UNION ALL SELECT path, 'Bad' || s, 'constructor' FROM f WHERE NOT go UNION ALL SELECT path, 'obj.run', 'method' FROM f WHERE NOT go UNION ALL SELECT path, 'helper', 'local' FROM f WHERE NOT go"


@query("grf15_parsed_call_kinds", SHAPES_SQL)
def _(spark, d):
    first, second = (F.split_part("p_name", F.lit(" "), F.lit(k)) for k in (1, 2))
    p = table(spark, d, "part").select("p_partkey", "p_size", F.initcap(first).alias("c"), second.alias("m"), F.when(F.col("p_partkey") % 2 == 0, "go").otherwise("java").alias("language"))
    files = p.select(F.concat(F.lit("src/f"), F.col("p_partkey").cast("string"), F.lit("."), "language").alias("path"), F.when(F.col("language") == "go", _source(GO_SOURCE)).otherwise(_source(JAVA_SOURCE)).alias("content"))
    found = stored(brace_symbols.symbols(files), "parsed")
    imports = found.where("kind = 'import'").groupBy("path").agg(F.collect_set(F.coalesce("alias", "name")).alias("imports"))  # of one file
    calls = found.where("kind like '%call'").join(imports, "path", "left")
    name = F.concat_ws(".", "receiver", "name")
    return calls.select("path", name.alias("call"), graph.call_shape(name, F.coalesce("imports", F.array().cast("array<string>"))).alias("kind"))


@query("rnk10_quantised_nearest", SCALED + ", asked AS (SELECT vec_id AS query_id, v AS o, norm AS onorm FROM z WHERE vec_id % 50 = 0), near AS (SELECT query_id, vec_id, round(scale * list_dot_product(CAST(q AS DOUBLE[]), o) / (onorm * norm), 6) AS score FROM z, asked) SELECT query_id, vec_id, score, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM near) WHERE place <= 10")
def _(spark, d):
    e = table(spark, d, "embeddings")
    return v.quantised_nearest(e, e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 10)


#: Every third turn is a tool's result that replaces the turn before it.
MIGRATED_SQL = """WITH c AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN 'tool' WHEN role = 'user' THEN 'user' ELSE 'assistant' END AS role, CAST(to_json(text) AS VARCHAR) AS text FROM conversations),
n AS (SELECT *, 'legacy-message:' || conv_id || ':' || turn AS own, 'legacy-message:' || conv_id || ':' || CASE WHEN role = 'tool' THEN turn - 1 ELSE turn END AS taken FROM c)
SELECT conv_id AS session_id, turn AS seq, CASE role WHEN 'tool' THEN 'tool/result' ELSE role || '/message' END AS type, CASE role
  WHEN 'user' THEN '{"content":' || text || ',"source":{"kind":"user"},"id":"' || own || '","role":"user"}'
  WHEN 'assistant' THEN '{"message":{"id":"' || own || '","role":"assistant","content":' || text || ',"source":{"model":"m","kind":"model"}}}'
  ELSE '{"message":{"id":"' || taken || '","role":"user","content":[{"type":"tool-result","toolCallId":"c' || turn || '","content":' || text || ',"isError":false}],"source":{"kind":"tool","callId":"c' || turn || '"}}}' END AS data FROM n"""


@query("prj27_event_migration", MIGRATED_SQL)
def _(spark, d):
    c = table(spark, d, "conversations")
    tool, user = F.col("turn") % 3 == 2, F.col("role") == "user"
    source = lambda k, value: F.struct(F.lit(value).alias(k))
    data = (
        F.when(tool, F.to_json(F.struct(F.concat(F.lit("c"), F.col("turn").cast("string")).alias("callId"), F.col("text").alias("content"), F.lit(False).alias("isError"))))
        .when(user, F.to_json(F.struct(F.col("text").alias("content"), source("kind", "user").alias("source")))).otherwise(F.to_json(F.struct(F.col("text").alias("content"), source("model", "m").alias("provenance"))))
    )
    kind = F.when(tool, "tool/result").when(user, "user/message").otherwise("assistant/message")
    events = c.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), kind.alias("type"), data.alias("data"), F.when(tool, F.col("turn") - 1).alias("replaces"))
    return migration.migrated(events).drop("problem")

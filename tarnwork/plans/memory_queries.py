"""Governed-record queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnwork.operators import memory as m
from tarnwork.plans.registry import query
from tarnwork.sources.tables import millis, table

REV = "rev AS (SELECT o_custkey AS memory_id, o_orderkey AS entry, CASE WHEN o_orderstatus = 'P' THEN 'forgotten' ELSE 'active' END AS status, o_orderpriority AS kind, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS revision FROM orders)"


def _revised(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("memory_id"), F.col("o_orderkey").alias("entry"), F.when(F.col("o_orderstatus") == "P", "forgotten").otherwise("active").alias("status"), F.col("o_orderpriority").alias("kind"), "o_orderdate")
    return m.revisions(rows, "memory_id", ["o_orderdate", "entry"]).drop("o_orderdate")


@query("mem01_current", f"WITH {REV} SELECT memory_id, entry, status, kind, revision FROM (SELECT *, max(revision) OVER (PARTITION BY memory_id) AS last FROM rev) WHERE revision = last AND status <> 'forgotten'")
def _(spark, d):
    return m.current(_revised(spark, d), "memory_id")


@query("mem02_filtered_list", f"WITH {REV} SELECT memory_id, entry FROM (SELECT *, max(revision) OVER (PARTITION BY memory_id) AS last FROM rev) WHERE revision = last AND status = 'active' AND kind IN ('1-URGENT', '2-HIGH') ORDER BY memory_id LIMIT 50")
def _(spark, d):
    return m.current(_revised(spark, d), "memory_id").where("status = 'active' and kind in ('1-URGENT', '2-HIGH')").orderBy("memory_id").limit(50).select("memory_id", "entry")


@query("mem03_exact_dedupe", r"SELECT lang, min(doc_id) AS doc_id, count(*) AS copies, sha256(lower(trim(regexp_replace(text, '\s+', ' ', 'g')))) AS hash FROM documents GROUP BY lang, hash")
def _(spark, d):
    docs = table(spark, d, "documents").select("lang", m.normal_hash("text").alias("hash"), "doc_id")
    return m.first_of_equal(docs, ["lang", "hash"], "doc_id")


@query("mem04_superseded", f"WITH {REV} SELECT memory_id, revision, revision + 1 AS next_revision FROM rev WHERE (memory_id, revision + 1) IN (SELECT memory_id, revision FROM rev)")
def _(spark, d):
    return m.superseded(_revised(spark, d), "memory_id")


@query("mem05_conflicts", f"WITH {REV} SELECT a.memory_id, a.revision AS first, b.revision AS second FROM rev a JOIN rev b ON a.memory_id = b.memory_id AND b.revision = a.revision + 1 AND a.kind = b.kind AND a.status <> b.status")
def _(spark, d):
    r = _revised(spark, d)
    nxt = r.select("memory_id", (F.col("revision") - 1).alias("revision"), F.col("kind").alias("k2"), F.col("status").alias("s2"))
    return r.join(nxt, ["memory_id", "revision"]).where("kind = k2 and status <> s2").select("memory_id", F.col("revision").alias("first"), (F.col("revision") + 1).alias("second"))


@query("mem06_outcomes", "SELECT r.user_id, r.event_id AS result, c.event_id AS recall FROM (SELECT * FROM events WHERE event_type = 'purchase') r ASOF JOIN (SELECT * FROM events WHERE event_type = 'view') c ON r.user_id = c.user_id AND r.ts >= c.ts")
def _(spark, d):
    e = table(spark, d, "events").select("user_id", millis("ts").alias("at"), F.col("event_id").alias("id"), "event_type")
    return m.outcomes(e.where("event_type = 'view'"), e.where("event_type = 'purchase'"), "user_id")


@query("mem07_signals", "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY user_id, event_type")
def _(spark, d):
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query("mem08_admission", "SELECT DISTINCT user_id, event_type FROM events")
def _(spark, d):
    return table(spark, d, "events").select("user_id", "event_type").dropDuplicates()


@query("mem09_feedback", "SELECT doc_id, max(quality) AS rating, count(*) AS versions FROM labels GROUP BY doc_id")
def _(spark, d):
    return table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("rating"), F.count("*").alias("versions"))

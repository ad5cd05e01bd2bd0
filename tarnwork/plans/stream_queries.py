"""Streaming and stateful queries, each drained over the events table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tarnwork.plans.registry import query
from tarnwork.sources.tables import millis, table
from tarnwork.storage import shared_dir
from tarnwork.streaming import feeds, projections, refresh


def _feed(spark, d):
    return feeds.feed(spark, f"{d}/events.parquet", table(spark, d, "events").schema)


@query("stm01_stateful_fold", "SELECT user_id, count(*) AS n, round(sum(value), 4) AS total, count(CASE WHEN event_type = 'error' THEN 1 END) AS errors FROM events GROUP BY user_id")
def _(spark, d):
    states = feeds.drained(feeds.totals(_feed(spark, d)), "fold", "update")
    last = states.groupBy("user_id").agg(F.max_by(F.struct("n", "total", "errors"), "batch").alias("s"))
    return last.select("user_id", "s.n", F.round("s.total", 4).alias("total"), "s.errors")


@query("stm01_batch_fold", "SELECT user_id, count(*) AS n, round(sum(value), 4) AS total, count(CASE WHEN event_type = 'error' THEN 1 END) AS errors FROM events GROUP BY user_id")
def _(spark, d):
    return feeds.totals(table(spark, d, "events").select("user_id", "event_type", "value")).withColumn("total", F.round("total", 4))


@query("stm04_snapshot_cut", "SELECT min(last) AS cut FROM (SELECT user_id, max(event_id) AS last FROM events GROUP BY user_id)")
def _(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.max("event_id").alias("last")).agg(F.min("last").alias("cut"))


@query("stm05_micro_batches", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def _(spark, d):
    return feeds.drained(_feed(spark, d), "append").groupBy("event_type").agg(F.count("*").alias("n"))


@query("stm07_first_of_key", "SELECT count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events)")
def _(spark, d):
    return feeds.drained(feeds.first_of_step(_feed(spark, d), ["user_id", "event_type"]), "first").agg(F.count("*").alias("n"))


@query("stm08_circuit_breaker")
def _(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_id", millis("ts").alias("at"), (F.col("event_type") == "error").alias("failed"))
    return feeds.breaker(rows, 3, 3_600_000)


@query("stm09_change_feed", "SELECT event_id AS at, user_id AS k, CASE WHEN event_type = 'error' THEN 'deleted' ELSE 'put' END AS op FROM events")
def _(spark, d):
    return feeds.drained(_feed(spark, d).select(F.col("event_id").alias("at"), F.col("user_id").alias("k"), F.when(F.col("event_type") == "error", "deleted").otherwise("put").alias("op")), "changes").drop("batch")


#: Rows of a key so far, clicks in a row now, and most in a row.
CLICKS = projections.Projection(
    "clicks", 1, "user_id", "event_id", ("event_type",), "n bigint, now bigint, best bigint", "n bigint, now bigint, best bigint", (0, 0, 0),
    lambda s, r: (s[0] + 1, s[1] + 1 if r.event_type == "click" else 0, max(s[2], s[1] + 1 if r.event_type == "click" else 0)), lambda s: s,
)
CLICKS_SQL = "WITH e AS (SELECT user_id, event_type = 'click' AS hit, count(CASE WHEN event_type <> 'click' THEN 1 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS run FROM events), r AS (SELECT user_id, run, count(*) AS n, count(CASE WHEN hit THEN 1 END) AS hits FROM e GROUP BY user_id, run) SELECT user_id, CAST(sum(n) AS BIGINT) AS n, max_by(hits, run) AS now, max(hits) AS best FROM r GROUP BY user_id"


@query("ext03_projection_stream", CLICKS_SQL)
def _(spark, d):
    return projections.over_stream(_feed(spark, d), CLICKS, f"{shared_dir(spark)}/tarnwork/projection-{uuid.uuid4().hex}")


@query("ext03_projection_table", CLICKS_SQL)
def _(spark, d):
    return projections.over_table(table(spark, d, "events"), CLICKS)


@query("mem08_admission_stream", "SELECT DISTINCT user_id, event_type, CAST(ts AS DATE) AS day FROM events")
def _(spark, d):
    keyed = _feed(spark, d).select("user_id", "event_type", F.col("ts").cast("date").alias("day"), F.col("ts").cast("timestamp").alias("ts"))
    return feeds.drained(feeds.admitted(keyed, "ts", "400 days", ["user_id", "event_type", "day"]), "admitted").select("user_id", "event_type", "day")


#: Two versions of a file for each part; it calls the part of half its number, and then, if the number is a multiple of 7, that of a third.
REFRESH_SQL = """WITH RECURSIVE p AS (SELECT p_partkey AS k, 'src/m' || CASE WHEN p_partkey % 10 = 3 THEN (p_partkey - 1) || '_test' ELSE CAST(p_partkey AS VARCHAR) END || '.go' AS path, p_partkey % 10 = 3 AS is_test,
  CASE WHEN p_partkey % 11 = 5 THEN 'removed' WHEN p_partkey % 7 = 0 AND p_partkey // 2 <> p_partkey // 3 THEN 'modified' END AS status, CASE WHEN p_partkey % 7 = 0 THEN p_partkey // 3 ELSE p_partkey // 2 END AS callee FROM part),
up AS (SELECT k, k AS now, 0 AS hops FROM p WHERE status IS NULL OR status = 'modified'
  UNION ALL SELECT up.k, p.callee, hops + 1 FROM up JOIN p ON p.k = up.now WHERE p.status IS NULL AND p.callee <> p.k AND hops < 16),
hit AS (SELECT up.k, min(hops) AS hops FROM up JOIN p ON p.k = up.now WHERE p.status IS NOT NULL GROUP BY up.k),
dirty AS (SELECT k, hops FROM hit UNION ALL SELECT k, 0 FROM p WHERE status = 'removed')
SELECT 'file' AS kind, path AS a, coalesce(status, 'kept') AS b, hops AS n FROM p LEFT JOIN dirty USING (k)
UNION ALL SELECT 'edge', t.path, c.path, CASE WHEN c.path = 'src/m' || (t.k - 1) || '.go' THEN 90 ELSE 70 END FROM p t JOIN p c ON t.is_test AND NOT c.is_test AND coalesce(t.status, '') <> 'removed' AND coalesce(c.status, '') <> 'removed' AND contains(c.path, 'm' || (t.k - 1))"""


@query("stm12_refresh_stream", REFRESH_SQL)
def _(spark, d):
    k = F.col("p_partkey")
    number = lambda c: c.cast("bigint").cast("string")
    path = F.concat(F.lit("src/m"), F.when(k % 10 == 3, F.concat(number(k - 1), F.lit("_test"))).otherwise(number(k)), F.lit(".go"))
    source = lambda callee: F.concat(F.lit("package m\n\nfunc F"), number(k), F.lit("() {\n\tF"), number(F.floor(callee)), F.lit("()\n}\n"))
    parts = table(spark, d, "part")
    root = f"{shared_dir(spark)}/tarnwork/refresh-{uuid.uuid4().hex}"
    first = parts.select(path.alias("path"), source(k / 2).alias("content"), F.lit(1).cast("bigint").alias("at"))
    second = parts.where("p_partkey % 7 = 0 or p_partkey % 11 = 5").select(path.alias("path"), F.when(k % 11 != 5, source(k / 3)).alias("content"), F.lit(2).cast("bigint").alias("at"))
    index = refresh.Index(spark, root)
    for versions in (first, second):  # each is a new file of the stream
        versions.coalesce(1).write.mode("append").parquet(f"{root}/versions")
        index.follow(spark.readStream.schema(first.schema).parquet(f"{root}/versions"))
    now = index.part("files", refresh.FILES)
    last = now.groupBy("path").agg(F.max(F.when(F.col("batch") == 1, F.col("status"))).alias("status"))
    dirty = index.dirty().where("batch = 1").select("path", "hops")
    files = last.join(dirty, "path", "left").select(F.lit("file").alias("kind"), F.col("path").alias("a"), F.coalesce("status", F.lit("kept")).alias("b"), F.col("hops").alias("n"))
    return files.unionByName(index.edges().select(F.lit("edge").alias("kind"), F.col("test").alias("a"), F.col("code").alias("b"), F.round(100 * F.col("confidence")).cast("int").alias("n")))

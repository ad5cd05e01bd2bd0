"""The input tables, and session logs, chunks and graphs derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, columns and filters pushed down by Catalyst."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def millis(column: str):
    """Epoch milliseconds of a timestamp."""
    return F.unix_millis(F.col(column).cast("timestamp"))


def session_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session_id, seq, type, time, value): each user's events as a log with contiguous seq."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events")
    kinds = {"signup": "turn/start", "view": "step/start", "click": "assistant/chunk", "purchase": "assistant/message", "error": "tool/result"}
    kind = F.coalesce(*(F.when(F.col("event_type") == k, F.lit(v)) for k, v in kinds.items()))
    return e.select(F.col("user_id").alias("session_id"), (F.row_number().over(w) - 1).cast("bigint").alias("seq"), kind.alias("type"), millis("ts").alias("time"), "value", "event_id")


LOG_SQL = """log AS (
  SELECT user_id AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq,
    CASE event_type WHEN 'signup' THEN 'turn/start' WHEN 'view' THEN 'step/start' WHEN 'click' THEN 'assistant/chunk' WHEN 'purchase' THEN 'assistant/message' ELSE 'tool/result' END AS type,
    epoch_us(ts) // 1000 AS time, value, event_id
  FROM events)"""


def stepped_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The session log with the turn and step that each event belongs to."""
    w = Window.partitionBy("session_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    count = lambda kind: F.count(F.when(F.col("type") == kind, 1)).over(w)
    return session_log(spark, sf_dir).withColumns({"turn": count("turn/start"), "step": count("step/start")})


STEPPED_SQL = (
    LOG_SQL
    + """, stepped AS (
  SELECT *, count(CASE WHEN type = 'turn/start' THEN 1 END) OVER w AS turn, count(CASE WHEN type = 'step/start' THEN 1 END) OVER w AS step
  FROM log WINDOW w AS (PARTITION BY session_id ORDER BY seq ROWS UNBOUNDED PRECEDING))"""
)


def conversation_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session_id, seq, type, text): conversations as session logs."""
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), F.concat(F.col("role"), F.lit("/message")).alias("type"), "text")


CONVERSATION_SQL = "clog AS (SELECT conv_id AS session_id, turn AS seq, role || '/message' AS type, text FROM conversations)"


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, created_at, cwd, parent_session, live, persisted): orders stand in for session headers.

    The parent is the customer's order before; even keys are live, multiples of three persisted too.
    """
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), millis("o_orderdate").alias("created_at"),
        F.when(F.col("o_orderstatus") == "P", None).otherwise(F.concat(F.lit("/"), F.lower("o_orderstatus"))).alias("cwd"), F.lag("o_orderkey").over(w).alias("parent_session"),
        (F.col("o_orderkey") % 2 == 0).alias("live"), ((F.col("o_orderkey") % 2 == 1) | (F.col("o_orderkey") % 3 == 0)).alias("persisted"), F.col("o_custkey").alias("owner"), F.col("o_totalprice").alias("price"),
    )


SESSIONS_SQL = """sessions AS (
  SELECT o_orderkey AS id, epoch_ms(o_orderdate) AS created_at, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE '/' || lower(o_orderstatus) END AS cwd,
    lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS parent_session,
    o_orderkey % 2 = 0 AS live, (o_orderkey % 2 = 1 OR o_orderkey % 3 = 0) AS persisted, o_custkey AS owner, o_totalprice AS price
  FROM orders)"""


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(caller, callee): distinct edges between consecutive parts of an order."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    e = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("caller"), F.lead("l_partkey").over(w).alias("callee"))
    return e.where("callee is not null and caller <> callee").distinct()


CALLS_SQL = """calls AS (
  SELECT DISTINCT caller, callee FROM (SELECT l_partkey AS caller, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS callee FROM lineitem)
  WHERE callee IS NOT NULL AND caller <> callee)"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, path, content): pages as files, their URL's tail as the path."""
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("file_id"), F.regexp_replace("url", "^https?://|[?#].*$", "").alias("path"), F.col("html").alias("content"))


FILES_SQL = "files AS (SELECT page_id AS file_id, regexp_replace(url, '^https?://|[?#].*$', '', 'g') AS path, html AS content FROM pages)"

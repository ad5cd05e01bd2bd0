"""Preselection of files: seven layers whose scores add up."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnwork.functions.text import tokens
from tarnwork.operators import grams, retrieval
from tarnwork.storage import stored

#: Floor and scale of the layers that decay by rank.
DECAY = {"working-set": (2.0, 5.0), "recent": (1.2, 3.5), "pinned": (2.2, 4.0), "dirty-buffer": (1.5, 3.0)}
#: Weights of the other layers, and most files or symbols of a token.
SYMBOL_EXACT, SYMBOL_PART, PATH_TOKEN, FALLBACK = 2.0, 1.2, 1.0, 0.2
TOKENS, SHORTEST, PATHS, SYMBOLS = 8, 3, 20, 24
SUMMARIES, SUMMARIES_FROM = 80, 120


def decayed(lists: dict[str, DataFrame]) -> list[DataFrame]:
    """Hits of files in a request's own lists (query_id, path, rank), ranks from 0."""
    return [rows.select("query_id", "path", retrieval.rank_decay(F.col("rank"), DECAY[name][1], DECAY[name][0]).alias("score"), F.lit(name).alias("layer")) for name, rows in lists.items()]


def summary_hits(requests: DataFrame, summaries: DataFrame, limit: int) -> DataFrame:
    """Hits of full text search over summaries (path, text)."""
    most = min(limit, SUMMARIES) if limit <= SUMMARIES_FROM else SUMMARIES + (limit - SUMMARIES_FROM) // 3
    found = retrieval.ranked(retrieval.lexical(summaries.select(F.col("path").alias("doc_id"), "text"), requests.select("query_id", "text")), most)
    return found.select("query_id", F.col("doc_id").alias("path"), retrieval.summary_layer(F.col("score")).alias("score"), F.lit("fts-summary").alias("layer"))


def request_tokens(requests: DataFrame) -> DataFrame:
    """(query_id, k, token): the first tokens of three letters and more, repeated ones too."""
    long = F.slice(F.filter(tokens("text"), lambda t: F.length(t) >= SHORTEST), 1, TOKENS)
    return requests.select("query_id", F.posexplode(long).alias("k", "token"))


def token_hits(requests: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Hits of tokens inside paths and inside names of symbols (path, name), each by a gram index."""
    asked = stored(request_tokens(requests), "request-tokens")
    needles = asked.select(F.col("token").alias("needle"))
    paths = grams.contained_in(needles, files.select(F.col("path").alias("text_id"), F.lower("path").alias("text")))
    place = F.row_number().over(Window.partitionBy("needle").orderBy("text_id"))
    paths = paths.withColumn("place", place).where(F.col("place") <= PATHS).select(F.col("needle").alias("token"), F.col("text_id").alias("path"), F.lit(PATH_TOKEN).alias("score"))
    names = symbols.select(F.lower("name").alias("text_id"), F.lower("name").alias("text")).distinct()
    found = grams.contained_in(needles, names).select(F.col("needle").alias("token"), F.col("text_id").alias("lower"))
    found = found.join(symbols.select("path", "name", F.lower("name").alias("lower")), "lower")
    place = F.row_number().over(Window.partitionBy("token").orderBy("path", "name"))
    found = found.withColumn("place", place).where(F.col("place") <= SYMBOLS)
    names = found.select("token", "path", F.when(F.col("lower") == F.col("token"), SYMBOL_EXACT).otherwise(SYMBOL_PART).alias("score"))
    return asked.join(paths.unionByName(names), "token").select("query_id", "path", "score", F.lit("token-search").alias("layer"))


def preselect(requests: DataFrame, lists: dict[str, DataFrame], summaries: DataFrame, symbols: DataFrame, recent: DataFrame, limit: int) -> DataFrame:
    """(query_id, path, score, layers, place): each request's best files, with the layers that found them.

    ``requests`` is (query_id, text), ``summaries`` (path, text), ``symbols`` (path, name), ``recent`` (path, indexed_at).
    Requests that no layer answers get the files indexed last.  Equal texts are searched for once.
    """
    firsts = stored(requests.groupBy("text").agg(F.min("query_id").alias("query_id")), "request-texts")
    alike = stored(requests.alias("r").join(firsts.alias("f"), F.col("r.text").eqNullSafe(F.col("f.text"))).select("r.query_id", F.col("f.query_id").alias("first")), "equal-requests")
    found = stored(summary_hits(firsts, summaries, limit).unionByName(token_hits(firsts, summaries, symbols)), "text-hits")
    searched = found.withColumnRenamed("query_id", "first").join(alike, "first").select("query_id", "path", "score", "layer")
    hits = stored(reduce(DataFrame.unionByName, [*decayed(lists), searched]), "preselect-hits")
    last = recent.orderBy(F.desc("indexed_at"), "path").limit(limit).select("path", F.lit(FALLBACK).alias("score"), F.lit("fallback-indexed").alias("layer"))
    unanswered = requests.select("query_id").join(hits.select("query_id"), "query_id", "left_anti")
    rest = unanswered.join(F.broadcast(last))  # ``limit`` rows for each
    summed = hits.unionByName(rest).groupBy("query_id", F.replace("path", F.lit("\\"), F.lit("/")).alias("path"))
    summed = summed.agg(F.round(F.sum("score"), retrieval.DIGITS).alias("score"), F.array_join(F.sort_array(F.collect_set("layer")), ",").alias("layers"))
    return retrieval.top(summed, "score", limit, "path")

"""Graph context of search hits under one token budget for all its sections."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class Limits(NamedTuple):
    """Most hit symbols, callers and callees of each, tests, and the graph's per cent of the budget."""

    symbols: int
    callers: int
    callees: int
    tests: int
    percent: int


#: Limits by the number of files of a repository.
TIERS = ((500, Limits(3, 2, 2, 2, 20)), (5_000, Limits(5, 3, 3, 3, 25)), (50_000, Limits(7, 3, 3, 4, 25)), (None, Limits(8, 4, 4, 5, 30)))


def limits_for(n_files: int) -> Limits:
    return next(limits for below, limits in TIERS if below is None or n_files < below)


def node_cost(text: Column) -> Column:
    """Estimated tokens of a node: a quarter of its bytes, at least ten."""
    return F.greatest(F.floor(F.octet_length(text) / 4), F.lit(10)).cast("bigint")


def clipped(items: DataFrame) -> DataFrame:
    """The items that fit, of (query_id, budget, section, place, node, cost, ...), with the tokens ``used`` up to each.

    Items come by section and place.  A section ends at its first item that does not fit; what
    is left of the budget goes on to the next section.  A node that was tried before, in any
    section, is passed over; a null node is always tried.  A query has as many items as its
    limits allow, so one fold over an array of them does it, inside the plan and without Python.
    """
    names = [c for c in items.columns if c not in ("query_id", "budget", "section", "place")]
    listed = items.groupBy("query_id").agg(F.max("budget").alias("budget"), F.sort_array(F.collect_list(F.struct("section", "place", *names))).alias("items"))
    numbered = F.transform("items", lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.lit(-1).alias("stopped"), F.array().cast("array<string>").alias("tried"), F.array().cast("array<struct<i:int,used:bigint>>").alias("kept"))

    def step(s: Column, item: Column) -> Column:
        x, node = item["x"], item["x"]["node"].cast("string")
        passed = (x["section"] == s["stopped"]) | F.coalesce(F.array_contains(s["tried"], F.coalesce(node, F.lit(""))), F.lit(False))
        after = s["used"] + x["cost"]
        fits = ~passed & (after <= F.col("budget"))
        return F.struct(
            F.when(fits, after).otherwise(s["used"]).alias("used"),
            F.when(~passed & ~fits, x["section"]).otherwise(s["stopped"]).alias("stopped"),
            F.when(passed | node.isNull(), s["tried"]).otherwise(F.array_append(s["tried"], node)).alias("tried"),
            F.when(fits, F.array_append(s["kept"], F.struct(item["i"].alias("i"), after.alias("used")))).otherwise(s["kept"]).alias("kept"),
        )

    told = listed.withColumn("kept", F.aggregate(numbered, start, step, lambda s: s["kept"]))
    kept = F.transform("kept", lambda k: F.struct(F.get("items", k["i"]).alias("x"), k["used"].alias("used")))
    return told.select("query_id", F.explode(kept).alias("k")).select("query_id", "k.x.section", "k.x.place", *(F.col("k.x")[n].alias(n) for n in names), "k.used")


def _few(edges: DataFrame, seed: str, other: str, most: int) -> DataFrame:
    """(symbol, other, place): the first ``most`` neighbours of each symbol."""
    place = F.row_number().over(Window.partitionBy(seed).orderBy(other))
    return edges.select(F.col(seed).alias("symbol"), F.col(other).alias("other"), place.alias("place")).where(F.col("place") <= most)


def enrich(hits: DataFrame, edges: DataFrame, symbols: DataFrame, budgets: DataFrame, limits: Limits) -> DataFrame:
    """(query_id, section, place, node, text, cost, used): context nodes of each query's hits.

    ``hits`` is (query_id, symbol, rank) with ranks from 1, ``edges`` (caller, callee), ``symbols``
    (symbol, name, file, line, is_test), ``budgets`` (query_id, tokens).  Each hit symbol has a section of
    callers and one of callees; the tests of all hits are the last section.
    """
    chosen = hits.where(F.col("rank") <= limits.symbols)
    one = symbols.select("symbol", F.col("name").alias("name"))
    two = symbols.select(F.col("symbol").alias("other"), F.col("name").alias("other_name"), "file", "line")
    budget = budgets.select("query_id", F.floor(F.col("tokens") * limits.percent / 100).cast("bigint").alias("budget"))

    def section(kind: str, offset: int, near: DataFrame, arrow: tuple[str, str]) -> DataFrame:
        named = chosen.join(near, "symbol").join(one, "symbol").join(two, "other")
        text = F.concat(F.lit(f"{kind}: "), F.col(arrow[0]), F.lit(" → "), F.col(arrow[1]), F.lit(" ("), F.col("file"), F.lit(":"), F.col("line").cast("string"), F.lit(")"))
        return named.select("query_id", (2 * (F.col("rank") - 1) + offset).cast("int").alias("section"), "place", F.col("other").cast("string").alias("node"), text.alias("text"))

    callers = section("caller", 0, _few(edges, "callee", "caller", limits.callers), ("other_name", "name"))
    callees = section("callee", 1, _few(edges, "caller", "callee", limits.callees), ("name", "other_name"))
    tests = symbols.where("is_test").select(F.col("symbol").alias("caller"), F.col("file").alias("path"))
    paths = chosen.join(edges.join(tests, "caller").select(F.col("callee").alias("symbol"), "path").distinct(), "symbol").select("query_id", "path").distinct()
    placed = paths.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("path"))).where(F.col("place") <= limits.tests)
    tested = placed.select("query_id", F.lit(2 * limits.symbols).alias("section"), "place", F.lit(None).cast("string").alias("node"), F.concat(F.lit("test file: "), "path").alias("text"))
    every = callers.unionByName(callees).unionByName(tested).join(budget, "query_id")
    return clipped(every.withColumn("cost", node_cost(F.col("text"))))

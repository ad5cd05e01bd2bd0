"""Golden values and properties of single operators."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarnwork.functions import text as tx
from tarnwork.operators import folds, graph, log, predicates as p, retrieval as r, vectors as v
from tarnwork.sources import workspace
from tarnwork.storage import stored
from tarnwork.streaming import feeds


def test_fusion_of_one_list(spark):
    lane = r.ranked(spark.createDataFrame([(1, "a", 3.0), (1, "b", 2.0), (1, "c", 1.0)], "query_id int, doc_id string, score double"))
    got = {x["doc_id"]: x["part"] for x in lane.select("doc_id", (1 / (50 + F.col("rank"))).alias("part")).collect()}
    assert got == {"a": 1 / 51, "b": 1 / 52, "c": 1 / 53}


def test_overlap_and_tokens(spark):
    row = spark.createDataFrame([("getUserById order", "const user = getUserById(7)")], "q string, d string").select(tx.overlap(tx.query_tokens("q"), tx.tokens("d")).alias("o"), tx.tokens(F.lit("a_b 数据库系统设计与实现")).alias("t")).first()
    assert row["o"] == 0.5
    assert row["t"] == ["a_b", "数据库系统设计与", "实现"]


def test_expansion():
    assert tx.expand_query("getUserById order_total") == ["getuserbyid", "order_total", "get", "user", "by", "id", "order", "total"]


@pytest.mark.parametrize("text,at,limit,want", [("abcdefghij", 1, 5, "abcd…"), ("abcdefghij", 3, 5, "…bcd…"), ("abcdefghij", 3, 3, "…c…"), ("abc", 1, 5, "abc")])
def test_snippets(spark, text, at, limit, want):
    got = spark.range(1).select(tx.snippet(F.lit(text), F.lit(at), limit).alias("s")).first()["s"]
    assert got == want


def test_candidate_penalty_and_paths(spark):
    n = {x["n"]: x["c"] for x in spark.createDataFrame([(3,), (4,), (6,), (10,)], "n int").select("n", graph.penalised(F.lit(0.5), F.col("n")).alias("c")).collect()}
    assert n == {3: 0.5, 4: 0.375, 6: 0.25, 10: 0.15}
    rows = spark.createDataFrame([("src/pkg/module", "src/pkg/other", 2), ("src/a", "tests/b", 0)], "a string, b string, want int")
    assert all(x["got"] == x["want"] for x in rows.select("want", graph.common_segments(F.col("a"), F.col("b")).alias("got")).collect())


def test_severity(spark):
    got = [x[0] for x in spark.createDataFrame([(5,), (3,), (2,)], "n int").orderBy(F.desc("n")).select(graph.severity(F.col("n"))).collect()]
    assert got == ["high", "medium", "low"]


def test_text_filter(spark):
    rows = spark.createDataFrame([("Hello\n(AI)+",), ("hello ai",), ("café",)], "t string")
    assert [x[0] for x in rows.where(p.contains_text("t", "hello   (ai)+")).collect()] == ["Hello\n(AI)+"]
    assert rows.where(p.contains_text("t", "CAFÉ")).count() == 1
    with pytest.raises(ValueError):
        tx.text_filter("  ")


def test_clauses(spark):
    rows = spark.createDataFrame([("a", "/a", "p", True, False), ("b", None, None, False, True)], "id string, cwd string, parent string, live boolean, persisted boolean")
    assert [x["id"] for x in rows.where(p.every([p.one_of("id", ["a", "c"]), p.one_of("cwd", ["/a"]), p.available(["live"])])).collect()] == ["a"]
    assert [x["id"] for x in rows.where(p.one_of("cwd", [None])).collect()] == ["b"]
    assert rows.where(p.one_of("id", [])).count() == 0
    assert rows.where(p.available(["live", "persisted", "live"])).count() == 2
    with pytest.raises(p.FilterError, match="RANGE_REVERSED"):
        p.closed_range("id", 2, 1)


def test_surface(spark):
    rows = spark.createDataFrame([(1, 0, "append", None, None), (1, 1, None, None, None), (1, 2, "replace", 0, 0), (1, 3, None, None, None)], "session_id long, seq long, op string, start long, end long")
    assert [x["surface"] for x in folds.surface(rows).orderBy("seq").collect()] == ["shadowed", "log-only", "current", "log-only"]
    with pytest.raises(Exception, match="SURFACE_RANGE"):
        folds.surface(spark.createDataFrame([(1, 0, "replace", 0, 3)], "session_id long, seq long, op string, start long, end long")).collect()


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["x", "y"]), st.integers(-50, 50)), max_size=40))
def test_pack_and_unpack(spark, events):
    rows = [(1, i, kind, 1000 * i + gap, float(gap)) for i, (kind, gap) in enumerate(events)]
    frame = spark.createDataFrame(rows, "session_id long, seq long, type string, time long, value double")
    back = sorted(tuple(x) for x in log.unpacked(log.packed(frame, "x", least=1, most=7)).collect())
    assert back == sorted((s, q, t, val) for s, q, k, t, val in rows if k == "x")


def test_int8_round_trip(spark):
    e = spark.createDataFrame([(1, [0.5, -1.0, 0.25]), (2, [0.0, 0.0, 0.0])], "vec_id int, embedding array<float>")
    got = {x["vec_id"]: x for x in v.quantised_table(e).collect()}
    assert got[2]["scale"] == 1.0 and got[2]["q"] == [0, 0, 0]
    assert all(abs(q * got[1]["scale"] - x) <= got[1]["scale"] / 2 for q, x in zip(got[1]["q"], [0.5, -1.0, 0.25]))
    assert got[1]["q"][1] == -127


def test_strong_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 1), (7, 7)], "caller long, callee long")
    got = sorted(tuple(x) for x in graph.strong_components(edges, lambda t: stored(t, "t")).collect())
    assert got == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4)]


def tarjan(edges):
    """(node, least node of its component) of every node on a cycle."""
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
        out.setdefault(b, set())
    number, low, stack, on, found = {}, {}, [], set(), []

    def visit(v):
        number[v] = low[v] = len(number)
        stack.append(v)
        on.add(v)
        for w in out[v]:
            if w not in number:
                visit(w)
            if w in on:
                low[v] = min(low[v], low[w])
        if low[v] == number[v]:
            part = stack[stack.index(v) :]
            del stack[-len(part) :]
            on.difference_update(part)
            if len(part) > 1:
                found.extend((w, min(part)) for w in part)

    for v in out:
        if v not in number:
            visit(v)
    return sorted(found)


def test_strong_components_of_random_graph(spark):
    r = random.Random(4)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(75)]
    want = tarjan(edges)
    assert len({c for _, c in want}) > 1 or len(want) < 60
    got = graph.strong_components(spark.createDataFrame(edges, "caller long, callee long"), lambda t: stored(t, "t"))
    assert sorted(tuple(x) for x in got.collect()) == want != []


def test_strong_components_query_takes_all_edges(spark, data):
    from tarnwork.plans import catalog
    from tarnwork.sources.tables import calls

    got = catalog.queries()["grf16_strong_components"](spark, data)
    assert sorted(tuple(x) for x in got.collect()) == tarjan([tuple(x) for x in calls(spark, data).collect()])


def test_cursor():
    c = r.cursor([5, 1], {"a": [1, 2]}, 3)
    assert r.read_cursor(c, {"a": [2, 1]}, 3) == [5, 1]
    with pytest.raises(ValueError, match="CURSOR_STALE"):
        r.read_cursor(c, {"a": [1, 2]}, 4)
    with pytest.raises(ValueError, match="CURSOR_REQUEST"):
        r.read_cursor(c, {"a": [9]}, 3)


def test_ignore_rules(spark):
    rows = spark.createDataFrame([("a/b.log",), ("keep/b.log",), ("src/x.py",), ("build/x",)], "path string")
    assert sorted(x[0] for x in workspace.visible(rows, ["*.log", "!keep/*.log", "/build/"]).collect()) == ["keep/b.log", "src/x.py"]


def test_workspace_walk(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.txt").write_text("one\ntwo\n")
    (tmp_path / "b.bin").write_bytes(b"\0")
    assert workspace.walk(spark, str(tmp_path), [".txt"]).count() == 1
    assert [x["line"] for x in workspace.grep(spark, str(tmp_path / "d"), "tw", 5).collect()] == ["two"]


def test_circuit_breaker(spark):
    rows = spark.createDataFrame([(1, i, t, f) for i, (t, f) in enumerate([(0, True), (1, True), (2, True), (3, False), (100, True), (200, False), (201, True)])], "user_id long, event_id long, at long, failed boolean")
    got = [x["state"] for x in feeds.breaker(rows, 3, 50).orderBy("event_id").collect()]
    assert got == ["closed", "closed", "open", "open", "open", "closed", "closed"]


def test_stream_fold_equals_batch_fold(spark, data):
    from tarnwork.sources.tables import table

    batch = feeds.totals(table(spark, data, "events").select("user_id", "event_type", "value"))
    stream = feeds.drained(feeds.totals(feeds.feed(spark, f"{data}/events.parquet", table(spark, data, "events").schema)), "t", "update")
    a = {x["user_id"]: (x["n"], round(x["total"], 6), x["errors"]) for x in batch.collect()}
    b = {x["user_id"]: (x["n"], round(x["total"], 6), x["errors"]) for x in stream.groupBy("user_id").agg(F.max_by(F.struct("n", "total", "errors"), "batch").alias("s")).select("user_id", "s.*").collect()}
    assert a == b


def test_byte_prefix(spark):
    from tarnwork.functions.values import byte_prefix

    for text, limit, want in (("aé😀b", 3, "aé"), ("aé😀b", 6, "aé"), ("aé😀b", 7, "aé😀"), ("abc", 9, "abc"), ("😀", 2, "")):
        assert spark.range(1).select(byte_prefix(F.lit(text), limit).alias("p")).first()["p"] == want

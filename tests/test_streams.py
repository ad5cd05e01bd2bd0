"""Projections, admission and the refresh stream: streams equal tables, replays change nothing."""

import pathlib
import random

from pyspark.sql import functions as F

from tarnwork.sources import brace_symbols
from tarnwork.storage import shared_dir
from tarnwork.streaming import feeds, projections, refresh

SCHEMA = "user bigint, at bigint, kind string"


def streak(version, wanted):
    """How many rows of a kind came last in a row, and most in a row."""
    return projections.Projection(
        "streak", version, "user", "at", ("kind",), "n bigint, now bigint, best bigint", "n bigint, now bigint, best bigint", (0, 0, 0),
        lambda s, r: (s[0] + 1, s[1] + 1 if r.kind == wanted else 0, max(s[2], s[1] + 1 if r.kind == wanted else 0)), lambda s: s,
    )


def test_stream_equals_table_over_restarts_and_versions(spark, tmp_path):
    r = random.Random(1)
    rows = [(r.randrange(6), k, r.choice("ab")) for k in range(300)]
    source, root = str(tmp_path / "log"), f"{shared_dir(spark)}/projection"

    def add(part):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)

    def agree(p, part):
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        got = sorted(map(tuple, projections.over_stream(stream, p, root).collect()))
        assert got == sorted(map(tuple, projections.over_table(spark.createDataFrame(part, SCHEMA), p).collect()))

    add(rows[:100])
    agree(streak(1, "a"), rows[:100])
    add(rows[100:200])
    agree(streak(1, "a"), rows[:200])  # goes on from its checkpoint
    agree(streak(2, "b"), rows[:200])  # a new version reads the log from its beginning
    add(rows[200:])
    agree(streak(2, "b"), rows)
    agree(streak(1, "a"), rows)


def test_admission_within_the_watermark(spark, tmp_path):
    source = str(tmp_path / "events")
    rows = [(k % 4, f"2024-01-0{1 + k // 20} 00:00:{k % 60:02d}", "x") for k in range(60)]
    spark.createDataFrame(rows, "user bigint, ts string, kind string").selectExpr("user", "to_timestamp(ts) ts", "kind").coalesce(1).write.parquet(source)
    stream = spark.readStream.schema("user bigint, ts timestamp, kind string").parquet(source)
    got = feeds.drained(feeds.admitted(stream, "ts", "2 days", ["user", "kind"]), "admitted").collect()
    assert sorted(x["user"] for x in got) == [0, 1, 2, 3]


GO = "package a\n\nfunc {name}() {{\n\t{call}()\n}}\n"


def versions(spark, rows):
    return spark.createDataFrame(rows, "path string, content string, at bigint")


def state(index):
    return [sorted(map(tuple, x.collect())) for x in (index.files(), index.symbols().select("path", "kind", "name", "line", "batch"), index.edges(), index.dirty())]


def test_refresh_follows_versions_and_replays_change_nothing(spark, tmp_path):
    source, root = str(tmp_path / "versions"), f"{shared_dir(spark)}/index"
    index = refresh.Index(spark, root)
    first = [("src/a.go", GO.format(name="A", call="B"), 1), ("src/b.go", GO.format(name="B", call="C"), 1), ("src/c.go", GO.format(name="C", call="nothing"), 1), ("src/a_test.go", GO.format(name="TestA", call="A"), 1), ("notes.txt", "x", 1)]
    second = [("src/c.go", GO.format(name="C", call="D"), 2), ("src/c.go", "package a\n", 1), ("src/b.go", first[1][1], 2), ("src/new_test.go", GO.format(name="N", call="Z"), 2), ("notes.txt", None, 2), ("gone.go", None, 2)]
    follow = lambda: index.follow(spark.readStream.schema("path string, content string, at bigint").option("maxFilesPerTrigger", 1).parquet(source))
    versions(spark, first).coalesce(1).write.parquet(source)
    follow()
    assert {(x["path"], x["status"]) for x in index.part("files", refresh.FILES).collect()} == {(p, "added") for p, _, _ in first}
    assert {(x["test"], x["code"], x["reason"]) for x in index.edges().collect()} == {("src/a_test.go", "src/a.go", "same-basename")}
    versions(spark, second).coalesce(1).write.mode("append").parquet(source)
    follow()
    now = {x["path"]: x["status"] for x in index.part("files", refresh.FILES).where("batch = 1").collect()}
    assert now == {"src/c.go": "modified", "src/new_test.go": "added", "notes.txt": "removed"}
    assert {x["path"] for x in index.files().collect()} == {"src/a.go", "src/b.go", "src/c.go", "src/a_test.go", "src/new_test.go"}
    names = {x["path"]: {y["name"] for y in index.symbols().where(F.col("path") == x["path"]).collect()} for x in index.files().collect()}
    assert names == {p: {y["name"] for y in brace_symbols.go(t)} for p, t in [(a, b) for a, b, _ in first if a.endswith(".go") and a != "src/c.go"] + [(second[0][0], second[0][1]), (second[3][0], second[3][1])]}
    # c changed; b calls it, a calls b, a's test calls a
    assert {(x["path"], x["hops"]) for x in index.dirty().where("batch = 1").collect()} == {("src/c.go", 0), ("src/new_test.go", 0), ("notes.txt", 0), ("src/b.go", 1), ("src/a.go", 2), ("src/a_test.go", 3)}
    before = state(index)
    for number, part in ((1, second), (0, first), (1, second)):
        index.apply(versions(spark, part), number)
    assert state(index) == before
    index.part("ledger", refresh.LEDGER).count()
    # a batch that failed before its entry in the ledger is not seen
    index.write(versions(spark, [("half.go", "x", 3)]).select("path", F.lit("d").alias("digest"), F.lit(False).alias("removed"), F.lit("added").alias("status")), "files", 2)
    assert state(index) == before


def test_a_batch_leaves_no_scratch_tables(spark):
    root, shared = f"{shared_dir(spark)}/index-alone", pathlib.Path(shared_dir(spark).removeprefix("file://")) / "tarnwork"
    before = set(shared.glob("*")) if shared.is_dir() else set()
    index = refresh.Index(spark, root)
    index.apply(versions(spark, [("src/a.go", GO.format(name="A", call="B"), 1), ("src/a_test.go", GO.format(name="TestA", call="A"), 1)]), 0)
    assert set(shared.glob("*")) == before and index.edges().count() == 1 and index.dirty().count() == 2

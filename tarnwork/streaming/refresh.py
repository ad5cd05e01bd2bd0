"""An index of files that follows a stream of their versions: difference, parse, write, test edges, dirty files.

Every batch writes its part of the index under its number and then enters itself in a ledger; what is
read are the parts of batches in the ledger.  A batch that comes again, whole or after a failure
half way, is computed from the batches before it and overwrites only its own part, so it changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwork.operators import graph, resolver
from tarnwork.sources import brace_symbols
from tarnwork.storage import released_shuffles, scratch, stored

FILES = "path string, digest string, removed boolean, status string, batch int"
SYMBOLS = f"{brace_symbols.SCHEMA}, batch int"
EDGES = "test string, code string, reason string, confidence double, batch int"
DIRTY = "path string, hops int, batch int"
LEDGER = "number int, batch int"
#: How far changes reach along calls.
ROUNDS = 16


class Index:
    """The index under a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def part(self, kind: str, schema: str, below: int | None = None) -> DataFrame:
        """Rows of one kind from the batches in the ledger, those below a number only."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{kind}")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(f"{self.root}/{kind}")
        if kind == "ledger":
            return rows
        rows = rows.join(F.broadcast(self.part("ledger", LEDGER).select("batch")), "batch", "left_semi")  # a number a batch
        return rows if below is None else rows.where(F.col("batch") < below)

    def write(self, rows: DataFrame, kind: str, number: int) -> None:
        with released_shuffles(rows.sparkSession):
            rows.drop("batch").write.mode("overwrite").parquet(f"{self.root}/{kind}/batch={number}")

    def files(self, below: int | None = None) -> DataFrame:
        """(path, digest, batch) of the files that are there: the last version of each, unless it was removed."""
        last = self.part("files", FILES, below).groupBy("path").agg(F.max_by(F.struct("digest", "removed", "batch"), "batch").alias("v"))
        return last.where("not v.removed").select("path", "v.digest", "v.batch")

    def symbols(self, below: int | None = None) -> DataFrame:
        """The symbols of the last version of every file."""
        return self.part("symbols", SYMBOLS, below).join(self.files(below).select("path", "batch"), ["path", "batch"])

    def edges(self, below: int | None = None) -> DataFrame:
        """Test edges between files that are there, each as the last batch that touched one of them tells."""
        there = self.files(below)  # with the last batch that touched each
        told = self.part("edges", EDGES, below)
        for side in ("test", "code"):
            told = told.join(there.select(F.col("path").alias(side), F.col("batch").alias(f"{side}_last")), side)
        return told.where(F.col("batch") == F.greatest("test_last", "code_last")).select("test", "code", "reason", "confidence")

    def apply(self, batch: DataFrame, number: int) -> None:
        """Takes in versions (path, content, at) of files; null content removes a file."""
        with scratch(batch.sparkSession), released_shuffles(batch.sparkSession):
            self._apply(batch, number)

    def _apply(self, batch: DataFrame, number: int) -> None:
        newest = batch.groupBy("path").agg(F.max_by(F.struct("content"), "at").alias("v")).select("path", "v.content")
        now = newest.withColumn("digest", F.sha2("content", 256))
        known = self.files(number).select("path", F.col("digest").alias("old"))
        met = now.join(known, "path", "left")
        status = F.when(F.col("content").isNull(), F.when(F.col("old").isNotNull(), "removed")).when(F.col("old").isNull(), "added").when(F.col("old") != F.col("digest"), "modified")
        changed = stored(met.withColumn("status", status).where("status is not null"), "refresh-changed")
        self.write(changed.select("path", "digest", (F.col("status") == "removed").alias("removed"), "status"), "files", number)
        fresh = stored(brace_symbols.symbols(changed.where("content is not null").select("path", "content")), "refresh-symbols")
        self.write(fresh, "symbols", number)
        # all files as they are after this batch
        kept = self.files(number).select("path").join(changed.select("path"), "path", "left_anti")
        added = changed.where("status <> 'removed'").select("path")
        is_test = F.col("path").rlike(r"(^|/)tests?/|_test\.[a-z]+$|Test\.java$")
        of = lambda rows, tests: rows.where(is_test if tests else ~is_test)
        edges = resolver.test_edges(of(added, True), of(kept.unionByName(added), False)).unionByName(resolver.test_edges(of(kept, True), of(added, False)))
        self.write(edges, "edges", number)
        # whoever calls a name that a changed file declares, before or after, and so on
        before = self.symbols(number).where("kind not like '%call' and kind <> 'import'")
        every = before.join(changed.select("path"), "path", "left_anti").select("path", "kind", "name").unionByName(fresh.select("path", "kind", "name"))
        calls = self.symbols(number).join(changed.select("path"), "path", "left_anti").select("path", "kind", "name").unionByName(fresh.select("path", "kind", "name")).where("kind like '%call'")
        declared = every.where("kind not like '%call' and kind <> 'import'").select(F.col("path").alias("callee"), "name").unionByName(before.join(changed.select("path"), "path", "left_semi").select(F.col("path").alias("callee"), "name")).distinct()
        links = stored(calls.select(F.col("path").alias("caller"), "name").distinct().join(declared, "name").select("caller", "callee").where("caller <> callee").distinct(), "refresh-calls")
        dirty = graph.dirty(links, changed.select(F.col("path").alias("node")), ROUNDS, 1 << 60, lambda t: stored(t, "refresh-dirty"))
        self.write(dirty.select(F.col("node").alias("path"), F.col("round").alias("hops")), "dirty", number)
        self.write(self.spark.createDataFrame([(number,)], "number int"), "ledger", number)

    def dirty(self) -> DataFrame:
        return self.part("dirty", DIRTY)

    def follow(self, stream: DataFrame) -> None:
        """Takes in all versions that a stream (path, content, at) has now; a later call goes on from there."""
        run = stream.writeStream.foreachBatch(self.apply).option("checkpointLocation", f"{self.root}/checkpoint").trigger(availableNow=True).start()
        run.awaitTermination()

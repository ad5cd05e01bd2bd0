"""Structured Streaming over append-only logs.

The readers are file sources; runs use ``availableNow`` and a checkpoint in the shared folder,
so a rerun after a failure replays the same batches and sinks are idempotent by batch id.
"""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tarnwork.storage import shared_dir


def feed(spark: SparkSession, path: str, schema) -> DataFrame:
    """A Parquet folder or file as a stream, new files in later batches."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", 8)
    folder, _, name = path.rpartition("/")
    if any(f.endswith(f"/{name}") for f in spark.read.schema(schema).parquet(path).inputFiles()):  # one file: its folder, and only that name
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def drained(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there now, and reads what it wrote.

    Every batch is written under its id, overwriting an earlier try; ``update`` and ``complete``
    results are reduced to each batch's rows by the caller.
    """
    spark = stream.sparkSession
    root = f"{shared_dir(spark)}/tarnwork/{name}-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{root}/data/batch={number}")

    q = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    schema = StructType([*stream.schema.fields, StructField("batch", IntegerType())])
    return spark.read.schema(schema).parquet(f"{root}/data")


def first_of_step(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Only the first event of each key."""
    return stream.dropDuplicates(keys)


def admitted(stream: DataFrame, time: str, late: str, keys: list[str]) -> DataFrame:
    """The first row of each key; Spark forgets a key once the watermark has left it behind by ``late``."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, late: str, width: str) -> DataFrame:
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def bursts(stream: DataFrame, late: str, gap: str) -> DataFrame:
    """Sessions of events of a key that follow each other within a gap: debounced invalidation."""
    return stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))


def totals(rows: DataFrame) -> DataFrame:
    """(user_id, n, total, errors): one plan for a table and, drained in mode update, for a stream.

    Spark keeps the state of a stream; every batch gives the new state of the users that it names.
    """
    return rows.groupBy("user_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.count_if(F.col("event_type") == "error").alias("errors"))


def breaker(rows: DataFrame, threshold: int, cooldown_ms: int) -> DataFrame:
    """(user_id, at, state): a circuit breaker's state after every event of a key, folded in order."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["at", "event_id"])
        state, failures, opened, out = "closed", 0, 0, []
        for at, failed in zip(pdf["at"], pdf["failed"], strict=True):
            if state == "open" and at - opened >= cooldown_ms:
                state = "half-open"
            if state == "half-open":
                state, failures = ("open", threshold) if failed else ("closed", 0)
                opened = at if failed else opened
            elif state == "closed":
                failures = failures + 1 if failed else 0
                if failures >= threshold:
                    state, opened = "open", at
            out.append(state)
        return pd.DataFrame({"user_id": pdf["user_id"], "event_id": pdf["event_id"], "state": out})

    return rows.groupBy("user_id").applyInPandas(fold, "user_id bigint, event_id bigint, state string")

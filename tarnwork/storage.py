"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import contextlib
import contextvars
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset on a local master (tests) a temporary folder, set there."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tarnwork-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


@contextlib.contextmanager
def released_shuffles(spark: SparkSession) -> Iterator[None]:
    """Inside this block Spark drops the shuffle files of a query once it has ended."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


#: Paths of the tables stored in the innermost ``scratch`` block.
_SCOPE: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("stored in the innermost scratch block", default=None)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet and read again: short lineage, and whole after lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tarnwork/{name}-{uuid.uuid4().hex}"
    if (inside := _SCOPE.get()) is not None:
        inside.append(path)
    with released_shuffles(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables stored in this block are deleted at its end, so nothing lazy may leave it."""
    inside: list[str] = []
    token = _SCOPE.set(inside)
    try:
        yield
    finally:
        _SCOPE.reset(token)
        for path in map(spark._jvm.org.apache.hadoop.fs.Path, inside):
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

"""Reading tables, shared storage and row-wise Arrow helpers."""

from __future__ import annotations

import contextlib
import contextvars
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word characters are all but these six ASCII space characters.
SPACES = " \t\n\x0b\x0c\r"
#: Arrow batches to Python: setting, Spark's default, and what texts of any length need instead.
BATCH_LIMITS = (("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "1000"),)
#: The same as a regular expression.
SPACE_RUN = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    The cluster names it in ``spark.checkpoint.dir``.  Where that is unset and the session runs
    on this machine alone (local tests) a temporary folder is made once and set as the
    checkpoint folder of the session; on a cluster an unset folder is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tarnwork-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


@contextlib.contextmanager
def released_shuffles(spark: SparkSession):
    """Inside this block Spark drops the shuffle files of a query once it has ended."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again.

    This cuts the lineage, survives lost executors, and gives Catalyst the true size.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tarnwork/{name}-{uuid.uuid4().hex}"
    with released_shuffles(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_path = path
    if (inside := _SCOPE.get()) is not None:
        inside.append(out)
    return out


_SCOPE: contextvars.ContextVar[list[DataFrame] | None] = contextvars.ContextVar("tables stored in the innermost scratch block", default=None)


@contextlib.contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Stored tables of this block are deleted at its end, but those given to the yielded function.

    Only these may be read by what the block returns.
    """
    outside, inside, kept = _SCOPE.get(), [], []
    token = _SCOPE.set(inside)

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df)
        return df

    try:
        yield keep
    finally:
        _SCOPE.reset(token)
        discard(*(x for x in inside if all(x is not y for y in kept)))
        if outside is not None:
            outside += kept


#: Most rows of a stored table of a few numbers that is sent to all executors; larger ones are shuffled.
BROADCAST_ROWS = 1 << 20


def small_side(df: DataFrame) -> DataFrame:
    """A stored table of a few numbers a row, to be broadcast if it has few rows, else as it is."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def discard(*tables: DataFrame) -> None:
    """Deletes stored tables that no result needs any more."""
    for df in tables:
        jvm, spark = df.sparkSession._jvm, df.sparkSession
        path = jvm.org.apache.hadoop.fs.Path(df.stored_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free_name(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have yet, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, a null text as an empty one; other columns never clash."""
    return docs.select(F.col(id_col).alias(id_col), F.coalesce(F.col(text_col), F.lit("")).alias(text_col))


def id_type(docs: DataFrame, id_col: str) -> str:
    return docs.schema[id_col].dataType.simpleString()


def slices(batch: pa.RecordBatch, size_col: str | None, piece_bytes: int) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about ``piece_bytes`` bytes (or list members) of ``size_col``."""
    import pyarrow.compute  # noqa: F401

    if size_col is None:
        yield batch
        return
    column = batch.column(size_col)
    length = pa.compute.list_value_length if pa.types.is_list(column.type) else pa.compute.binary_length
    sizes = length(column).fill_null(0).to_pylist()
    first = total = 0
    for k, size in enumerate(sizes):
        if total and total + size > piece_bytes:
            yield batch.slice(first, k - first)
            first, total = k, 0
        total += size
    if first < len(sizes):
        yield batch.slice(first)


def small_batches(spark: SparkSession) -> None:
    """Fewer rows in an Arrow batch than Spark's default, as texts may be long.

    The setting holds for the session from here on, because plans read it only when they run;
    a value that the user has chosen stays.
    """
    for key, usual, most in BATCH_LIMITS:
        if spark.conf.get(key, None) in (None, usual):
            spark.conf.set(key, most)


def give_back() -> None:
    """Freed memory goes back to the system, as idle workers are kept and many share a machine."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim is not None:
        trim(0)


def map_slices(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch], schema, size_col: str | None = None, piece_bytes: int = 4 << 20) -> DataFrame:
    """``mapInArrow`` of ``work`` over slices of batches.

    Slicing bounds the memory of a task by the piece and the longest single row, not by the batch.
    """
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, size_col, piece_bytes):
                yield work(part)
            del batch
            give_back()

    return df.mapInArrow(run, schema)


def map_batches(df: DataFrame, work: Callable[[pa.RecordBatch], dict], schema: str, *, piece_bytes: int = 4 << 20, size_col: str | None = None) -> DataFrame:
    """The same for a ``work`` that returns output columns by name."""
    names = [x.name for x in df.sparkSession.createDataFrame([], schema).schema]

    def made(part: pa.RecordBatch) -> pa.RecordBatch:
        out = work(part)
        return pa.RecordBatch.from_arrays([x if isinstance(x := out[n], pa.Array) else pa.array(x) for n in names], names)

    return map_slices(df, made, schema, size_col, piece_bytes)

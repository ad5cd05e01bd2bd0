"""Token counts with a digest cache.

Counts are stored by the digest of the normalised content and the digest of the tokenizer's
version.  A run joins its documents' digests to the store, encodes each distinct missing
content once, and appends the new counts; copies of a text, in this run or a later one, are
never encoded again.

Edge cases: a null text counts as an empty one (0 tokens); rows that repeat, ids included,
each get their count, as do rows with a null id; an empty table appends nothing; a text of any
length is encoded whole, in a slice of its own; other columns are dropped at once, whatever
their names; the store may be absent, and may hold counts of other tokenizers and versions.
"""

from __future__ import annotations

import hashlib
import os
from functools import lru_cache
from importlib.metadata import version

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwork.llm.common import map_batches, released_shuffles, stored, texts

STORE_SCHEMA = "content string, n_tokens bigint, tokenizer string"


def tokenizer_digest(path: str) -> str:
    """Digest of the vocabulary file and of the library that reads it."""
    library = "tokenizers" if path.endswith(".json") else "sentencepiece"
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + f"{library} {version(library)}".encode()).hexdigest()


@lru_cache(maxsize=4)
def _counter(path: str):
    if path.endswith(".json"):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; each more thread keeps memory of its own
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        return lambda rows: [len(x) for x in tokenizer.encode_batch_fast(rows, add_special_tokens=False)]
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda rows: [len(x) for x in library.encode(rows, num_threads=1)]


def count_tokens(contents: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """(content, n_tokens) of a table (content, text), each row encoded once."""

    def work(batch: pa.RecordBatch) -> dict:
        return {"content": batch.column(0), "n_tokens": pa.array(_counter(path)(batch.column(1).to_pylist()), pa.int64())}

    return map_batches(contents.select("content", text_col), work, "content string, n_tokens bigint", size_col=text_col, piece_bytes=1 << 17)


def read_store(docs: DataFrame, store: str) -> DataFrame:
    """The stored counts; a store that is not there yet is empty."""
    spark = docs.sparkSession
    try:
        return spark.read.schema(STORE_SCHEMA).parquet(store)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], STORE_SCHEMA)


def cached_counts(docs: DataFrame, path: str, store: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, content, n_bytes, n_tokens) of every row; ``store`` gains the missing counts.

    The byte-level tokenizers here have no normaliser, so the normalised content is the
    UTF-8 text itself.  A text that a third of all rows share is reduced within each task
    before the shuffle, and the final join carries digests only.
    """
    rows = texts(docs, id_col, text_col).withColumn("content", F.sha2(F.col(text_col), 256))
    kind = tokenizer_digest(path)
    known = read_store(docs, store).where(F.col("tokenizer") == kind).select("content", "n_tokens")
    distinct = rows.groupBy("content").agg(F.first(text_col).alias(text_col))
    missing = distinct.join(known, "content", "left_anti")
    with released_shuffles(docs.sparkSession):
        count_tokens(missing, path, text_col).withColumn("tokenizer", F.lit(kind)).write.mode("append").parquet(store)
    counts = read_store(docs, store).where(F.col("tokenizer") == kind).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))
    counts = stored(counts, "token-counts")  # as a table of its own, so that Spark may split a hot digest's side of the join
    return rows.select(id_col, "content", F.octet_length(text_col).cast("bigint").alias("n_bytes")).join(counts, "content", "left").select(id_col, "content", "n_bytes", "n_tokens")

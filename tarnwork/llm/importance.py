"""Importance resampling towards a target distribution, in two Arrow passes.

Features are the runs of one and two consecutive words, hashed into ``BUCKETS`` buckets.  The
first pass counts them: each partition adds up one vector with ``np.bincount``, and
``treeReduce`` merges the vectors, so that neither the driver nor a task holds more than a few
of them.  The vectors of the corpus and of the target give each bucket a gain.  The second
pass gathers the gains, which have a fixed size, sums them by document with ``np.bincount``
weights, and adds Gumbel noise from the id.  The documents with the highest scores are drawn.

Ranks come without one task for all rows: scores are whole numbers of a narrow range, so the
rows above each score are known from a histogram, and only rows of one score are ordered
together.  The noise spreads even equal texts over thousands of scores.

Edge cases: null and empty texts, and texts without words, have no features and weight 0;
texts of any length are read whole, words of any length hashed whole; equal scores go to the
smaller id, nulls last, and rows that repeat, ids included, are separate documents with
neighbouring ranks; null ids share one noise, that of the text ``7:``; an empty corpus gives
an empty result, an empty target counts nothing; other columns are dropped at once, whatever
their names.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnwork.llm import fingerprints as fp
from tarnwork.llm import words as w
from tarnwork.llm.common import id_type, map_batches, slices, small_batches, small_side, stored, texts

BUCKETS = 10_000
SEED = 7
MIN_WORDS = 20
PERCENT = 25
#: Vectors are merged in so many steps, so that the driver gets about the cube root of their number.
DEPTH = 3
#: Bytes of a word that are hashed for all words at once; what is left of longer ones goes one by one.
TOGETHER = 48
PIECE_BYTES = 2 << 20
_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_ALL = np.uint32(0xFFFFFFFF)


@lru_cache(maxsize=1)
def crc_table() -> np.ndarray:
    """The 256 steps of CRC-32, by its rule."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & np.uint32(1), np.uint32(0xEDB88320) ^ (c >> np.uint32(1)), c >> np.uint32(1))
    return c


def crc_states(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, states: np.ndarray) -> np.ndarray:
    """CRC registers after the bytes [start, end), from the registers before them."""
    table, sizes = crc_table(), ends - starts
    order = np.argsort(-np.minimum(sizes, TOGETHER), kind="stable")
    at, reg = starts[order], states[order]
    longer = np.searchsorted(-sizes[order].clip(max=TOGETHER), -np.arange(1, TOGETHER + 1), side="right")  # words with more than j bytes
    for j in range(TOGETHER):
        m = longer[j]
        if not m:
            break
        part = reg[:m]
        reg[:m] = table[(part ^ data[at[:m] + j]) & np.uint32(0xFF)] ^ (part >> np.uint32(8))
    out = np.empty_like(reg)
    out[order] = reg
    for i in np.flatnonzero(sizes > TOGETHER):
        out[i] = zlib.crc32(data[starts[i] + TOGETHER : ends[i]], int(out[i] ^ _ALL)) ^ 0xFFFFFFFF
    return out


def feature_buckets(data: np.ndarray, offsets: np.ndarray, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and row of every feature of all rows, and each row's number of words."""
    data = w.LOWER[data]
    starts, ends, row = w.edges(_WORD[data], offsets)
    one = crc_states(data, starts, ends, np.full(len(starts), _ALL, np.uint32))
    pair = np.flatnonzero(row[1:] == row[:-1])
    spaced = crc_table()[(one[pair] ^ np.uint32(0x20)) & np.uint32(0xFF)] ^ (one[pair] >> np.uint32(8))
    two = crc_states(data, starts[pair + 1], ends[pair + 1], spaced)
    hashed = (np.concatenate((one, two)) ^ _ALL) % np.uint32(buckets)
    return hashed.astype(np.int64), np.concatenate((row, row[pair])), np.bincount(row, minlength=len(offsets) - 1)


def bucket_counts(docs: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts each bucket has: the first pass."""
    small_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in slices(batch, text_col, PIECE_BYTES):
                total += np.bincount(feature_buckets(*fp.buffer_of(part.column(0)), buckets)[0], minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["counts"])

    vectors = docs.select(F.col(text_col).alias(text_col)).mapInArrow(count, "counts binary").rdd.map(lambda r: np.frombuffer(r[0], np.int64))
    return vectors.treeReduce(lambda a, b: a + b, DEPTH) if vectors.getNumPartitions() else np.zeros(buckets, np.int64)


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Each bucket's gain: the smoothed log ratio of target to corpus, in thousandths, rounded down."""
    n, s, t = len(corpus), int(corpus.sum()), int(target.sum())
    ratio = lambda a, b: math.log((b + 1.0) * (s + n) / ((a + 1.0) * (t + n)))
    return np.array([math.floor(1000 * ratio(int(a), int(b))) for a, b in zip(corpus, target, strict=True)], np.int64)


def weighted(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_features, weight) of every row: the second pass."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def work(batch: pa.RecordBatch) -> dict:
        gain = shared.value
        bucket, row, words = feature_buckets(*fp.buffer_of(batch.column(1)), len(gain))
        n = np.bincount(row, minlength=len(words))
        total = np.bincount(row, weights=gain[bucket], minlength=len(words)).astype(np.int64)  # exact: whole numbers
        return {id_col: batch.column(0), "n_words": words, "n_features": n, "weight": total // np.maximum(n, 1)}

    return map_batches(texts(docs, id_col, text_col), work, f"{id_col} {id_type(docs, id_col)}, n_words bigint, n_features bigint, weight bigint", size_col=text_col, piece_bytes=PIECE_BYTES)


def noise(id_col: str, seed: int = SEED):
    """Gumbel noise in thousandths, from the digest of seed and id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))


def ranked(scored: DataFrame, id_col: str, eligible, percent: int) -> DataFrame:
    """``scored``, a stored table, with the rank of the drawn rows, null for others."""
    by_score = scored.where(eligible).groupBy("score").agg(F.count("*").alias("rows"))
    upto = Window.orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, 0)  # a row for each whole score
    steps = stored(by_score.withColumn("upto", F.sum("rows").over(upto)), "resample-scores")
    n = steps.agg(F.coalesce(F.max("upto"), F.lit(0))).first()[0]
    drawn = percent * n // 100
    wanted = steps.where(F.col("upto") - F.col("rows") < drawn).select(F.col("score").alias("s"), (F.col("upto") - F.col("rows")).alias("above"))
    cut = wanted.agg(F.min("s")).first()[0]
    taken = eligible & (F.col("score") >= cut) if cut is not None else F.lit(False)
    order = Window.partitionBy("score").orderBy(F.col(id_col).asc_nulls_last(), "n_features", "weight")
    top = scored.where(taken).withColumn("place", F.row_number().over(order)).join(small_side(wanted), F.col("score") == F.col("s"))
    place = (F.col("above") + F.col("place")).cast("bigint")
    top = top.select(*scored.columns, F.when(place <= drawn, place).alias("rank"))
    return top.unionByName(scored.where(~taken).withColumn("rank", F.lit(None).cast("bigint")))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """(id, n_features, weight, score, rank) of every row of ``docs``; ``target`` has a column ``text_col``."""
    gain = gains(bucket_counts(docs, text_col), bucket_counts(target, text_col))
    rows = weighted(docs, gain, id_col, text_col).withColumn("score", F.col("weight") + noise(id_col))
    out = ranked(stored(rows, "resample-scored"), id_col, F.col("n_words") >= MIN_WORDS, percent)
    return out.select(id_col, "n_features", "weight", "score", "rank")

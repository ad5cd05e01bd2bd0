"""Phrase collocations by hashed passes (PCY and DHP) with Apriori pruning.

Pass k reads the texts, counts the candidate phrases of k words exactly, and meanwhile counts the
phrases of k + 1 words in hash buckets.  A phrase of k words is a candidate if the two phrases
of k - 1 words inside it are frequent and its bucket is.  Both tests are bitmaps of
``2 ** BITS`` bits, packed into 2 MB each whatever the corpus, which go to all executors; they
never miss a frequent phrase, and what they let through is counted exactly.  In the same pass only those longer phrases
enter a bucket whose two parts passed the tests.

A task's buckets are one vector of counts up to the least that is frequent: sums of such counts reach it exactly
if the true count does.  Vectors are cut into chunks, compressed, and merged chunk by chunk.
Exact counts are added up inside a slice, then by Spark before and after the shuffle, on the
phrases themselves, so a frequent word is no hot key.

Every part of a frequent phrase is frequent, so the counts of all parts are at hand: a cut
after k words scores floor(2000000 a / (l + r)), in decimals.  Candidates that lie in a longer
one nearly as frequent are dropped.  The best of each language are taken from the best of
``SLOTS`` shares of it.

Edge cases: null and empty texts have no words; a null language is ``und``, like the language of
that name; words of any length and texts of any length are read whole; no phrase crosses a
separator or a row; rows that repeat count again; ties are told apart by the phrase; ids are
not read; an empty table, or one without frequent phrases, gives an empty result; other
columns are dropped at once, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnwork.llm import fingerprints as fp
from tarnwork.llm import words as w
from tarnwork.llm.common import scratch, slices, small_batches, stored

LONGEST = 4
LEAST = 30
#: A candidate inside a longer one goes if the longer one has at least this percentage of its occurrences.
NESTED_PERCENT = 80
SCALE = 2_000_000
TOP = 2000
UNKNOWN = "und"
#: Buckets of a pass: 2 ** BITS, in so many chunks.
BITS = 24
CHUNKS = 256
SLOTS = 64
PIECE_BYTES = 4 << 20
_BREAK = w.byte_class(b".,;:!?\n\x0b\x0c\r")
_INSIDE = ~(_BREAK | w.byte_class(b" \t"))
_U64 = np.uint64
PASS = "lang string, phrase string, f bigint, chunk int, buckets binary"


class Grams(NamedTuple):
    """The words of a slice: joined text, starts, ends, rows, words to the piece's end, and the hashes of the phrases of 1, 2, ... words from each word."""

    text: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray
    left: np.ndarray
    hashes: list[np.ndarray]


def grams(texts: pa.Array, langs: pa.Array, longest: int) -> Grams:
    """Phrases of up to ``longest`` words of all texts; their hashes depend on the language too."""
    data, offsets = fp.buffer_of(texts)
    text, starts, ends, row, first = w.joined(data, _INSIDE[data], offsets)
    n = len(starts)
    piece = np.cumsum(_BREAK[data])[first] if n else first
    last = np.ones(n, bool)
    last[:-1] = (row[1:] != row[:-1]) | (piece[1:] != piece[:-1])
    stop = np.flatnonzero(last)
    left = stop[np.searchsorted(stop, np.arange(n))] - np.arange(n) + 1 if n else first
    names, at = fp.buffer_of(langs)
    salt = fp.mix(fp.spans(fp.prefix_sums(names, 1), at[:-1], at[1:], 1) + _U64(1))
    sums = fp.prefix_sums(text, 0)
    word = fp.mix(fp.spans(sums, starts, ends, 0) + (ends - starts).astype(_U64))
    hashes = [fp.mix(word ^ salt[row])]
    for k in range(1, longest):
        step = np.zeros(n, _U64)
        step[: n - k] = word[k:]
        hashes.append(fp.mix(hashes[-1] * _U64(0x9E3779B97F4A7C15) + step))  # means nothing where left <= k
    return Grams(text, starts, ends, row, left, hashes)


def buckets_of(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> _U64(64 - bits)).astype(np.int64)


def has_bit(bitmap: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    return (bitmap[bucket >> 3] >> (bucket & 7).astype(np.uint8) & 1).astype(bool)


def add_up(vector: np.ndarray, bucket: np.ndarray, least: int) -> None:
    """Counts buckets into a vector of counts up to ``least``."""
    at, n = np.unique(bucket, return_counts=True)
    vector[at] = np.minimum(vector[at] + n, least)


def chunks(vector: np.ndarray) -> pa.RecordBatch:
    """The chunks of a vector that are not all zero, as rows of a pass."""
    parts = vector.reshape(CHUNKS, -1)
    some = np.flatnonzero(parts.any(axis=1))
    packed = [pa.compress(parts[i].tobytes(), codec="zstd", asbytes=True) for i in some]
    nulls = [pa.nulls(len(some), kind) for kind in (pa.string(), pa.string(), pa.int64())]
    return pa.RecordBatch.from_arrays([*nulls, pa.array(some, pa.int32()), pa.array(packed, pa.binary())], ["lang", "phrase", "f", "chunk", "buckets"])


def bitmap(vectors: DataFrame, bits: int, least: int) -> np.ndarray:
    """Which buckets have ``least`` or more over all vectors: 2 ** ``bits`` bits."""
    size = (1 << bits) // CHUNKS

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                part = np.frombuffer(pa.decompress(packed.as_buffer(), size, codec="zstd"), np.uint8)
                sums[chunk] = np.minimum(sums[chunk] + part, least).astype(np.uint8) if chunk in sums else part
        packed = [np.packbits(x >= least, bitorder="little").tobytes() for x in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(packed, pa.binary())], ["chunk", "bits"])

    out = np.zeros((CHUNKS, size // 8), np.uint8)
    for chunk, packed in vectors.where("chunk is not null").select("chunk", "buckets").repartition("chunk").mapInArrow(merge, "chunk int, bits binary").collect():  # 2 MB at most
        out[chunk] = np.frombuffer(packed, np.uint8)
    return out.reshape(-1)


def frequent_bits(phrases: DataFrame, k: int, bits: int, least: int) -> np.ndarray:
    """The bitmap of the hashes of a table (lang, phrase) of frequent phrases of ``k`` words."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vector = np.zeros(1 << bits, np.uint8)
        for batch in batches:
            for part in slices(batch, "phrase", PIECE_BYTES):
                found = grams(part.column(1), part.column(0), k)
                vector[buckets_of(found.hashes[-1][found.left == k], bits)] = least
        yield chunks(vector)

    return bitmap(phrases.select("lang", "phrase").mapInArrow(mark, PASS), bits, least)


def one_pass(rows: DataFrame, k: int, parts: np.ndarray | None, hashed: np.ndarray | None, bits: int, least: int) -> DataFrame:
    """Counts of the candidate phrases of ``k`` words by slice, and buckets of those of one more, in one table."""
    shared = rows.sparkSession.sparkContext.broadcast((parts, hashed))
    more = k < LONGEST

    def counted(batch: pa.RecordBatch, vector: np.ndarray) -> pa.RecordBatch:
        parts, hashed = shared.value
        found = grams(batch.column(1), batch.column(0), k + more)
        own = found.hashes[k - 1]
        able = found.left >= k
        if k > 1:
            part = has_bit(parts, buckets_of(found.hashes[k - 2], bits))
            able[:-1] &= part[:-1] & part[1:]
            able &= has_bit(hashed, buckets_of(own, bits))
        if more and len(able):
            longer = found.left > k
            longer[:-1] &= able[:-1] & able[1:]
            add_up(vector, buckets_of(found.hashes[k][longer], bits), least)
        at = np.flatnonzero(able)
        _, which, n = np.unique(own[at], return_index=True, return_counts=True)
        at = at[which]
        text = found.text.tobytes()
        phrases = pa.array([text[i:j] for i, j in zip(found.starts[at].tolist(), found.ends[at + k - 1].tolist(), strict=True)], pa.binary())
        langs = batch.column(0).take(pa.array(found.row[at]))
        return pa.RecordBatch.from_arrays([langs, phrases.cast(pa.string()), pa.array(n, pa.int64()), pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())], ["lang", "phrase", "f", "chunk", "buckets"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vector = np.zeros(1 << bits if more else 0, np.uint8)
        for batch in batches:
            for part in slices(batch, "text", PIECE_BYTES):
                yield counted(part, vector)
            del batch
            pa.default_memory_pool().release_unused()
        if more:
            yield chunks(vector)

    return rows.mapInArrow(run, PASS)


def frequent(docs: DataFrame, text_col: str, lang_col: str, least: int, bits: int) -> tuple[list[DataFrame], DataFrame]:
    """The phrases (lang, phrase, f) of 1, 2, ... words that occur ``least`` times, and (lang, n) of all words."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(lang_col), F.lit(UNKNOWN)).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    out: list[DataFrame] = []
    parts = hashed = words = None
    for k in range(1, LONGEST + 1):
        made = stored(one_pass(rows, k, parts, hashed, bits, least), f"phrases-pass-{k}")
        counts = made.where("chunk is null").groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
        out.append(stored(counts, f"phrases-{k}"))
        if k == 1:
            words = stored(made.where("chunk is null").groupBy("lang").agg(F.sum("f").alias("n")), "phrases-words")
        if k < LONGEST:
            parts, hashed = frequent_bits(out[-1], k, bits, least), bitmap(made, bits, least)
    return out, words


def part(first, size):
    """The phrase of ``size`` words from a place on, of the column ``words``."""
    return F.array_join(F.slice("words", first, size), " ")


def scored(counts: list[DataFrame]) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the candidates that no longer one covers."""
    join = lambda tables: reduce(DataFrame.unionByName, tables)
    candidates = join(counts[1:]).select("lang", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("words"))
    size = F.size("words")
    longer = join(counts[2:]).select("lang", F.col("f"), F.split("phrase", " ").alias("words"))
    inner = F.explode(F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: part(i, n)))))
    covered = longer.select("lang", "f", inner.alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = candidates.join(covered, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer").cast("decimal(20,0)") < NESTED_PERCENT * F.col("a").cast("decimal(20,0)"))).drop("longer")
    cut = kept.withColumn("k", F.explode(F.sequence(F.lit(1), size - 1)))
    cut = cut.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("head"), part(F.col("k") + 1, size).alias("rest"))
    known = join(counts[:-1])
    heads = known.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l"))
    rests = known.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    both = cut.join(heads, ["lang", "head"]).join(rests, ["lang", "rest"])
    both = both.withColumn("score", F.expr(f"(cast(a as decimal(20,0)) * {SCALE}) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))"))
    best = both.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("b"))
    return best.select("lang", "phrase", "b.a", "b.l", "b.r", "b.score")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", top: int = TOP, least: int = LEAST, bits: int = BITS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases.

    ``least`` is at most 127, ``bits`` at least 11; fewer bits let more through, which costs only work.
    """
    with scratch() as keep:
        counts, words = frequent(docs, text_col, lang_col, least, bits)
        order = (F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
        shares = scored(counts).withColumn("slot", F.pmod(F.xxhash64("phrase"), F.lit(SLOTS)))
        some = shares.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "slot").orderBy(*order))).where(F.col("rank") <= top).drop("rank", "slot")
        best = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).where(F.col("rank") <= top)
        out = keep(stored(best.join(F.broadcast(words) if words.count() <= 1 << 16 else words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "phrases-best"))
    return out

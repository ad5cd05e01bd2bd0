"""Quantised vectors and exact cosine search as column expressions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Vectors and queries of a block of comparisons; both grow with the tables up to ``WIDEST``, lest there be more than ``TILES`` blocks.
SLICE, BLOCK, TILES, WIDEST = 8192, 2048, 128, 32768
#: Pairs compared at once inside a block.
AT_ONCE = 1 << 21


def floats(v: Column | str) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def scale(v: Column) -> Column:
    """One 127th of the largest component, 1 for a zero vector."""
    most = F.array_max(F.transform(v, lambda x: F.abs(x)))
    return F.when(most > 0, most / 127).otherwise(F.lit(1.0))


def quantised(v: Column, by: Column) -> Column:
    """Components as whole numbers in -127..127, halves rounded up."""
    return F.transform(v, lambda x: F.greatest(F.lit(-127), F.least(F.lit(127), F.floor(x / by + 0.5))).cast("int"))


def dequantised(q: Column, by: Column) -> Column:
    return F.transform(q, lambda x: x * by)


def quantised_table(vectors: DataFrame) -> DataFrame:
    """(vec_id, q, scale, norm) of (vec_id, embedding)."""
    v = vectors.select("vec_id", floats("embedding").alias("v"))
    s = v.select("vec_id", "v", scale(F.col("v")).alias("scale"))
    return s.select("vec_id", quantised(F.col("v"), F.col("scale")).alias("q"), "scale", norm(F.col("v")).alias("norm"))


def quantised_cosine(q: Column, by: Column, length: Column, query: Column, query_norm: Column) -> Column:
    return F.when((length > 0) & (query_norm > 0), by * dot(F.transform(q, lambda x: x.cast("double")), query) / (query_norm * length)).otherwise(F.lit(0.0))


def _matrix(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)


def _first_copies(v: np.ndarray, by: np.ndarray, n: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The rows without those that ``k`` equal rows with smaller ids stand before: all of them score the same."""
    whole = np.ascontiguousarray(np.column_stack([v, by, n]))
    _, group = np.unique(whole.view(np.dtype((np.void, whole.dtype.itemsize * whole.shape[1]))).reshape(-1), return_inverse=True)
    order = np.lexsort((ids, group))
    place = np.arange(len(order))
    fresh = np.r_[True, group[order][1:] != group[order][:-1]]
    return np.sort(order[place - np.maximum.accumulate(np.where(fresh, place, 0)) < k])


def _at_least(scores: np.ndarray, k: int) -> np.ndarray:
    """What the ``k``-th best of each row is at least: the ``k``-th best of the largest of groups of columns."""
    rows, m = scores.shape
    groups = max(min(m, 4 * k), m // 32)
    most = scores[:, : m // groups * groups].reshape(rows, -1, groups).max(axis=1)
    return np.partition(most, groups - k, axis=1)[:, groups - k] if groups > k else np.full(rows, -np.inf, scores.dtype)


def best_of_blocks(vectors: DataFrame, queries: DataFrame, keys: list[str], k: int, digits: int, parts: int | None = None) -> DataFrame:
    """(query_id, vec_id, score): of vectors (vec_id, v, by, n) and queries (query_id, o, on) with equal ``keys`` the best of each query, scores rounded.

    A block is multiplied as matrices of short floats to tell who may be among the ``k`` best after rounding; their scores are then
    summed in the order of the components, as the column expressions do it.  More than ``k`` rows a query may remain.
    """
    kinds = [f"{c} {df.schema[c].dataType.simpleString()}" for df, c in ((queries, "query_id"), (vectors, "vec_id"))]

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if left.num_rows and right.num_rows:
            v, o = _matrix(left, "v").astype(np.float64), _matrix(right, "o").astype(np.float64)
            by, n, on, ids = (t.column(c).to_numpy() for t, c in ((left, "by"), (left, "n"), (right, "on"), (left, "vec_id")))
            told = _first_copies(v, by, n, ids, k)
            v, by, n, ids = v[told], by[told], n[told], ids[told]
            with np.errstate(divide="ignore", invalid="ignore"):
                short_v, short_o = (np.nan_to_num(x, nan=0.0, posinf=0.0, neginf=0.0).astype(np.float32) for x in (v * (by / n)[:, None], o / on[:, None]))
            margin = 2 * 10.0**-digits + 4e-7 * v.shape[1]  # and what short floats may be off
            step = max(1, AT_ONCE // len(v))
            for at in range(0, len(o), step):
                near, some, length = short_o[at : at + step] @ short_v.T, o[at : at + step], on[at : at + step]
                row, col = np.divmod(np.flatnonzero(near >= (_at_least(near, k) - np.float32(margin))[:, None]), len(v))
                exact = np.zeros(len(row))
                for i in range(0, len(row), 1 << 16):
                    r, c = row[i : i + (1 << 16)], col[i : i + (1 << 16)]
                    under = length[r] * n[c]
                    exact[i : i + (1 << 16)] = np.divide(by[c] * np.cumsum(some[r] * v[c], axis=1)[:, -1], under, out=np.zeros(len(r)), where=under > 0)
                order = np.lexsort((ids[col], -exact, row))  # of equal scores the first ones are enough
                row, col, exact = row[order], col[order], exact[order]
                fresh = np.r_[True, (row[1:] != row[:-1]) | (exact[1:] != exact[:-1])]
                kept = np.arange(len(row)) - np.maximum.accumulate(np.where(fresh, np.arange(len(row)), 0)) < k
                found.append((row[kept] + at, told[col[kept]], exact[kept]))
        row, col, exact = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, kind) for i, kind in enumerate((np.int64, np.int64, np.float64)))
        return pa.table({"query_id": right.column("query_id").take(pa.array(row)), "vec_id": left.column("vec_id").take(pa.array(col)), "score": pa.array(exact)})

    # Spark may join small partitions, which would leave many blocks to one task
    cut = lambda df: (df.repartition(parts, *keys) if parts else df).groupBy(*keys)
    met = cut(vectors.select("vec_id", "v", "by", "n", *keys)).cogroup(cut(queries.select("query_id", "o", "on", *keys))).applyInArrow(compare, ", ".join([*kinds, "score double"]))
    return met.select("query_id", "vec_id", F.round("score", digits).alias("score"))


def dealt(vectors: int, queries: int) -> tuple[int, int]:
    """How many slices so many vectors are cut into, and how many blocks the queries: every row is sent once to each part of the other side."""
    slice_, block = SLICE, BLOCK
    while -(-vectors // slice_) * -(-queries // block) > TILES and block < WIDEST:
        block *= 2
        slice_ = max(slice_, block)
    return max(1, -(-vectors // slice_)), max(1, -(-queries // block))


def _all(vectors: DataFrame, queries: DataFrame, k: int, digits: int) -> DataFrame:
    """The same of all vectors and queries (query_id, embedding), dealt over blocks of bounded size."""
    slices, blocks = dealt(vectors.count(), queries.count())
    asked = queries.where("embedding is not null").select("query_id", F.col("embedding").alias("o")).withColumns({"on": norm(floats("o")), "size": F.size("o")})
    part = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = vectors.withColumns({"size": F.size("v"), "slice": part("vec_id", slices), "block": every(blocks)})
    return best_of_blocks(rows, asked.withColumns({"block": part("query_id", blocks), "slice": every(slices)}), ["block", "slice", "size"], k, digits, 4 * slices * blocks)


def _placed(rows: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def nearest(vectors: DataFrame, queries: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """(query_id, vec_id, score, place): the k nearest with positive cosine of query vectors (query_id, embedding).

    All pairs are compared, in blocks of vectors by queries that are dealt over the tasks; a block keeps its
    best of each query before the merge.
    """
    rows = vectors.where("embedding is not null").select("vec_id", F.col("embedding").alias("v")).withColumns({"by": F.lit(1.0), "n": norm(floats("v"))})
    return _placed(_all(rows, queries, k, digits).where("score > 0"), k)


def lane(vectors: DataFrame, queries: DataFrame, pool: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """(query_id, vec_id, score, place): the nearest vectors together with those of a pool (query_id, vec_id) that earlier lanes found.

    Vectors of the pool are scored in their quantised form; what both have keeps the better score.
    """
    asked = queries.select("query_id", floats("embedding").alias("o")).withColumn("on", norm(F.col("o")))
    known = pool.distinct().join(quantised_table(vectors), "vec_id").join(asked, "query_id")
    known = known.select("query_id", "vec_id", F.round(quantised_cosine(F.col("q"), F.col("scale"), F.col("norm"), F.col("o"), F.col("on")), digits).alias("score")).where("score > 0")
    every = nearest(vectors, queries, k, digits).drop("place").unionByName(known).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return every.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def quantised_nearest(vectors: DataFrame, queries: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """(query_id, vec_id, score, place): the k best of each query by the cosine with the quantised vectors, compared in the same blocks."""
    rows = quantised_table(vectors.where("embedding is not null")).select("vec_id", floats("q").alias("v"), F.col("scale").alias("by"), F.col("norm").alias("n"))
    return _placed(_all(rows, queries, k, digits), k)

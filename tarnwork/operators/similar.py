"""Nearest vectors through an index of cells.

Centres are fitted on a bounded sample; every vector is in the cell of its nearest centre, and a
query looks into the cells of its ``PROBES`` nearest ones.  What it finds there is compared exactly, so
scores are right and only neighbours in other cells are missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnwork.operators.vectors import best_of_blocks, floats, norm

#: Most vectors that the centres are fitted on, and rounds of the fit.
SAMPLE, ROUNDS = 4096, 12
#: Share of the centres that a query looks at, and the least number of them: directions without any
#: order, like those of the test tables, need that many for a recall of 0.9.
PROBED, LEAST_PROBES = 0.75, 8
MOST_CENTRES = 1024


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def centres_of(vectors: DataFrame, n: int) -> np.ndarray:
    """About ``n`` ** 0.5 / 2 centres of the directions of at most ``SAMPLE`` vectors (vec_id, embedding), the first by hash."""
    rows = vectors.where("embedding is not null").select(floats("embedding").alias("v"), "vec_id").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").collect()
    x = _unit(np.array([r[0] for r in rows], np.float64)) if rows else np.zeros((0, 1))
    k = int(min(MOST_CENTRES, len(x), max(1, n**0.5 / 2)))
    centres = x[:k].copy()
    for _ in range(ROUNDS if k else 0):
        nearest = (x @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, x)
        used = np.bincount(nearest, minlength=k) > 0
        centres[used] = _unit(sums[used])
    return centres


def cells(vectors: DataFrame, centres: np.ndarray, id_col: str, n: int) -> DataFrame:
    """(id, embedding, cell): each vector in its ``n`` nearest cells."""
    shared = vectors.sparkSession.sparkContext.broadcast(centres)  # a bounded number of centres
    kind = vectors.schema[id_col].dataType.simpleString()

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = shared.value
        for batch in batches:
            if batch.num_rows and len(centres):
                x = np.array(batch.column(1).to_pylist(), np.float64)
                best = np.argsort(-(x @ centres.T), axis=1, kind="stable")[:, :n]
                row = np.repeat(np.arange(len(x)), best.shape[1])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(best.reshape(-1).astype(np.int32))], [id_col, "embedding", "cell"])

    return vectors.where("embedding is not null").select(id_col, floats("embedding").alias("embedding")).mapInArrow(assign, f"{id_col} {kind}, embedding array<double>, cell int")


def nearest(vectors: DataFrame, queries: DataFrame, k: int, least: float = 0.0, digits: int = 6) -> DataFrame:
    """(query_id, vec_id, score, place): of the cells that a query (query_id, embedding) looks at, the ``k`` vectors nearest by cosine, above ``least``."""
    centres = centres_of(vectors, vectors.count())
    index = cells(vectors, centres, "vec_id", 1).select("vec_id", "cell", F.col("embedding").alias("v"), F.lit(1.0).alias("by"), norm(F.col("embedding")).alias("n"))
    asked = cells(queries, centres, "query_id", max(LEAST_PROBES, int(PROBED * len(centres)))).select("query_id", "cell", F.col("embedding").alias("o"), norm(F.col("embedding")).alias("on"))
    met = best_of_blocks(index, asked, ["cell"], k, digits).where(F.col("score") > least)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return met.withColumn("place", place).where(F.col("place") <= k)

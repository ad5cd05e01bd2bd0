"""Text quality from compression: dictionaries of good and bad text compete.

A zstandard dictionary is trained on labelled good texts and another on bad ones.  A text
that shrinks more with the good one is likelier good: the compressed-size difference,
normalised by the length and by the sizes, and the size itself feed a logistic calibration.
Every text is scored whole, in blocks.  Labels are learned from a bounded sample of rows: at
most ``FIT_ROWS`` ids of each label that come first by hash, one row an id, half for the
dictionaries and half for the calibration.  A dictionary is made from all blocks of its rows'
whole texts, of as many of these rows as have ``FIT_BYTES`` bytes together; the calibration reads
the whole texts on the executors, and only its numbers, one triple an id, are collected.

Edge cases: null and empty texts score like a text of no bytes, which the calibration maps
to a fixed value; with no labelled row of either kind the score is the share of good labels,
or 0.5; rows that repeat, ids included, each get the same score, and of several texts of a
labelled id the one with the least hash is learned from; a null id is scored and
never learned from; an empty table gives an empty result; a text of any length is scored in
blocks; other columns, whatever their names, are dropped by ``score`` and kept by ``keep_good``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwork.llm.common import discard, id_type, map_batches, map_slices, stored, texts

#: Most labelled rows of each label that a fit collects: half for the dictionary, half to calibrate.
FIT_ROWS = 1600
#: Bytes of the whole texts, together, that a label's dictionary is made from.
FIT_BYTES = 32 << 20
DICTIONARY_BYTES = 112_640
BLOCK = 2048
LEVEL = 3


class Model:
    """Two dictionaries and the weights of the calibration."""

    def __init__(self, good: bytes, bad: bytes, mean: list[float], scale: list[float], weights: list[float]):
        self.good, self.bad, self.mean, self.scale, self.weights = good, bad, mean, scale, weights
        self._compressors = None

    def __getstate__(self):
        return self.__dict__ | {"_compressors": None}

    def sizes(self, text: bytes) -> tuple[int, int]:
        """Compressed sizes with the good and the bad dictionary, over all blocks."""
        import zstandard

        if self._compressors is None:
            made = []
            for data in (self.good, self.bad):
                d = zstandard.ZstdCompressionDict(data)
                d.precompute_compress(level=LEVEL)
                made.append(zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
            self._compressors = made
        good, bad = self._compressors
        blocks = [text[i : i + BLOCK] for i in range(0, max(len(text), 1), BLOCK)]
        return sum(len(good.compress(b)) for b in blocks), sum(len(bad.compress(b)) for b in blocks)

    def inputs(self, text: bytes) -> list[float]:
        good, bad = self.sizes(text)
        n = len(text) + 20
        return [(bad - good) / n, (bad - good) / (bad + good), good / n]

    def scores(self, rows: list[bytes]) -> np.ndarray:
        if not rows:
            return np.zeros(0)
        if not self.good:
            return np.full(len(rows), self.weights[0])
        x = (np.array([self.inputs(t) for t in rows]) - self.mean) / self.scale
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + x @ np.array(self.weights[1:]), -30, 30)))


def _dictionary(blocks: list[bytes]) -> bytes:
    import zstandard

    total = sum(map(len, blocks))
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, total // 4)), blocks).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: the text itself is the dictionary
        return (b"\n".join(blocks) or b"\n" * 8)[:DICTIONARY_BYTES]


def calibrated(model: Model, x: np.ndarray, y: np.ndarray, good_share: float) -> Model:
    """``model`` with the weights of a logistic fit of labels y to inputs x."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    p = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    share = min(max(good_share, 0.02), 0.98)
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y).mean())  # back to the true shares
    w = np.zeros(4)
    for _ in range(40):  # Newton steps of a lightly penalised logistic fit
        q = 1 / (1 + np.exp(-np.clip(p @ w, -30, 30)))
        gradient = p.T @ (weight * (q - y)) + 1e-2 * w
        w = w - np.linalg.solve((p * (weight * q * (1 - q))[:, None]).T @ p + 1e-2 * np.eye(4), gradient)
    return Model(model.good, model.bad, mean.tolist(), scale.tolist(), w.tolist())


def training_row(id_col: str = "doc_id"):
    """Rows from which labels may be learned; the others are held out.  Null ids are not held out, and have no label."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 != 1, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = FIT_ROWS, size: int = FIT_BYTES) -> Model:
    """Fits on a bounded sample: the ``rows`` labelled ids of each label that come first by hash, in turn for each use."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col), F.col("quality").cast("int").alias("quality")).where(training_row(id_col))
    share = known.agg(F.avg("quality")).first()[0]
    order = [F.xxhash64(F.col(id_col)), F.col(id_col)]
    chosen = []
    for q in (0, 1):
        ids = [r[0] for r in known.where(F.col("quality") == q).select(id_col).distinct().orderBy(*order).limit(rows).collect()]
        chosen += [(i, q, k % 2 == 0) for k, i in enumerate(ids)]
    names = {id_col: labels.schema[id_col].dataType.simpleString(), "quality": "int", "for_dictionary": "boolean"}
    picked = docs.sparkSession.createDataFrame(chosen, ", ".join(f"{k} {v}" for k, v in names.items()))
    # at most 2 x rows ids: safe to broadcast
    met = texts(docs, id_col, text_col).join(F.broadcast(picked), id_col)
    one = F.min_by(text_col, F.struct(F.xxhash64(text_col), F.col(text_col)))
    found = stored(met.groupBy(id_col, "quality", "for_dictionary").agg(one.alias(text_col)), "quality-sample")
    raw = F.encode(text_col, "UTF-8")
    starts = F.sequence(F.lit(0), F.greatest(F.octet_length(text_col) - 1, F.lit(0)), F.lit(BLOCK))
    within = []  # whole texts, in the order of their ids' hashes, as long as they fit together
    for q in (0, 1):
        left = size
        for i, n in found.where(F.col("for_dictionary") & (F.col("quality") == q)).select(id_col, F.octet_length(text_col)).orderBy(*order).collect():
            if n <= left:
                within.append((i,))
                left -= n
    fits = docs.sparkSession.createDataFrame(within, f"{id_col} {names[id_col]}")
    cut = found.where("for_dictionary").join(F.broadcast(fits), id_col).select("quality", F.explode(F.transform(starts, lambda at: F.substring(raw, at + 1, F.lit(BLOCK)))).alias("block")).where(F.octet_length("block") > 0)
    made = [_dictionary([bytes(r[0]) for r in cut.where(F.col("quality") == q).select("block").orderBy(F.xxhash64("block"), "block").collect()]) for q in (1, 0)]
    empty = Model(*made, [0.0] * 3, [1.0] * 3, [0.0] * 4)

    def work(batch: pa.RecordBatch) -> dict:
        return {"quality": batch.column(0), "x": pa.array([empty.inputs((t or "").encode()) for t in batch.column(1).to_pylist()], pa.list_(pa.float64()))}

    got = map_batches(found.where("not for_dictionary").select("quality", text_col), work, "quality int, x array<double>", size_col=text_col).collect()
    got = sorted((r["quality"], r["x"]) for r in got)
    discard(found)
    if len({q for q, _ in got}) < 2:  # no labelled text of one kind: there is nothing to tell apart
        return Model(b"", b"", [], [], [0.5 if share is None else float(share)])
    return calibrated(empty, np.array([x for _, x in got]), np.array([float(q) for q, _ in got]), float(share))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted): how likely each text is good, and 1 from 0.5 up."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of fixed size

    def work(batch: pa.RecordBatch) -> dict:
        s = shared.value.scores([t.encode() for t in batch.column(1).to_pylist()])
        return {id_col: batch.column(0), "score": pa.array(s, pa.float64()), "predicted": pa.array((s >= 0.5).astype(np.int32), pa.int32())}

    return map_batches(texts(docs, id_col, text_col), work, f"{id_col} {id_type(docs, id_col)}, score double, predicted int", size_col=text_col)


def keep_good(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text is predicted good."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batch: pa.RecordBatch) -> pa.RecordBatch:
        column = batch.column(batch.schema.get_field_index(text_col)).fill_null("")
        s = shared.value.scores([t.encode() for t in column.to_pylist()])
        return batch.filter(pa.array(s >= 0.5, pa.bool_()))

    return map_slices(docs, keep, docs.schema, size_col=text_col)

"""The index of cells, the vector lane with a pool, and conflict review, against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwork.operators import memory, similar, vectors


def blobs(n, spread, seed=1):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(20, 16))
    return [(k, [float(v) for v in centres[k % 20] + spread * r.normal(size=16)], int(r.integers(0, 3))) for k in range(n)]


@pytest.mark.parametrize("spread", [0.2, 1.0, 5.0])
def test_index_recall(spark, spread):
    rows = blobs(2000, spread)
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    asked = table.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    got = {(x["query_id"], x["vec_id"]): x["score"] for x in similar.nearest(table, asked, 10).collect()}
    x = np.array([v for _, v, _ in rows])
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = want = 0
    for q in range(0, 2000, 50):
        score = x @ x[q]
        best = sorted(range(2000), key=lambda i: (-round(score[i], 6), i))[:10]
        want += len(best)
        hits += sum((q, i) in got and abs(got[q, i] - score[i]) < 1e-5 for i in best)
    assert hits >= 0.9 * want


def test_index_recall_on_the_tables(spark, data):
    big = data.replace("sf0.001", "sf0.1")
    e = spark.read.parquet(f"{big}/embeddings.parquet")
    asked = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    exact = {(x["query_id"], x["vec_id"]) for x in vectors.nearest(e, asked, 10).collect()}
    got = {(x["query_id"], x["vec_id"]) for x in similar.nearest(e, asked, 10).collect()}
    assert len(got & exact) >= 0.9 * len(exact)


def test_empty_index(spark):
    none = spark.createDataFrame([], "vec_id bigint, embedding array<double>, label int")
    assert similar.nearest(none, none.select(F.col("vec_id").alias("query_id"), "embedding"), 3).count() == 0


def test_lane_joins_the_pool(spark):
    table = spark.createDataFrame([(k, v, 0) for k, v, _ in blobs(60, 1.0)], "vec_id bigint, embedding array<double>, label int")
    asked = table.where("vec_id in (0, 7)").select(F.col("vec_id").alias("query_id"), "embedding")
    pool = spark.createDataFrame([(0, k) for k in range(60)] + [(7, 7), (7, 7), (9, 9)], "query_id bigint, vec_id bigint")
    got = {(x["query_id"], x["vec_id"]): (x["score"], x["place"]) for x in vectors.lane(table, asked, pool, 3).collect()}
    x = {r["vec_id"]: np.array(r["embedding"]) for r in table.collect()}

    def cosine(q, v, quantised):
        if quantised:
            s = abs(v).max() / 127
            return float((np.floor(v / s + 0.5).clip(-127, 127) * s) @ q / np.linalg.norm(q) / np.linalg.norm(v))
        return float(v @ q / np.linalg.norm(q) / np.linalg.norm(v))

    for q, members in ((0, range(60)), (7, [7])):
        exact = sorted(((round(cosine(x[q], v, False), 6), -k) for k, v in x.items()), reverse=True)[:3]
        best = {-k: s for s, k in exact if s > 0}
        for k in members:
            s = round(cosine(x[q], x[k], True), 6)
            if s > 0:
                best[k] = max(best.get(k, s), s)
        want = sorted(best.items(), key=lambda p: (-p[1], p[0]))[:3]
        assert [(k, got[q, k][1]) for k, _ in want] == [(k, i + 1) for i, (k, _) in enumerate(want)]
        assert all(abs(got[q, k][0] - s) < 2e-6 for k, s in want)


def test_three_relations(spark):
    rows = [(1, "a", "Same  text", "sum"), (2, "a", "same text", "sum"), (3, "a", "other", "SUM "), (4, "b", "same text", "sum"), (5, "a", "third", "sum"), (6, "a", "x", ""), (7, "a", "y", " ")]
    entries = spark.createDataFrame(rows, "entry bigint, scope string, content string, summary string")
    table = spark.createDataFrame([(k, [1.0, 0.01 * k], k % 2) for k in range(1, 6)] + [(6, [-1.0, 0.0], 1), (7, [0.0, 1.0], 1)], "vec_id bigint, embedding array<double>, label int")
    got = memory.conflicts(entries, entries.where("entry = 2").select("entry"), memory.opposed(table, "label", 0.9), "vectors").collect()
    told = {(x["entry"], x["other"], x["relation"], x["detector"]) for x in got}
    assert told == {
        (2, 1, "exact-duplicate", "canonical"), (3, 1, "normalized-summary-collision", "canonical"), (5, 1, "normalized-summary-collision", "canonical"),
        (2, 1, "semantic-conflict", "vectors"), (2, 3, "semantic-conflict", "vectors"), (2, 5, "semantic-conflict", "vectors"),
    }
    assert all(x["reasons"] == ["label 0 against 1"] for x in got if x["relation"] == "semantic-conflict")
    assert memory.conflicts(entries.limit(0), entries.select("entry").limit(0)).count() == 0


def test_blocks_equal_all_pairs(spark, monkeypatch):
    from tarnwork.operators import vectors

    monkeypatch.setattr(vectors, "SLICE", 40)
    monkeypatch.setattr(vectors, "BLOCK", 3)
    rng = np.random.default_rng(4)
    x = np.round(rng.standard_normal((150, 6)), 1)
    x[100:140] = x[100]  # copies tie
    x[7] = 0
    e = spark.createDataFrame([(k, [float(y) for y in v]) for k, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    asked = e.where("vec_id % 10 = 0 or vec_id = 7").selectExpr("vec_id as query_id", "embedding")
    for found, positive, scale in ((vectors.nearest, True, None), (vectors.quantised_nearest, False, 127)):
        got = {(r["query_id"], r["place"]): (r["vec_id"], round(r["score"], 5)) for r in found(e, asked, 4).collect()}
        f = x.astype(np.float32).astype(np.float64)
        most = np.abs(f).max(axis=1, keepdims=True)
        by = np.where(most > 0, most / 127, 1.0)
        shown = f if scale is None else np.clip(np.floor(f / by + 0.5), -127, 127) * by
        n = np.linalg.norm(f, axis=1)
        for q in [k for k in range(150) if k % 10 == 0 or k == 7]:
            s = np.divide(shown @ f[q], n * n[q], out=np.zeros(150), where=n * n[q] > 0)
            best = [(k, v) for v, k in sorted((-round(float(v), 6), k) for k, v in enumerate(s) if v > 0 or not positive)[:4]]
            assert [got[q, p + 1] for p in range(len(best))] == [(k, round(-v, 5)) for k, v in best]


def test_conflicts_of_every_entry(spark, data):
    from tarnwork.plans import catalog

    e = spark.read.parquet(f"{data}/embeddings.parquet").orderBy("vec_id").collect()
    ids, labels, x = [r["vec_id"] for r in e], {r["vec_id"]: r["label"] for r in e}, np.array([r["embedding"] for r in e], np.float64)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    score = np.round(x @ x.T, 6)
    want = {}
    for a, row in zip(ids, score):
        best = sorted(zip(-row, ids))[:10]
        want |= {(a, b): -s for s, b in best if -s > 0.2 and b != a and labels[a] != labels[b]}
    got = {(r["entry"], r["other"]): r["score"] for r in catalog.queries()["ext06_semantic_conflicts"](spark, data).collect()}
    assert len({a for a, _ in got}) > len(ids) / 2
    assert got.keys() == want.keys() and all(abs(s - want[p]) < 2e-6 for p, s in got.items())


def test_blocks_grow_with_the_tables():
    assert vectors.dealt(0, 0) == (1, 1) and vectors.dealt(20000, 400) == (3, 1)
    slices, blocks = vectors.dealt(600_000, 600_000)
    assert slices == blocks == 19  # so often every row is sent

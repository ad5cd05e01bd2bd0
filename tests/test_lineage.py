"""Pointer doubling and the surface fold against walks and lists."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tarnwork.operators import folds, lineage


def forest(r, n):
    nodes = {}
    for i in range(n):
        nodes[i] = r.choice([None, r.randrange(n), r.randrange(n, n + 5), *(r.randrange(max(1, i)) for _ in range(8))])
    nodes[n + 10] = n + 10
    return nodes


def walk(nodes, i):
    seen, at = [], i
    while nodes[at] is not None and nodes[at] in nodes:
        at = nodes[at]
        if at in seen or at == i:
            return None
        seen.append(at)
    return seen, at, nodes[at] is not None


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_roots_equal_walks(spark, seed):
    nodes = forest(random.Random(seed), 120)
    got = lineage.roots(spark.createDataFrame(list(nodes.items()), "id bigint, parent bigint")).collect()
    want = []
    for i in nodes:
        w = walk(nodes, i)
        want.append((i, None, None, False, True) if w is None else (i, w[1], len(w[0]), w[2], False))
    assert sorted(map(tuple, got)) == sorted(want)


def test_ancestors_and_descendants(spark):
    nodes = {k: v for k, v in forest(random.Random(7), 150).items() if v is None or v < k}
    table = spark.createDataFrame([(k, v, (k * 37) % 11) for k, v in nodes.items()], "id bigint, parent bigint, created bigint")
    got = sorted(map(tuple, lineage.ancestors(table, table.where("id % 3 = 0")).collect()))
    assert got == sorted((i, a, k + 1) for i in nodes if i % 3 == 0 for k, a in enumerate(walk(nodes, i)[0]))
    tops = {i for i in nodes if i % 5 == 0}
    key = lambda i: f"{(i * 37) % 11:016d}:{i:012d}"
    want = [(top, i, depth, "/".join(map(key, reversed(chain[: depth + 1])))) for i in nodes for chain in [[i, *walk(nodes, i)[0]]] for depth, top in enumerate(chain) if top in tops]
    assert sorted(map(tuple, lineage.descendants(table, spark.createDataFrame([(t,) for t in tops], "id bigint")).collect())) == sorted(want)


def test_a_cycle_is_an_error(spark):
    ring = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "id bigint, parent bigint")
    with pytest.raises(ValueError, match="LINEAGE_CYCLE"):
        lineage.ancestors(ring, ring)


def test_a_chain_of_a_hundred_thousand(spark):
    chain = spark.range(100_000).select("id", F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"))
    assert lineage.roots(chain).where("root = 0 and depth = id and not cyclic and not missing").count() == 100_000
    assert lineage.ancestors(chain.where("id < 20000"), spark.createDataFrame([(19_999,)], "id bigint")).where("ancestor + depth = 19999").count() == 19_999


def list_fold(ops):
    now, out = [], {}
    for seq, op, a, b in ops:
        out[seq] = "log-only" if op is None else "current"
        if op == "append":
            now.append(seq)
        elif op == "replace":
            for gone in now[a : b + 1]:
                out[gone] = "shadowed"
            now[a : b + 1] = [seq]
    return [out[x[0]] for x in ops]


def random_ops(r, n):
    ops, left = [], 0
    for seq in range(n):
        op = r.choice([None, "append", "append", "append", "replace", "replace"]) if left else r.choice([None, "append"])
        a = b = None
        if op == "replace":
            a = r.randrange(left)
            b = min(left - 1, a + r.choice([0, 0, 1, 2, left]))
            left -= b - a
        left += op == "append"
        ops.append((seq, op, a, b))
    return ops


def test_surface_of_ranges_equals_the_list(spark):
    r = random.Random(4)
    sessions = {s: random_ops(r, r.randint(1, 80)) for s in range(40)}
    assert all(folds.surface_of(ops) == list_fold(ops) for ops in sessions.values())
    rows = [(s, *x) for s, ops in sessions.items() for x in ops]
    r.shuffle(rows)
    got = {(x["session_id"], x["seq"]): x["surface"] for x in folds.surface(spark.createDataFrame(rows, "session_id bigint, seq bigint, op string, start bigint, end bigint")).collect()}
    assert got == {(s, x[0]): y for s, ops in sessions.items() for x, y in zip(ops, list_fold(ops))}


def test_a_session_of_a_hundred_thousand_replaces():
    n = 100_000
    ops = [(k, "append", None, None) for k in range(n)] + [(n + k, "replace", (k * 7919) % (n - k), min(n - k - 1, (k * 7919) % (n - k) + 1)) for k in range(n - 1)]
    left, fixed = n, []
    for seq, op, a, b in ops:
        if op == "replace":
            a = a % left
            b = min(left - 1, a + 1)
            left -= b - a
        fixed.append((seq, op, a, b))
    began = time.process_time()
    got = folds.surface_of(fixed)
    assert time.process_time() - began < 15 and got.count("current") == left


def test_a_range_beyond_the_surface_is_an_error():
    with pytest.raises(ValueError, match="SURFACE_RANGE"):
        folds.surface_of([(0, "append", None, None), (1, "replace", 0, 1)])

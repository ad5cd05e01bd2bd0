"""Importance resampling, SimHash components and phrase mining, against plain Python on small tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tarnwork.llm import collocations, importance, queries, simhash
from tarnwork.llm import fingerprints as fp

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sorted_rows(rows):
    return sorted(rows, key=repr)


# 11


def plain_resample(docs, target):
    """(id, n_features, weight, score, rank) of rows (id, text), by the contract's words."""

    def buckets(text):
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))
        return len(w), [zlib.crc32(f.encode()) % 10_000 for f in w + [f"{a} {b}" for a, b in zip(w, w[1:])]]

    known = [(i, *buckets(t)) for i, t in docs]
    s, t = Counter(b for _, _, f in known for b in f), Counter(b for x in target for b in buckets(x)[1])
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (sum(s.values()) + 10_000) / ((s[b] + 1) * (sum(t.values()) + 10_000)))) for b in s}
    rows = []
    for i, words, f in known:
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words])
    able = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    ranks = Counter()
    for k, r in enumerate(able[: 25 * len(able) // 100]):
        ranks[(*r[:4], k + 1)] += 1
    out = [tuple(x) for x in ranks.elements()]
    left = Counter(tuple(r[:4]) for r in rows) - Counter(x[:4] for x in out)
    return out + [(*x, None) for x in left.elements()]


def test_resampling_equals_plain_counts(spark, docs, fixture_rows, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    target = [fixture_rows[6][1], "Some of the words, and THE same again é1 数据", None, ""]
    spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = queries.op11_importance_resampling(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {t for _, t in got.dtypes} == {"bigint"}
    want = plain_resample([(r[0], r[1]) for r in fixture_rows], target)
    assert sorted_rows(tuple(x) for x in got.collect()) == sorted_rows(want)
    assert sum(x[4] is not None for x in want) > 10


def test_resampling_does_not_depend_on_partitions(docs, spark):
    target = spark.createDataFrame([("one two three",)], "text string")
    a, b = (sorted_rows(map(tuple, importance.resample(x, target).collect())) for x in (docs.repartition(1), docs.repartition(7)))
    assert a == b


def test_resampling_of_empty_tables(spark, empty, docs):
    none = spark.createDataFrame([], "text string")
    assert importance.resample(empty, docs).count() == 0
    assert importance.resample(docs, none).count() == docs.count()
    assert (importance.bucket_counts(none) == 0).all()


def test_equal_scores_go_to_the_smaller_id(spark):
    rows = [(i % 5 or None, "w " * 30) for i in range(40)]
    got = importance.resample(spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame([("w",)], "text string")).collect()
    assert sorted_rows(map(tuple, got)) == sorted_rows(plain_resample(rows, ["w"]))


def test_crc_of_long_and_short_words():
    r = random.Random(4)
    texts = ["".join(r.choice("ab1 é-") for _ in range(r.randint(0, 200))) for _ in range(50)] + ["x" * 5000 + " " + "y" * 48 + " " + "z" * 49]
    bucket, row, _ = importance.feature_buckets(*fp.buffer_of(pa.array(texts)), 1 << 31)
    for k, t in enumerate(texts):
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", t)
        assert Counter(bucket[row == k].tolist()) == Counter(zlib.crc32(f.encode()) % (1 << 31) for f in w + [f"{a} {b}" for a, b in zip(w, w[1:])])


# 12


def plain_simhash(text):
    from xxhash import xxh64_intdigest

    w = (text or "").translate(LOWER).encode().split()
    grams = [b" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [b" ".join(w)] if w else []
    h = [xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints, ids):
    """The smallest id of each row's component, from all pairs."""
    parent = list(range(len(prints)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= 4 and root(i) != root(j):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    low = {}
    for i, x in enumerate(ids):
        k = root(i)
        low[k] = x if low.get(k) is None else low[k] if x is None else min(low[k], x)
    return [low[root(i)] for i in range(len(prints))]


def test_simhash_components_equal_all_pairs(spark, docs, empty, fixture_rows, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op12_simhash_near_dedup(spark, str(tmp_path)).collect()
    prints = [plain_simhash(r[1]) for r in fixture_rows]
    want = [(r[0], f"{p:016x}", c) for r, p, c in zip(fixture_rows, prints, plain_components(prints, [r[0] for r in fixture_rows]))]
    assert sorted_rows(map(tuple, got)) == sorted_rows(want)
    assert simhash.near_components(empty).count() == 0


def clouds(r, n):
    """Fingerprints in clouds of a few flipped bits, some chained, and some by chance near zero."""
    out = []
    for _ in range(n):
        c = r.getrandbits(64)
        for _ in range(r.randint(1, 12)):
            out.append(c)
            for b in r.sample(range(64), r.randint(0, 6)):
                c ^= 1 << b
    return out + [sum(1 << b for b in r.sample(range(64), r.randint(0, 5))) for _ in range(40)]


@pytest.mark.parametrize("blocks", simhash.PLANS)
@pytest.mark.parametrize("cell", [simhash.CELL, 16])
def test_every_plan_finds_all_links(spark, monkeypatch, blocks, cell):
    monkeypatch.setattr(simhash, "CELL", cell)
    r = random.Random(len(blocks))
    prints = clouds(r, 150)
    if cell == 16:
        c = r.getrandbits(64)
        prints += [c ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 4))) for _ in range(200)]  # a hot anchor
    prints = sorted(set(prints))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    from tarnwork.llm.common import stored
    from tarnwork.llm.components import components

    classes = stored(spark.createDataFrame([(p,) for p in signed], "fp bigint"), "t")
    copies = stored(simhash.copied(classes, blocks), "t")
    labels = {x["node"]: x["component"] for x in components(stored(simhash.links(simhash.cells(copies)), "t")).collect()}
    want = plain_components(prints, signed)
    assert [labels.get(p, p) for p in signed] == want
    assert len(set(want)) < len(want)


def test_codes_are_perfect():
    for blocks in simhash.PLANS:
        assert sum(b.bits for b in blocks) == 64 and sum(b.near + 1 for b in blocks) > simhash.THRESHOLD
        for block in blocks:
            changes, begin, _ = simhash.patterns(block)
            columns, radius = simhash.parity(block.code)
            weights = np.bitwise_count(changes)
            first = weights[begin[:-1]]
            assert (np.diff(begin) > 0).all() and first.max() == radius  # every word has a home within the radius
            assert sum(math.comb(len(columns), k) for k in range(radius + 1)) == len(first)  # and no other anchor
    assert [simhash.PLANS.index(simhash.plan(n)) for n in (0, 10**5, 10**7, 10**10)] == [0, 0, 1, 2]


def test_simhash_of_odd_texts():
    texts = ["", None, "a", "A b", "x y z w", "x  y\tz\nw  v ", "é Ü ß", "a b c d " * 900, "\x00 \x1c w", "w" * 5000 + " 1 2 3"]
    got = simhash.simhashes(*fp.buffer_of(pa.array(texts)))
    assert [int(x) for x in got] == [plain_simhash(t) for t in texts]


# 13


def plain_collocations(rows, least, top):
    """(lang, rank, phrase, a, l, r, n, score) of rows (lang, text), by the contract's words."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            w = [x for x in re.split("[ \t]+", piece) if x]
            n[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    kept = {k: v for k, v in f.items() if v >= least}
    out = []
    for lang in n:
        found = []
        for (at, p), a in kept.items():
            if at != lang or len(p) < 2:
                continue
            longer = [v for (x, q), v in kept.items() if x == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if any(100 * v >= 80 * a for v in longer):
                continue
            score, _, left, right = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, k + 1, p.decode(), -a, left, right, n[lang], -s) for k, (s, a, p, left, right) in enumerate(sorted(found)[:top])]
    return out


def phrase_rows(seed):
    r = random.Random(seed)
    w = "the of new york city é数 a-b Times".split()
    rows = [(r.choice([None, "und", "en", "de"]), "".join(r.choice(w) + r.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\x0b"]) for _ in range(r.randint(0, 60)))) for _ in range(60)]
    rows += [("en", "one two three four " * 8 + "! three four"), ("en", None), ("de", ""), ("fr", " \t .,; "), ("en", "x" * 20_000 + " y z " * 40)]
    return rows


@pytest.mark.parametrize("least, top", [(3, 2000), (8, 5)])
def test_collocations_equal_plain_counts(spark, monkeypatch, least, top):
    monkeypatch.setattr(collocations, "PIECE_BYTES", 900)
    rows = phrase_rows(least)
    table = spark.createDataFrame([(*x, 1, "n") for x in rows], "lang string, text string, f bigint, phrase string").repartition(3)
    got = collocations.collocations(table, top=top, least=least).collect()
    want = plain_collocations(rows, least, top)
    assert sorted_rows(map(tuple, got)) == sorted_rows(want) and len(want) >= 10


def test_few_buckets_let_more_through(spark):
    """Bitmaps only save work: with few buckets the result is the same."""
    rows = phrase_rows(1)
    got = collocations.collocations(spark.createDataFrame(rows, "lang string, text string"), least=4, bits=11).collect()
    assert sorted_rows(map(tuple, got)) == sorted_rows(plain_collocations(rows, 4, 2000))


def test_counts_up_to_the_least_add_up():
    r = np.random.default_rng(1)
    vector, exact = np.zeros(64, np.uint8), np.zeros(64, np.int64)
    for _ in range(30):
        b = r.integers(0, r.integers(1, 64), 50)
        collocations.add_up(vector, b, 30)
        exact += np.bincount(b, minlength=64)
    assert (vector == np.minimum(exact, 30)).all()


def test_collocations_of_an_empty_table(spark, empty):
    assert collocations.collocations(empty).count() == 0
    assert collocations.collocations(spark.createDataFrame([("en", "a b c")], "lang string, text string")).count() == 0


def test_scores_beyond_64_bits(spark):
    big = 10**15
    words = spark.createDataFrame([("en", "a", 3 * big), ("en", "b", 2 * big), ("en", "c", big)], "lang string, phrase string, f bigint")
    two = spark.createDataFrame([("en", "a b", big + 7), ("en", "b c", big)], "lang string, phrase string, f bigint")
    none = two.where("f < 0")
    got = {x["phrase"]: x["score"] for x in collocations.scored([words, two, none, none]).collect()}
    assert got == {"a b": 2_000_000 * (big + 7) // (5 * big), "b c": 2_000_000 * big // (3 * big)}

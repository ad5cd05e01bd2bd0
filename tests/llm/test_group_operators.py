"""Operators over pairs and sources, and the pipeline, against brute force on small tables."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tarnwork.llm import compression_quality, mixing, ngram_join, pii, queries, suffix_dedup
from tarnwork.llm.components import components
from tarnwork.llm.common import stored


def sorted_rows(rows):
    return sorted(rows, key=repr)


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset() if not w else frozenset([tuple(w)]) if len(w) < 5 else frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def jaccard(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    group = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    least = {g: min((i for (i, _), h in zip(sets, group) if h == g and i is not None), default=None) for g in set(group)}
    return sorted_rows((i, len(s), least[g] if s else i) for (i, s), g in zip(sets, group))


@pytest.mark.parametrize("frequent", [2, ngram_join.FREQUENT])
def test_jaccard_join(docs, empty, fixture_rows, monkeypatch, frequent):
    monkeypatch.setattr(ngram_join, "FREQUENT", frequent)
    got = sorted_rows(tuple(x) for x in ngram_join.jaccard_components(docs).collect())
    assert got == jaccard([(r[0], r[1]) for r in fixture_rows])
    assert ngram_join.jaccard_components(empty).count() == 0


def test_small_sets_enumerate_pairs(spark, monkeypatch):
    rows = [(i, f"a b c d e f g h {'x' if i % 2 else 'y'}") for i in range(6)] + [(10, "p q r s t u v"), (11, "p q r s t u w"), (12, "p q r s t u v w")]
    monkeypatch.setattr(ngram_join, "boundary", lambda lists, sets: 100)
    got = sorted_rows(tuple(x) for x in ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert got == jaccard(rows)


def test_near_copies_of_one_text(spark):
    """A group of which a pivot joins only a part: chains of edits, edits far from the centre, and a passage that others share."""
    r = random.Random(8)
    base = [f"w{k}" for k in range(150)]
    rows = []
    for k in range(160):
        w = list(base)
        for _ in range(r.choice([0, 1, 2, 3, 4, 5, 6, 8, 12])):
            w[r.randrange(len(w))] = r.choice([f"x{r.randrange(4)}", f"y{r.randrange(10**6)}"])
        if r.random() < 0.2:
            del w[r.randrange(100) :][: r.randrange(30)]
        rows.append((k, " ".join(w)))
    chain = list(base[:60]) + [f"z{k}" for k in range(60)]
    for k in range(40):  # each links to the next ones only
        chain[(k * 7) % 120] = f"c{k}"
        rows.append((1000 + k, " ".join(chain)))
    rows += [(2000 + k, " ".join(base[40:110] + [f"o{k}_{j}" for j in range(r.randint(5, 90))])) for k in range(60)]
    r.shuffle(rows)
    got = sorted_rows(tuple(x) for x in ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert got == jaccard(rows)
    sizes = Counter(x[2] for x in got)
    assert len([n for n in sizes.values() if n > 5]) >= 2 and len(sizes) > 50


def test_components(spark):
    edges = stored(spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (7, 7)], "a bigint, b bigint"), "t")
    got = dict(tuple(x) for x in components(edges).collect())
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in (100, 101, 103)} == {100}


def repeats(texts, length):
    data = [(t or "").encode() for t in texts]
    n = Counter(b[p : p + length] for b in data for p in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if n[b[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        out.append((len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), __import__("hashlib").sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("kinds", [1, suffix_dedup.GROUP_KINDS])
def test_suffix_dedup(docs, empty, fixture_rows, monkeypatch, kinds):
    monkeypatch.setattr(suffix_dedup, "GROUP_KINDS", kinds)
    want = sorted_rows((r[0], *x) for r, x in zip(fixture_rows, repeats([r[1] for r in fixture_rows], 200)))
    assert sorted_rows(tuple(x) for x in suffix_dedup.digests(docs).collect()) == want
    assert sum(x[2] > 0 for x in want) > 5
    assert suffix_dedup.digests(empty).count() == 0


def test_doubling_over_every_position(spark, docs, empty, fixture_rows):
    rows = [r[:2] for r in fixture_rows if len(r[1] or "") < 3000]
    want = sorted_rows((r[0], *x) for r, x in zip(rows, repeats([r[1] for r in rows], 200)))
    got = suffix_dedup.digests(spark.createDataFrame(rows, "doc_id bigint, text string"), search=suffix_dedup.every_position)
    assert sorted_rows(tuple(x) for x in got.collect()) == want
    assert suffix_dedup.digests(empty, search=suffix_dedup.every_position).count() == 0


def test_long_texts_come_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "_LONG", 300)
    monkeypatch.setattr(suffix_dedup, "_CHUNK", 100)
    base = " ".join(f"w{i * i}" for i in range(400))
    rows = [(0, base), (1, base[500:900] + "zz" + base[100:350]), (2, "y" * 250)]
    want = sorted_rows((i, *x) for (i, _), x in zip(rows, repeats([t for _, t in rows], 200)))
    assert sorted_rows(tuple(x) for x in suffix_dedup.digests(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()) == want


def test_mixing(docs, empty, fixture_rows):
    got = mixing.mix(docs).collect()
    sizes = defaultdict(int)
    for x in got:
        sizes[x["source"]] += x["size"]
    assert sorted_rows((x["doc_id"], x["size"]) for x in got) == sorted_rows((r[0], len((r[1] or "").split(" ")) and len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))) for r in fixture_rows)
    goal = {x["source"]: x["target"] for x in got}
    assert abs(sum(goal.values()) - sum(sizes.values())) < 1e-6 and all(goal[s] <= 3 * sizes[s] + 1e-9 for s in goal)
    taken = Counter()
    for x in got:
        assert 0 <= x["times"] <= 3
        taken[x["source"]] += x["times"] * x["size"]
    largest = max(x["size"] for x in got)
    assert all(abs(taken[s] - goal[s]) <= largest for s in goal)
    again = mixing.mix(docs.repartition(7)).collect()
    key = lambda rows: sorted_rows((x["doc_id"], x["source"], x["size"], x["times"]) for x in rows)
    assert key(again) == key(got)
    assert mixing.mix(empty).count() == 0
    mixed = mixing.mixed_documents(docs)
    assert mixed.schema == docs.schema and mixed.count() == sum(x["times"] for x in got)
    assert mixing.mixed_documents(empty).count() == 0


def test_targets_by_water_filling(spark):
    rows = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 50), (None, 100)], "source string, size bigint")
    got = {x["source"]: x["target"] for x in mixing.targets(rows).collect()}
    # total 1160, weights 5 2 1 5: all but b are filled to three times their size
    assert got == {"a": 30, "b": 680, "c": 150, None: 300}
    assert abs(sum(got.values()) - 1160) < 1e-6


@pytest.fixture(scope="module")
def clashing(docs):
    """Columns with the names that operators use inside."""
    names = ["row", "_row", "_first", "mix_row", "_mix_row", "mix_times", "MIX_EPOCH", "times", "bucket", "component_id", "group", "start", "_shingles", "ids"]
    return docs.select("*", *(F.lit(k).alias(n) for k, n in enumerate(n for n in names if n not in docs.columns)))


def test_stages_keep_columns_of_any_name(spark, clashing):
    for stage in (corpus_pipeline.ngram_jaccard, corpus_pipeline.mix_sources, corpus_pipeline.personal_data):
        after = stage(spark, clashing, "")
        assert after.schema.names == clashing.schema.names
        kept = {tuple(x) for x in clashing.drop("text", "n_chars").collect()}
        assert {tuple(x) for x in after.drop("text", "n_chars").collect()} <= kept


def test_pipeline_stages(spark, docs, empty, labels, tmp_path):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    columns = "doc_id", "text", "lang", "source", "n_chars"
    for table in (docs.select(*columns), empty):
        now = table
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            after = stage(spark, now, str(tmp_path))
            if k < 4:
                assert after.schema.names == table.schema.names
            now = stored(after, "t")
        assert now.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "span_ends_sha256"]


def test_pipeline_rows(spark, docs, labels, fixture_rows, tmp_path):
    """All five stages, each against a plain computation over its own input."""
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    model = compression_quality.fit(docs, labels)
    tagger = pii.tagger(spark)
    rows = lambda df: [(x["doc_id"], x["text"], x["source"]) for x in df.collect()]
    now = docs
    good = [r for r in rows(now) if model.scores([(r[1] or "").encode()])[0] >= 0.5]
    now = stored(corpus_pipeline.quality_classifier(spark, now, str(tmp_path)), "t")
    assert sorted_rows(rows(now)) == sorted_rows(good)
    groups = jaccard([(k, r[1]) for k, r in enumerate(good)])
    now = stored(corpus_pipeline.ngram_jaccard(spark, now, str(tmp_path)), "t")
    left = rows(now)
    assert len(left) == len({g for _, _, g in groups})
    members = defaultdict(list)
    for k, _, g in groups:
        members[g].append(good[k])
    least = sorted_rows(min((r[0] for r in m if r[0] is not None), default=None) for m in members.values())
    assert sorted_rows(r[0] for r in left) == least
    clean = sorted_rows((i, None if t is None else pii.masked(t, pii.spans(tagger, [t])[0][1]), s) for i, t, s in left)
    now = stored(corpus_pipeline.personal_data(spark, now, str(tmp_path)), "t")
    assert sorted_rows(rows(now)) == clean
    assert now.where("n_chars <> length(text)").count() == 0
    times = mixing.mix(now).where("times > 0").collect()
    now = stored(corpus_pipeline.mix_sources(spark, now, str(tmp_path)), "t")
    taken = rows(now)
    assert len(taken) == sum(x["times"] for x in times) and Counter(r[0] for r in taken) == sum((Counter({x["doc_id"]: x["times"]}) for x in times), Counter())
    library = __import__("sentencepiece").SentencePieceProcessor(model_file=queries.tokenizer_path(queries.PIECES))
    digest = lambda t: __import__("hashlib").sha256(t.encode()).hexdigest()
    want = []
    for i, t, _ in taken:
        ids = [*library.encode(t or ""), library.eos_id()]
        want.append((i, len(ids), digest(" ".join(map(str, ids))), digest(library.decode(ids))))
    got = corpus_pipeline.sentencepiece(spark, now, str(tmp_path)).collect()
    assert sorted_rows(tuple(x)[:4] for x in got) == sorted_rows(want)
    assert sorted_rows(tuple(x)[:4] for x in corpus_pipeline.run(spark, str(tmp_path)).collect()) == sorted_rows(want)


def test_near_duplicate_stage_keeps_one(spark, docs):
    kept = corpus_pipeline.ngram_jaccard(spark, docs.where("doc_id is not null"), "")
    groups = ngram_join.jaccard_components(docs.where("doc_id is not null"))
    assert {x[0] for x in kept.select("doc_id").collect()} == {x[0] for x in groups.select("component_id").collect()}


def test_near_duplicate_stage_keeps_one_row(spark, docs, fixture_rows):
    nameless = (None, "only rows without any id have this text", *fixture_rows[0][2:])
    rows = [*fixture_rows, nameless, nameless]
    kept = corpus_pipeline.ngram_jaccard(spark, docs.unionByName(spark.createDataFrame([nameless] * 2, docs.schema)), "")
    assert kept.schema.names == docs.schema.names
    first = {}
    for (k, _, group) in jaccard([(k, r[1]) for k, r in enumerate(rows)]):
        first[group] = min(first.get(group, k), k, key=lambda k: (rows[k][0] is None, rows[k][0] or 0, k))
    assert sorted_rows((x["doc_id"], x["text"]) for x in kept.collect()) == sorted_rows(rows[k][:2] for k in first.values())

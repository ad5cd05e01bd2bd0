"""Operators that treat each row for itself, against brute force on small tables."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwork.llm import compression_quality, license_scan, ogg, pii, quality_rules, queries, sentencepieces, token_cache
from tarnwork.llm.common import stored
from tarnwork.llm.queries import BYTES, PIECES, encoded, tokenizer_path


def sorted_rows(rows):
    return sorted(rows, key=repr)


def test_base_counts(docs, empty, fixture_rows):
    got = quality_rules.base_counts(docs, ["doc_id"]).collect()

    def want(i, text):
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        grams = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        n = Counter(grams)
        covered = {k + j for k, g in enumerate(grams) if n[g] > 1 for j in range(5)}
        return (i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered))

    assert sorted_rows((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got) == sorted_rows(want(r[0], r[1]) for r in fixture_rows)
    assert quality_rules.base_counts(empty, ["doc_id"]).count() == 0


def scatter(x):
    cov = np.cov(x.T, bias=True)
    least = np.array(quality_rules.LEAST_DEVIATION) ** 2
    cov[np.diag_indices(len(cov))] = np.maximum(np.diag(cov), least) + quality_rules.RIDGE * least
    return x.mean(0), cov


def concentrated(x, near):
    """Exact concentration steps from some rows to a fixed set of the nearest ones: (log determinant, centre, scatter)."""
    h, before = int(np.ceil(len(x) * quality_rules.SUPPORT)), None
    while True:
        centre, cov = scatter(x[near])
        z = x - centre
        near = np.sort(np.argsort(np.einsum("ni,ij,nj->n", z, np.linalg.inv(cov), z), kind="stable")[:h])
        if before is not None and np.array_equal(near, before):
            return np.linalg.slogdet(cov)[1], centre, cov
        before = near


def least_determinant(x, r, tries=60):
    """The best of many random starts."""
    return min((concentrated(x, r.choice(len(x), 8, replace=False)) for _ in range(tries)), key=lambda e: e[0])


def blended_estimate(groups, r):
    """Centre and scatter by which the first group is judged, of groups each inside the next."""
    x = groups[-1]
    centre = np.median(x, 0)
    scale = np.maximum(quality_rules.LEAST_DEVIATION, 1.4826 * np.median(abs(x - centre), 0)) ** 2
    cov = np.diag(scale + quality_rules.RIDGE * np.array(quality_rules.LEAST_DEVIATION) ** 2) / quality_rules.widened()
    for x in reversed(groups):
        _, c, s = least_determinant(x, r) if len(x) > 8 else concentrated(x, np.arange(len(x)))
        share = len(x) / (len(x) + quality_rules.PRIOR_ROWS)
        centre, cov = share * c + (1 - share) * centre, share * s + (1 - share) * cov
    return centre, cov


def features_of(spark, docs):
    counts = quality_rules.base_counts(docs, ["doc_id"]).where(~quality_rules.base_failed()).select("doc_id", *quality_rules.vectors()).collect()
    return {x["doc_id"]: np.array([x[f] for f in quality_rules.FEATURES]) for x in counts}


def test_estimate_has_the_least_determinant(spark):
    r = np.random.default_rng(3)
    base = r.multivariate_normal([5, 1.6, 0.2, 0.3, 0.3], np.diag([0.5, 0.1, 0.1, 0.2, 0.2]) ** 2 + 0.004, 300)
    far = r.multivariate_normal([7, 2.4, 0.7, 0.9, 0.1], np.diag([0.1] * 5) ** 2, 90)  # a tight cluster that a mean follows
    x = np.round(np.concatenate([base, far]), 6)
    bins = stored(quality_rules.binned(spark.createDataFrame([("g", *map(float, v)) for v in x], ["group", *quality_rules.FEATURES]), "group"), "t")
    got = quality_rules.minimum_covariance(bins, stored(quality_rules.first_estimate(bins), "t")).first()
    want = least_determinant(x, r)
    assert got["log_det"] <= want[0] + 0.1  # bins of distance are a little wider than the exact share
    assert np.allclose(got["centre"], want[1], atol=0.05)
    z = x - np.array(got["centre"])
    d2 = np.einsum("ni,ij,nj->n", z, np.linalg.inv(np.array(got["scatter"])), z)
    assert d2[300:].min() > d2[:300].max()


@pytest.mark.parametrize("points", [1, 2, 3])
@pytest.mark.parametrize("copies", [1, 4, 33])
def test_singular_scatter(spark, points, copies):
    """Groups of one, two and three distinct vectors: centre, determinant and inverse are numpy's."""
    r = np.random.default_rng(points * 100 + copies)
    kinds = {"plain": r.random((points, 5)).round(3) * [6, 2, 1, 1, 1], "collinear": (np.arange(points)[:, None] * np.array([1.0, 0.5, 0.3, 0.4, 0.7]) + 1).round(6), "far": r.integers(0, 9, (points, 5)) * 1.0}
    rows = [(k, *map(float, v)) for k, x in kinds.items() for v in x for _ in range(copies)]
    bins = quality_rules.binned(spark.createDataFrame(rows, ["group", *quality_rules.FEATURES]), "group")
    got = {x["group"]: x for x in quality_rules.estimate(bins, "group").collect()}
    for k, x in kinds.items():
        centre, cov = scatter(np.repeat(x, copies, 0))
        assert np.allclose(got[k]["centre"], centre) and np.allclose(got[k]["scatter"], cov)
        assert abs(got[k]["log_det"] - np.linalg.slogdet(cov)[1]) < 1e-6
        assert np.allclose(np.array(got[k]["inverse"]) @ cov, np.eye(5), atol=1e-6)


def test_groups_of_few_distinct_texts(spark):
    """Exact copies, and two and three distinct texts, are judged, and none of them goes."""
    r = random.Random(6)
    text = lambda n: " ".join(f"w{r.randrange(10**6)}" for _ in range(n))
    kinds = {"one": [text(60)], "two": [text(40), text(90)], "three": [text(30), text(60), text(120)]}
    rows = [(i, kinds[s][i % len(kinds[s])], "en", s) for s in kinds for i in range(90)]
    got = quality_rules.quality(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")).collect()
    assert len(got) == 270 and all(x["kept"] and 0 <= x["distance2"] < 50 for x in got)


def test_robust_outliers(spark):
    r = np.random.default_rng(3)
    rows = []
    for i in range(400):
        odd = i % 20 == 0
        w = ["w" * int(r.integers(3, 9)) + str(int(r.integers(0, 10**6))) for _ in range(int(np.exp(r.normal(5, 0.4))))]
        rows.append((i, " ".join(x + "###$$$%%%" for x in w) if odd else " ".join(w), "en", "s" if i % 3 else None))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    got = {x["doc_id"]: x for x in quality_rules.quality(docs).collect()}
    x = features_of(spark, docs)
    factor = quality_rules.SUPPORT / quality_rules.chi_square_share(quality_rules.chi_square_quantile(quality_rules.SUPPORT, 5), 7)
    limit = quality_rules.chi_square_quantile(quality_rules.CUTOFF, 5) * factor
    for source in ("s", None):
        ids = [k for k, _, _, s in rows if s == source]
        every = np.array([x[k] for k, _, _, _ in rows])
        centre, cov = blended_estimate([np.array([x[i] for i in ids]), every, every], r)
        z = np.array([x[i] for i in ids]) - centre
        want = np.einsum("ni,ij,nj->n", z, np.linalg.inv(cov), z)
        sure = abs(want / limit - 1) > 0.3
        assert all(got[i]["kept"] == (w <= limit) for i, w, s in zip(ids, want, sure) if s)
        assert np.corrcoef(want, [got[i]["distance2"] for i in ids])[0, 1] > 0.99
    assert all(got[i]["kept"] == (i % 20 != 0) for i in got)


def outlier_docs(n, lang, first=0):
    """n ordinary documents, then one with a few symbols."""
    r = np.random.default_rng(n)
    rows = [[f"w{r.integers(10**5, 10**6)}" for _ in range(int(np.exp(r.normal(5, 0.2))))] for _ in range(n)]
    w = [f"w{k}" for k in range(10**5, 10**5 + 150)]
    rows.append(["#" + x if k % 6 else x for k, x in enumerate(w)])
    return [(first + i, " ".join(x), lang, "s") for i, x in enumerate(rows)]


def test_moderate_outliers_are_rejected(spark):
    docs = spark.createDataFrame(outlier_docs(200, "en"), "doc_id bigint, text string, lang string, source string")
    got = {x["doc_id"]: x for x in quality_rules.quality(docs).collect()}
    assert not got[200]["base_failed"]
    assert [i for i in got if not got[i]["kept"]] == [200]


def test_small_groups_are_judged_by_a_pool(spark):
    rows = [(*x[:3], f"s{k % 20}") for k, x in enumerate(outlier_docs(300, "en"))] + [(*x[:2], None, "t") for x in outlier_docs(9, "", 1000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    got = {x["doc_id"]: x for x in quality_rules.quality(docs).collect()}
    assert [i for i in sorted(got) if not got[i]["kept"]] == [300, 1009]
    x = features_of(spark, docs)
    r = np.random.default_rng(1)
    take = lambda keep: np.array([x[row[0]] for row in rows if keep(row)])
    for ids, own, pool in ((range(0, 301, 20), lambda row: row[3] == "s0", lambda row: row[2] == "en"), (range(1000, 1010), lambda row: row[3] == "t", lambda row: row[2] is None)):
        centre, cov = blended_estimate([take(own), take(pool), take(lambda row: True)], r)
        want = np.array([(x[i] - centre) @ np.linalg.inv(cov) @ (x[i] - centre) for i in ids])
        assert np.corrcoef(want, [got[i]["distance2"] for i in ids])[0, 1] > 0.98


def test_table_of_a_few_rows_is_judged(spark):
    docs = spark.createDataFrame(outlier_docs(20, "en"), "doc_id bigint, text string, lang string, source string")
    assert [x["doc_id"] for x in quality_rules.quality(docs).where("not kept").collect()] == [20]


def test_quality_edge_cases(docs, empty, fixture_rows):
    assert quality_rules.quality(docs).count() == len(fixture_rows)
    assert quality_rules.quality(empty).count() == 0


def test_chi_square():
    assert abs(quality_rules.chi_square_quantile(0.975, 5) - 12.8325) < 1e-3


def test_license_scan(spark, docs, empty):
    found = {(x["doc_id"], x["license"]) for x in license_scan.scan(docs).collect()}
    assert {x[1] for x in found} == {"mit-line"}
    assert license_scan.scan(empty).count() == 0
    rows = [(k, "x " * 50 + v + " y" * 50) for k, v in enumerate(license_scan.TEMPLATES.values())]
    rows += [(100, "Licensed under the Apache Tomcat, Version 2.0."), (101, "nothing here at all that is known")]
    got = license_scan.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    names = list(license_scan.TEMPLATES)
    assert {(k, n) for k, n in enumerate(names)} <= {(x["doc_id"], x["license"]) for x in got}
    assert not {x["doc_id"] for x in got} & {100, 101}
    # exact containment, by brute force
    split = lambda t: re.sub("[" + re.escape(license_scan.IGNORED) + "]", "", t.lower()).split()
    grams = lambda t: {tuple(split(t)[i : i + 5]) for i in range(len(split(t)) - 4)}
    want = {(i, n) for i, t in rows for n, v in license_scan.TEMPLATES.items() if len(grams(v) & grams(t)) >= 0.75 * len(grams(v))}
    assert {(x["doc_id"], x["license"]) for x in got} == want
    assert {(x["doc_id"], x["license"]) for x in license_scan.scan(spark.createDataFrame(rows, "doc_id bigint, text string"), templates={}).collect()} == set()


def test_license_parts_are_not_added_up_over_a_text(spark):
    words = license_scan.TEMPLATES["mit"].split()
    scattered = " ".join(" ".join(words[k : k + 12]) + " filler" * 400 for k in range(0, len(words), 12))
    cut = "x " * 300 + " ".join(words[: int(len(words) * 0.85)]) + " y" * 300
    rows = [(1, scattered), (2, cut), (3, " ".join(words).upper() + " z" * 2000)]
    got = {(x["doc_id"], x["license"]) for x in license_scan.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert {(2, "mit"), (3, "mit")} <= got and (1, "mit") not in got


def test_license_recall_of_bands(spark):
    """Every one of fifty random notices of 1 to 20 shingles is found in at least 98 % of the texts with it."""
    r = random.Random(2)
    word = lambda: f"w{r.randrange(10**6)}"
    notices = {f"n{k}": " ".join(word() for _ in range(5 + k % 20)) for k in range(50)}
    rows = []
    for name, text in notices.items():
        rows += [(name, " ".join([*(word() for _ in range(r.randint(0, 60))), text, *(word() for _ in range(r.randint(0, 60)))])) for _ in range(50)]
    found = Counter(x["doc_id"] for x in license_scan.scan(spark.createDataFrame(rows, "doc_id string, text string"), templates=notices).where("doc_id = license and containment = 1").collect())
    assert min(found[name] for name in notices) >= 49


def test_license_recall_of_edited_notices(spark):
    """Notices of which about three quarters or more are left, against exact containment."""
    r = random.Random(3)
    word = lambda: f"w{r.randrange(10**6)}"
    notices = {f"n{k}": " ".join(word() for _ in range(24 + 7 * k)) for k in range(12)}
    grams = lambda t: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)}
    rows, want = [], set()
    for k, (name, text) in enumerate(list(notices.items()) * 40):
        w = text.split()
        for _ in range(r.randint(0, max(1, len(w) // 22))):
            i = r.randrange(len(w))
            w[i : i + r.randint(0, 1)] = [word()] * r.randint(0, 1)
        full = " ".join([*(word() for _ in range(r.randint(0, 40))), *w, *(word() for _ in range(r.randint(0, 40)))])
        rows.append((k, full))
        if len(grams(full) & grams(text)) >= 0.75 * len(grams(text)):
            want.add((k, name))
    got = {(x["doc_id"], x["license"]) for x in license_scan.scan(spark.createDataFrame(rows, "doc_id bigint, text string"), templates=notices).collect()}
    assert got <= want and len(got) >= 0.99 * len(want) and len(want) > 200


def test_full_bitmap_changes_no_result(spark, monkeypatch):
    rows = [(1, "a b " * 30 + license_scan.TEMPLATES["unlicense"]), (2, None), (3, "one two three " * 200), (4, license_scan.TEMPLATES["mit"] * 3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = sorted(map(tuple, license_scan.scan(docs).collect()))
    monkeypatch.setattr(license_scan, "BITS", 64)
    assert sorted(map(tuple, license_scan.scan(docs).collect())) == want
    assert {x[1] for x in want if x[0] == 1} == {"unlicense"} and {"mit", "mit-grant"} <= {x[1] for x in want if x[0] == 4}


def slow_crc(data):
    c = 0
    for b in data:
        c ^= b << 24
        for _ in range(8):
            c = (c << 1 ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
    return c


def test_ogg_pages():
    data = bytes(range(256)) * 5
    assert ogg.page_checksum(data) == slow_crc(data)
    for block, streams in ((576, 2), (30_000, 3), (255, 1)):
        for n in (0, 1, 254, 255, 256, 576, 100_000):
            payload = (data * 100)[:n]
            media = ogg.write(payload, streams, block)
            found, errors = ogg.read(media)
            assert not errors and ogg.payload_of(found) == payload
            assert sum(x.granules[-1] for x in found.values()) == n
    bad = bytearray(ogg.write(data * 100))
    bad[500] ^= 1
    found, errors = ogg.read(bytes(bad))
    assert any("bad page" in e for e in errors)
    assert ogg.read(b"junk" + ogg.write(data))[1][0] == "no page at 0"
    assert ogg.read(ogg.write(data)[:-3])[1]


def plain_ogg(media):
    """Packets by stream with the granule of the page that each ends on, read byte by byte."""
    at, packets, open_, seen = 0, {}, {}, {}
    while at < len(media):
        assert media[at : at + 5] == b"OggS\x00"
        flags, granule = media[at + 5], int.from_bytes(media[at + 6 : at + 14], "little", signed=True)
        serial, number, crc = (int.from_bytes(media[at + k : at + k + 4], "little") for k in (14, 18, 22))
        lacing = media[at + 27 : at + 27 + media[at + 26]]
        body = at + 27 + len(lacing)
        end = body + sum(lacing)
        assert slow_crc(media[at : at + 22] + bytes(4) + media[at + 26 : end]) == crc
        assert number == seen.get(serial, 0) and bool(flags & 1) == bool(open_.get(serial)) and bool(flags & 2) == (number == 0)
        seen[serial] = number + 1
        for size in lacing:
            open_[serial] = open_.get(serial, b"") + media[body : body + size]
            body += size
            if size < 255:
                packets.setdefault(serial, []).append((open_.pop(serial), granule))
        at = end
    assert not any(open_.values())
    return packets, sum(seen.values())


def test_media_form_and_feature():
    r = random.Random(3)
    for n in (576, 1152, 576 * 7, 576 * 90):
        payload = bytes(r.randrange(256) for _ in range(n))
        media = ogg.write(payload)
        packets, pages = plain_ogg(media)
        assert len(packets) == 2 and all(p[0][0][:8] == b"\x7fpcm8\x00\x00\x00" for p in packets.values())
        data = [p[1:] for _, p in sorted(packets.items())]
        blocks = [data[k % 2][k // 2][0] for k in range(n // 576)]
        assert b"".join(blocks) == payload
        assert all(g >= sum(len(x) for x, _ in part[: k + 1]) for part in data for k, (_, g) in enumerate(part) if g >= 0)
        assert [part[-1][1] for part in data if part] == [sum(len(x) for x, _ in part) for part in data if part]
        mean = sum(payload) / n
        deviation = (sum((x - mean) ** 2 for x in payload) / n) ** 0.5
        crossings = sum((a >= 128) != (b >= 128) for a, b in zip(payload, payload[1:]))
        seconds = max(sum(len(x) for x, _ in part) for part in data) / 8000
        told = dict(x.split("=") for x in ogg.feature(ogg.read(media)[0], payload).split(";"))
        # each stream's first packet names it
        assert (int(told["streams"]), int(told["pages"]), int(told["packets"]), int(told["crossings"])) == (2, pages, sum(map(len, packets.values())), crossings)
        assert abs(float(told["mean"]) - mean) < 1e-4 and abs(float(told["deviation"]) - deviation) < 1e-4 and abs(float(told["seconds"]) - seconds) < 1e-6


def test_media_columns(spark, docs, empty):
    rows = docs.select("doc_id", F.encode("text", "UTF-8").alias("payload"))
    got = ogg.read_media(ogg.write_media(rows)).collect()
    assert sorted_rows((x["doc_id"], bytes(x["payload"])) for x in got) == sorted_rows((x["doc_id"], bytes(x["payload"] or b"")) for x in rows.collect())
    assert all(not x["errors"] for x in got)
    assert ogg.read_media(spark.createDataFrame([(1, None), (2, bytearray(b"no"))], "doc_id int, media binary")).where("payload is null and size(errors) > 0").count() == 2
    assert ogg.write_media(empty.select("doc_id", F.encode("text", "UTF-8").alias("payload"))).count() == 0


def test_media_query(spark, docs, fixture_rows, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted_rows(queries.op4_media_columns(spark, str(tmp_path)).collect())
    want = []
    for r in fixture_rows:
        raw = (r[1] or "").encode()
        payload = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        media = ogg.write(payload)
        want.append((r[0], len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest()))
    assert sorted_rows(tuple(x)[:7] for x in got) == sorted_rows(want)
    assert all(x["feature"] for x in got)


def test_classifier_query(spark, docs, labels, fixture_rows, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    got = queries.op5_quality_classifier(spark, str(tmp_path)).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 3 == 1
    assert sorted_rows((x["doc_id"], x["held_out"]) for x in got) == sorted_rows((r[0], held(r[0])) for r in fixture_rows)
    assert all(x["predicted"] == int(x["score"] >= 0.5) for x in got)


def test_scores_equal_plain_compression(spark, docs, labels, fixture_rows):
    """Scores from the library's own compressor, and weights that no step would mend."""
    import zstandard

    model = compression_quality.fit(docs, labels)

    def sizes(text, dictionary):
        d = zstandard.ZstdCompressionDict(dictionary)
        d.precompute_compress(level=3)
        c = zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
        return sum(len(c.compress(text[i : i + 2048])) for i in range(0, max(1, len(text)), 2048))

    def inputs(text):
        good, bad = sizes(text, model.good), sizes(text, model.bad)
        return [(bad - good) / (len(text) + 20), (bad - good) / (bad + good), good / (len(text) + 20)]

    def score(text):
        z = model.weights[0] + sum(w * (x - m) / s for w, x, m, s in zip(model.weights[1:], inputs(text), model.mean, model.scale))
        return 1 / (1 + np.exp(-min(30, max(-30, z))))

    got = sorted_rows((x["doc_id"], round(x["score"], 6), x["predicted"]) for x in compression_quality.score(docs, model).collect())
    assert got == sorted_rows((r[0], round(score((r[1] or "").encode()), 6), int(score((r[1] or "").encode()) >= 0.5)) for r in fixture_rows)
    # the sample: labelled rows that are not held out, in the order of their hashes, every second one to calibrate
    known = [(i, int(k % 5 != 0)) for k, (i, *_) in enumerate(fixture_rows) if i is not None and zlib.crc32(str(i).encode()) % 3 != 1]
    hashed = {x["i"]: x["h"] for x in spark.createDataFrame(sorted({(i,) for i, _ in known}), "i bigint").select("i", F.xxhash64("i").alias("h")).collect()}
    text_hash = {x["t"]: x["h"] for x in spark.createDataFrame([(r[1] or "",) for r in fixture_rows], "t string").select("t", F.xxhash64("t").alias("h")).collect()}
    text = {}
    for i, t, *_ in fixture_rows:
        text[i] = min(text.get(i, t or ""), t or "", key=lambda x: (text_hash[x], x))
    rows = [(i, q) for q in (0, 1) for k, i in enumerate(sorted({i for i, y in known if y == q}, key=lambda i: (hashed[i], i))) if k % 2]
    x, y = np.array([inputs(text[i].encode()) for i, _ in rows]), np.array([float(q) for _, q in rows])
    assert np.allclose(x.mean(0), model.mean)
    share = min(max(np.mean([q for _, q in known]), 0.02), 0.98)
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y).mean())
    p = np.column_stack([np.ones(len(x)), (x - model.mean) / model.scale])
    w = np.array(model.weights)
    assert abs(p.T @ (weight * (1 / (1 + np.exp(-(p @ w))) - y)) + 1e-2 * w).max() < 1e-6


def test_dictionary_is_bounded_by_rows_and_bytes(spark, docs, labels):
    small = compression_quality.fit(docs, labels, rows=6, size=2000)
    assert compression_quality.score(docs, small).where("score is null").count() == 0
    assert len(small.good) <= 2000


def test_classifier_reads_whole_texts(spark):
    """Good and bad texts differ only behind twenty thousand bytes that they share."""
    head = "common words that both kinds have " * 700
    r = random.Random(1)
    rows = [(i, head + " ".join(("value flow river stone" if i % 2 else "zxq kwj vvb qqz").split()[r.randrange(4)] + str(r.randrange(9)) for _ in range(3000))) for i in range(60)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    model = compression_quality.fit(table, spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id bigint, quality int"))
    held = [x for x in compression_quality.score(table, model).collect() if zlib.crc32(str(x["doc_id"]).encode()) % 3 == 1]
    assert all(x["predicted"] == x["doc_id"] % 2 for x in held)


def test_compression_classifier(spark, docs, empty, labels):
    good = [f"the quick animal number {i} ran over a field of grass and was seen by {i * 7} people in town" for i in range(80)]
    bad = [f"BUY!! NOW!! {i}!! WIN!! " * 6 for i in range(80)]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(good + bad)], "doc_id bigint, text string")
    known = spark.createDataFrame([(i, int(i < 80), 0) for i in range(160)], "doc_id bigint, quality int, toxic int")
    model = compression_quality.fit(table, known)
    got = {x["doc_id"]: x for x in compression_quality.score(table, model).collect()}
    held = [i for i in range(160) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(got[i]["predicted"] == (i < 80) for i in held) >= 0.95 * len(held)
    assert all(0 <= x["score"] <= 1 for x in got.values())
    again = compression_quality.fit(table.repartition(5), known.repartition(3))
    assert again.weights == model.weights
    model = compression_quality.fit(docs, labels)
    assert compression_quality.score(docs, model).count() == docs.count()
    assert compression_quality.keep_good(docs, model).schema == docs.schema
    for none in (compression_quality.fit(empty, labels), compression_quality.fit(docs, labels.limit(0))):
        assert compression_quality.score(docs, none).where("score is null").count() == 0
    assert compression_quality.score(empty, model).count() == 0


def test_sentencepiece(docs, empty, fixture_rows):
    sentencepiece = pytest.importorskip("sentencepiece")
    path = tokenizer_path(PIECES)
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    got = sentencepieces.decode(sentencepieces.encode(docs, path), path).collect()
    want = {r[1] or "": [*library.encode(r[1] or ""), library.eos_id()] for r in fixture_rows}
    assert {tuple(x["ids"]) for x in got} == {tuple(x) for x in want.values()}
    for x in got:
        text = next(t for t, ids in want.items() if ids == x["ids"])
        assert x["decoded"] == library.decode(x["ids"])
        assert len(x["span_ends"]) == len(x["ids"]) - 1
        raw = text.encode()
        if raw:
            assert x["span_ends"][-1] == len(raw) and sorted(x["span_ends"]) == x["span_ends"]
        cuts = [0, *x["span_ends"]]
        for a, b, i in zip(cuts, cuts[1:], x["ids"]):
            piece = library.id_to_piece(i)
            if not library.is_byte(i) and "▁" not in text:
                assert raw[a:b].decode() in (piece.replace("▁", " "), piece.replace("▁", " ")[1:])
    assert encoded(empty).count() == 0
    digest = encoded(docs.where("doc_id = 6")).first()
    ids = want[next(r[1] for r in fixture_rows if r[0] == 6)]
    assert digest["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


def test_character_map():
    sentencepiece = pytest.importorskip("sentencepiece")
    try:
        library = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc")
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(library.serialized_model_proto())
    except (AttributeError, TypeError, RuntimeError) as e:
        pytest.skip(f"no normaliser in this library: {e}")
    mapping = sentencepieces.CharacterMap(proto.normalizer_spec.precompiled_charsmap)
    for text in ("ﬁne Ａ１ ① ｶﾞ é é 　x", "plain", "㍿ ½ ａｂｃ"):
        data, out, at = text.encode(), [], 0
        while at < len(data):
            size, new = mapping.longest(data, at) or (n := sentencepieces._utf8_length(data[at]), data[at : at + n])
            out.append(new)
            at += size
        assert b"".join(out).decode().split() == library.normalize(text).replace("▁", " ").split()


@pytest.mark.parametrize("squeeze", [True, False])
def test_encoding_through_a_character_map(spark, tmp_path, squeeze):
    """A model whose map is not empty: ids and spans as the library tells them."""
    sentencepiece = pytest.importorskip("sentencepiece")
    from sentencepiece import sentencepiece_model_pb2 as pb

    model, rules = pb.ModelProto(), pb.ModelProto()
    with open(tokenizer_path(PIECES), "rb") as f:
        model.ParseFromString(f.read())
    rules.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto())
    model.normalizer_spec.precompiled_charsmap = rules.normalizer_spec.precompiled_charsmap
    model.normalizer_spec.remove_extra_whitespaces = squeeze
    path = str(tmp_path / "mapped.model")
    with open(path, "wb") as f:
        f.write(model.SerializeToString())
    r = random.Random(2)
    rows = [(k, "".join(r.choice(["a", "é", " ", "  ", "\n", "ｶﾞ", "①", "ﬁ", "e\u0301", "<s>", "\t", "word", "㍿", "½", "Ａ", " the"]) for _ in range(r.randint(0, 25)))) for k in range(400)]
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    for x in sentencepieces.encode(spark.createDataFrame(rows, "doc_id bigint, text string"), path).collect():
        text = rows[x["doc_id"]][1]
        assert x["ids"] == [*library.encode(text), library.eos_id()]
        assert x["span_ends"] == [p.end for p in library.encode(text, return_type="proto").pieces]


def test_token_counts(docs, empty, fixture_rows, tmp_path):
    tokenizers = pytest.importorskip("tokenizers")
    path = tokenizer_path(BYTES)
    tokenizer = tokenizers.Tokenizer.from_file(path)
    want = sorted_rows((r[0], len((r[1] or "").encode()), len(tokenizer.encode(r[1] or "", add_special_tokens=False))) for r in fixture_rows)
    store = str(tmp_path / "store")
    for _ in range(2):
        got = token_cache.cached_counts(docs, path, store).collect()
        assert sorted_rows((x["doc_id"], x["n_bytes"], x["n_tokens"]) for x in got) == want
    stored = docs.sparkSession.read.schema(token_cache.STORE_SCHEMA).parquet(store)
    assert stored.count() == stored.select("content").distinct().count() == len({r[1] or "" for r in fixture_rows})
    assert token_cache.cached_counts(empty, path, store).count() == 0


CONTRACT = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def contract_spans(text):
    """The contract's patterns, left to right, one kind after the other."""

    def good(kind, found):
        d = re.sub("[^0-9]", "", found)
        if kind == "ip":
            return all(int(x) <= 255 for x in found.split("."))
        if kind == "card":
            return 13 <= len(d) <= 19 and sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(reversed(d))) % 10 == 0
        return kind == "email" or 9 <= len(d) <= 15

    return [(k, m.start(), m.end()) for k, p in CONTRACT.items() for m in re.finditer(p, text) if good(k, m[0])]


def test_patterns_against_the_contract():
    r = random.Random(1)
    for _ in range(20_000):
        text = "".join(r.choice(["a", "1", "25", "@", ".", "-", "+", " ", "0", "%", "(", ")", "é", "4539578763621486"]) for _ in range(r.randint(0, 30)))
        assert pii.pattern_spans(text) == contract_spans(text), text


@pytest.mark.parametrize("text", ["1" * 10**6, "a" * 10**6, "+" * 10**6, "1.1.1." + "9" * 5000, "a" * 10**6 + " @", "1 " * 500_000, "a@" * 500_000, "+1" + " " * 10**6, "." * 10**6, "1." * 500_000])
def test_long_texts_take_linear_time(text):
    began = time.process_time()
    found = pii.pattern_spans(text)
    assert time.process_time() - began < 10
    assert len(found) == (len(text) // 8 if text.startswith("1.1.1.1.") else 0)


def test_pii(spark, docs, empty, fixture_rows):
    model = pii.tagger(spark)
    got = pii.find(docs, model).collect()
    assert sorted_rows((x["doc_id"], tuple(tuple(s) for s in x["base"])) for x in got) == sorted_rows((r[0], tuple(contract_spans(r[1] or ""))) for r in fixture_rows)
    assert any(s["kind"] == "email" for x in got for s in x["base"])
    for x in got:
        assert {tuple(s) for s in x["base"]} <= {tuple(s) for s in x["spans"]}
    text = "write to bob.12 (at) mail3 (dot) example (dot) com or call (017) 555-7713 today"
    (base, spans), = pii.spans(model, [text])
    assert not base and {text[a:b] for _, a, b in spans} == {"bob.12 (at) mail3 (dot) example (dot) com", "(017) 555-7713"}
    assert pii.masked("a 10.0.0.1 b", [("ip", 2, 10)]) == "a [IP] b"
    masked = pii.mask(docs, model)
    assert masked.schema == docs.schema and masked.count() == docs.count()
    assert masked.where("text like '%@mail3%'").count() == 0
    assert pii.find(empty, model).count() == 0 and pii.mask(empty, model).count() == 0
    again = pii.tagger(spark)
    assert again is not model and all(np.array_equal(again.p[k], v) for k, v in model.p.items())


def test_query_digests_of_spans(spark, docs, fixture_rows, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op9_pii(spark, str(tmp_path)).collect()
    told = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
    want = [(r[0], *(sum(s[0] == k for s in contract_spans(r[1] or "")) for k in CONTRACT), hashlib.sha256(told(contract_spans(r[1] or "")).encode()).hexdigest()) for r in fixture_rows]
    assert sorted_rows(tuple(x)[:6] for x in got) == sorted_rows(want)


def test_windows_and_stretches_give_one_answer():
    """Characters left out as outside, and windows of long stretches, change no tag of a plain decoding."""
    model, r = pii.trained(), random.Random(9)
    texts = ["".join(pii.labelled_sentence(r)[0] for _ in range(r.randint(1, 4))) for _ in range(30)] + ["12 3. " * 300, ""]
    lengths = np.array([len(t) for t in texts])
    reading = pii.Reading(model, pii.symbols("".join(texts)), lengths)
    reading.read(np.arange(len(reading.done)))
    u = reading.scores(0, len(reading.codes), reading.unread(0, len(reading.codes), slice(None)))
    t = model.p["T"]
    got = pii.model_spans(model, texts, everything=True)
    for k, text in enumerate(texts):
        a = int(lengths[:k].sum())
        score, back = t[0] * 0 - 1e30, []
        score[0] = 0
        for row in u[a : a + len(text)]:
            s = score[:, None] + t
            back.append(s.argmax(0))
            score = s.max(0) + row
        tags = [int((score + t[:, 0]).argmax())]
        for b in reversed(back):
            tags.append(int(b[tags[-1]]))
        tags = tags[::-1][1:]
        want, start = [], None
        for i, tag in enumerate([*tags, 0]):
            if start is not None and (tag == 0 or tag % 2 == 1 or (tag - 1) // 2 != (tags[start] - 1) // 2):
                want.append((pii.KINDS[(tags[start] - 1) // 2], start, i))
                start = None
            if start is None and tag > 0:
                start = i
        assert got[k] == want


def test_reading_near_marks_loses_no_accepted_span(data):
    import duckdb

    model, r = pii.trained(), random.Random(5)
    texts = [x[0] or "" for x in duckdb.sql(f"SELECT text FROM '{data}/documents.parquet'").fetchall()]
    texts += ["".join(pii.labelled_sentence(r)[0] for _ in range(3)) for _ in range(60)]
    filler = "plain words without any sign in them and so on " * 20
    texts += [filler + "dead:beef::cafe " + filler, filler + "a" * 400 + " [at] mail.com " + filler, filler + "call 017 555 7713 or a.b (at) mail (dot) org", "dead:beef::cafe", "", "1"]
    every = pii.model_spans(model, texts, everything=True)
    some = pii.model_spans(model, texts)
    accepted = lambda spans, t: {(k, a, b) for k, a, b in spans if any(c in "0123456789@:([" for c in t[a:b])}
    assert [accepted(x, t) for x, t in zip(every, texts)] == [accepted(x, t) for x, t in zip(some, texts)]
    assert sum(map(len, some)) > 100
    for kind, found in (("ip", "dead:beef::cafe"), ("email", "bob (at) mail (dot) org"), ("email", "a@b.c"), ("phone", "017 555 7713"), ("ip", "1.2.3.4"), ("card", "4539 5787 6362 1486")):
        assert pii._fits(kind, found) and pii.MARKS[pii.symbols(found)].any()


LONG = {
    "letters": "a" * 10**6 + " @", "marks at both ends": "@ " + "b" * 10**6 + " 1", "digits": "1" * 10**6, "at signs": "@" * 10**6, "brackets": "([" * 500_000, "accents": "é" * 10**6 + " 4 " + "ü" * 1000,
    "words": "und so weiter 12 " * 60_000, "many marks far apart": ("a" * 3000 + " @ ") * 300,
}


@pytest.mark.parametrize("text", LONG.values(), ids=LONG)
def test_tagger_reads_long_texts_in_linear_time(text):
    model = pii.trained()
    pii.spans(model, ["warm 1"])
    took = []
    for n in (4, 1):
        part = text[len(text) - len(text) // n :]
        began = time.process_time()
        got = pii.model_spans(model, [part])
        took.append(time.process_time() - began)
        if n == 4:
            inside = lambda found: [x for x in found[0] if pii.MARKS[pii.symbols(part[x[1] : x[2]])].any()]  # noqa: B023, E731
            assert inside(got) == inside(pii.model_spans(model, [part], everything=True))
    assert took[1] < 8 * max(took[0], 0.5) and took[1] < 60


def test_spans_do_not_depend_on_the_texts_beside_them():
    model, r = pii.trained(), random.Random(8)
    texts = ["".join(pii.labelled_sentence(r)[0] for _ in range(r.randint(1, 3))) for _ in range(40)] + ["x" * 900 + " 5", "", "@", "7 " * 400]
    assert pii.model_spans(model, texts) == [pii.model_spans(model, [t])[0] for t in texts]


def test_tagger_gradients_and_accuracy():
    model = pii.Tagger(3)
    r = np.random.default_rng(0)
    x, y = r.integers(0, pii.N_SYMBOLS, (2, 7)), r.integers(0, len(pii.TAGS), (2, 7))
    _, g = model.gradients(x, y)
    for name in ("T", "O", "Wf", "Wb", "E", "bf"):
        flat = np.unravel_index(int(np.argmax(abs(g[name]))), g[name].shape)
        old = model.p[name][flat]
        model.p[name][flat] = old + 1e-2
        up, _ = model.gradients(x, y)
        model.p[name][flat] = old - 1e-2
        down, _ = model.gradients(x, y)
        model.p[name][flat] = old
        assert abs((up - down) / 2e-2 - g[name][flat]) < 2e-2 * max(1, abs(g[name][flat]))
    held = [pii.labelled_sentence(random.Random(k)) for k in range(10_000, 10_150)]
    found = pii.model_spans(pii.trained(), [t for t, _ in held], everything=True)
    hits = sum(len(set(a) & set(b)) for (_, a), b in zip(held, found))
    assert hits >= 0.9 * sum(len(a) for _, a in held) and hits >= 0.9 * sum(map(len, found))

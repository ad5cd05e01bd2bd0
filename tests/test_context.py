"""Budgets, gram lookups, near spellings, layers and memory search against plain Python on small tables."""

import random

import pytest
from pyspark.sql import functions as F

from tarnwork.operators import context, grams, memory, preselect, resolver


def test_clipping_carries_the_rest_of_a_budget_on(spark):
    r = random.Random(3)
    rows, want = [], []
    for q in range(60):
        budget, used, tried = r.randint(0, 120), 0, set()
        for section in range(r.randint(0, 6)):
            open_ = True
            for place in range(r.randint(0, 5)):
                node, cost = r.choice([None, "a", "b", "c", "d"]), r.randint(10, 40)
                rows.append((q, budget, section, place, node, cost, f"t{place}"))
                if not open_ or (node is not None and node in tried):
                    continue
                if node is not None:
                    tried.add(node)
                if used + cost > budget:
                    open_ = False
                    continue
                used += cost
                want.append((q, section, place, node, cost, f"t{place}", used))
    r.shuffle(rows)
    table = spark.createDataFrame(rows, "query_id bigint, budget bigint, section int, place int, node string, cost bigint, text string")
    assert sorted(map(repr, map(tuple, context.clipped(table).collect()))) == sorted(map(repr, want))
    assert context.clipped(table.limit(0)).count() == 0


def test_context_of_one_hit(spark):
    edges = spark.createDataFrame([(1, 2), (3, 2), (4, 2), (2, 1), (2, 5), (9, 2)], "caller bigint, callee bigint")
    symbols = spark.createDataFrame([(k, f"f{k}", f"m{k}.py", 10 * k, k == 9) for k in (1, 2, 3, 4, 5, 9)], "symbol bigint, name string, file string, line int, is_test boolean")
    hits, budgets = spark.createDataFrame([(7, 2, 1)], "query_id bigint, symbol bigint, rank int"), spark.createDataFrame([(7, 200)], "query_id bigint, tokens bigint")
    got = context.enrich(hits, edges, symbols, budgets, context.Limits(3, 3, 2, 2, 25)).orderBy("used").collect()
    assert [x["text"] for x in got] == ["caller: f1 → f2 (m1.py:10)", "caller: f3 → f2 (m3.py:30)", "caller: f4 → f2 (m4.py:40)", "callee: f2 → f5 (m5.py:50)", "test file: m9.py"]  # f1 is a caller already
    assert [x["used"] for x in got] == [10, 20, 30, 40, 50]
    assert [context.limits_for(n).symbols for n in (0, 499, 500, 5_000, 50_000)] == [3, 3, 5, 7, 8]


def test_substrings_by_grams(spark):
    r = random.Random(1)
    word = lambda low, high: "".join(r.choice("abcé_/%") for _ in range(r.randint(low, high)))
    texts = [(k, word(0, 14)) for k in range(150)] + [(150, "aaaaaaaa"), (151, "aaaaaaaa")]
    needles = [word(0, 6) for _ in range(120)] + ["aaaa", "aa", "a", "zz", "abc" * 9]
    got = grams.contained_in(spark.createDataFrame([(x,) for x in needles], "needle string"), spark.createDataFrame(texts, "text_id bigint, text string")).collect()
    assert sorted(map(tuple, got)) == sorted((n, k) for n in set(needles) - {""} for k, t in texts if n in t)
    assert grams.contained_in(spark.createDataFrame([("",)], "needle string"), spark.createDataFrame(texts, "text_id bigint, text string")).count() == 0


def test_only_whole_needles_have_postings(spark, monkeypatch):
    sizes = {}
    monkeypatch.setattr(grams, "stored", lambda df, name: sizes.setdefault(name, df.persist().count()) and df)
    texts = spark.range(3000).select(F.col("id").alias("text_id"), F.format_string("src/m%06d.go", "id").alias("text"))
    needles = spark.range(0, 3000, 3).select(F.format_string("m%06d", "id").alias("needle"))
    assert grams.contained_in(needles, texts).count() == 1000 and sizes["gram-postings"] == 1000


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[-1] + 1))
        row = new
    return row[-1]


@pytest.mark.parametrize("most", [1, 2])
def test_near_spellings(spark, most):
    r = random.Random(most)
    words = ["".join(r.choice("abé") for _ in range(r.randint(0, 6))) for _ in range(90)]
    names = ["".join(r.choice("abé") for _ in range(r.randint(0, 6))) for _ in range(90)]
    got = grams.within_edits(spark.createDataFrame([(x,) for x in words], "word string"), spark.createDataFrame([(x,) for x in names], "name string"), most).collect()
    assert sorted(map(tuple, got)) == sorted((a, b, d) for a in set(words) for b in set(names) if (d := edit_distance(a, b)) <= most)


def test_test_edges_equal_all_pairs(spark):
    r = random.Random(5)
    part = lambda: r.choice(["foo", "bar", "api", "x", "user", "io", "test", "a-b"])
    tests = {f"t/{r.choice(['test_', '', 'A'])}{part()}{r.choice(['_', '-', ''])}{part()}{r.choice(['_test.py', '.spec.ts', '.test.js', '.py'])}" for _ in range(60)}
    code = {f"src/{part()}/{part()}{r.choice(['', 'bar', '_x', '.min'])}.{r.choice(['py', 'ts'])}" for _ in range(60)} | {"src/foobar.py", "src/Foo.py", "lib/fXo.py"}
    tests |= {"t/test_foo_test.py", "t/f_o_test.py"}

    def stem(path):
        name = path.rsplit("/", 1)[-1]
        return name[: name.rindex(".")] if name.rfind(".") > 0 else name

    def clean(s):
        inner = s.removeprefix("test_")
        s = inner[:-5] if inner.endswith("_test") else s
        return s[:-5] if s.endswith((".test", ".spec")) else s

    def like(fragment, path):
        import re

        return re.search("".join("." if c == "_" else re.escape(c.lower()) for c in fragment), path.lower()) is not None

    want = set()
    for t in tests:
        s = stem(t)
        fragments = [x for x in (clean(s), *(p for p in s.split("_") + s.split("-") if len(p) >= 3 and p != "test")) if x]
        for c in code:
            if any(like(f, c) for f in fragments):
                if stem(c) == clean(s):
                    want.add((t, c, "same-basename", 0.9))
                elif clean(s) in c or stem(c) in t:
                    want.add((t, c, "path-overlap", 0.7))
    table = lambda rows: spark.createDataFrame([(x,) for x in rows], "path string")
    assert {tuple(x) for x in resolver.test_edges(table(tests), table(code)).collect()} == want
    assert ("t/test_foo_test.py", "src/foobar.py", "path-overlap", 0.7) in want


def test_layers_add_up(spark):
    requests = spark.createDataFrame([(1, "Parse parse the parser"), (2, "zzz")], "query_id bigint, text string")
    files = ["src/parse.py", "src/lexer.py", "lib\\old.py", "doc/readme.md"]
    summaries = spark.createDataFrame([(f, "nothing here") for f in files], "path string, text string")
    symbols = spark.createDataFrame([("src/lexer.py", "Parse"), ("src/lexer.py", "parse_all"), ("doc/readme.md", "x")], "path string, name string")
    recent = spark.createDataFrame([(f, k) for k, f in enumerate(files)], "path string, indexed_at bigint")
    ranks = lambda *rows: spark.createDataFrame(list(rows), "query_id bigint, path string, rank int")
    lists = {"working-set": ranks((1, "lib\\old.py", 0), (1, "src/parse.py", 4)), "recent": ranks((1, "lib\\old.py", 1)), "pinned": ranks((1, "lib\\old.py", 0)), "dirty-buffer": ranks((1, "src/lexer.py", 2))}
    got = {(x["query_id"], x["path"]): (x["score"], x["layers"]) for x in preselect.preselect(requests, lists, summaries, symbols, recent, 3).collect()}
    # the token parse comes twice, parser and the are tokens of their own
    assert got[1, "src/parse.py"] == (2.0 + 2 * 1.0, "token-search,working-set")
    assert got[1, "lib/old.py"] == (5.0 + 1.75 + 4.0, "pinned,recent,working-set")
    assert got[1, "src/lexer.py"] == (1.5 + 2 * (2.0 + 1.2), "dirty-buffer,token-search")
    assert {k[1] for k in got if k[0] == 2} == {"doc/readme.md", "lib/old.py", "src/lexer.py"} and got[2, "doc/readme.md"] == (0.2, "fallback-indexed")


def test_memory_search_equals_a_scan(spark):
    r = random.Random(2)
    w = "alpha beta gamma delta eps".split()
    entries = [(k, " ".join(r.choice(w) for _ in range(r.randint(0, 7))), r.random(), r.random(), r.randint(0, 3), r.randint(0, 3)) for k in range(80)]
    asked = [(100 + k, r.sample(w, r.randint(0, 3)), r.choice(["al", "eta", "a g", "ps", "alpha be", "nope"])) for k in range(25)]
    table = spark.createDataFrame(entries, "entry bigint, text string, importance double, trust double, positive int, negative int")
    got = memory.search(table, spark.createDataFrame(asked, "query_id bigint, words array<string>, needle string"), 5).collect()
    want = []
    for q, words, needle in asked:
        hits = []
        for e, text, importance, trust, good, bad in entries:
            a, b = int(bool(words) and set(words) <= set(text.split())), int(len(needle) >= 3 and needle in text)
            if a or b:
                hits.append((-round((0.6 * a + 0.4 * b) * (0.5 + 0.3 * importance + 0.2 * trust) + 0.1 * (good - bad) / (good + bad + 1), 9), e, a, b))
        want += [(q, e, a, b, -s, k + 1) for k, (s, e, a, b) in enumerate(sorted(hits)[:5])]
    close = lambda rows: sorted((x[0], x[1], x[2], x[3], round(x[4], 6), x[5]) for x in rows)
    assert close(got) == close(want) and len(want) > 40
    assert memory.search(table, spark.createDataFrame([], "query_id bigint, words array<string>, needle string"), 5).count() == 0


@pytest.mark.parametrize("first", [1, 7, 1 << 14])
def test_memory_search_in_parts_and_within_bounds(spark, monkeypatch, first):
    sizes = {}
    keep = memory.stored
    monkeypatch.setattr(memory, "FIRST", first)
    monkeypatch.setattr(memory, "stored", lambda df, name: (out := keep(df, name), sizes.update({name: max(sizes.get(name, 0), out.count())}))[0])
    entries = spark.range(90).select(F.col("id").alias("entry"), F.concat(F.lit("one two six"), F.when(F.col("id") % 3 == 0, " rare").otherwise("")).alias("text"), ((F.col("id") * 7 % 5) / 4).alias("importance"), F.lit(0.5).alias("trust"), F.lit(0).alias("positive"), F.lit(0).alias("negative"))
    asked = spark.range(100, 140).select(F.col("id").alias("query_id"), F.array(F.lit("two"), F.when(F.col("id") % 2 == 0, "rare").otherwise("six")).alias("words"), F.lit("two s").alias("needle"))
    got = memory.search(entries, asked, 4).collect()
    for q in range(100, 140):
        best = sorted((-(k * 7 % 5), k) for k in range(90) if q % 2 or k % 3 == 0)[:4]
        assert [x["entry"] for x in sorted(got, key=lambda x: x["place"]) if x["query_id"] == q] == [k for _, k in best]
    assert sizes["memory-found"] <= 2 * 4 and sizes["memory-asked"] == 2  # equal requests are answered once


def test_gram_columns(spark):
    row = spark.range(1).select(grams.grams(F.lit("abcd"), 3).alias("a"), grams.grams(F.lit("ab"), 3).alias("b"), F.sort_array(grams.deletions(F.lit("aba"), 1)).alias("c")).first()
    assert (row["a"], row["b"], row["c"]) == (["abc", "bcd"], [], ["aa", "ab", "aba", "ba"])


def test_equal_texts_are_searched_for_once(spark, monkeypatch):
    sizes = {}
    monkeypatch.setattr(preselect, "stored", lambda df, name: sizes.setdefault(name, df.persist().count()) and df)
    asked = [(k, t) for k, t in enumerate(["parse lexer"] * 30 + [None, "zzz"])]
    summaries = spark.createDataFrame([("src/parse.py", "parse"), ("src/lexer.py", "lexer parse")], "path string, text string")
    symbols, recent = spark.createDataFrame([("src/lexer.py", "Parse")], "path string, name string"), spark.createDataFrame([("src/parse.py", 1)], "path string, indexed_at bigint")
    got = preselect.preselect(spark.createDataFrame(asked, "query_id bigint, text string"), {}, summaries, symbols, recent, 5).collect()
    assert sizes["text-hits"] == 5 and sizes["preselect-hits"] == 30 * 5
    assert len({(x["path"], x["score"], x["layers"]) for x in got if x["query_id"] < 30}) == 2 and len(got) == 30 * 2 + 2
    assert {(x["query_id"], x["layers"]) for x in got if x["query_id"] >= 30} == {(30, "fallback-indexed"), (31, "fallback-indexed")}

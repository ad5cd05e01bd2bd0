"""Resolution, test edges, cycles and chunks against plain Python on small tables."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tarnwork.operators import chunks, folds, graph, resolver, retrieval as r
from tarnwork.operators.prefix import running
from tarnwork.plans import catalog
from tarnwork.storage import stored

SYMBOLS = "symbol_id bigint, file string, name string, qname string, params int, receiver string"
REFS = "ref_id bigint, name string, file string, owner string, arg_count int, receiver string"
IMPORTS = "file string, local_name string, imported_name string, module string"


def ladder(ref, symbols, imports):
    """(target, step, confidence, candidates) by walking the steps for one reference."""
    _, name, file, owner, args, hint = ref
    name = name.strip()
    if not name:
        return None
    parts = name.split(".")
    one = lambda ids: ids.pop() if len(ids := set(ids)) == 1 else None
    qualified = lambda q: one(s[0] for s in symbols if s[1] == file and s[3] == q)
    if parts[0] in ("self", "this") and len(parts) > 1:
        member = owner and qualified(f"{owner}.{parts[1]}")
        if member is None:
            return None
        chain = qualified(".".join([owner, *parts[1:]])) if len(parts) > 2 else None
        return (chain, "self_member", 0.95, 1) if chain is not None else (member, "self_member", 1.0, 1)
    if len(parts) > 1:
        if (hit := qualified(name)) is not None:
            return hit, "same_file", 0.95, 1
    else:
        if owner and (hit := qualified(f"{owner}.{name}")) is not None:
            return hit, "same_file", 0.9, 1
        here = [s for s in symbols if s[1] == file and s[2] == name]
        if here:
            return min(here, key=lambda s: (len(s[3] or s[2]), s[0]))[0], "same_file", 0.9, 1
    for i in imports:
        if i[0] == file and i[1] == parts[0]:
            wanted = parts[-1] if len(parts) > 1 else i[2] or name
            if (hit := one(s[0] for s in symbols if s[1] == i[3] and s[2] == wanted)) is not None:
                return hit, "import", 0.85, 1
    strip = lambda p: p[:-3] if p.endswith(".py") else p

    def near(a):
        n = 0
        for x, y in zip(strip(a).split("/"), strip(file).split("/")):
            if x != y:
                break
            n += 1
        return n

    best = lambda pool: max(pool, key=lambda s: (near(s[1]), s[0]))[0]
    less = lambda c, n: c if n <= 3 else c * 3 / n
    if len(parts) > 1:
        bucket = [s for s in symbols if s[3] and s[3].lower().split(".")[-1] == parts[-1].lower()]
        found = [s for s in bucket if s[3].lower() == name.lower() or s[3].lower().endswith("." + name.lower())] if len(bucket) <= resolver.POOL else []
        if found:
            return best(found), "suffix", less(0.65, len(found)), len(found)
    pool = [s for s in symbols if s[2].lower() == parts[-1].lower()]
    pool = pool if len(pool) <= resolver.POOL else []
    n = len(pool)
    modules = [strip(i[3]).replace("/", ".") for i in imports if i[0] == file]
    dotted = lambda s: strip(s[1]).replace("/", ".")
    reach = lambda s: any(m == dotted(s) or m.startswith(dotted(s) + ".") or dotted(s).startswith(m + ".") for m in modules)
    alone = lambda s, c, k: c * k if modules and not reach(s) else c
    if n == 1:
        return pool[0][0], "global_unique", alone(pool[0], 0.75, 0.6), 1
    if args is not None and n > 1:
        fit = [s for s in pool if s[4] == args] or [s for s in pool if s[4] is not None and s[4] > args]
        if fit and len(fit := fit + [s for s in pool if s[4] is None]) < n:
            pool = fit
        if len(pool) == 1:
            return pool[0][0], "fuzzy_arg_count", alone(pool[0], 0.55, 0.5), n
    if hint is not None and len(pool) > 1:
        kept = [s for s in pool if s[5] in (None, hint)]
        if any(s[5] == hint for s in pool) and len(kept) < len(pool):
            pool = kept
        if len(pool) == 1:
            return pool[0][0], "fuzzy_receiver", alone(pool[0], 0.55, 0.5), n
    if len(pool) > 1:
        close = [s for s in pool if reach(s)]
        if len(close) == 1:
            return close[0][0], "fuzzy_import_distance", less(0.40, len(pool)), n
        return (best(close), "fuzzy_import_distance", less(0.30, len(pool)), n) if close else (best(pool), "fuzzy_import_distance", less(0.30, len(pool)) * 0.5, n)
    return None


def test_ladder_against_a_walk(spark, monkeypatch):
    monkeypatch.setattr(resolver, "POOL", 9)
    d = random.Random(4)
    files, names, classes = [f"src/{p}/m{k}.py" for p in ("a", "b/c", "b") for k in range(3)], [f"f{k}" for k in range(14)] + ["Run", "run", "solo"], ["Box", "Net"]
    symbols = []
    for i in range(90):
        name, cls = d.choice(names[:-1]), d.choice([None, *classes])
        symbols.append((i, d.choice(files), name, f"{cls}.{name}" if cls else d.choice([name, None]), d.choice([None, 0, 1, 2]), cls))
    symbols.append((90, "src/b/c/m1.py", "solo", "solo", None, None))
    symbols += [(91, "src/x.py", "two", "A.two", 1, "A"), (92, "src/y.py", "two", "B.two", 2, "B"), (93, "src/x.py", "duo", "A.duo", 1, "A"), (94, "src/y.py", "duo", "B.duo", 1, "B"), (95, files[0], "deep", "Box.f0.deep", 0, None), (96, files[0], "f0", "Box.f0", 0, "Box")]
    imports = [(f, "lib", d.choice([None, "f1"]), d.choice(files)) for f in files[:6]]
    refs = []
    for i in range(400):
        n, c = d.choice([*names, "nothing"]), d.choice([*classes, "lib", "self", "this", "pkg.Box"])
        refs.append((i, d.choice([n, f"{c}.{n}", f" {n} ", n.upper()]), d.choice([*files, "src/x.py", "other/z.py"]), d.choice([None, *classes]), d.choice([None, 0, 1, 2, 3]), d.choice([None, *classes])))
    refs += [(900, "", files[0], None, None, None), (901, "solo", files[0], None, None, None), (902, "two", "q.py", None, 2, None), (903, "duo", "q.py", None, 1, "B"), (904, "self.f0.deep", files[0], "Box", None, None), (905, "two", "src/x.py", None, None, None)]
    got = {x["ref_id"]: x for x in resolver.resolve(spark.createDataFrame(refs, REFS), spark.createDataFrame(symbols, SYMBOLS), spark.createDataFrame(imports, IMPORTS)).collect()}
    steps = Counter()
    for ref in refs:
        want, x = ladder(ref, symbols, imports), got[ref[0]]
        have = None if x["step"] is None else (x["target"], x["step"], x["confidence"], x["candidates"])
        assert have == (None if want is None else (want[0], want[1], round(want[2], 6), want[3])), ref
        steps[x["step"]] += 1
    assert set(steps) == {None, *resolver.STEPS} - {"scope_binding"}


def test_names_of_many_symbols_are_evidence(spark, monkeypatch):
    d = random.Random(6)
    symbols = [(i, f"src/{'abc'[i % 3]}/m{i % 11}.py", "Run" if i % 2 else "run", d.choice(["Box.run", "Net.run", "run"]), d.choice([None, 0, 1, 2]), d.choice([None, "Box", "Net"])) for i in range(700)]
    imports = [(f"src/x{k}.py", "lib", None, f"src/{'abc'[k % 3]}/m{k}.py") for k in range(5)]
    refs = [(i, d.choice(["run", " RUN ", "box.run", "pkg.Net.run", "lib.Run"]), f"src/{d.choice(['a/q', 'x1', 'x3', 'b/c/q'])}.py", None, d.choice([None, 0, 1, 2, 3]), d.choice([None, "Box", "Net"])) for i in range(200)]
    tables = spark.createDataFrame(refs, REFS), spark.createDataFrame(symbols, SYMBOLS), spark.createDataFrame(imports, IMPORTS)
    assert {x["step"] for x in resolver.resolve(*tables).collect()} == {None}  # the limit, when asked for
    got = {x["ref_id"]: x for x in resolver.resolve(*tables, whole=True).collect()}
    monkeypatch.setattr(resolver, "POOL", 1 << 30)
    for ref in refs:
        want, x = ladder(ref, symbols, imports), got[ref[0]]
        assert (x["target"], x["step"], x["confidence"], x["candidates"]) == (want[0], want[1], round(want[2], 6), want[3]), ref


def test_reachability(spark):
    row = spark.range(1).select(*(resolver.reachable(F.lit(f), F.array(F.lit("src.utils.helpers"))).alias(k) for k, f in (("a", "src/utils/helpers.py"), ("b", "src/utils.py"), ("c", "tests/conftest.py"), ("d", "src/utilsXtra.py")))).first()
    assert tuple(row) == (True, True, False, False)


@pytest.mark.parametrize("stem,want", [("test_a", "test_a"), ("a_test", "a"), ("test_a_test", "a"), ("a.test", "a"), ("a.spec", "a"), ("plain", "plain"), ("test_x.spec", "test_x")])
def test_clean_stems(spark, stem, want):
    assert spark.range(1).select(resolver.clean_stem(F.lit(stem))).first()[0] == want


def test_fragments_and_edges(spark):
    assert spark.range(1).select(resolver.stem_fragments(F.lit("test_user-login_flow"))).first()[0] == ["test_user-login_flow", "user-login", "flow", "test_user", "login_flow"]
    paths = lambda *p: spark.createDataFrame([(x,) for x in p], "path string")
    got = resolver.test_edges(paths("t/login_test.py", "t/test_api.py"), paths("src/login.py", "src/login/form.py", "src/api/x.py", "src/other.py")).collect()
    assert {(x["test"], x["code"], x["reason"], x["confidence"]) for x in got} == {("t/login_test.py", "src/login.py", "same-basename", 0.9), ("t/login_test.py", "src/login/form.py", "path-overlap", 0.7)}


def test_cycles_with_witnesses(spark):
    rows = [(1, 2, "b"), (1, 2, "a"), (2, 1, "c"), (3, 4, "d"), (4, 5, "e"), (5, 3, "f"), (5, 6, "g"), (3, 4, "c")]
    imports = stored(spark.createDataFrame(rows, "`from` bigint, `to` bigint, statement string"), "imports")
    members = graph.strong_components(imports.select(F.col("from").alias("caller"), F.col("to").alias("callee")), lambda t: stored(t, "scc"))
    got = sorted(tuple(x) for x in resolver.cycles(members, imports, graph.severity).collect())
    assert got == [(1, 2, "low", 1, 2, "a"), (1, 2, "low", 2, 1, "c"), (3, 3, "medium", 3, 4, "c"), (3, 3, "medium", 4, 5, "e"), (3, 3, "medium", 5, 3, "f")]
    assert {x[0] for x in resolver.cycles(members, imports, graph.severity, 1).select("component").collect()} == {3}


def test_reopened_edges(spark):
    edges = spark.createDataFrame([(1, 10, "a"), (2, 20, "b"), (3, 30, "a")], "ref_id bigint, target bigint, target_file string")
    found = spark.createDataFrame([(1, 11), (2, 99)], "ref_id bigint, target bigint")
    got = sorted(tuple(x) for x in resolver.reopened(edges, spark.createDataFrame([("a",)], "file string"), found).collect())
    assert got == [(1, 11, True), (2, 20, False), (3, None, True)]


def test_chunks_along_symbols(spark):
    text = "\n".join(["", "import x", *(f"a{k}" for k in range(200)), "", "", "end"])
    files = spark.createDataFrame([(1, text)], "file_id bigint, text string")
    symbols = spark.createDataFrame([(1, 3, 170, "big"), (1, 160, 180, "overlap"), (1, 190, 195, "small")], "file_id bigint, start_line int, end_line int, name string")
    got = [(x["chunk_index"], x["start_line"], x["end_line"], x["symbol"], len(x["text"].split("\n"))) for x in chunks.by_symbols(files, symbols).orderBy("chunk_index").collect()]
    assert got == [(0, 1, 2, None, 2), (1, 3, 82, "big", 80), (2, 83, 162, "big", 80), (3, 163, 170, "big", 8), (4, 160, 180, "overlap", 21), (5, 181, 189, None, 9), (6, 190, 195, "small", 6), (7, 196, 205, None, 10)]


@pytest.mark.parametrize("path,query,directory,want", [("src/app/index.ts", "index.ts", False, 1000), ("src/app/index.ts", "INDEX", False, 900), ("src/app/index.ts", "dex", False, 700), ("src/app/index.ts", "app/", False, 500), ("src/app", "app", True, 1025), ("src/app/index.ts", "sai", False, 300 + 100 - 6), ("src/app/index.ts", "zz", False, None)])
def test_fuzzy_paths(spark, path, query, directory, want):
    assert spark.range(1).select(r.fuzzy_path_score(F.lit(path), query, F.lit(directory))).first()[0] == want


def test_running_sums_of_a_hot_group(spark):
    d = random.Random(1)
    rows = [(d.choice([None, "hot", "hot", "hot", "cold"]), k, d.randint(0, 5)) for k in range(600)]
    d.shuffle(rows)
    got = {x["k"]: x["upto"] for x in running(spark.createDataFrame(rows, "g string, k int, v int"), ["g"], ["k"], F.col("v")).collect()}
    total = Counter()
    for g, k, v in sorted(rows, key=lambda x: x[1]):
        total[g] += v
        assert got[k] == total[g]


def test_phrases_need_their_words_in_turn(spark):
    texts = spark.createDataFrame([(1, "a b a b c".split()), (2, "b a".split()), (3, [])], "id bigint, x array<string>")
    phrases = spark.createDataFrame([(7, ["a", "b"]), (8, ["b", "a"]), (9, ["a", "a"])], "query_id bigint, phrase array<string>")
    assert {tuple(x) for x in r.phrase_hits(texts, phrases, ["id"]).collect()} == {(7, 1, 2), (8, 1, 1), (8, 2, 1)}


def test_guarded_page_refuses_a_changed_corpus(spark):
    rows = spark.createDataFrame([(1, 5), (2, 6)], "doc_id bigint, n bigint")
    now = r.revision(rows, "doc_id", "n")
    assert r.guarded_page(rows, now, lambda x: x.limit(1), "doc_id", "n").count() == 1
    with pytest.raises(ValueError, match="CORPUS_CHANGED"):
        r.guarded_page(rows.limit(1), now, lambda x: x, "doc_id", "n")


def test_fingerprints_count_copies(spark):
    rows = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "x"), ("c", "x"), ("c", "x")], "k string, v string")
    got = {x["k"]: x["fingerprint"] for x in folds.fingerprint(rows, "k", "v").collect()}
    assert got["a"] == got["c"] != got["b"]


def test_ladder_query_takes_many_steps(spark, data):
    got = {x["step"]: x["n"] for x in catalog.queries()["grf12_steps_taken"](spark, data).collect()}
    assert {"none", "self_member", "same_file", "import", "suffix", "global_unique", "fuzzy_import_distance"} <= set(got)


@pytest.mark.parametrize("name,want", [("obj.method", "method"), ("obj.ClassName", "constructor"), ("obj.__init__", "constructor"), ("ext", "imported"), ("MyClass", "constructor"), ("local_fn", "local")])
def test_call_shapes(spark, name, want):
    assert spark.range(1).select(graph.call_shape(F.lit(name), F.array(F.lit("ext"), F.lit("other")))).first()[0] == want


def test_equal_phrases_are_looked_up_once(spark):
    texts = spark.range(40).select("id", F.array(*map(F.lit, "a b a b c".split())).alias("x"))
    phrases = spark.range(30).select(F.col("id").alias("query_id"), F.array(F.lit("a"), F.lit("b")).alias("phrase"))
    assert r.phrase_spans(texts, phrases, ["id"]).count() == 40  # and not once for each query
    assert {x["spans"] for x in r.phrase_hits(texts, phrases, ["id"]).collect()} == {2} and r.phrase_hits(texts, phrases, ["id"]).count() == 1200


def test_rounds_store_only_what_they_find(spark):
    rows = []
    edges = spark.createDataFrame([(k + 1, k) for k in range(12)] + [(3, 7)], "caller bigint, callee bigint")
    store = lambda t: rows.append(t.count()) or stored(t, "front")
    got = graph.dirty(edges, spark.createDataFrame([(0,)], "node bigint"), 8, 1 << 60, store)
    assert sorted(map(tuple, got.collect())) == [(k, k) for k in range(9)] and sum(rows) == 9
    assert graph.dirty(edges, spark.createDataFrame([(0,)], "node bigint"), 8, 3, store).count() == 4


def test_pairs_of_equal_keys_in_blocks(spark):
    a = [(k, d) for k, d in enumerate(["hot"] * 40 + ["x", "y", None])]
    b = [(k, d) for k, d in enumerate(["hot"] * 25 + ["y", "y", "z", None])]
    left, right = spark.createDataFrame(a, "a bigint, k string"), spark.createDataFrame(b, "b bigint, k string")
    got = sorted(map(tuple, graph.equal_pairs(left, right, "k", 4).collect()))
    assert got == sorted((x, y) for x, k in a for y, m in b if k is not None and k == m)


def test_pairs_of_stems_are_made_by_many_tasks(spark, data):
    assert catalog.queries()["jon07_test_stems"](spark, data).select(F.spark_partition_id()).distinct().count() > 1


def test_either_match_of_keys_with_several_values(spark):
    d = random.Random(8)
    a = [(d.choice([*range(30), None]), d.choice([*range(6), None])) for _ in range(90)]
    b = [(d.choice([*range(20, 45), None]), d.choice([*range(3, 9), None])) for _ in range(70)]
    got = [tuple(r) for r in graph.either_match(spark.createDataFrame(a, "a bigint, k int"), spark.createDataFrame(b, "b bigint, k int"), 4).collect()]
    assert len(got) == len(set(got))
    assert set(got) == {(x, y) for x, k in a for y, m in b if None not in (x, y) and (x == y or (k is not None and k == m))}


def test_either_match_broadcasts_no_copies(spark, data):
    plan = catalog.queries()["jon05_either_match"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"BroadcastExchange[^\n]*\n[^\n]*Generate explode", plan)  # Spark decides to broadcast by the size before copies are made


def test_few_pairs_are_held_at_once(spark):
    rows = spark.range(3000).select(F.col("id").alias("a"), F.lit("hot").alias("k"))
    pairs = graph.equal_pairs(rows, rows.withColumnRenamed("a", "b"), "k")
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"Generate explode(?:(?!Generate)[\s\S])*Coalesce (?:(?!Exchange)[\s\S])*Generate explode", plan)  # one code for both steps would hold all pairs of two blocks
    assert pairs.count() == 3000**2 == pairs.distinct().count()

"""Name resolution: nine steps from the surest evidence to path distance, the first hit wins.

Tables: symbols (symbol_id, file, name, qname, params, receiver), references (ref_id, name,
file, owner, arg_count, receiver) and imports (file, local_name, imported_name, module).  Each
step is a join whose result is one row a reference; a step that decides alone (``self.x``) masks
the later ones.  A pool of equal names, of any size, meets its references in blocks and comes to a reference as counts
by what the steps ask of a candidate, so arrays stay small; on demand pools of more than ``POOL`` symbols are
no evidence.  The step of lexical scopes gives nothing, as no parser here emits scopes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwork.operators.graph import LEAF_POOL as POOL
from tarnwork.operators.graph import common_segments, met_blocks, penalised
from tarnwork.operators import grams
from tarnwork.storage import stored

#: Confidence of each kind of resolution.
CONFIDENCE = {
    "exact": 1.0,
    "qualified": 0.95,
    "scope_resolved": 0.9,
    "import_resolved": 0.85,
    "global_unique": 0.75,
    "suffix_match": 0.65,
    "fuzzy_signal": 0.55,
    "fuzzy_single": 0.40,
    "fuzzy_multi": 0.30,
}
#: Steps in order, and what an unreachable winner's confidence is multiplied by.
STEPS = ("self_member", "scope_binding", "same_file", "import", "suffix", "global_unique", "fuzzy_arg_count", "fuzzy_receiver", "fuzzy_import_distance")
FAR_UNIQUE, FAR_SIGNAL, FAR_MULTI = 0.6, 0.5, 0.5
#: References and files of a block in which they meet.
MEET = 64
#: Extensions that module paths drop.
EXTENSIONS = r"\.(py|pyi|tsx?|jsx?|mjs|cjs|go|rs|java|c|h|cc|cpp|cxx|hpp)$"


def module_path(path: Column) -> Column:
    return F.regexp_replace(path, EXTENSIONS, "")


def _dotted(path: Column) -> Column:
    return F.replace(module_path(path), F.lit("/"), F.lit("."))


def reachable(file: Column, modules: Column) -> Column:
    """Whether one of the imported modules is the file's, holds it, or lies in it."""
    a = _dotted(file)
    one = lambda m: (a == m) | F.startswith(a, F.concat(m, F.lit("."))) | F.startswith(m, F.concat(a, F.lit(".")))
    return F.exists(modules, one)


def _one(symbols: DataFrame, *by: str) -> DataFrame:
    """(*by, id) where just one symbol has these values."""
    found = symbols.groupBy(*by).agg(F.min("symbol_id").alias("id"), F.max("symbol_id").alias("other"))
    return found.where("id = other").drop("other")


def evidence(symbols: DataFrame, key: Column, most: int | None) -> DataFrame:
    """The symbols with their key, each once; those of a key that more than ``most`` have are left out."""
    keyed = symbols.withColumn("key", key).where("key is not null").dropDuplicates(["key", "symbol_id"])
    if most is None:
        return keyed
    return keyed.join(keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") <= most), "key", "left_semi")


def _same(file: Column, their: Column) -> Column:
    return common_segments(module_path(their), module_path(file))


def pools(asked: DataFrame, symbols: DataFrame, most: int | None = None) -> DataFrame:
    """(ref_id, pool): the symbols of the name ``key`` of each reference (ref_id, key, file, arg_count, hint, modules).

    Symbols that no step tells apart for the reference are one entry (tier, compatible, near, same, id, n): how the
    parameters fit, whether the receiver does, whether the file is imported, how many leading path segments are equal; the last id and how many.
    """
    each = evidence(symbols, F.lower("name"), most).groupBy("key", "file", "params", "receiver").agg(F.max("symbol_id").alias("id"), F.count("*").alias("n"))
    by_file = each.groupBy("key", F.col("file").alias("their_file")).agg(F.collect_list(F.struct("params", "receiver", "id", "n")).alias("kinds"))  # of one file
    met = met_blocks(asked, by_file.select("their_file", "key", "kinds"), "key", MEET)
    rows = met.select(F.explode("own").alias("r"), "their").select("r.*", F.explode("their").alias("t"))
    near = F.coalesce(reachable(F.col("t.their_file"), F.col("modules")), F.lit(False))
    rows = rows.select("ref_id", "arg_count", "hint", near.alias("near"), _same(F.col("file"), F.col("t.their_file")).alias("same"), F.explode("t.kinds").alias("k"))
    params, args = F.col("k.params"), F.col("arg_count")
    tier = F.when(params == args, "exact").when(params > args, "more").when(params.isNull(), "unknown").otherwise("less")
    told = ["tier", "compatible", "near", "same"]
    rows = rows.select("ref_id", tier.alias("tier"), (F.col("k.receiver") == F.col("hint")).alias("compatible"), "near", "same", "k.id", "k.n")
    found = rows.groupBy("ref_id", *told).agg(F.max("id").alias("id"), F.sum("n").alias("n"))
    return found.groupBy("ref_id").agg(F.collect_list(F.struct(*told, "id", "n")).alias("pool"))  # a few of each path depth


def suffixes(asked: DataFrame, symbols: DataFrame, most: int | None = None) -> DataFrame:
    """(ref_id, suffix_id, suffix_n): of references (ref_id, key, file) the nearest symbol whose qualified name is the key or ends with it after a dot, and how many are so."""
    keyed = evidence(symbols, F.lower(F.substring_index("qname", ".", -1)), most)
    parts = F.split(F.lower("qname"), r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size("parts") - 1), lambda i: F.array_join(F.slice("parts", i, F.size("parts")), "."))
    rows = keyed.select("symbol_id", F.col("file").alias("their_file"), parts.alias("parts")).where("size(parts) > 1").select("symbol_id", "their_file", F.explode(ends).alias("key"))
    by_file = rows.groupBy("their_file", "key").agg(F.max("symbol_id").alias("id"), F.count("*").alias("n"))
    met = met_blocks(asked, by_file, "key", MEET).select(F.explode("own").alias("r"), "their").select("r.*", F.explode("their").alias("t"))
    found = met.groupBy("ref_id", _same(F.col("file"), F.col("t.their_file")).alias("same")).agg(F.max("t.id").alias("id"), F.sum("t.n").alias("n"))
    return found.groupBy("ref_id").agg(F.max(F.struct("same", "id"))["id"].alias("suffix_id"), F.sum("n").alias("suffix_n"))


def total(pool: Column) -> Column:
    return F.aggregate(pool, F.lit(0).cast("bigint"), lambda n, x: n + x["n"])


def nearest(pool: Column) -> Column:
    """The symbol whose path shares most leading segments with the file's, of equal ones the last."""
    return F.array_max(F.transform(pool, lambda x: F.struct(x["same"], x["id"])))["id"]


def _hit(step: str, kind: str, id_: Column, *, count: Column | int = 1, confidence: Column | None = None) -> Column:
    c = F.lit(CONFIDENCE[kind]) if confidence is None else confidence
    n = F.lit(count) if isinstance(count, int) else count
    return F.struct(id_.cast("bigint").alias("target"), F.lit(step).alias("step"), F.lit(kind).alias("kind"), F.round(c, 6).alias("confidence"), n.cast("int").alias("candidates"))


def exact_steps(refs: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """``refs`` with self_member, same_file and import: what these steps find for each reference."""
    qualified, named = _one(symbols.where("qname is not null"), "file", "qname"), _one(symbols, "file", "name")
    shortest = symbols.groupBy("file", "name").agg(F.min_by("symbol_id", F.struct(F.length(F.coalesce("qname", "name")), "symbol_id")).alias("id"))

    def found(rows: DataFrame, table: DataFrame, on: str, key: Column, name: str) -> DataFrame:
        t = table.select(F.col("file").alias("t_file"), F.col(on).alias("t_key"), F.col("id").alias(name))
        return rows.withColumn("key", key).join(t, (F.col("file") == F.col("t_file")) & (F.col("key") == F.col("t_key")), "left").drop("key", "t_file", "t_key")

    own, tail = F.col("self"), F.array_join(F.slice("parts", F.lit(2), F.size("parts")), ".")
    rows = found(refs, qualified, "qname", F.when(own, F.concat_ws(".", F.col("owner"), F.get("parts", F.lit(1)))), "member")
    rows = found(rows, qualified, "qname", F.when(own, F.concat_ws(".", F.col("owner"), tail)), "chain")
    rows = found(rows, qualified, "qname", F.when(F.col("dotted"), F.col("name")), "here")
    rows = found(rows, qualified, "qname", F.when(~F.col("dotted"), F.concat(F.col("owner"), F.lit("."), F.col("name"))), "owned")
    rows = found(rows, shortest, "name", F.when(~F.col("dotted"), F.col("name")), "plain")
    member = F.when(F.col("owner").isNotNull() & F.col("member").isNotNull(), F.when((F.size("parts") > 2) & F.col("chain").isNotNull(), _hit("self_member", "qualified", F.col("chain"))).otherwise(_hit("self_member", "exact", F.col("member"))))
    same = F.when(F.col("here").isNotNull(), _hit("same_file", "qualified", F.col("here"))).when(F.coalesce("owned", "plain").isNotNull(), _hit("same_file", "scope_resolved", F.coalesce("owned", "plain")))
    rows = rows.withColumns({"self_member": F.when(own, member), "same_file": same}).drop("member", "chain", "here", "owned", "plain")
    # an import binds the head of a name; what it names is looked up in the module's file
    bound = imports.select(F.col("file").alias("i_file"), F.col("local_name").alias("head_name"), "imported_name", "module").dropDuplicates(["i_file", "head_name"])
    rows = rows.join(bound, (F.col("file") == F.col("i_file")) & (F.get("parts", F.lit(0)) == F.col("head_name")), "left")
    wanted = F.when(F.col("dotted"), F.col("leaf")).otherwise(F.coalesce("imported_name", "name"))
    target = named.select(F.col("file").alias("m_file"), F.col("name").alias("m_name"), F.col("id").alias("imported"))
    rows = rows.withColumn("wanted", wanted).join(target, (F.col("module") == F.col("m_file")) & (F.col("wanted") == F.col("m_name")), "left")
    return rows.withColumn("import", F.when(F.col("imported").isNotNull(), _hit("import", "import_resolved", F.col("imported")))).drop("i_file", "head_name", "imported_name", "module", "wanted", "m_file", "m_name", "imported")


def resolve(refs: DataFrame, symbols: DataFrame, imports: DataFrame, whole: bool = False) -> DataFrame:
    """(ref_id, target, step, kind, confidence, candidates): of every reference, null where nothing fits.

    ``whole``: names are looked up among all symbols that have them; otherwise a name that more than ``POOL`` have is no evidence.
    """
    most = None if whole else POOL
    # equal references are resolved once
    told = ["name", "file", "owner", "arg_count", "receiver"]
    every, refs = refs, stored(refs.groupBy(*told).agg(F.min("ref_id").alias("ref_id")), "distinct-references")
    parts = F.split(F.trim("name"), r"\.")
    rows = refs.select(
        "ref_id", F.trim("name").alias("name"), "file", "owner", "arg_count", F.col("receiver").alias("hint"), parts.alias("parts"), (F.size(parts) > 1).alias("dotted"),
        F.element_at(parts, -1).alias("leaf"), ((F.size(parts) > 1) & F.get(parts, F.lit(0)).isin("this", "self")).alias("self"),
    )
    modules = imports.groupBy(F.col("file").alias("of_file")).agg(F.collect_set(_dotted(F.col("module"))).alias("modules"))  # bounded by a file's imports
    rows = stored(exact_steps(rows, symbols, imports).join(modules, F.col("file") == F.col("of_file"), "left").drop("of_file"), "exact-steps")
    left = rows.where(~F.col("self") & F.col("same_file").isNull() & F.col("import").isNull() & (F.col("name") != ""))
    by_suffix = stored(suffixes(left.where("dotted").select("ref_id", F.lower("name").alias("key"), "file"), symbols, most), "suffixes")
    left = left.join(by_suffix, "ref_id", "left_anti")
    by_name = pools(left.select("ref_id", F.lower("leaf").alias("key"), "file", "arg_count", "hint", "modules"), symbols, most)
    none = F.array().cast(by_name.schema["pool"].dataType)
    rows = rows.join(by_suffix, "ref_id", "left").join(by_name, "ref_id", "left").withColumn("pool", F.coalesce("pool", none))
    # signals narrow the pool; unknown arities and receivers are ruled in, never out
    of_tier = lambda tier: F.filter("pool", lambda x: x["tier"] == tier)
    fit = F.when(F.size(of_tier("exact")) > 0, of_tier("exact")).otherwise(of_tier("more"))
    rows = rows.withColumn("fit", F.when(F.size(fit) > 0, F.concat(fit, of_tier("unknown"))))
    n = total(F.col("pool"))
    rows = rows.withColumn("by_args", F.when(F.col("arg_count").isNotNull() & (n > 1) & (total(F.col("fit")) < n), F.col("fit")).otherwise(F.col("pool")))
    kept = F.filter("by_args", lambda x: F.coalesce(x["compatible"], F.lit(True)))
    positive = F.exists("by_args", lambda x: x["compatible"])
    some = total(F.col("by_args"))
    rows = rows.withColumn("kept", kept).withColumn("by_receiver", F.when(F.col("hint").isNotNull() & (some > 1) & positive & (total(F.col("kept")) < some), F.col("kept")).otherwise(F.col("by_args")))
    rows = rows.withColumns({"n": n, "n_by_args": some, "n_left": total(F.col("by_receiver")), "near": F.filter("by_receiver", lambda x: x["near"])})
    rows = stored(rows.withColumn("n_near", total(F.col("near"))).drop("fit", "kept"), "narrowed-pools")  # else Catalyst repeats each narrowing in all that follow
    only = lambda pool: F.get(pool, F.lit(0))
    far = lambda pool: F.col("modules").isNotNull() & ~only(pool)["near"]
    lone = lambda pool, kind, less: F.lit(CONFIDENCE[kind]) * F.when(far(pool), less).otherwise(1.0)
    first = lambda pool: only(pool)["id"]
    n, left, near = F.col("n"), F.col("n_left"), F.col("n_near")
    multi = penalised(F.lit(CONFIDENCE["fuzzy_multi"]), left)
    distant = F.when(near == 1, _hit(STEPS[8], "fuzzy_multi", first("near"), count=n, confidence=penalised(F.lit(CONFIDENCE["fuzzy_single"]), left)))
    distant = distant.when(near > 1, _hit(STEPS[8], "fuzzy_multi", nearest(F.col("near")), count=n, confidence=multi))
    distant = distant.otherwise(_hit(STEPS[8], "fuzzy_multi", nearest(F.col("by_receiver")), count=n, confidence=multi * FAR_MULTI))
    matches = F.col("suffix_n")
    ladder = [
        F.col("same_file"),
        F.col("import"),
        F.when(matches.isNotNull(), _hit("suffix", "suffix_match", F.col("suffix_id"), count=matches, confidence=penalised(F.lit(CONFIDENCE["suffix_match"]), matches))),
        F.when(n == 1, _hit("global_unique", "global_unique", first("pool"), confidence=lone("pool", "global_unique", FAR_UNIQUE))),
        F.when(F.col("arg_count").isNotNull() & (n > 1) & (F.col("n_by_args") == 1), _hit(STEPS[6], "fuzzy_signal", first("by_args"), count=n, confidence=lone("by_args", "fuzzy_signal", FAR_SIGNAL))),
        F.when(F.col("hint").isNotNull() & (F.col("n_by_args") > 1) & (left == 1), _hit(STEPS[7], "fuzzy_signal", first("by_receiver"), count=n, confidence=lone("by_receiver", "fuzzy_signal", FAR_SIGNAL))),
        F.when(left > 1, distant),
    ]
    won = F.when(F.col("self"), F.col("self_member")).when(F.col("name") != "", F.coalesce(*ladder))
    found = rows.select(F.col("ref_id").alias("first_id"), won.alias("w"))
    first = refs.select(F.col("ref_id").alias("first_id"), *(F.col(c).alias(f"first_{c}") for c in told))
    same = [F.col(c).eqNullSafe(F.col(f"first_{c}")) for c in told]
    return every.join(first.join(found, "first_id"), same).select("ref_id", "w.target", "w.step", "w.kind", "w.confidence", "w.candidates")


def test_stem(path: Column) -> Column:
    """The base name of a path without its last extension."""
    return F.regexp_replace(F.substring_index(path, "/", -1), r"(?<=.)\.[^.]*$", "")


def clean_stem(stem: Column) -> Column:
    """A test's stem without ``test_`` and ``_test`` together, or without ``.test`` or ``.spec``."""
    inner = F.regexp_replace(stem, "^test_", "")
    after = F.when(F.endswith(inner, F.lit("_test")), F.regexp_replace(inner, "_test$", "")).otherwise(stem)
    return F.regexp_replace(after, r"\.(test|spec)$", "")


def stem_fragments(stem: Column) -> Column:
    """What a test's code may be called: the clean stem, then its parts of three letters and more."""
    parts = F.filter(F.concat(F.split(stem, "_"), F.split(stem, "-")), lambda x: (F.length(x) >= 3) & (x != "test"))
    return F.array_distinct(F.filter(F.concat(F.array(clean_stem(stem)), parts), lambda x: x != ""))


def test_edges(tests: DataFrame, code: DataFrame) -> DataFrame:
    """(test, code, reason, confidence) of tables (path): the same base name, or a path that contains the other's stem.

    A pair counts if the code's path has a fragment of the test's stem in it, in any case of ASCII
    letters, with ``_`` for any character.  Both containments are looked up in a gram index, so no
    test is compared with all code.
    """
    t = tests.select(F.col("path").alias("test"), test_stem(F.col("path")).alias("stem"))
    t = stored(t.select("test", clean_stem(F.col("stem")).alias("base"), stem_fragments(F.col("stem")).alias("fragments")), "tests")
    c = stored(code.select(F.col("path").alias("code"), test_stem(F.col("path")).alias("code_stem")), "code")
    as_texts = lambda rows, name: rows.select(F.col(name).alias("text_id"), F.col(name).alias("text"))
    of_base = grams.contained_in(t.select(F.col("base").alias("needle")), as_texts(c, "code")).select(F.col("needle").alias("base"), F.col("text_id").alias("code"))
    of_stem = grams.contained_in(c.select(F.col("code_stem").alias("needle")), as_texts(t, "test")).select(F.col("needle").alias("code_stem"), F.col("text_id").alias("test"))
    met = t.select("test", "base").join(of_base, "base").select("test", "code").unionByName(c.select("code", "code_stem").join(of_stem, "code_stem").select("test", "code")).distinct()
    pairs = met.join(t, "test").join(c, "code").where("test <> code")
    pairs = pairs.where(F.expr("exists(fragments, f -> lower(code) like concat('%', lower(f), '%') escape '\\u0001')"))
    same = F.col("base") == F.col("code_stem")
    return pairs.select("test", "code", F.when(same, "same-basename").otherwise("path-overlap").alias("reason"), F.when(same, 0.9).otherwise(0.7).alias("confidence"))


def cycles(members: DataFrame, imports: DataFrame, severity, most: int = 50) -> DataFrame:
    """(component, size, severity, from, to, statement): the largest cycles with one witness edge for each pair of files.

    ``members`` is (node, component), ``imports`` (from, to, statement).
    """
    sized = members.groupBy("component").agg(F.count("*").alias("size"))
    chosen = sized.orderBy(F.desc("size"), "component").limit(most)  # a report of the largest
    named = members.join(F.broadcast(chosen), "component")
    a, b = (named.select(F.col("node").alias(c), F.col("component").alias(f"{c}_component"), *(["size"] if c == "from" else [])) for c in ("from", "to"))
    inside = imports.join(a, "from").join(b, "to").where("from_component = to_component")
    seen = inside.groupBy(F.col("from_component").alias("component"), "size", "from", "to").agg(F.min("statement").alias("statement"))
    return seen.select("component", "size", severity(F.col("size")).alias("severity"), "from", "to", "statement")


def reopened(edges: DataFrame, changed: DataFrame, found: DataFrame) -> DataFrame:
    """(ref_id, target, fresh): edges into changed files cleared and resolved anew; others stay.

    ``edges`` is (ref_id, target, target_file), ``changed`` (file), ``found`` a new resolution.
    """
    stale = edges.join(changed.select(F.col("file").alias("target_file")), "target_file", "left_semi")
    kept = edges.join(stale.select("ref_id"), "ref_id", "left_anti").select("ref_id", "target", F.lit(False).alias("fresh"))
    return kept.unionByName(stale.select("ref_id").join(found.select("ref_id", "target"), "ref_id", "left").withColumn("fresh", F.lit(True)))


def latest_between(events: DataFrame, recalls: DataFrame) -> DataFrame:
    """(session_id, goal_id, seq, operation, recall_seq): for each end of a goal the last recall after its creation.

    One window over both tables: no range join.
    """
    marks = events.where("operation = 'create'").select("session_id", "seq", "goal_id")
    w = Window.partitionBy("session_id", "goal_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    ends = events.withColumn("created", F.max(F.when(F.col("operation") == "create", F.col("seq"))).over(w)).where("operation in ('complete', 'block') and created is not null")
    both = ends.select("session_id", "seq", "goal_id", "operation", "created", F.lit(None).cast("bigint").alias("recall")).unionByName(
        recalls.select("session_id", "seq", F.lit(None).cast(marks.schema["goal_id"].dataType).alias("goal_id"), F.lit("recall").alias("operation"), F.lit(None).cast("bigint").alias("created"), F.col("seq").alias("recall"))
    )
    last = Window.partitionBy("session_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    told = both.withColumn("recall_seq", F.max("recall").over(last)).where("operation <> 'recall' and recall_seq > created")
    return told.select("session_id", "goal_id", "seq", "operation", "recall_seq")

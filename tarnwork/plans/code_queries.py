"""Queries over code: resolution, chunks along symbols, test edges, cycles and impact."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnwork.functions import text as tx, values
from tarnwork.operators import chunks, graph, resolver, retrieval as r
from tarnwork.plans.graph_queries import REACH_SQL
from tarnwork.plans.registry import query
from tarnwork.sources.tables import CALLS_SQL, STEPPED_SQL, calls, stepped_log, table
from tarnwork.storage import stored


def code_symbols(spark, d) -> DataFrame:
    """(symbol_id, file, name, qname, params, receiver): parts as methods of classes in a tree of files."""
    p = table(spark, d, "part")
    k = F.col("p_partkey")
    cls = F.concat(F.initcap(F.split_part("p_name", F.lit(" "), F.lit(1))), F.initcap("p_type"))
    name = F.concat(F.split_part("p_name", F.lit(" "), F.lit(2)), F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("_"), (k % 500).cast("string"))))
    free = k % 4 == 0
    return p.select(
        k.alias("symbol_id"), F.concat(F.lit("src/"), F.lower("p_type"), F.lit("/m"), F.regexp_extract("p_brand", "[0-9]+", 0), F.lit(".py")).alias("file"), name.alias("name"),
        F.when(free, name).otherwise(F.concat(cls, F.lit("."), name)).alias("qname"), F.when(k % 5 != 0, (k % 4).cast("int")).alias("params"), F.when(~free, cls).alias("receiver"),
    )


def code_references(spark, d) -> tuple[DataFrame, DataFrame]:
    """References, each written after some symbol in one of twelve ways, and the imports of their files."""
    s = code_symbols(spark, d).withColumnRenamed("name", "leaf")
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("ref_id"), ((F.col("c_custkey") * 7 + 5) % 199).alias("symbol_id"))
    way = F.col("ref_id") % 12
    cls = F.coalesce("receiver", F.lit("Nothing"))
    name = (
        F.when(way == 0, F.concat(F.lit("self."), "leaf")).when(way == 1, F.concat(F.lit("this.no_"), "leaf")).when(way == 2, F.col("qname")).when(way == 3, F.col("leaf")).when(way == 4, F.col("leaf"))
        .when(way == 5, F.concat(F.lit("lib."), "leaf")).when(way == 6, F.concat(cls, F.lit("."), "leaf")).when(way == 7, F.col("leaf")).when(way == 8, F.concat(F.lit(" "), "leaf", F.lit(" ")))
        .when(way == 9, F.upper("leaf")).when(way == 10, F.lit("")).otherwise(F.concat("leaf", F.lit("_unknown")))
    )
    near = way.isin(0, 1, 2, 3)
    file = F.when(near, F.col("file")).otherwise(F.concat(F.lit("src/app/r"), (F.col("ref_id") % 37).cast("string"), F.lit(".py")))
    joined = c.join(s, "symbol_id")
    refs = joined.select("ref_id", name.alias("name"), file.alias("file"), F.when(way.isin(0, 1), F.col("receiver")).alias("owner"), F.when(way.isin(7, 8), F.col("params")).alias("arg_count"), F.when(way == 8, F.col("receiver")).alias("receiver"))
    imported = joined.where(way == 5).groupBy(file.alias("file")).agg(F.min_by("file", "ref_id").alias("module"))
    imports = imported.select("file", F.lit("lib").alias("local_name"), F.lit(None).cast("string").alias("imported_name"), "module")
    return refs, imports


@query("grf06_resolution_ladder")
def _(spark, d):
    refs, imports = code_references(spark, d)
    return resolver.resolve(refs, stored(code_symbols(spark, d), "symbols"), stored(imports, "imports"), whole=True)


@query("grf12_steps_taken")
def _(spark, d):
    refs, imports = code_references(spark, d)
    found = resolver.resolve(refs, stored(code_symbols(spark, d), "symbols"), stored(imports, "imports"), whole=True)
    return found.groupBy(F.coalesce("step", F.lit("none")).alias("step")).agg(F.count("*").alias("n"))


PATHS = "CASE doc_id % 6 WHEN 0 THEN 'tests/test_' || source || '_' || doc_id // 6 % 10 || '_test.py' WHEN 1 THEN 'src/' || source || '_' || doc_id // 6 % 10 || '.py' WHEN 2 THEN 'web/' || lang || '-' || doc_id // 6 % 10 || '.spec.ts' WHEN 3 THEN 'web/' || lang || '-' || doc_id // 6 % 10 || '.ts' WHEN 4 THEN 'lib/test_' || doc_id || '.py' ELSE 'lib/' || doc_id || '.py' END"
STEMS_SQL = f"""p AS (SELECT doc_id, {PATHS} AS path FROM documents), s AS (SELECT *, regexp_replace(split_part(path, '/', -1), '\\.[^.]*$', '') AS stem FROM p),
b AS (SELECT *, regexp_replace(CASE WHEN ends_with(regexp_replace(stem, '^test_', ''), '_test') THEN regexp_replace(regexp_replace(stem, '^test_', ''), '_test$', '') ELSE stem END, '\\.(test|spec)$', '') AS base FROM s)"""


def _paths(spark, d):
    k, n = F.col("doc_id") % 6, (F.floor(F.col("doc_id") / 6) % 10).cast("string")
    i = F.col("doc_id").cast("string")
    path = (
        F.when(k == 0, F.concat(F.lit("tests/test_"), "source", F.lit("_"), n, F.lit("_test.py"))).when(k == 1, F.concat(F.lit("src/"), "source", F.lit("_"), n, F.lit(".py")))
        .when(k == 2, F.concat(F.lit("web/"), "lang", F.lit("-"), n, F.lit(".spec.ts"))).when(k == 3, F.concat(F.lit("web/"), "lang", F.lit("-"), n, F.lit(".ts")))
        .when(k == 4, F.concat(F.lit("lib/test_"), i, F.lit(".py"))).otherwise(F.concat(F.lit("lib/"), i, F.lit(".py")))
    )
    return table(spark, d, "documents").select("doc_id", path.alias("path"), k.isin(0, 2, 4).alias("is_test"))


@query("grf23_stem_fragments", f"WITH {STEMS_SQL} SELECT doc_id, list_distinct(list_filter([base] || string_split(stem, '_') || string_split(stem, '-'), lambda x: x = base OR (length(x) >= 3 AND x <> 'test'))) AS fragments FROM b".replace("list_distinct(", "list_sort(list_distinct(").replace("AS fragments", ") AS fragments"))
def _(spark, d):
    return _paths(spark, d).select("doc_id", F.sort_array(resolver.stem_fragments(resolver.test_stem(F.col("path")))).alias("fragments"))


FRAGMENTS_SQL = "list_distinct(list_filter([base] || string_split(stem, '_') || string_split(stem, '-'), lambda x: x = base OR (length(x) >= 3 AND x <> 'test')))"
EDGES_SQL = f"""WITH {STEMS_SQL}, t AS (SELECT DISTINCT path, base, {FRAGMENTS_SQL} AS fragments FROM b WHERE doc_id % 6 IN (0, 2, 4)), c AS (SELECT DISTINCT path, stem FROM b WHERE doc_id % 6 IN (1, 3, 5)),
e AS (SELECT t.path AS test, c.path AS code, t.base = c.stem AS same FROM t, c WHERE (contains(c.path, t.base) OR contains(t.path, c.stem)) AND list_bool_or(list_transform(fragments, lambda f: lower(c.path) LIKE '%' || lower(f) || '%')))"""


def _test_edges(spark, d):
    paths = _paths(spark, d).select("path", "is_test").distinct()
    return resolver.test_edges(paths.where("is_test").select("path"), paths.where("not is_test").select("path"))


@query("grf22_test_edge_scores", EDGES_SQL + " SELECT test, code, CASE WHEN same THEN 'same-basename' ELSE 'path-overlap' END AS reason, CASE WHEN same THEN 0.9 ELSE 0.7 END AS confidence FROM e")
def _(spark, d):
    return _test_edges(spark, d)


@query("grf21_tests_of_files", EDGES_SQL + " SELECT code AS file, list_sort(list(test)) AS tests FROM e GROUP BY code")
def _(spark, d):
    return _test_edges(spark, d).groupBy(F.col("code").alias("file")).agg(F.sort_array(F.collect_list("test")).alias("tests"))


BFS = """, seed AS ({seed}), reach AS (SELECT node, 0 AS hops FROM seed UNION SELECT calls.caller, hops + 1 FROM reach JOIN calls ON calls.callee = reach.node WHERE hops < 16), best AS (SELECT node, min(hops) AS hops FROM reach GROUP BY node)"""


@query("grf20_impact", f"WITH RECURSIVE {CALLS_SQL}" + BFS.format(seed="SELECT DISTINCT callee AS node FROM calls WHERE callee % 50 = 0") + " SELECT best.node, hops, p_size > 25 AS is_test FROM best JOIN part ON p_partkey = best.node")
def _(spark, d):
    edges = stored(calls(spark, d), "calls")
    seeds = edges.select(F.col("callee").alias("node")).where("node % 50 = 0").distinct()
    reached = graph.dirty(edges, seeds, 16, 1 << 60, lambda t: stored(t, "impact"))
    return reached.join(table(spark, d, "part").select(F.col("p_partkey").alias("node"), (F.col("p_size") > 25).alias("is_test")), "node").select("node", F.col("round").alias("hops"), "is_test")


@query("grf26_dirty_closure", f"WITH RECURSIVE {CALLS_SQL}" + BFS.format(seed="SELECT p_partkey AS node FROM part WHERE p_partkey % 50 = 1") + " SELECT node, hops AS round FROM best")
def _(spark, d):
    changed = table(spark, d, "part").where("p_partkey % 50 = 1").select(F.col("p_partkey").alias("node"))
    return graph.dirty(stored(calls(spark, d), "calls"), changed, 16, 1 << 60, lambda t: stored(t, "dirty"))


@query("grf28_reopened_edges")
def _(spark, d):
    refs, imports = code_references(spark, d)
    symbols, imports = stored(code_symbols(spark, d), "symbols"), stored(imports, "imports")
    found = stored(resolver.resolve(refs, symbols, imports, whole=True), "resolved")
    edges = found.where("target is not null").join(symbols.select(F.col("symbol_id").alias("target"), F.col("file").alias("target_file")), "target").select("ref_id", "target", "target_file")
    changed = symbols.where("file like '%/m1_.py'").select("file").distinct()
    after = resolver.resolve(refs, symbols.where("symbol_id % 10 <> 2"), imports, whole=True)
    return resolver.reopened(edges, changed, after)


CYCLES_SQL = f"""WITH RECURSIVE imports AS (SELECT * FROM (SELECT l_partkey AS a, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS b, 'import ' || lpad(CAST(l_orderkey AS VARCHAR), 12, '0') AS statement FROM lineitem) WHERE b IS NOT NULL AND a <> b),
calls AS (SELECT DISTINCT a AS caller, b AS callee FROM imports), {REACH_SQL},
chosen AS (SELECT component, count(*) AS size FROM members GROUP BY component ORDER BY size DESC, component LIMIT 50)
SELECT chosen.component, size, CASE WHEN size >= 5 THEN 'high' WHEN size >= 3 THEN 'medium' ELSE 'low' END AS severity, imports.a AS "from", imports.b AS "to", min(statement) AS statement
FROM imports JOIN members m ON m.node = imports.a JOIN members n ON n.node = imports.b AND m.component = n.component JOIN chosen ON chosen.component = m.component GROUP BY ALL"""


@query("grf17_cycles", CYCLES_SQL)
def _(spark, d):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    lines = table(spark, d, "lineitem").select(F.col("l_partkey").alias("from"), F.lead("l_partkey").over(w).alias("to"), F.concat(F.lit("import "), F.lpad(F.col("l_orderkey").cast("string"), 12, "0")).alias("statement"))
    imports = stored(lines.where("to is not null and from <> to"), "imports")
    members = graph.strong_components(imports.select(F.col("from").alias("caller"), F.col("to").alias("callee")), lambda t: stored(t, "scc"))
    return resolver.cycles(members, imports, graph.severity)


#: Symbols of a text: lines 2 on, some of them longer than a chunk, and a second that may overlap the first.
SPANS_SQL = "l AS (SELECT doc_id AS file_id, string_split(text, chr(10)) AS lines FROM documents), sp AS (SELECT file_id, 2 AS a, least(len(lines), 2 + file_id % 90) AS b, 'alpha' AS name FROM l WHERE len(lines) >= 3 UNION ALL SELECT file_id, 5 + file_id % 50, 5 + file_id % 50 + 100, 'beta' FROM l WHERE len(lines) >= 5 + file_id % 50)"
CHUNKS_SQL = f"""WITH {SPANS_SQL},
o AS (SELECT sp.*, lines, len(lines) AS n, coalesce(lag(b) OVER w, 0) AS covered, row_number() OVER w AS i, lead(a) OVER w IS NULL AS final FROM sp JOIN l USING (file_id) WINDOW w AS (PARTITION BY file_id ORDER BY a, b, name)),
gaps AS (SELECT file_id, i, 0 AS part, covered + 1 AS start_line, a - 1 AS end_line, NULL AS symbol, array_to_string(lines[covered + 1:a - 1], chr(10)) AS text FROM o WHERE covered + 1 <= a - 1 UNION ALL SELECT file_id, i + 1, 0, b + 1, n, NULL, array_to_string(lines[b + 1:n], chr(10)) FROM o WHERE final AND b + 1 <= n),
body AS (SELECT file_id, i, 1 AS part, a AS start_line, b AS end_line, name AS symbol, array_to_string(lines[a:least(b, n)], chr(10)) AS text FROM o WHERE least(b, n) - a + 1 <= 80
  UNION ALL SELECT file_id, i, 1 + k, a + k, least(a + k + 79, least(b, n)), name, array_to_string(lines[a + k:least(a + k + 79, least(b, n))], chr(10)) FROM (SELECT *, unnest(range(0, CAST(least(b, n) - a + 1 AS BIGINT), 80)) AS k FROM o WHERE least(b, n) - a + 1 > 80)),
every AS (SELECT * FROM gaps WHERE regexp_replace(text, '\\s', '', 'g') <> '' UNION ALL SELECT * FROM body)
SELECT file_id, row_number() OVER (PARTITION BY file_id ORDER BY i, part) - 1 AS chunk_index, start_line, end_line, symbol, md5(text) AS digest FROM every"""


@query("prj15_symbol_chunks", CHUNKS_SQL)
def _(spark, d):
    files = table(spark, d, "documents").select(F.col("doc_id").alias("file_id"), "text")
    n, k = F.size(F.split("text", "\n")), F.col("file_id")
    one = files.where(n >= 3).select("file_id", F.lit(2).alias("start_line"), F.least(n, (2 + k % 90).cast("int")).alias("end_line"), F.lit("alpha").alias("name"))
    two = files.where(n >= 5 + k % 50).select("file_id", (5 + k % 50).cast("int").alias("start_line"), (105 + k % 50).cast("int").alias("end_line"), F.lit("beta").alias("name"))
    made = chunks.by_symbols(files, one.unionByName(two))
    return made.select("file_id", "chunk_index", "start_line", "end_line", "symbol", F.md5("text").alias("digest"))


CALL_IDS = f"WITH {STEPPED_SQL}, k AS (SELECT s.*, (s.event_id % 4) AS call_id FROM stepped s), c AS (SELECT session_id, turn, call_id, seq FROM k WHERE type = 'assistant/chunk'), x AS (SELECT session_id, turn, call_id, seq FROM k WHERE type = 'tool/result')"


@query("jon10_call_by_id", CALL_IDS + " SELECT x.session_id, x.turn, x.call_id, x.seq, c.seq AS call_seq FROM x ASOF LEFT JOIN c ON x.session_id = c.session_id AND x.turn = c.turn AND x.call_id = c.call_id AND x.seq > c.seq")
def _(spark, d):
    rows = stepped_log(spark, d).withColumn("call_id", F.col("event_id") % 4)
    w = Window.partitionBy("session_id", "turn", "call_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.where("type in ('assistant/chunk', 'tool/result')").withColumn("call_seq", F.max(F.when(F.col("type") == "assistant/chunk", F.col("seq"))).over(w))
    return rows.where("type = 'tool/result'").select("session_id", "turn", "call_id", "seq", "call_seq")


@query("jon11_importers", f"WITH {CALLS_SQL} SELECT p_partkey AS file, count(*) AS importers, min(caller) AS first FROM part JOIN calls ON callee = p_partkey GROUP BY p_partkey")
def _(spark, d):
    found = table(spark, d, "part").select(F.col("p_partkey").alias("callee")).join(calls(spark, d), "callee")
    return found.groupBy(F.col("callee").alias("file")).agg(F.count("*").alias("importers"), F.min("caller").alias("first"))


GOALS_SQL = "g AS (SELECT session_id, seq, event_id % 3 AS goal_id, CASE type WHEN 'turn/start' THEN 'create' WHEN 'tool/result' THEN 'complete' WHEN 'assistant/message' THEN 'block' END AS operation FROM stepped WHERE type IN ('turn/start', 'tool/result', 'assistant/message')), rec AS (SELECT session_id, seq FROM stepped WHERE type = 'assistant/chunk')"


@query("jon13_latest_recall", f"WITH {STEPPED_SQL}, {GOALS_SQL}, e AS (SELECT g.*, (SELECT max(c.seq) FROM g c WHERE c.session_id = g.session_id AND c.goal_id = g.goal_id AND c.operation = 'create' AND c.seq < g.seq) AS created FROM g WHERE operation <> 'create'), x AS (SELECT e.*, (SELECT max(rec.seq) FROM rec WHERE rec.session_id = e.session_id AND rec.seq < e.seq) AS recall_seq FROM e) SELECT session_id, goal_id, seq, operation, recall_seq FROM x WHERE recall_seq > created")
def _(spark, d):
    log = stepped_log(spark, d)
    operation = F.when(F.col("type") == "turn/start", "create").when(F.col("type") == "tool/result", "complete").when(F.col("type") == "assistant/message", "block")
    goals = log.select("session_id", "seq", (F.col("event_id") % 3).alias("goal_id"), operation.alias("operation")).where("operation is not null")
    return resolver.latest_between(goals, log.where("type = 'assistant/chunk'").select("session_id", "seq"))


PREVIEW = "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN left(props::VARCHAR, CAST(5 + event_id % 7 AS INTEGER)) ELSE left(CAST(event_id * 1000 AS VARCHAR), 3) || CASE WHEN event_id % 3 = 0 THEN '.' ELSE '' END END AS preview FROM events"


@query("jsn03_json_prefix", f"SELECT event_id, preview AS value, json_valid(preview) AS parsed FROM ({PREVIEW})")
def _(spark, d):
    e = table(spark, d, "events")
    odd = F.concat(F.left((F.col("event_id") * 1000).cast("string"), F.lit(3)), F.when(F.col("event_id") % 3 == 0, ".").otherwise(""))
    rows = e.select("event_id", F.when(F.col("event_id") % 2 == 0, F.left("props", (5 + F.col("event_id") % 7).cast("int"))).otherwise(odd).alias("preview"))
    return rows.select("event_id", F.col("preview").alias("value"), values.whole_json("preview").alias("parsed"))


@query("srt04_final_top", "SELECT source, doc_id, n_chars FROM (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS p FROM documents) WHERE p <= 7")
def _(spark, d):
    return r.top(table(spark, d, "documents").select(F.col("source").alias("query_id"), "doc_id", "n_chars"), "n_chars", 7).select(F.col("query_id").alias("source"), "doc_id", "n_chars")


@query("srt12_tiered_top", "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS p, count(*) OVER (PARTITION BY source) AS n FROM documents) WHERE p <= CASE WHEN n < 500 THEN 5 WHEN n < 5000 THEN 10 WHEN n < 50000 THEN 15 ELSE 20 END")
def _(spark, d):
    docs = table(spark, d, "documents").select(F.col("source").alias("query_id"), "doc_id", "n_chars")
    sizes = docs.groupBy("query_id").agg(F.count("*").alias("n"))
    most = r.TIERS[-1][1]
    return r.top(docs, "n_chars", most).join(sizes, "query_id").where(F.col("place") <= r.default_hits(F.col("n"))).select(F.col("query_id").alias("source"), "doc_id")


@query("srt09_guarded_page", "SELECT doc_id, n_chars, (SELECT count(*) || ':' || sum(n_chars) || ':' || max(doc_id) FROM documents) AS revision FROM documents ORDER BY n_chars DESC, doc_id LIMIT 20")
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    return r.guarded_page(docs, r.revision(docs, "doc_id", "n_chars"), lambda rows: r.page(rows, "n_chars", "doc_id", 19), "doc_id", "n_chars")


PHRASE_SQL = r"""WITH t AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS x FROM conversations),
q AS (SELECT conv_id AS query_id, list_slice(x, 2, 3) AS p FROM t WHERE conv_id % 50 = 0 AND turn = 0 AND len(x) >= 3),
m AS (SELECT query_id, conv_id, turn, len(x) AS n, len(list_filter(range(1, len(x)), lambda i: x[i] = p[1] AND x[i + 1] = p[2])) AS spans FROM t, q)
SELECT query_id, conv_id, turn, spans FROM m WHERE spans > 0"""


@query("rnk28_phrase_queries", PHRASE_SQL)
def _(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", tx.unicode_tokens("text").alias("x"))
    phrases = c.where("conv_id % 50 = 0 and turn = 0 and size(x) >= 3").select(F.col("conv_id").alias("query_id"), F.slice("x", F.lit(2), F.lit(2)).alias("phrase"))
    return r.phrase_hits(c, phrases, ["conv_id", "turn"])


@query("rnk29_unicode_tokens", r"SELECT conv_id, turn, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS tokens FROM conversations")
def _(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", tx.unicode_tokens("text").alias("tokens"))

"""Lineage and graph queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnwork.operators import graph, lineage
from tarnwork.plans.registry import query
from tarnwork.sources.tables import CALLS_SQL, SESSIONS_SQL, calls, sessions, table
from tarnwork.storage import stored

CALLS = f"WITH {CALLS_SQL} "
CALLS_R = f"WITH RECURSIVE {CALLS_SQL}, "
CHUNKED = "lines AS (SELECT doc_id AS file_id, CAST(unnest(range(1, len(string_split(text, chr(10))) + 1)) AS BIGINT) AS line FROM documents), chunks AS (SELECT file_id, line AS start_line, line // 3 AS chunk FROM lines WHERE line % 3 = 2)"


def _nodes(spark, d):
    return sessions(spark, d).select("id", F.col("parent_session").alias("parent"), F.col("created_at").alias("created"))


@query("grf01_ancestors", f"WITH RECURSIVE {SESSIONS_SQL}, up AS (SELECT s.id, s.parent_session AS ancestor, 1 AS depth FROM sessions s WHERE s.parent_session IS NOT NULL UNION ALL SELECT u.id, n.parent_session, u.depth + 1 FROM up u JOIN sessions n ON n.id = u.ancestor WHERE n.parent_session IS NOT NULL) SELECT id, ancestor, depth FROM up")
def _(spark, d):
    nodes = _nodes(spark, d)
    return lineage.ancestors(nodes, nodes)


@query("grf01_missing_parents", f"WITH {SESSIONS_SQL}, kept AS (SELECT * FROM sessions WHERE id % 5 <> 0) SELECT id, parent_session AS parent FROM kept WHERE parent_session IS NOT NULL AND parent_session NOT IN (SELECT id FROM kept)")
def _(spark, d):
    return lineage.missing_parents(_nodes(spark, d).where("id % 5 <> 0"))


@query("grf01_roots", f"WITH RECURSIVE {SESSIONS_SQL}, kept AS (SELECT id, CASE WHEN id % 1000 = 7 THEN id ELSE parent_session END AS parent FROM sessions WHERE id % 11 <> 0), up AS (SELECT id, id AS tip, 0 AS depth FROM kept UNION ALL SELECT u.id, n.parent, u.depth + 1 FROM up u JOIN kept n ON n.id = u.tip WHERE n.parent IN (SELECT id FROM kept) AND u.depth < 200), last AS (SELECT id, max_by(tip, depth) AS tip, max(depth) AS depth FROM up GROUP BY id) SELECT last.id, CASE WHEN depth < 200 THEN tip END AS root, CASE WHEN depth < 200 THEN depth END AS depth, depth < 200 AND kept.parent IS NOT NULL AS missing, depth = 200 AS cyclic FROM last JOIN kept ON kept.id = last.tip")
def _(spark, d):
    kept = _nodes(spark, d).where("id % 11 <> 0").withColumn("parent", F.when(F.col("id") % 1000 == 7, F.col("id")).otherwise(F.col("parent")))
    return lineage.roots(kept)


@query("grf02_descendants", f"WITH RECURSIVE {SESSIONS_SQL}, down AS (SELECT id AS root, id, 0 AS depth, lpad(created_at::VARCHAR, 16, '0') || ':' || lpad(id::VARCHAR, 12, '0') AS path FROM sessions WHERE parent_session IS NULL UNION ALL SELECT root, c.id, d.depth + 1, d.path || '/' || lpad(c.created_at::VARCHAR, 16, '0') || ':' || lpad(c.id::VARCHAR, 12, '0') FROM down d JOIN sessions c ON c.parent_session = d.id) SELECT root, id, depth, path FROM down")
def _(spark, d):
    nodes = _nodes(spark, d)
    return lineage.descendants(nodes, nodes.where("parent is null"))


@query("grf05_source_links", "SELECT conv_id AS session_id, turn AS seq, unnest([turn - 1, turn - 2]) AS source_seq FROM conversations WHERE turn >= 2")
def _(spark, d):
    c = table(spark, d, "conversations").where("turn >= 2").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), F.array(F.col("turn") - 1, F.col("turn") - 2).alias("sources"))
    return lineage.source_links(c)


@query("grf04_replacement_chain", "WITH RECURSIVE up AS (SELECT conv_id, turn, turn - 1 AS replaced, 1 AS depth FROM conversations WHERE turn >= 1 UNION ALL SELECT conv_id, turn, replaced - 1, depth + 1 FROM up WHERE replaced >= 1) SELECT conv_id AS session_id, turn AS seq, max(depth) AS depth, min(replaced) AS origin FROM up GROUP BY conv_id, turn")
def _(spark, d):
    c = table(spark, d, "conversations")
    key = F.col("conv_id") * 1000
    nodes = c.select((key + F.col("turn")).alias("id"), F.when(F.col("turn") >= 1, key + F.col("turn") - 1).alias("parent"))
    up = lineage.roots(nodes).where("depth > 0")
    return up.select(F.floor(F.col("id") / 1000).alias("session_id"), (F.col("id") % 1000).alias("seq"), "depth", (F.col("root") % 1000).alias("origin"))


@query("grf13_candidate_penalty", "SELECT n, round(CASE WHEN n <= 3 THEN 0.5 ELSE 0.5 * 3 / n END, 6) AS confidence FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) GROUP BY n")
def _(spark, d):
    n = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).select("n").distinct()
    return n.select("n", F.round(graph.penalised(F.lit(0.5), F.col("n")), 6).alias("confidence"))


@query("grf14_path_distance", "WITH p AS (SELECT page_id, string_split(url, '/') AS u, string_split(lead(url) OVER (ORDER BY page_id), '/') AS v FROM pages) SELECT page_id, len(list_filter(range(1, len(u) + 1), lambda i: list_slice(u, 1, i) = list_slice(v, 1, i))) AS same FROM p WHERE v IS NOT NULL")
def _(spark, d):
    pages = table(spark, d, "pages")
    nxt = pages.select((F.col("page_id") - 1).alias("page_id"), F.col("url").alias("next"))
    return pages.join(nxt, "page_id").select("page_id", graph.common_segments(F.col("url"), F.col("next")).alias("same"))


@query("grf15_call_kinds", "SELECT p_partkey, CASE WHEN p_size > 25 AND regexp_matches(p_name, '^[A-Z]') THEN 'constructor' WHEN p_size > 25 THEN 'method' WHEN p_size > 12 THEN 'imported' ELSE 'local' END AS kind FROM part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", graph.call_kind(F.when(F.col("p_size") > 25, F.lit("r")), F.col("p_name"), F.col("p_size") > 12).alias("kind"))


REACH_SQL = "reach AS (SELECT caller AS a, callee AS b FROM calls UNION SELECT a, callee FROM reach JOIN calls ON caller = b), members AS (SELECT x.a AS node, min(x.b) AS component FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a GROUP BY x.a)"


@query("grf16_strong_components", CALLS_R + REACH_SQL + " SELECT node, component FROM members")
def _(spark, d):
    return graph.strong_components(calls(spark, d), lambda t: stored(t, "scc"))


@query("grf17_mutual_cycles", CALLS + "SELECT a.caller AS low, a.callee AS high FROM calls a JOIN calls b ON a.caller = b.callee AND a.callee = b.caller WHERE a.caller < a.callee")
def _(spark, d):
    return graph.mutual(calls(spark, d))


@query("grf18_dead_code", CALLS + "SELECT p_partkey AS node, p_name AS name FROM part WHERE p_partkey NOT IN (SELECT callee FROM calls WHERE (caller + callee) % 29 = 0) AND p_partkey NOT IN (SELECT s_suppkey FROM supplier) AND NOT regexp_matches(p_name, '^(main|test|large)') ORDER BY p_partkey LIMIT 100")
def _(spark, d):
    nodes = table(spark, d, "part").select(F.col("p_partkey").alias("node"), F.col("p_name").alias("name"))
    outside = table(spark, d, "supplier").select(F.col("s_suppkey").alias("node"))
    return graph.dead(nodes, calls(spark, d).where("(caller + callee) % 29 = 0"), "^(main|test|large)", outside).orderBy("node").limit(100)  # a report


@query("grf19_callers_two_hops", CALLS + ", one AS (SELECT DISTINCT caller AS node FROM calls WHERE callee IN (3, 9) AND caller NOT IN (3, 9)), two AS (SELECT DISTINCT caller AS node FROM calls WHERE callee IN (SELECT node FROM one) AND caller NOT IN (3, 9) AND caller NOT IN (SELECT node FROM one)) SELECT node, 0 AS hops FROM (VALUES (3), (9)) t(node) UNION ALL SELECT node, 1 FROM one UNION ALL SELECT node, 2 FROM two")
def _(spark, d):
    seeds = spark.range(2).select((F.col("id") * 6 + 3).alias("node"))
    return graph.within(calls(spark, d), seeds, 2, "caller")


@query("jon03_line_to_chunk", f"WITH {CHUNKED} SELECT l.file_id, l.line, c.chunk FROM lines l ASOF JOIN chunks c ON l.file_id = c.file_id AND l.line >= c.start_line")
def _(spark, d):
    lines = table(spark, d, "documents").select(F.col("doc_id").alias("file_id"), F.explode(F.sequence(F.lit(1).cast("bigint"), F.size(F.split("text", "\n")).cast("bigint"))).alias("line"))
    chunks = lines.where("line % 3 = 2").select("file_id", F.col("line").alias("start_line"), F.floor(F.col("line") / 3).alias("chunk"))
    return graph.as_of_chunk(lines, chunks)


@query("jon06_both_directions", CALLS + "SELECT seed, other, side FROM (SELECT caller AS seed, callee AS other, 'out' AS side FROM calls UNION ALL SELECT callee, caller, 'in' FROM calls)")
def _(spark, d):
    e = calls(spark, d)
    out = e.select(F.col("caller").alias("seed"), F.col("callee").alias("other"), F.lit("out").alias("side"))
    return out.unionByName(e.select(F.col("callee").alias("seed"), F.col("caller").alias("other"), F.lit("in").alias("side")))


@query("agg16_degrees", CALLS + "SELECT node, sum(i) AS inward, sum(o) AS outward FROM (SELECT caller AS node, 0 AS i, 1 AS o FROM calls UNION ALL SELECT callee, 1, 0 FROM calls) GROUP BY node")
def _(spark, d):
    return graph.degrees(calls(spark, d))


@query("rnk24_graph_score", CALLS + ", deg AS (SELECT node, sum(i) AS i, sum(o) AS o FROM (SELECT caller AS node, 0 AS i, 1 AS o FROM calls UNION ALL SELECT callee, 1, 0 FROM calls) GROUP BY node) SELECT node, round(least(ln(i + o + 1.0) / 10 + least(i, 10) / 100, 0.4), 6) AS score FROM deg")
def _(spark, d):
    from tarnwork.operators.retrieval import graph_score

    return graph.degrees(calls(spark, d)).select("node", F.round(graph_score(F.col("inward"), F.col("outward"), F.col("inward")), 6).alias("score"))

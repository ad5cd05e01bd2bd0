"""Scans, sinks, filters, projections, folds and windows over logs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tarnwork.functions import text as tx
from tarnwork.operators import folds, log, predicates as p
from tarnwork.plans.registry import query
from tarnwork.sources.tables import CONVERSATION_SQL, LOG_SQL, SESSIONS_SQL, STEPPED_SQL, conversation_log, millis, session_log, sessions, stepped_log, table

LOG = f"WITH {LOG_SQL} "
STEPPED = f"WITH {STEPPED_SQL} "
CLOG = f"WITH {CONVERSATION_SQL} "
SESS = f"WITH {SESSIONS_SQL} "


# --- scans and sinks ------------------------------------------------------------------------


@query("src01_full_scan", "SELECT conv_id AS session_id, turn AS seq, text FROM conversations WHERE conv_id = 7")
def _(spark, d):
    return conversation_log(spark, d).where("session_id = 7").orderBy("seq").select("session_id", "seq", "text")


@query("src02_suffix_scan", LOG + "SELECT session_id, seq, type FROM log WHERE session_id = 8 AND seq >= 10")
def _(spark, d):
    return log.suffix(session_log(spark, d).where("session_id = 8"), 10).select("session_id", "seq", "type")


@query("src03_tail_scan", LOG + "SELECT session_id, seq, type FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) AS r FROM log) WHERE r <= 3")
def _(spark, d):
    return log.tail(session_log(spark, d), 3).select("session_id", "seq", "type")


@query("src04_packed_predecessors", LOG + "SELECT session_id, seq, type FROM log WHERE session_id = 8 AND seq BETWEEN 5 AND 40 AND type IN ('assistant/chunk', 'tool/result')")
def _(spark, d):
    return session_log(spark, d).where("session_id = 8 and seq between 5 and 40").where(p.event_type(["assistant/chunk", "tool/result"])).select("session_id", "seq", "type")


@query("src05_session_list", SESS + "SELECT id, created_at, cwd, parent_session FROM sessions")
def _(spark, d):
    return sessions(spark, d).select("id", "created_at", "cwd", "parent_session")


@query("src06_point_lookup", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey = 42")
def _(spark, d):
    return table(spark, d, "orders").where("o_orderkey = 42").select("o_orderkey", "o_custkey", "o_orderstatus")


@query("src07_inspect_gaps", f"WITH {LOG_SQL}, torn AS (SELECT * FROM log WHERE NOT (session_id % 5 = 0 AND seq = 4)) SELECT session_id, min(expected) AS expected FROM (SELECT session_id, seq, row_number() OVER (PARTITION BY session_id ORDER BY seq) - 1 AS expected FROM torn) WHERE seq <> expected GROUP BY session_id")
def _(spark, d):
    return log.broken(session_log(spark, d).where("not (session_id % 5 = 0 and seq = 4)"))


SNAPSHOT = "SELECT coalesce(b.doc_id, a.doc_id) AS doc_id, CASE WHEN b.doc_id IS NULL THEN 'added' WHEN a.doc_id IS NULL THEN 'removed' WHEN a.h <> b.h THEN 'modified' END AS change FROM (SELECT doc_id, md5(text) AS h FROM documents WHERE doc_id % 10 <> 3) b FULL JOIN (SELECT doc_id, md5(CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END) AS h FROM documents WHERE doc_id % 10 <> 4) a ON a.doc_id = b.doc_id WHERE b.doc_id IS NULL OR a.doc_id IS NULL OR a.h <> b.h"


@query("src08_snapshot_changes", SNAPSHOT)
def _(spark, d):
    docs = table(spark, d, "documents")
    before = docs.where("doc_id % 10 <> 3").select("doc_id", F.md5("text").alias("h"))
    after = docs.where("doc_id % 10 <> 4").select("doc_id", F.md5(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("h"))
    return log.snapshot_changes(before, after, "doc_id", "h")


@query("src13_unit_load", "SELECT n_nationkey AS k, n_name AS v FROM nation")
def _(spark, d):
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("v"))


@query("src14_json_unit_parse", "SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k FROM events WHERE CAST(props->>'$.k' AS BIGINT) >= 50")
def _(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k")).where("k >= 50")


@query("src15_file_grep", "SELECT page_id, url FROM pages WHERE regexp_matches(html, '<nav>.*<li>', 's') AND contains(lower(html), 'charset') AND url LIKE '%/en/%'")
def _(spark, d):
    return table(spark, d, "pages").where(F.col("html").rlike("(?s)<nav>.*<li>") & F.contains(F.lower("html"), F.lit("charset")) & F.col("url").like("%/en/%")).select("page_id", "url")


@query("snk02_upsert_latest", "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS r FROM orders) WHERE r = 1")
def _(spark, d):
    return log.latest(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], "o_orderkey")


@query("snk03_delete_suffix", LOG + "SELECT session_id, seq FROM log WHERE NOT (session_id % 2 = 0 AND seq >= 20)")
def _(spark, d):
    return session_log(spark, d).where("not (session_id % 2 = 0 and seq >= 20)").select("session_id", "seq")


@query("snk05_kv_changes", "SELECT n_nationkey AS k, n_name AS v FROM nation WHERE n_nationkey % 5 NOT IN (1, 2) UNION ALL SELECT n_nationkey, upper(n_name) || '2' FROM nation WHERE n_nationkey % 5 = 1")
def _(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("v"))
    old = n.where("k % 5 = 1").select("k", F.lit("put").alias("op"), F.lit("x").alias("v"), F.lit(1).alias("at"))
    new = n.where("k % 5 = 1").select("k", F.lit("put").alias("op"), F.concat(F.upper("v"), F.lit("2")).alias("v"), F.lit(2).alias("at"))
    gone = n.where("k % 5 = 2").select("k", F.lit("delete").alias("op"), F.lit(None).cast("string").alias("v"), F.lit(1).alias("at"))
    return log.apply_changes(n, old.unionByName(new).unionByName(gone), "k")


@query("snk07_redacted_export", "SELECT doc_id, regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+', '[email]', 'g'), '[0-9]{13,19}', '[card]', 'g') AS text FROM documents")
def _(spark, d):
    t = F.regexp_replace(F.regexp_replace("text", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+", "[email]"), "[0-9]{13,19}", "[card]")
    return table(spark, d, "documents").select("doc_id", t.alias("text"))


# --- filters ----------------------------------------------------------------------------------


@query("flt01_session_clauses", SESS + "SELECT id FROM sessions WHERE (cwd IN ('/f') OR cwd IS NULL) AND created_at BETWEEN 757382400000 AND 978307200000 AND parent_session IS NULL AND live")
def _(spark, d):
    clauses = [p.one_of("cwd", ["/f", None]), p.closed_range("created_at", 757382400000, 978307200000), p.one_of("parent_session", [None]), p.available(["live"])]
    return sessions(spark, d).where(p.every(clauses)).select("id")


@query("flt02_event_clauses", LOG + "SELECT session_id, seq FROM log WHERE seq BETWEEN 3 AND 9 AND type IN ('tool/result', 'turn/start') AND time >= 1704100000000")
def _(spark, d):
    return session_log(spark, d).where(p.every([p.closed_range("seq", 3, 9), p.event_type(["tool/result", "turn/start"]), p.closed_range("time", 1704100000000)])).select("session_id", "seq")


@query("flt03_id_in", SESS + "SELECT id, owner FROM sessions WHERE id IN (1, 5, 8)")
def _(spark, d):
    return sessions(spark, d).where(p.one_of("id", [1, 5, 8])).select("id", "owner")


@query("flt04_cwd_nullable", SESS + "SELECT id FROM sessions WHERE cwd IS NULL OR cwd = '/o'")
def _(spark, d):
    return sessions(spark, d).where(p.one_of("cwd", [None, "/o"])).select("id")


@query("flt05_created_range", SESS + "SELECT id, created_at FROM sessions WHERE created_at BETWEEN 757382400000 AND 820454400000")
def _(spark, d):
    return sessions(spark, d).where(p.closed_range("created_at", 757382400000, 820454400000)).select("id", "created_at")


@query("flt05_open_ranges", SESS + "SELECT count(CASE WHEN created_at >= 820454400000 THEN 1 END) AS after, count(CASE WHEN created_at <= 820454400000 THEN 1 END) AS before, 0 AS none FROM sessions")
def _(spark, d):
    s, at = sessions(spark, d), 820454400000
    return s.agg(F.count_if(p.closed_range("created_at", low=at)).alias("after"), F.count_if(p.closed_range("created_at", high=at)).alias("before"), F.count_if(p.one_of("id", [])).alias("none"))


@query("flt06_roots", SESS + "SELECT id, owner FROM sessions WHERE parent_session IS NULL")
def _(spark, d):
    return sessions(spark, d).where(p.one_of("parent_session", [None])).select("id", "owner")


@query("flt07_availability", SESS + "SELECT count(*) AS n, sum(CASE WHEN live THEN 1 ELSE 0 END) AS live FROM sessions WHERE persisted")
def _(spark, d):
    return sessions(spark, d).where(p.available(["persisted", "persisted"])).agg(F.count("*").alias("n"), F.count_if("live").alias("live"))


@query("flt08_time_range", LOG + "SELECT session_id, seq, time FROM log WHERE time BETWEEN 1704153600000 AND 1704240000000")
def _(spark, d):
    return session_log(spark, d).where(p.closed_range("time", 1704153600000, 1704240000000)).select("session_id", "seq", "time")


@query("flt10_text_filter", r"SELECT doc_id FROM documents WHERE regexp_matches(text, '\bthe\s+of\b' , 'i') OR regexp_matches(text, 'de\s+la', 'i')")
def _(spark, d):
    docs = table(spark, d, "documents")
    return docs.where(F.col("text").rlike(r"(?i)\bthe\s+of\b") | p.contains_text("text", "DE  la")).select("doc_id")


@query("flt14_path_prefix", "SELECT page_id FROM pages WHERE starts_with(url, 'https://') OR starts_with(url, 'http://m.')")
def _(spark, d):
    return table(spark, d, "pages").where(p.under("url", ["https://", "http://m."])).select("page_id")


@query("flt15_query_fields", "SELECT doc_id, lang FROM documents WHERE lang IN ('de') AND source LIKE 'src1%' AND contains(lower(text), 'keit')")
def _(spark, d):
    free, fields = p.parse_query("keit lang:de path:src1")
    return table(spark, d, "documents").where(p.one_of("lang", fields["lang"]) & p.under("source", fields["path"]) & F.contains(F.lower("text"), F.lit(free))).select("doc_id", "lang")


@query("flt16_authorized", SESS + "SELECT id FROM sessions WHERE owner IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def _(spark, d):
    grants = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("owner"))
    return p.authorized(sessions(spark, d), grants, "owner").select("id")


@query("flt17_wildcard", "SELECT p_partkey FROM part WHERE p_type LIKE 'STANDARD%' OR p_brand LIKE 'Brand#1_'")
def _(spark, d):
    return table(spark, d, "part").where(p.wildcard("p_type", "STANDARD*") | p.wildcard("p_brand", "Brand#1?")).select("p_partkey")


TEST_PATHS = "CASE page_id // 9 % 5 WHEN 0 THEN url WHEN 1 THEN url || '/tests/x.py' WHEN 2 THEN url || '/test_x.c' WHEN 3 THEN url || '/TestX_test.go' ELSE url || '/x.spec.ts' END"
LANGUAGES = ("rust", "python", "typescript", "go", "java", "cpp", "ruby", "jsx", "c")


@query("flt18_test_files", f"""WITH f AS (SELECT page_id, {TEST_PATHS} AS p, [{', '.join(f"'{x}'" for x in LANGUAGES)}][page_id % 9 + 1] AS lang FROM pages)
SELECT page_id, CASE WHEN lang = 'rust' THEN p LIKE '%/tests/%' OR p LIKE '%\\_test.rs' ESCAPE '\\' WHEN lang = 'python' THEN p LIKE '%/tests/%' OR p LIKE '%test\\_%' ESCAPE '\\' OR p LIKE '%\\_test.py%' ESCAPE '\\' OR p LIKE '%tests.py'
WHEN lang IN ('typescript', 'jsx') THEN p LIKE '%.test.%' OR p LIKE '%.spec.%' OR p LIKE '%\\_\\_tests\\_\\_%' ESCAPE '\\' WHEN lang = 'go' THEN p LIKE '%\\_test.go' ESCAPE '\\' WHEN lang = 'java' THEN split_part(p, '/', -1) LIKE 'Test%' OR p LIKE '%Test.java'
WHEN lang IN ('c', 'cpp') THEN regexp_matches(lower(p), '_test\\.(c|cpp|cc|cxx)$|/test_|/tests/|_tests\\.c') ELSE false END AS is_test FROM f""")
def _(spark, d):
    k = F.floor(F.col("page_id") / 9) % 5
    tail = F.when(k == 0, "").when(k == 1, "/tests/x.py").when(k == 2, "/test_x.c").when(k == 3, "/TestX_test.go").otherwise("/x.spec.ts")
    language = F.get(F.array(*map(F.lit, LANGUAGES)), (F.col("page_id") % 9).cast("int"))
    return table(spark, d, "pages").select("page_id", F.concat("url", tail).alias("path"), language.alias("language")).select("page_id", p.test_file("path", "language").alias("is_test"))


@query("flt19_secret_shaped", r"""WITH t AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN text ELSE text || ['', ' password: hunter22', ' sk_' || repeat('a', 16), ' api key=short', ' ghp_' || repeat('b', 15)][doc_id % 5] END AS text FROM documents)
SELECT doc_id FROM t WHERE regexp_matches(text, '-----BEGIN [A-Z ]*PRIVATE KEY-----') OR regexp_matches(text, '\b(sk|ghp|github_pat)_[A-Za-z0-9_-]{16,}\b') OR regexp_matches(text, '(?i)\b(api[_ -]?key|access[_ -]?token|password|secret)\s*[:=]\s*\S{8,}')""")
def _(spark, d):
    k = F.col("doc_id") % 5
    tail = F.when(k == 2, " password: hunter22").when(k == 3, " sk_" + "a" * 16).when(k == 4, " api key=short").otherwise("")
    return table(spark, d, "documents").select("doc_id", F.concat("text", tail).alias("text")).where(p.secret_shaped("text")).select("doc_id")


@query("flt20_path_contains", "SELECT page_id FROM pages WHERE lower(url) LIKE '%page=2%'")
def _(spark, d):
    return table(spark, d, "pages").where(F.contains(F.lower("url"), F.lit("page=2"))).select("page_id")


# --- projections ----------------------------------------------------------------------------


@query("prj01_event_text", CLOG + "SELECT session_id, seq, CASE WHEN type = 'system/message' THEN '' ELSE trim(text, ' \n\t') END AS text FROM clog")
def _(spark, d):
    return conversation_log(spark, d).select("session_id", "seq", F.when(F.col("type") == "system/message", "").otherwise(F.btrim("text", F.lit(" \n\t"))).alias("text"))


@query("prj03_joined_parts", r"SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10)) AS text FROM documents")
def _(spark, d):
    parts = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return table(spark, d, "documents").select("doc_id", F.array_join(parts, "\n").alias("text"))


@query("prj06_search_documents", CLOG + "SELECT session_id, count(*) AS n FROM clog WHERE type <> 'system/message' AND trim(text) <> '' GROUP BY session_id")
def _(spark, d):
    return conversation_log(spark, d).where("type <> 'system/message' and trim(text) <> ''").groupBy("session_id").agg(F.count("*").alias("n"))


@query("prj07_latest_title", CLOG + "SELECT session_id, arg_max(text, seq) AS title FROM clog WHERE type = 'user/message' GROUP BY session_id")
def _(spark, d):
    return conversation_log(spark, d).where("type = 'user/message'").groupBy("session_id").agg(F.max_by("text", "seq").alias("title"))


PACKED = f"""WITH {LOG_SQL}, own AS (SELECT *, seq - row_number() OVER (PARTITION BY session_id ORDER BY seq) AS run FROM log WHERE type IN ('assistant/chunk')),
runs AS (SELECT session_id, run, min(seq) AS seq0, arg_min(time, seq) AS time0, count(*) AS n, list(value ORDER BY seq) AS vals, list(time ORDER BY seq) AS times FROM own GROUP BY session_id, run)"""


@query("prj09_pack_runs", PACKED + " SELECT session_id, seq0, time0, n, list_transform(times, lambda x, i: CASE WHEN i = 1 THEN 0 ELSE x - times[i - 1] END) AS dt, vals AS values FROM runs WHERE n >= 3")
def _(spark, d):
    return log.packed(session_log(spark, d), "assistant/chunk")


@query("prj12_unpack_runs", PACKED + " SELECT o.session_id, o.seq, o.time, o.value FROM own o JOIN runs r ON o.session_id = r.session_id AND o.run = r.run WHERE r.n >= 3")
def _(spark, d):
    return log.unpacked(log.packed(session_log(spark, d), "assistant/chunk"))


@query("prj11_byte_bounded_parts")
def _(spark, d):
    return log.byte_bounded(conversation_log(spark, d), 2000)


@query("prj18_content_hash", "SELECT doc_id, substr(sha256(text), 1, 16) AS hash FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.content_hash("text").alias("hash"))


@query("prj19_stable_ids", "SELECT l_orderkey, l_linenumber, substr(sha256(concat_ws('|', l_orderkey, l_linenumber, l_partkey)), 1, 16) AS uid FROM lineitem")
def _(spark, d):
    uid = F.substring(F.sha2(F.concat_ws("|", *(F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey"))), 256), 1, 16)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", uid.alias("uid"))


@query("prj20_offset_position", "SELECT doc_id, strpos(text, 'on') AS off, len(string_split(left(text, strpos(text, 'on') - 1), chr(10))) AS line, strpos(text, 'on') - 1 - coalesce(length(left(text, strpos(text, 'on') - 1)) - strpos(reverse(left(text, strpos(text, 'on') - 1)), chr(10)) + 1, 0) * CASE WHEN contains(left(text, strpos(text, 'on') - 1), chr(10)) THEN 1 ELSE 0 END AS col FROM documents WHERE strpos(text, 'on') > 0")
def _(spark, d):
    at = F.instr("text", "on")
    before = F.left(F.col("text"), at - 1)
    lines = F.split(before, "\n")
    return table(spark, d, "documents").where(at > 0).select("doc_id", at.alias("off"), F.size(lines).alias("line"), F.length(F.element_at(lines, -1)).alias("col"))


@query("prj22_retained_history", CLOG + "SELECT session_id, seq, used FROM (SELECT session_id, seq, sum(octet_length(encode(text))) OVER (PARTITION BY session_id ORDER BY seq DESC ROWS UNBOUNDED PRECEDING) AS used, row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) AS back FROM clog) WHERE used <= 1500 OR back = 1")
def _(spark, d):
    return log.retained(conversation_log(spark, d), 1500)


@query("prj23_pruned_results", "SELECT doc_id, CASE WHEN length(text) <= 200 + 100 + 5 THEN text ELSE left(text, 200) || '[...]' || right(text, 100) END AS text FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.pruned("text", 200, 100, "[...]").alias("text"))


@query("prj24_call_pairing", STEPPED + """, nxt AS (SELECT *, first_value(CASE WHEN type = 'tool/result' THEN seq END IGNORE NULLS) OVER w AS result_seq, first_value(CASE WHEN type = 'tool/result' THEN time END IGNORE NULLS) OVER w AS rt
  FROM stepped WINDOW w AS (PARTITION BY session_id, turn ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)) SELECT session_id, seq, turn, result_seq, rt - time AS wait FROM nxt WHERE type = 'step/start'""")
def _(spark, d):
    return log.paired_calls(stepped_log(spark, d), "step/start", "tool/result")


@query("prj24_orphan_results", STEPPED + "SELECT session_id, seq, turn FROM (SELECT *, max(CASE WHEN type = 'step/start' THEN seq END) OVER (PARTITION BY session_id, turn ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS c FROM stepped) WHERE type = 'tool/result' AND c IS NULL")
def _(spark, d):
    return log.orphan_results(stepped_log(spark, d), "step/start", "tool/result")


@query("prj25_turn_closers", LOG + "SELECT session_id, last + 1 AS seq, 'assistant/message' AS type FROM (SELECT session_id, max(CASE WHEN type = 'turn/start' THEN seq END) AS o, max(CASE WHEN type = 'assistant/message' THEN seq END) AS c, max(seq) AS last FROM log GROUP BY session_id) WHERE o IS NOT NULL AND (c IS NULL OR c < o)")
def _(spark, d):
    return log.closers(session_log(spark, d), "turn/start", "assistant/message")


@query("prj26_header_fold", LOG + "SELECT session_id, seq, last_value(CASE WHEN type = 'turn/start' THEN value END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS header FROM log")
def _(spark, d):
    return session_log(spark, d).select("session_id", "seq", F.last(F.when(F.col("type") == "turn/start", F.col("value")), ignorenulls=True).over(folds.order().rowsBetween(Window.unboundedPreceding, 0)).alias("header"))


SPANS = f"WITH {LOG_SQL}, spans AS (SELECT session_id, seq AS id, time AS start, time + CAST(floor(value * 60000) AS BIGINT) AS \"end\" FROM log)"


def _spans(spark, d):
    return session_log(spark, d).select("session_id", F.col("seq").alias("id"), F.col("time").alias("start"), (F.col("time") + F.floor(F.col("value") * 60000)).alias("end"))


@query("prj28_timeline", SPANS + """, told AS (SELECT *, coalesce(greatest(start - max("end") OVER (PARTITION BY session_id ORDER BY start, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS idle FROM spans),
skips AS (SELECT *, sum(idle) OVER (PARTITION BY session_id ORDER BY start, id ROWS UNBOUNDED PRECEDING) AS skipped FROM told) SELECT session_id, id, idle, start - skipped AS "from", "end" - skipped AS "to" FROM skips""")
def _(spark, d):
    return log.timeline(_spans(spark, d), "session_id")


@query("prj29_overlap_selection", SPANS + ' SELECT session_id, id FROM spans WHERE start <= 1704200000000 AND "end" >= 1704190000000')
def _(spark, d):
    return log.overlapping(_spans(spark, d), 1704190000000, 1704200000000).select("session_id", "id")


# --- joins and sets ---------------------------------------------------------------------------


@query("jon01_corpus_merge", "SELECT coalesce(a.id, b.id) AS id, coalesce(a.v, b.v) AS v, a.id IS NOT NULL AS live, b.id IS NOT NULL AS persisted FROM (SELECT o_orderkey AS id, o_totalprice + 1 AS v FROM orders WHERE o_orderkey % 2 = 0) a FULL JOIN (SELECT o_orderkey AS id, o_totalprice AS v FROM orders WHERE o_orderkey % 3 = 0) b ON a.id = b.id")
def _(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("v"))
    return log.corpus(o.where("id % 2 = 0").withColumn("v", F.col("v") + 1), o.where("id % 3 = 0"))


@query("jon08_snapshot_diff", SNAPSHOT.replace("SELECT coalesce", "SELECT change, count(*) AS n FROM (SELECT coalesce", 1) + ") GROUP BY change")
def _(spark, d):
    docs = table(spark, d, "documents")
    before = docs.where("doc_id % 10 <> 3").select("doc_id", F.md5("text").alias("h"))
    after = docs.where("doc_id % 10 <> 4").select("doc_id", F.md5(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("h"))
    return log.snapshot_changes(before, after, "doc_id", "h").groupBy("change").agg(F.count("*").alias("n"))


@query("set03_removed_paths", "SELECT doc_id FROM documents WHERE doc_id % 2 = 0 EXCEPT SELECT doc_id FROM labels")
def _(spark, d):
    return table(spark, d, "documents").where("doc_id % 2 = 0").select("doc_id").distinct().join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@query("set04_coverage", "SELECT count(*) AS missing FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def _(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "embeddings"), F.col("doc_id") == F.col("vec_id"), "left_anti").agg(F.count("*").alias("missing"))


@query("set05_first_occurrence", "SELECT text, min(doc_id) AS doc_id FROM documents GROUP BY text")
def _(spark, d):
    return table(spark, d, "documents").groupBy("text").agg(F.min("doc_id").alias("doc_id"))


@query("set06_authorized_parents", "SELECT DISTINCT l.doc_id FROM labels l WHERE l.doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en') AND l.toxic = 1")
def _(spark, d):
    return table(spark, d, "labels").where("toxic = 1").select("doc_id").intersect(table(spark, d, "documents").where("lang = 'en'").select("doc_id"))


# --- aggregates -----------------------------------------------------------------------------


@query("agg01_turns_steps", STEPPED + "SELECT session_id, count(CASE WHEN changed THEN 1 END) AS turns, count(*) AS steps FROM (SELECT session_id, coalesce(turn <> lag(turn) OVER (PARTITION BY session_id ORDER BY seq), true) AS changed FROM stepped WHERE type = 'step/start') GROUP BY session_id")
def _(spark, d):
    return folds.turns_and_steps(stepped_log(spark, d))


TIMES = STEPPED + ", times AS (SELECT session_id, turn, step, min(CASE WHEN type = 'step/start' THEN time END) AS start, min(CASE WHEN type = 'assistant/chunk' THEN time END) AS first_token, min(CASE WHEN type = 'assistant/message' THEN time END) AS message FROM stepped WHERE step > 0 GROUP BY session_id, turn, step)"


@query("agg02_model_time", TIMES + " SELECT session_id, sum(greatest(0, message - start)) AS model_ms, count(*) AS answered FROM times WHERE message IS NOT NULL GROUP BY session_id")
def _(spark, d):
    return folds.model_time(stepped_log(spark, d))


@query("agg03_first_token", TIMES + " SELECT session_id, sum(greatest(0, first_token - start)) AS ttft_ms, count(*) AS ttft_n FROM times WHERE first_token IS NOT NULL GROUP BY session_id")
def _(spark, d):
    return folds.first_token_time(stepped_log(spark, d))


@query("agg04_decode", TIMES + " SELECT session_id, sum(message - first_token) AS decode_ms, count(*) AS decoded FROM times WHERE first_token IS NOT NULL AND message IS NOT NULL AND message >= first_token GROUP BY session_id")
def _(spark, d):
    return folds.decode_time(stepped_log(spark, d))


@query("agg05_tool_time", STEPPED + """, nxt AS (SELECT *, first_value(CASE WHEN type = 'tool/result' THEN time END IGNORE NULLS) OVER (PARTITION BY session_id, turn ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS rt FROM stepped)
SELECT session_id, sum(rt - time) AS tool_ms, count(*) AS paired FROM nxt WHERE type = 'step/start' AND rt IS NOT NULL GROUP BY session_id""")
def _(spark, d):
    pairs = log.paired_calls(stepped_log(spark, d), "step/start", "tool/result").where("wait is not null")
    return pairs.groupBy("session_id").agg(F.sum("wait").alias("tool_ms"), F.count("*").alias("paired"))


@query("agg06_usage", STEPPED + "SELECT session_id, round(sum(value), 4) AS tokens, count(*) AS samples FROM (SELECT session_id, value, coalesce(lead(turn) OVER w <> turn OR lead(step) OVER w <> step, true) AS last FROM stepped WHERE type = 'assistant/message' WINDOW w AS (PARTITION BY session_id ORDER BY seq)) WHERE last GROUP BY session_id")
def _(spark, d):
    return folds.usage(stepped_log(spark, d))


@query("agg07_pressure", LOG + ", l AS (SELECT session_id, max(seq) AS s, arg_max(value, seq) AS sample FROM log WHERE type = 'assistant/message' GROUP BY session_id), g AS (SELECT log.session_id, coalesce(max(l.sample), 0.0) AS sample, round(sum(CASE WHEN s IS NULL OR seq > s THEN value ELSE 0 END), 4) AS added FROM log LEFT JOIN l ON log.session_id = l.session_id GROUP BY log.session_id) SELECT session_id, sample, added, round((sample + added) / 1000, 6) AS pressure FROM g")
def _(spark, d):
    return folds.pressure(session_log(spark, d), 1000)


@query("agg08_breakdown", CLOG + "SELECT session_id, sum(CASE WHEN type = 'system/message' THEN t ELSE 0 END) AS system, sum(CASE WHEN type = 'assistant/message' THEN t ELSE 0 END) AS assistant, sum(CASE WHEN type = 'user/message' THEN t ELSE 0 END) AS user FROM (SELECT *, CAST(ceil(length(text) / 4.0) AS BIGINT) + 4 AS t FROM clog) GROUP BY session_id")
def _(spark, d):
    c = conversation_log(spark, d).withColumn("t", tx.token_estimate("text").cast("bigint"))
    return c.groupBy("session_id").agg(*(F.sum(F.when(F.col("type") == f"{k}/message", F.col("t")).otherwise(0)).alias(k) for k in ("system", "assistant", "user")))


@query("agg12_layer_bill", "SELECT source, sum(n) AS total, max(CASE WHEN lang = 'en' THEN n END) AS en, max(CASE WHEN lang = 'de' THEN n END) AS de FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY source, lang) GROUP BY source")
def _(spark, d):
    parts = table(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    return parts.groupBy("source").agg(F.sum("n").alias("total"), *(F.max(F.when(F.col("lang") == k, F.col("n"))).alias(k) for k in ("en", "de")))


@query("agg13_best_per_session", CLOG + "SELECT session_id, seq, n FROM (SELECT session_id, seq, length(text) AS n, row_number() OVER (PARTITION BY session_id ORDER BY length(text) DESC, seq) AS r FROM clog) WHERE r = 1")
def _(spark, d):
    w = Window.partitionBy("session_id").orderBy(F.desc("n"), "seq")
    return conversation_log(spark, d).select("session_id", "seq", F.length("text").alias("n")).withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


@query("agg14_max_merge", "SELECT doc_id, max(s) AS score FROM (SELECT doc_id, CAST(0.5 AS DOUBLE) * quality AS s FROM labels UNION ALL SELECT doc_id, CAST(0.7 AS DOUBLE) * toxic FROM labels) GROUP BY doc_id")
def _(spark, d):
    lab = table(spark, d, "labels")
    return lab.select("doc_id", (0.5 * F.col("quality")).alias("s")).unionByName(lab.select("doc_id", (0.7 * F.col("toxic")).alias("s"))).groupBy("doc_id").agg(F.max("s").alias("score"))


@query("agg15_capped_sum", "SELECT o_custkey, round(CAST(least(0.8 + (count(*) - 1) * 0.1, 1.2) AS DOUBLE), 6) AS score FROM orders GROUP BY o_custkey")
def _(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.round(F.least(0.8 + (F.count("*") - 1) * 0.1, F.lit(1.2)), 6).alias("score"))


@query("agg17_distinct_first", r"SELECT doc_id, list_transform(list_filter(list_transform(x, lambda t, i: {'t': t, 'k': list_position(x, t) = i}), lambda s: s.k), lambda s: s.t) AS words FROM (SELECT doc_id, string_split(split_part(text, chr(10), 1), ' ') AS x FROM documents)")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_distinct(F.split(F.split_part("text", F.lit("\n"), F.lit(1)), " ")).alias("words"))


@query("agg18_group_by_file", "SELECT l_orderkey AS file, list(l_linenumber ORDER BY l_linenumber) AS matches FROM lineitem WHERE l_quantity > 25 GROUP BY l_orderkey")
def _(spark, d):
    return table(spark, d, "lineitem").where("l_quantity > 25").groupBy(F.col("l_orderkey").alias("file")).agg(F.sort_array(F.collect_list("l_linenumber")).alias("matches"))


@query("agg20_nearest_rank_p95", "SELECT lang, CAST(quantile_disc(n_chars, 0.95) AS DOUBLE) AS p95 FROM documents GROUP BY lang")
def _(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY n_chars)").cast("double").alias("p95"))


@query("agg21_failure_rate", LOG + """, r AS (SELECT session_id, seq, count(*) OVER t AS n, avg(CASE WHEN type = 'tool/result' THEN 1.0 ELSE 0.0 END) OVER t AS a, avg(CASE WHEN type = 'tool/result' THEN 1.0 ELSE 0.0 END) OVER k AS b FROM log
  WINDOW t AS (PARTITION BY session_id ORDER BY time RANGE BETWEEN 86400000 PRECEDING AND CURRENT ROW), k AS (PARTITION BY session_id ORDER BY time, seq ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) SELECT session_id, seq, round(CASE WHEN n <= 20 THEN a ELSE b END, 6) AS rate FROM r""")
def _(spark, d):
    return folds.failure_rate(session_log(spark, d), 86_400_000, 20)


@query("agg22_status_counts", "SELECT count(CASE WHEN o_orderstatus = 'O' THEN 1 END) AS o, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS f, count(CASE WHEN o_orderstatus = 'P' THEN 1 END) AS p FROM orders")
def _(spark, d):
    return table(spark, d, "orders").agg(*(F.count_if(F.col("o_orderstatus") == s.upper()).alias(s) for s in "ofp"))


@query("agg23_latest_revision", "SELECT o_custkey, count(*) AS revisions, arg_max(o_orderkey, {'d': o_orderdate, 'k': o_orderkey}) AS o_orderkey FROM orders GROUP BY o_custkey")
def _(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("revisions"), F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"))


@query("agg24_object_count", "SELECT count(*) AS n FROM lineitem")
def _(spark, d):
    return table(spark, d, "lineitem").agg(F.count("*").alias("n"))


@query("agg25_allocation", "WITH s AS (SELECT n_nationkey AS id, count(*) AS w FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey), f AS (SELECT id, floor(1000 * w / sum(w) OVER ()) AS share, row_number() OVER (ORDER BY id) AS r FROM s) SELECT id, CAST(share + CASE WHEN r <= 1000 - sum(share) OVER () THEN 1 ELSE 0 END AS BIGINT) AS share FROM f")
def _(spark, d):
    w = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("id")).agg(F.count("*").alias("w"))
    return folds.allocate(w, "w", 1000)


@query("agg26_multiset_fingerprint", "SELECT source, sha256(string_agg(lang || ':' || n, chr(10) ORDER BY lang)) AS fingerprint FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY source, lang) GROUP BY source")
def _(spark, d):
    return folds.fingerprint(table(spark, d, "documents"), "source", "lang")


@query("agg27_goal_state", LOG + "SELECT session_id, arg_max(type, seq) AS state, max(CASE WHEN type = 'turn/start' THEN seq END) AS goal, count(CASE WHEN type = 'tool/result' THEN 1 END) AS rejected FROM log GROUP BY session_id")
def _(spark, d):
    return session_log(spark, d).groupBy("session_id").agg(F.max_by("type", "seq").alias("state"), F.max(folds.of("turn/start", "seq")).alias("goal"), F.count_if(F.col("type") == "tool/result").alias("rejected"))


@query("agg28_context_traces", LOG + "SELECT session_id, count(*) AS kept, count(CASE WHEN value >= 50 THEN 1 END) AS admitted FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) AS r FROM log) WHERE r <= 50 GROUP BY session_id")
def _(spark, d):
    return log.tail(session_log(spark, d), 50).groupBy("session_id").agg(F.count("*").alias("kept"), F.count_if(F.col("value") >= 50).alias("admitted"))


@query("agg29_list_metadata", LOG + "SELECT session_id, count(CASE WHEN type = 'turn/start' THEN 1 END) = 0 AS blank, arg_max(time, seq) FILTER (WHERE type = 'turn/start') AS last_prompt FROM log GROUP BY session_id")
def _(spark, d):
    return folds.list_metadata(session_log(spark, d))


@query("agg30_updated_at", LOG + "SELECT session_id, greatest(min(time), coalesce(max(CASE WHEN type = 'turn/start' THEN time END), 0)) AS updated_at FROM log GROUP BY session_id")
def _(spark, d):
    return session_log(spark, d).groupBy("session_id").agg(F.greatest(F.min("time"), F.coalesce(F.max(folds.of("turn/start", "time")), F.lit(0))).alias("updated_at"))


@query("agg31_physical_types", LOG + "SELECT type, count(*) AS n FROM log GROUP BY type")
def _(spark, d):
    return session_log(spark, d).groupBy("type").agg(F.count("*").alias("n"))


# --- windows --------------------------------------------------------------------------------


@query("win01_edge_cap", "SELECT l_orderkey, l_partkey FROM (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_linenumber, l_suppkey) AS r FROM lineitem) WHERE r <= 2")
def _(spark, d):
    w = Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_linenumber", "l_suppkey")
    return table(spark, d, "lineitem").withColumn("r", F.row_number().over(w)).where("r <= 2").select("l_orderkey", "l_partkey")


@query("win02_neighbours", LOG + "SELECT h.session_id, h.seq AS hit, l.seq FROM log h JOIN log l ON l.session_id = h.session_id AND l.seq BETWEEN h.seq - 2 AND h.seq + 3 WHERE h.value > 200")
def _(spark, d):
    rows = session_log(spark, d)
    return folds.around(rows, rows.where("value > 200"), 2, 3)


@query("win05_streaks", LOG + ", f AS (SELECT *, CASE WHEN lag(type) OVER w = type THEN 0 ELSE 1 END AS fresh FROM log WINDOW w AS (PARTITION BY session_id ORDER BY seq)), r AS (SELECT *, sum(fresh) OVER (PARTITION BY session_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS run FROM f) SELECT session_id, seq, streak FROM (SELECT session_id, seq, row_number() OVER (PARTITION BY session_id, run ORDER BY seq) AS streak FROM r) WHERE streak IN (3, 5, 8)")
def _(spark, d):
    return folds.streaks(session_log(spark, d)).where(F.col("streak").isin(3, 5, 8))


@query("win06_low_output", LOG + "SELECT session_id, seq, count(*) OVER w = 3 AND max(value) OVER w < 60 AS low FROM log WHERE type = 'assistant/message' WINDOW w AS (PARTITION BY session_id ORDER BY seq ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)")
def _(spark, d):
    return folds.low_output(session_log(spark, d), 3, 60)


@query("win07_time_window", LOG + "SELECT session_id, seq, count(*) OVER (PARTITION BY session_id ORDER BY time RANGE BETWEEN 3600000 PRECEDING AND CURRENT ROW) AS n FROM log")
def _(spark, d):
    return session_log(spark, d).select("session_id", "seq", F.count("*").over(Window.partitionBy("session_id").orderBy("time").rangeBetween(-3_600_000, 0)).alias("n"))


@query("win08_open_calls", LOG + "SELECT session_id, seq, sum(CASE type WHEN 'step/start' THEN 1 WHEN 'tool/result' THEN -1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS open FROM log")
def _(spark, d):
    return folds.balance(session_log(spark, d), "step/start", "tool/result")


@query("win09_idle_gaps", SPANS + """ SELECT session_id, sum(gap) AS idle FROM (SELECT session_id, greatest(0, start - max("end") OVER (PARTITION BY session_id ORDER BY start, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS gap FROM spans) GROUP BY session_id""")
def _(spark, d):
    return log.timeline(_spans(spark, d), "session_id").groupBy("session_id").agg(F.sum("idle").alias("idle"))


@query("win10_first_last_per_turn", STEPPED + "SELECT session_id, turn, min(CASE WHEN type = 'assistant/message' THEN seq END) AS first, max(CASE WHEN type = 'assistant/message' THEN seq END) AS last FROM stepped GROUP BY session_id, turn")
def _(spark, d):
    return stepped_log(spark, d).groupBy("session_id", "turn").agg(F.min(folds.of("assistant/message", "seq")).alias("first"), F.max(folds.of("assistant/message", "seq")).alias("last"))


@query("win11_turn_changes", STEPPED + "SELECT session_id, seq, turn FROM (SELECT session_id, seq, turn, lag(turn) OVER (PARTITION BY session_id ORDER BY seq) AS before FROM stepped) WHERE before IS NOT NULL AND turn <> before")
def _(spark, d):
    return stepped_log(spark, d).withColumn("before", F.lag("turn").over(folds.order())).where("before is not null and turn <> before").select("session_id", "seq", "turn")


# --- sorts and pages -----------------------------------------------------------------------


@query("srt01_newest_first", SESS + "SELECT id, created_at FROM sessions ORDER BY created_at DESC, id LIMIT 20")
def _(spark, d):
    return sessions(spark, d).orderBy(F.desc("created_at"), "id").limit(20).select("id", "created_at")


@query("srt08_offset_page", SESS + "SELECT id, (SELECT count(*) FROM sessions) AS total FROM sessions ORDER BY id LIMIT 10 OFFSET 30")
def _(spark, d):
    s = sessions(spark, d)
    total = s.agg(F.count("*").alias("total"))
    return s.orderBy("id").offset(30).limit(10).join(F.broadcast(total)).select("id", "total")  # one row


@query("srt10_byte_capped_groups", "SELECT source, doc_id FROM (SELECT source, doc_id, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS used, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) WHERE used <= 10000 OR r = 1")
def _(spark, d):
    from tarnwork.operators.retrieval import within_budget

    return within_budget(table(spark, d, "documents").select("source", "doc_id", "n_chars"), "source", "doc_id", "n_chars", 10000).select("source", "doc_id")


@query("srt14_history_page", LOG + "SELECT seq, type FROM log WHERE session_id = 8 AND seq < 30 ORDER BY seq DESC LIMIT 11")
def _(spark, d):
    return session_log(spark, d).where("session_id = 8 and seq < 30").orderBy(F.desc("seq")).limit(11).select("seq", "type")


# --- scalars --------------------------------------------------------------------------------


@query("str01_collapse", r"SELECT conv_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM conversations")
def _(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", tx.collapse("text").alias("text"))


@query("str03_ascii_lower", "SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.ascii_lower("text").alias("text"))


@query("str05_file_parts", r"SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS base, regexp_replace(regexp_extract(url, '([^/]*)$', 1), '(.)\.[^.]*$', '\1') AS stem FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", tx.base_name("url").alias("base"), tx.stem("url").alias("stem"))


@query("str06_titles", r"SELECT conv_id, turn, array_to_string(list_slice(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' '), 1, 8), ' ') AS title FROM conversations")
def _(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", tx.first_words(tx.clean_title("text"), 8).alias("title"))


LITERALS_SQL = "CASE page_id % 12 WHEN 0 THEN url WHEN 1 THEN '/' || url WHEN 2 THEN 'orders-' || page_id || '.Events' WHEN 3 THEN 'jobs.queue.' || page_id WHEN 4 THEN 'APP_KEY_' || page_id WHEN 5 THEN 'app.database.host' WHEN 6 THEN 'select a FROM users' || page_id WHEN 7 THEN 'Request failed: ' || page_id WHEN 8 THEN 'myLogger ' || page_id WHEN 9 THEN 'ab' WHEN 10 THEN 'plain words' ELSE 'Not Found in table of ' || page_id END"


@query("str07_literal_kinds", f"WITH x AS (SELECT page_id, {LITERALS_SQL} AS v FROM pages) SELECT page_id, [CASE WHEN starts_with(url, 'http') THEN 'url' END, 'route', 'topic', 'queue', 'env_key', 'config_key', 'sql', 'error_string', 'log_key', NULL, NULL, 'sql'][page_id % 12 + 1] AS kind FROM x JOIN pages USING (page_id)")
def _(spark, d):
    k, n = F.col("page_id") % 12, F.col("page_id").cast("string")
    made = [F.col("url"), F.concat(F.lit("/"), "url"), F.concat(F.lit("orders-"), n, F.lit(".Events")), F.concat(F.lit("jobs.queue."), n), F.concat(F.lit("APP_KEY_"), n), F.lit("app.database.host"), F.concat(F.lit("select a FROM users"), n), F.concat(F.lit("Request failed: "), n), F.concat(F.lit("myLogger "), n), F.lit("ab"), F.lit("plain words"), F.concat(F.lit("Not Found in table of "), n)]
    return table(spark, d, "pages").select("page_id", tx.literal_kind(F.get(F.array(*made), k.cast("int"))).alias("kind"))


@query("str09_code_points", "SELECT doc_id, length(text) AS n, left(text, 50) AS head FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.length("text").alias("n"), F.substring("text", 1, 50).alias("head"))


@query("str10_preview", "SELECT doc_id, CASE WHEN length(text) <= 300 THEN text ELSE left(text, 300) || '… (+' || (length(text) - 300) || ' more chars)' END AS preview FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.preview("text", 300).alias("preview"))


@query("mth01_token_estimate", "SELECT doc_id, CAST(ceil(length(text) / 4.0) AS BIGINT) + 4 AS tokens FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.token_estimate("text").cast("bigint").alias("tokens"))


@query("mth02_graph_estimate", "SELECT doc_id, greatest(octet_length(encode(text)) // 4, 10) AS tokens FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.graph_token_estimate("text").alias("tokens"))


@query("dat01_iso_parse", "SELECT o_orderkey, epoch_ms(strptime(strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S'), '%Y-%m-%dT%H:%M:%S')) AS ms FROM orders")
def _(spark, d):
    iso = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    return table(spark, d, "orders").select("o_orderkey", F.unix_millis(F.try_to_timestamp(iso, F.lit("yyyy-MM-dd'T'HH:mm:ss"))).alias("ms"))


@query("dat03_recurrence", "SELECT event_id, 1704067200000 + (epoch_us(ts) // 1000 - 1704067200000) // 3600000 * 3600000 AS occurrence FROM events")
def _(spark, d):
    anchor, every = 1_704_067_200_000, 3_600_000
    return table(spark, d, "events").select("event_id", (F.lit(anchor) + F.floor((millis("ts") - anchor) / every) * every).alias("occurrence"))


@query("arr01_arrays", "SELECT vec_id, list_slice(embedding, 1, 3) AS head, len(embedding) AS n FROM embeddings")
def _(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.slice("embedding", 1, 3).alias("head"), F.size("embedding").alias("n"))


@query("jsn01_validity", "SELECT event_id, json_valid(props) AS ok FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN left(props, length(props) - 1) ELSE props END AS props FROM events)")
def _(spark, d):
    props = F.when(F.col("event_id") % 3 == 0, F.expr("left(props, length(props) - 1)")).otherwise(F.col("props"))
    return table(spark, d, "events").select("event_id", F.try_parse_json(props).isNotNull().alias("ok"))

"""Walks and symbols of files that are derived from tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnwork.plans.registry import query
from tarnwork.sources import brace_symbols, tree, workspace
from tarnwork.sources.tables import FILES_SQL, files, table

#: Ignore files: one at the top, one for each host, and one in the hosts' folder ``en``.
TOP_RULES = "*9\n/www.*/de/\n!*29\n"
HOST_RULES = {0: "fr/\n!fr/8*\n", 1: "# none\n", 2: "es/*5*\n!es/**/*55*\n"}
EN_RULES = "*3*\n!*33*\n\n"

#: Each part of the paths is decided by itself: the last rule that matches, of the deepest file, unless a folder above is gone.
WALK_SQL = rf"""WITH {FILES_SQL}, p AS (SELECT file_id, rtrim(path, '/') AS path, string_split(rtrim(path, '/'), '/') AS x FROM files),
h AS (SELECT host, length(host) % 3 AS kind FROM (SELECT DISTINCT x[1] AS host FROM p)),
e AS (SELECT p.*, kind, x[1] AS host, x[2] AS lang, x[3] AS name, starts_with(x[1], 'www.') AS www FROM p JOIN h ON h.host = x[1] WHERE len(x) = 3),
d AS (SELECT *,
  CASE WHEN ends_with(host, '9') AND NOT ends_with(host, '29') THEN true ELSE false END AS host_gone,
  CASE WHEN kind = 0 AND lang = 'fr' THEN true WHEN www AND lang = 'de' THEN true ELSE false END AS lang_gone,
  CASE WHEN lang = 'en' AND contains(name, '33') THEN false WHEN lang = 'en' AND contains(name, '3') THEN true
    WHEN kind = 0 AND lang = 'fr' AND starts_with(name, '8') THEN false
    WHEN kind = 2 AND lang = 'es' AND contains(name, '55') THEN false WHEN kind = 2 AND lang = 'es' AND contains(name, '5') THEN true
    WHEN ends_with(name, '29') THEN false WHEN ends_with(name, '9') THEN true ELSE false END AS name_gone FROM e)
SELECT path, min(file_id) AS file_id, CAST(row_number() OVER (ORDER BY host, lang, name) AS BIGINT) AS place FROM d WHERE NOT (host_gone OR lang_gone OR name_gone) GROUP BY path, host, lang, name"""


@query("src09_workspace_walk", WALK_SQL)
def _(spark, d):
    listed = files(spark, d).select(F.rtrim("path", F.lit("/")).alias("path"), "file_id").where(F.size(F.split("path", "/")) == 3)
    listed = listed.groupBy("path").agg(F.min("file_id").alias("file_id"))
    host = F.split_part("path", F.lit("/"), F.lit(1))
    hosts = listed.select(host.alias("host")).distinct()
    rules = F.create_map(*(F.lit(x) for kv in HOST_RULES.items() for x in kv))[(F.length("host") % 3).cast("int")]
    documents = hosts.select(F.explode(F.array(F.struct(F.concat("host", F.lit("/.gitignore")).alias("path"), rules.alias("content")), F.struct(F.concat("host", F.lit("/en/.gitignore")).alias("path"), F.lit(EN_RULES).alias("content")))).alias("f")).select("f.*")
    top = spark.range(1).select(F.lit(".gitignore").alias("path"), F.lit(TOP_RULES).alias("content"))
    return tree.walk(listed, documents.unionByName(top))


#: Sources made of a part's names: ``{c}`` a class, ``{m}`` a member, ``{n}`` its key, ``{s}`` its size.
GO_SOURCE = """package p{s}

import (
	"fmt"
	alias{s} "enc/{m}"
)

// func notReal() {
type {c} struct {
	Name string
}

func (s *{c}) Get{n}(a, b int, rest ...string) (string, error) {
	/* }} */
	fmt.Println("}{ func x()")
	return helper{s}(a), nil
}

func helper{s}(n int) int { return n }
"""
JAVA_SOURCE = """import java.util.{c};
import static a.b.{m};

public class {c} extends Base<String> {
    private String text = "class Fake { }"; // int f() {
    public {c}(String name, final int size) { this.name = name; }
    @Override public List<String> get{n}(Map<String, Integer> m) throws IOException {
        if (m == null) { throw new Bad{s}("x"); }
        return obj.run(helper(m));
    }
}
enum {c}Kind { RED, GREEN }
"""


def _source(template: str):
    out = F.lit(template)
    for mark, value in (("{c}", F.col("c")), ("{m}", F.col("m")), ("{n}", F.col("p_partkey").cast("string")), ("{s}", F.col("p_size").cast("string"))):
        out = F.replace(out, F.lit(mark), value)
    return out


SYMBOL_ROWS = {
    "go": [
        ("import", "'fmt'", "'fmt'", "NULL", "NULL", "NULL", "NULL", "NULL", "NULL", 4, 4), ("import", "m", "'enc/' || m", "NULL", "NULL", "NULL", "NULL", "NULL", "'alias' || s", 5, 5),
        ("class", "c", "NULL", "NULL", "NULL", "NULL", "NULL", "NULL", "NULL", 9, 11), ("method", "'Get' || n", "c", "'int, int, ...string'", "3", "'(string, error)'", "NULL", "NULL", "NULL", 13, 17),
        ("member-call", "'Println'", "NULL", "NULL", "NULL", "NULL", "'fmt'", "'Get' || n", "NULL", 15, 15), ("call", "'helper' || s", "NULL", "NULL", "NULL", "NULL", "NULL", "'Get' || n", "NULL", 16, 16),
        ("function", "'helper' || s", "NULL", "'int'", "1", "'int'", "NULL", "NULL", "NULL", 19, 19),
    ],
    "java": [
        ("import", "c", "'java.util.' || c", "NULL", "NULL", "NULL", "NULL", "NULL", "NULL", 1, 1), ("import", "m", "'static a.b.' || m", "NULL", "NULL", "NULL", "NULL", "NULL", "NULL", 2, 2),
        ("class", "c", "NULL", "NULL", "NULL", "NULL", "NULL", "NULL", "NULL", 4, 11), ("method", "c", "c", "'String, int'", "2", "NULL", "NULL", "NULL", "NULL", 6, 6),
        ("method", "'get' || n", "c", "'Map<String, Integer>'", "1", "'List<String>'", "NULL", "NULL", "NULL", 7, 10), ("constructor-call", "'Bad' || s", "NULL", "NULL", "NULL", "NULL", "NULL", "'get' || n", "NULL", 8, 8),
        ("member-call", "'run'", "NULL", "NULL", "NULL", "NULL", "'obj'", "'get' || n", "NULL", 9, 9), ("call", "'helper'", "NULL", "NULL", "NULL", "NULL", "NULL", "'get' || n", "NULL", 9, 9),
        ("enum", "c || 'Kind'", "NULL", "NULL", "NULL", "NULL", "NULL", "NULL", "NULL", 12, 12),
    ],
}
_EACH = [f"SELECT path, '{language}' AS language, '{kind}' AS kind, {name} AS name, {container} AS container, {types} AS param_types, CAST({count} AS INTEGER) AS param_count, {result} AS return_type, {receiver} AS receiver, {caller} AS caller, {alias} AS alias, {line} AS line, {end} AS end_line FROM f WHERE language = '{language}'" for language, rows in SYMBOL_ROWS.items() for kind, name, container, types, count, result, receiver, caller, alias, line, end in rows]
SYMBOLS_SQL = "WITH f AS (SELECT 'src/f' || p_partkey || '.' || CASE WHEN p_partkey % 2 = 0 THEN 'go' ELSE 'java' END AS path, CASE WHEN p_partkey % 2 = 0 THEN 'go' ELSE 'java' END AS language, upper(left(p_name, 1)) || substring(split_part(p_name, ' ', 1), 2) AS c, split_part(p_name, ' ', 2) AS m, CAST(p_partkey AS VARCHAR) AS n, CAST(p_size AS VARCHAR) AS s FROM part) " + " UNION ALL ".join(_EACH)


@query("prj21_brace_symbols", SYMBOLS_SQL)
def _(spark, d):
    first, second = (F.split_part("p_name", F.lit(" "), F.lit(k)) for k in (1, 2))
    p = table(spark, d, "part").select("p_partkey", "p_size", F.initcap(first).alias("c"), second.alias("m"), F.when(F.col("p_partkey") % 2 == 0, "go").otherwise("java").alias("language"))
    path = F.concat(F.lit("src/f"), F.col("p_partkey").cast("string"), F.lit("."), "language")
    return brace_symbols.symbols(p.select(path.alias("path"), F.when(F.col("language") == "go", _source(GO_SOURCE)).otherwise(_source(JAVA_SOURCE)).alias("content")))


PYTHON_SOURCE = """import os
class {c}:
    def get{n}(self, x):
        return helper{s}(x)

def helper{s}(y):
    return os.path.join(y)
"""
_PYTHON = [("import", "'os'", "''", 1, "NULL"), ("class", "c", "''", 2, "NULL"), ("function", "'get' || n", "c", 3, "NULL"), ("call", "'helper' || s", "c || '.get' || n", 4, "'helper' || s"), ("function", "'helper' || s", "''", 6, "NULL"), ("call", "'os.path.join'", "'helper' || s", 7, "'join'")]
PYTHON_SQL = "WITH f AS (SELECT 'src/f' || p_partkey || '.py' AS path, upper(left(p_name, 1)) || substring(split_part(p_name, ' ', 1), 2) AS c, CAST(p_partkey AS VARCHAR) AS n, CAST(p_size AS VARCHAR) AS s FROM part) " + " UNION ALL ".join(f"SELECT path, '{kind}' AS kind, {name} AS name, {container} AS container, {line} AS line, {callee} AS callee FROM f" for kind, name, container, line, callee in _PYTHON)


@query("prj21_python_symbols", PYTHON_SQL)
def _(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_size", F.initcap(F.split_part("p_name", F.lit(" "), F.lit(1))).alias("c"), F.lit("").alias("m"))
    return workspace.python_symbols(p.select(F.concat(F.lit("src/f"), F.col("p_partkey").cast("string"), F.lit(".py")).alias("path"), _source(PYTHON_SOURCE).alias("content")))

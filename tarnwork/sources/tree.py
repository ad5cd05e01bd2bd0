"""Ignore-aware walks over tables of files, and over folders that Spark can read."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwork.operators.prefix import running

RULES = ".gitignore"
_PART = re.compile(r"/\*\*/|^\*\*/|/\*\*$|\*+|\?|\[[!^]?\]?[^\]]*\]|\\.|[^*?\[\\/]+|/|.", re.DOTALL)


def rule_of(line: str) -> tuple[bool, bool, str] | None:
    """(negated, for folders only, regular expression of a whole path) of an ignore rule; None for comments and blank lines."""
    line = re.sub(r"(?<!\\)[ \t\r]+$", "", line)
    if not line or line.startswith("#"):
        return None
    negated = line.startswith("!")
    line = line[negated:]
    folder = line.endswith("/")
    line = line.rstrip("/") if folder else line
    anchored = "/" in line
    line = line.removeprefix("/")
    if not line:
        return None
    fixed = {"/**/": "/(?:.*/)?", "**/": "(?:.*/)?", "/**": "/.+", "?": "[^/]"}
    out = ""
    for part in _PART.findall(line):
        if part in fixed:
            out += fixed[part]
        elif part.startswith("*"):
            out += "[^/]*"
        elif part.startswith("[") and len(part) > 2:
            inner = part[2:-1] if part[1] in "!^" else part[1:-1]
            out += ("[^/" if part[1] in "!^" else "[") + re.sub(r"([\\\[\]&^])", r"\\\1", inner) + "]"
        elif part.startswith("\\") and len(part) == 2:
            out += re.escape(part[1])
        else:
            out += re.escape(part)
    return negated, folder, f"^{'' if anchored else '(?:.*/)?'}{out}$"


def rules_of(documents: DataFrame) -> DataFrame:
    """(base, depth, k, negated, folder, pattern): the rules of ignore files (path, content), by their folder."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                base = path.rpartition("/")[0]
                rows += [(base, base.count("/") + bool(base), k, *rule) for k, line in enumerate((content or "").split("\n")) if (rule := rule_of(line))]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], ["base", "depth", "k", "negated", "folder", "pattern"])

    return documents.select("path", "content").mapInArrow(parse, "base string, depth int, k int, negated boolean, folder boolean, pattern string")


def folders(path: Column) -> Column:
    """The folders that a path lies in, from the top, which is not among them."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.when(F.size(parts) > 1, F.array_join(F.slice(parts, F.lit(1), i), "/")))


def ignored_entries(entries: DataFrame, rules: DataFrame) -> DataFrame:
    """The entries (entry, is_folder) that ignore files exclude: the last matching rule of the deepest file decides."""
    bases = F.explode(F.array_union(F.array(F.lit("")), F.filter(folders(F.col("entry")), lambda x: x.isNotNull())))
    local = F.when(F.col("base") == "", F.col("entry")).otherwise(F.expr("substring(entry, length(base) + 2)"))
    met = entries.select("entry", "is_folder", bases.alias("base")).join(rules, "base")
    met = met.withColumn("local", local).where((F.col("is_folder") | ~F.col("folder")) & F.expr("rlike(local, pattern)"))
    decided = met.groupBy("entry", "is_folder").agg(F.max_by("negated", F.struct("depth", "k")).alias("negated"))
    return decided.where("not negated").select("entry", "is_folder")


def walk(files: DataFrame, documents: DataFrame, include: tuple[str, ...] = (), exclude: tuple[str, ...] = (), scope: tuple[str, ...] | None = None) -> DataFrame:
    """The files (path, ...) that a walk from the top reaches, with their ``place``: folders breadth first, names in order.

    ``documents`` are the ignore files (path, content).  A folder that is excluded hides all
    below it, whatever the rules there; so one join decides each entry by itself, and files
    without an excluded folder above them are left.  ``exclude`` rules hold besides, from the top;
    a file must match one of the ``include`` rules and lie in the ``scope``, if there are any.
    """
    inside = F.filter(folders(F.col("path")), lambda x: x.isNotNull())
    known = files.select("path", inside.alias("_folders"))
    above = known.select(F.explode("_folders").alias("entry")).distinct().withColumn("is_folder", F.lit(True))
    entries = above.unionByName(known.select(F.col("path").alias("entry"), F.lit(False).alias("is_folder")))
    gone = ignored_entries(entries, rules_of(documents))
    for negated, folder, pattern in filter(None, map(rule_of, exclude)):
        if negated:
            raise ValueError("an exclusion cannot be negated")
        gone = gone.unionByName(entries.where(F.col("entry").rlike(pattern) & (F.col("is_folder") | F.lit(not folder))))
    hidden = known.select("path", F.explode("_folders").alias("entry")).join(gone.where("is_folder").select("entry").distinct(), "entry", "left_semi").select("path")
    hidden = hidden.unionByName(gone.where("not is_folder").select(F.col("entry").alias("path")))
    left = files.join(hidden, "path", "left_anti")
    if include:
        left = left.where(F.col("path").rlike("|".join(f"(?:{pattern})" for _, _, pattern in filter(None, map(rule_of, include)))))
    if scope is not None:
        wanted = F.lit(False)
        for path in scope:
            wanted = wanted | (F.col("path") == path) | F.startswith("path", F.lit(f"{path}/"))
        left = left.where(wanted)
    parts = F.split("path", "/")
    ordered = left.withColumns({"_depth": F.size(parts), "_above": F.slice(parts, F.lit(1), F.size(parts) - 1), "_name": F.element_at(parts, -1)})
    return running(ordered, [], ["_depth", "_above", "_name"], name="place").drop("_depth", "_above", "_name")


def ignore_documents(spark: SparkSession, top, most: int) -> DataFrame:
    """(path, content) of the ignore files in the folders down to ``most`` levels below a Hadoop path.

    Spark's own sources pass over names that begin with a dot, so these few small files are
    listed and read through the file system's client, as Spark lists files itself.
    """
    jvm = spark._jvm
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    root, rows = top.toString().rstrip("/") + "/", []
    for depth in range(most + 1):
        for status in fs.globStatus(jvm.org.apache.hadoop.fs.Path(root + "*/" * depth + RULES)) or []:
            stream = fs.open(status.getPath())
            try:
                rows.append((status.getPath().toString()[len(root) :], jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
            finally:
                stream.close()
    return spark.createDataFrame(rows, "path string, content string")


def workspace(spark: SparkSession, root: str, **options) -> DataFrame:
    """(path, size, mtime, place): the walk over a folder, of names that do not begin with a dot or an underscore."""
    top = spark._jvm.org.apache.hadoop.fs.Path(root)
    top = top.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(top)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    below = re.sub(r"^[a-z]+:/*", "/", top.toString()).rstrip("/") + "/"  # however the scheme is written
    path = F.substring(F.col("path"), F.instr(F.col("path"), below) + len(below), F.length("path"))
    listed = found.select(path.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
    most = listed.agg(F.coalesce(F.max(F.size(F.split("path", "/"))), F.lit(1))).first()[0]
    return walk(listed, ignore_documents(spark, top, most - 1), **options)

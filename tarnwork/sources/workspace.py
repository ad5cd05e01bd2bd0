"""Workspace files: walking, ignore rules, greps and Python symbols."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def walk(spark: SparkSession, root: str, suffixes: list[str] | None = None) -> DataFrame:
    """(path, size, mtime, content) of all files under a folder that Spark can read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    if suffixes:
        rows = rows.where(F.col("path").rlike("(" + "|".join(re.escape(s) for s in suffixes) + ")$"))
    return rows.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), "content")


def grep(spark: SparkSession, root: str, pattern: str, most: int) -> DataFrame:
    """(path, line): matching lines of the text files under a folder."""
    lines = spark.read.option("recursiveFileLookup", "true").text(root).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("line"))
    return lines.where(F.col("line").rlike(pattern)).orderBy("path", "line").limit(most)


def rule_pattern(rule: str) -> tuple[bool, str] | None:
    """(negated, regular expression) of an ignore rule; None for comments and blank lines."""
    rule = rule.rstrip()
    if not rule or rule.startswith("#"):
        return None
    negated = rule.startswith("!")
    rule = rule[negated:]
    folder = rule.endswith("/")
    anchored = "/" in rule.strip("/") or rule.startswith("/")
    out = "^" if anchored else "(^|/)"
    for part in re.findall(r"\*\*/|/\*\*$|\*\*|\*|\?|[^*?]+", rule.strip("/")):
        out += {"**/": "(.*/)?", "/**": "/.*", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(part) or re.escape(part)
    return negated, out + ("/" if folder else "(/|$)")


def ignored(path: str, rules: list[str]):
    """Whether the last rule that matches a path excludes it."""
    out = F.lit(False)
    for rule in rules:
        if parsed := rule_pattern(rule):
            negated, pattern = parsed
            out = F.when(F.col(path).rlike(pattern), not negated).otherwise(out)
    return out


def visible(files: DataFrame, rules: list[str]) -> DataFrame:
    return files.where(~ignored("path", rules))


def included(files: DataFrame, patterns: list[str]) -> DataFrame:
    return files.where(ignored("path", patterns))


def python_symbols(files: DataFrame) -> DataFrame:
    """(path, kind, name, container, line, callee) of Python sources; broken files give nothing."""
    import ast

    def visit(node: ast.AST, container: str, out: list[tuple]) -> None:
        for child in ast.iter_child_nodes(node):
            inner = container
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                out.append(("class" if isinstance(child, ast.ClassDef) else "function", child.name, container, child.lineno, None))
                inner = f"{container}.{child.name}".lstrip(".")
            elif isinstance(child, (ast.Import, ast.ImportFrom)):
                out += [("import", a.name, container, child.lineno, None) for a in child.names]
            elif isinstance(child, ast.Call):
                out.append(("call", ast.unparse(child.func), container, child.lineno, ast.unparse(child.func).rpartition(".")[2]))
            visit(child, inner, out)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                found: list[tuple] = []
                try:
                    visit(ast.parse(content), "", found)
                except (SyntaxError, ValueError):
                    continue
                rows += [(path, *x) for x in found]
            yield pd.DataFrame(rows, columns=["path", "kind", "name", "container", "line", "callee"])

    spread = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a small file is one task, whatever its rows cost
    return files.select("path", "content").repartition(spread, "path").mapInPandas(parse, "path string, kind string, name string, container string, line int, callee string")

"""Chunks of files and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def by_lines(docs: DataFrame, lines: int = 80) -> DataFrame:
    """(doc_id, chunk_index, start_line, end_line, text): windows of lines, blank ones left out before numbering."""
    each = docs.select("doc_id", F.split("text", "\n").alias("l")).select("doc_id", "l", F.explode(F.sequence(F.lit(0), F.floor((F.size("l") - 1) / lines))).alias("win"))
    made = each.select("doc_id", "win", F.size("l").alias("n"), F.array_join(F.slice("l", (F.col("win") * lines + 1).cast("int"), F.lit(lines)), "\n").alias("text"))
    kept = made.where(F.btrim("text", F.lit(" \t\n")) != "")
    w = Window.partitionBy("doc_id").orderBy("win")
    return kept.select("doc_id", (F.row_number().over(w) - 1).cast("bigint").alias("chunk_index"), (F.col("win") * lines + 1).alias("start_line"), F.least((F.col("win") + 1) * lines, F.col("n").cast("bigint")).alias("end_line"), "text")


def file_documents(files: DataFrame, summary: int = 200, excerpt: int = 1000) -> DataFrame:
    """(file_id, summary, excerpt) of files that hold text."""
    text = F.replace("content", F.lit("\r"), F.lit(""))
    kept = files.where(~F.contains("content", F.lit("\x00")))
    return kept.select("file_id", F.left(F.trim(F.get(F.split(text, "\n"), F.lit(0))), F.lit(summary)).alias("summary"), F.left(text, F.lit(excerpt)).alias("excerpt"))


#: Fixed value: most lines of a chunk.
LINE_BUDGET = 80


def by_symbols(files: DataFrame, symbols: DataFrame, budget: int = LINE_BUDGET) -> DataFrame:
    """(file_id, chunk_index, start_line, end_line, symbol, text): chunks along symbols.

    ``files`` is (file_id, text), ``symbols`` (file_id, start_line, end_line, name), of files that
    have some.  A symbol is one chunk, or several of ``budget`` lines; lines between symbols are
    a chunk without a symbol unless blank.  A symbol covers all lines up to its end, also where
    it overlaps the one before.  All work is inside the row of a file.
    """
    spans = symbols.groupBy("file_id").agg(F.sort_array(F.collect_list(F.struct(F.col("start_line").alias("a"), F.col("end_line").alias("b"), "name"))).alias("spans"))  # bounded by the file
    rows = files.join(spans, "file_id").withColumn("lines", F.split("text", "\n"))
    n = F.size("lines")
    piece = lambda first, last, shown, name: F.struct(first.cast("int").alias("start_line"), shown.cast("int").alias("end_line"), name.alias("symbol"), F.array_join(F.slice("lines", first, F.greatest(last - first + 1, F.lit(0))), "\n").alias("text"))
    none = F.array().cast("array<struct<start_line:int,end_line:int,symbol:string,text:string>>")
    nameless = F.lit(None).cast("string")

    def gap(first, last):
        made = piece(first, last, last, nameless)
        return F.when((first <= last) & (F.trim(F.regexp_replace(made["text"], r"\s", "")) != ""), F.array(made)).otherwise(none)

    def along(s, i):
        covered = F.when(i == 0, 0).otherwise(F.coalesce(F.get("spans", i - 1)["b"], F.lit(0)))
        last = F.least(s["b"], n)
        cuts = F.sequence(F.lit(0), F.greatest(last - s["a"], F.lit(0)).cast("int"), F.lit(budget))
        whole = F.array(piece(s["a"], last, s["b"], s["name"]))
        parts = F.transform(cuts, lambda at: piece(s["a"] + at, F.least(s["a"] + at + budget - 1, last), F.least(s["a"] + at + budget - 1, last), s["name"]))
        return F.concat(gap(covered + 1, s["a"] - 1), F.when(last - s["a"] + 1 <= budget, whole).otherwise(parts))

    tail = gap(F.element_at("spans", -1)["b"] + 1, n)
    made = rows.select("file_id", F.posexplode(F.concat(F.flatten(F.transform("spans", along)), tail)).alias("chunk_index", "c"))
    return made.select("file_id", "chunk_index", "c.*")

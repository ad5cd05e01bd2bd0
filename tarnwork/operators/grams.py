"""Lookups that would else compare all pairs: substrings by grams, near spellings by deletions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwork.storage import stored

#: Longest substring that texts are looked up by.
GRAM = 16
#: Bits of the map of wanted grams: sixteen for each, within these powers of two.
BITS_LEAST, BITS_MOST = 16, 27


def grams(text: Column | str, size: Column | int) -> Column:
    """The substrings of ``size`` characters, in order; none of a shorter text."""
    c = F.col(text) if isinstance(text, str) else text
    n = F.lit(size) if isinstance(size, int) else size
    return F.when(F.length(c) >= n, F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substring(c, i, n))).otherwise(F.array().cast("array<string>"))


def marked(keys: DataFrame, key: str) -> tuple[DataFrame, int]:
    """A row (bits) with a bitmap of the hashes of ``key``, 16 MB at most, and the power of two of its size."""
    power = min(BITS_MOST, max(BITS_LEAST, (16 * keys.count()).bit_length()))
    at = F.xxhash64(key).bitwiseAND((1 << power) - 1)
    words = keys.groupBy(F.shiftrightunsigned(at, 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(xxhash64({key}) & 63 as int))")).alias("b")).toArrow()
    bits = np.zeros(1 << (power - 6), np.int64)
    bits[words["w"].to_numpy()] = words["b"].to_numpy()
    return keys.sparkSession.createDataFrame(pa.table({"bits": pa.array([bits], pa.list_(pa.int64()))})), power


def maybe(rows: DataFrame, key: str, marks: tuple[DataFrame, int]) -> DataFrame:
    """The rows whose key may be one of the marked ones; only few of the others stay."""
    bits, power = marks
    held = F.expr(f"shiftrightunsigned(get(bits, cast(shiftrightunsigned(xxhash64({key}) & {(1 << power) - 1}L, 6) as int)), cast(xxhash64({key}) & 63 as int)) & 1L")
    return rows.join(F.broadcast(bits), held == 1).drop("bits")  # of bounded size


def contained_in(needles: DataFrame, texts: DataFrame) -> DataFrame:
    """(needle, text_id) of every text of (text_id, text) that has the needle as a substring.

    An inverted index of substrings as long as the needles, up to ``GRAM`` characters: up to there an
    equal gram is the needle itself, so that only what is found is joined.  Of a longer needle's grams the
    one that fewest texts have is looked up, and those texts are searched for the whole needle.  A bitmap
    of the needles' grams leaves nearly all others behind before the shuffle.  Empty needles are in no text.
    """
    asked = needles.where("needle <> ''").select("needle").distinct()
    own = stored(asked.select("needle", F.explode(F.array_distinct(grams("needle", F.least(F.lit(GRAM), F.length("needle"))))).alias("gram")), "needle-grams")
    sizes = [r[0] for r in own.select(F.length("gram").alias("n")).distinct().collect()]  # 1 to GRAM
    if not sizes:
        return asked.join(texts.select("text_id"), F.lit(False))
    wanted = own.select("gram").distinct()
    every = F.array_distinct(F.flatten(F.array(*(grams("text", n) for n in sizes))))
    spread = int(needles.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a small file is one task, whatever it holds
    found = maybe(texts.select("text_id", "text").repartition(spread, "text_id").select("text_id", F.explode(every).alias("gram")), "gram", marked(wanted, "gram"))
    found = stored(found.join(wanted, "gram", "left_semi"), "gram-postings")
    short = F.length("needle") <= GRAM
    met = own.where(short).join(found, "gram").select("needle", "text_id")
    if max(sizes) < GRAM:
        return met
    df = found.groupBy("gram").agg(F.count("*").alias("df"))
    ranked = own.where(~short).join(df, "gram", "left").groupBy("needle").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "gram")).alias("r"))
    candidates = ranked.where("r.df > 0").select("needle", F.col("r.gram").alias("gram")).join(found, "gram").select("needle", "text_id")
    return met.unionByName(candidates.join(texts, "text_id").where(F.contains("text", F.col("needle"))).select("needle", "text_id"))


def deletions(word: Column | str, most: int) -> Column:
    """A word and what is left of it without up to ``most`` of its characters."""
    c = F.col(word) if isinstance(word, str) else word
    out = last = F.array(c)
    for _ in range(most):
        without = lambda x: F.when(F.length(x) > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.length(x), F.lit(1))), lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.length(x))))).otherwise(F.array().cast("array<string>"))
        last = F.array_distinct(F.flatten(F.transform(last, without)))
        out = F.concat(out, last)
    return F.array_distinct(out)


def within_edits(words: DataFrame, names: DataFrame, most: int = 1) -> DataFrame:
    """(word, name, edits) of tables (word) and (name): spellings at most ``most`` edits apart.

    Two words that near have a common rest after as many deletions on either side, so they
    meet in an equal key; the edit distance then decides.
    """
    a = words.select("word").distinct().select("word", F.explode(deletions("word", most)).alias("rest"))
    b = names.select("name").distinct().select("name", F.explode(deletions("name", most)).alias("rest"))
    return a.join(b, "rest").select("word", "name").distinct().withColumn("edits", F.levenshtein("word", "name")).where(F.col("edits") <= most)

"""Quality rules: fixed counts, and robust multivariate outliers per language and source.

Every document has a vector of transformed statistics.  Vectors are summed up once in bins of
``BIN`` times the least deviations, with exact sums of their members, so that all later steps
read a table whose size depends on the number of groups, not of documents.  For each (language,
source), each language and the whole table the minimum-covariance-determinant estimate of
centre and scatter is sought from three starts (medians and median deviations, mean and
covariance of all, and the covariance of spatial signs) by concentration steps: the bins nearest
to an estimate with the share ``SUPPORT`` of the documents give the next one, until a start's
determinant falls no more.  The estimate of least determinant stands.

Scatter is regularised throughout, determinants included: variances are at least the squared
``LEAST_DEVIATION``, and ``RIDGE`` times that is added, so every scatter has an inverse, also
of one point, two points or collinear ones.  An estimate from n documents is blended with that
of the next larger group in the proportion n : ``PRIOR_ROWS``, and that of the table with its
medians and median deviations; so the estimate changes smoothly with the size of a group.  A
document whose squared Mahalanobis distance exceeds the chi-square quantile ``CUTOFF`` is
rejected.

Edge cases: a null text counts as an empty one (all counts 0, base rule failed); null
languages and sources are groups of their own; groups without documents that pass the base rules
judge none; rows that repeat each get their verdict; ties of distance fall into one step of the
histogram and are all in the nearest share or all out; an empty table gives an empty result;
texts of any length are counted whole; other columns, whatever their names, are dropped at once.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwork.llm.common import SPACES, scratch, stored
from tarnwork.llm.mixing import words_of

SYMBOLS = "#*$%&|<>"
GRAM = 5
LEAST_WORDS = 10
MOST_REPEATED = 20  # per cent of the words
#: Documents that the estimate of the next larger group stands for.
PRIOR_ROWS = 60
EVERY = "every row"
SUPPORT = 0.75
#: The estimate of least determinant that a start has led to.
BEST = "struct<log_det:double,centre:array<double>,scatter:array<array<double>>>"
#: Steps end when no logarithm of a determinant falls by more than this.
SETTLED = 1e-3
CUTOFF = 0.999
#: The transformed statistics, and the least standard deviation that is taken for real: a
#: group in which a statistic hardly varies must not reject on traces of it.
FEATURES = ("log_words", "word_length", "symbols", "repeated_lines", "repeated_words")
LEAST_DEVIATION = (0.3, 0.05, 0.06, 0.12, 0.12)
P = len(FEATURES)
#: Share of the least variances that is added to all variances.
RIDGE = 0.05
#: Width of the bins of vectors, in least deviations.
BIN = 0.5
#: Distances fall into steps of a factor of 2 ** (1 / STEPS).
STEPS = 32
PAIRS = [(i, j) for i in range(P) for j in range(i, P)]
MOMENTS = ["n", *(f"s{i}" for i in range(P)), *(f"p{i}_{j}" for i, j in PAIRS)]


def chi_square_share(x: float, p: int) -> float:
    """Distribution function of chi-square with p degrees of freedom, by its power series."""
    a, x = p / 2, x / 2
    term = total = 1 / a
    k = a
    while term > total * 1e-15:
        k += 1
        term *= x / k
        total += term
    return total * math.exp(-x + a * math.log(x) - math.lgamma(a))


def chi_square_quantile(share: float, p: int) -> float:
    low, high = 1e-9, 200.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square_share(middle, p) < share else (low, middle)
    return high


def base_counts(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` columns with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, SPACES, "") != "")
    a = docs.select(
        *keep, words_of(text_col).alias("_words"), lines.alias("_lines"), F.length(F.translate(text, SPACES, "")).cast("bigint").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
    )
    counts = ["word_chars", "n_symbols"]
    b = a.select(
        *keep, *counts, F.size("_words").cast("bigint").alias("n_words"), F.size("_lines").cast("bigint").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"), F.transform("_words", lambda w: F.xxhash64(w)).alias("_hashes"),
    )
    counts += ["n_words", "n_lines", "n_dup_lines"]
    at = lambda i, k: F.get(F.col("_hashes"), i + k)
    grams = F.transform(F.sequence(F.lit(0), F.size("_hashes") - GRAM), lambda i: F.xxhash64(*(at(i, k) for k in range(GRAM))))
    c = b.select(*keep, *counts, F.when(F.size("_hashes") >= GRAM, grams).otherwise(F.array().cast("array<bigint>")).alias("_grams"))
    twice = F.size(F.array_distinct("_grams")) < F.size("_grams")
    d = c.select(*keep, *counts, F.when(twice, F.sort_array(F.transform("_grams", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))).alias("_sorted"))
    same = lambda k, by: F.coalesce(F.get("_sorted", k)["g"] == F.get("_sorted", k + by)["g"], F.lit(False))
    doubled = F.filter(F.sequence(F.lit(0), F.size("_sorted") - 1), lambda k: ((k > 0) & same(k, -1)) | same(k, 1))
    e = d.select(*keep, *counts, F.when(F.col("_sorted").isNotNull(), F.sort_array(F.transform(doubled, lambda k: F.get("_sorted", k)["i"]))).alias("_places"))
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("end"))
    covered = F.aggregate("_places", start, lambda s, i: F.struct((s["n"] + i + GRAM - F.greatest(i, s["end"])).alias("n"), (i + GRAM).alias("end")), lambda s: s["n"])
    return e.select(*keep, *counts, F.coalesce(covered, F.lit(0)).alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def vectors() -> list[Column]:
    """The transformed statistics, rounded so that sums hardly depend on their order."""
    part = lambda a, b: F.sqrt(F.col(a) / F.greatest(F.col(b), F.lit(1)))
    made = (F.log1p("n_words"), F.log((F.col("word_chars") + 1) / (F.col("n_words") + 1)), part("n_symbols", "word_chars"), part("n_dup_lines", "n_lines"), part("n_repeat_words", "n_words"))
    return [F.round(x, 6).alias(n) for x, n in zip(made, FEATURES, strict=True)]


def moments(x: list[Column], n: Column) -> list[Column]:
    """What ``n`` documents with the vector ``x`` add to the sums."""
    n = n.cast("double")
    return [n.alias("n"), *((n * v).alias(f"s{i}") for i, v in enumerate(x)), *((n * x[i] * x[j]).alias(f"p{i}_{j}") for i, j in PAIRS)]


def summed(rows: DataFrame, *by: str) -> DataFrame:
    """(*by, MOMENTS): sums by key."""
    return rows.groupBy(*by).agg(*(F.sum(m).alias(m) for m in MOMENTS))


def binned(rows: DataFrame, *by: str) -> DataFrame:
    """(*by, MOMENTS) of the vectors of each bin."""
    bins = [F.floor(F.col(f) / (BIN * LEAST_DEVIATION[i])).alias(f"b{i}") for i, f in enumerate(FEATURES)]
    return summed(rows.select(*by, *bins, *moments([F.col(f) for f in FEATURES], F.lit(1))), *by, *(f"b{i}" for i in range(P))).drop(*(f"b{i}" for i in range(P)))


def means() -> list[Column]:
    """The mean vector of a row of sums."""
    return [F.col(f"s{i}") / F.col("n") for i in range(P)]


def regular(i: int) -> float:
    """What is added to the variance of statistic ``i``."""
    return RIDGE * LEAST_DEVIATION[i] ** 2


def solved(rows: DataFrame) -> DataFrame:
    """Adds inverse and log_det of a regularised ``scatter``.

    Gauss-Jordan elimination, one fold over the columns; the determinant is the product of the
    pivots.  None of a regularised scatter is less than the least ridge, but for rounding.
    """
    least = F.lit(min(map(regular, range(P))) / 2)
    wide = F.transform("scatter", lambda row, i: F.concat(row, F.transform(F.sequence(F.lit(0), F.lit(P - 1)), lambda j: (i == j).cast("double"))))
    pivot = lambda m, k: F.greatest(F.get(F.get(m, k), k), least)
    less = lambda m, k: F.transform(m, lambda row, i: F.transform(row, lambda v, j: F.when(i == k, v / pivot(m, k)).otherwise(v - F.get(row, k) * F.get(F.get(m, k), j) / pivot(m, k))))
    step = lambda s, k: F.struct(less(s["m"], k).alias("m"), (s["log_det"] + F.log(pivot(s["m"], k))).alias("log_det"))
    out = rows.withColumn("r", F.aggregate(F.sequence(F.lit(0), F.lit(P - 1)), F.struct(wide.alias("m"), F.lit(0.0).alias("log_det")), step))
    return out.withColumns({"inverse": F.transform("r.m", lambda row: F.slice(row, P + 1, P)), "log_det": F.col("r.log_det")}).drop("r")


def matrix(entry) -> Column:
    return F.array(*(F.array(*(entry(i, j) for j in range(P))) for i in range(P)))


def estimate(sums: DataFrame, *by: str) -> DataFrame:
    """(*by, n, centre, scatter, inverse, log_det) from sums; the scatter is regularised."""
    mean = means()
    cov = {(i, j): F.col(f"p{i}_{j}") / F.col("n") - mean[i] * mean[j] for i, j in PAIRS}
    entry = lambda i, j: F.greatest(cov[i, i], F.lit(LEAST_DEVIATION[i] ** 2)) + regular(i) if i == j else cov[min(i, j), max(i, j)]
    return solved(summed(sums, *by).select(*by, "n", F.array(*mean).alias("centre"), matrix(entry).alias("scatter")))


def distance(x: list[Column]) -> Column:
    """Squared Mahalanobis distance of a vector from ``centre`` by ``inverse``."""
    z = [v - F.col("centre")[i] for i, v in enumerate(x)]
    total = F.lit(0.0)
    for i, j in PAIRS:
        total = total + z[i] * z[j] * F.col("inverse")[i][j] * (1 if i == j else 2)
    return F.greatest(total, F.lit(0.0))


def nearest(measured: DataFrame, share: float, *by: str) -> DataFrame:
    """The bins of each key (with columns n, d2) in the steps of distance that hold its nearest share."""
    w = Window.partitionBy(*by)  # as many rows as a group has bins
    told = measured.withColumn("step", F.ceil(F.log2(F.col("d2") + 2.0**-20) * STEPS))
    told = told.withColumns({"before": F.coalesce(F.sum("n").over(w.orderBy("step").rangeBetween(Window.unboundedPreceding, -1)), F.lit(0.0)), "all": F.sum("n").over(w)})
    return told.where(F.col("before") < F.col("all") * share).drop("step", "before", "all")


def medians(rows: DataFrame, width: float = 0.01) -> DataFrame:
    """(group, medians) to within ``width`` of (group, n, x), from counts of rounded values."""
    long = rows.select("group", "n", F.posexplode("x").alias("feature", "v")).withColumn("bin", F.floor(F.col("v") / width))
    counted = long.groupBy("group", "feature", "bin").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("group", "feature")
    running = counted.withColumns({"upto": F.sum("n").over(w.orderBy("bin")), "all": F.sum("n").over(w)})
    each = running.where(F.col("upto") * 2 >= F.col("all")).groupBy("group", "feature").agg((F.min("bin") * width + width / 2).alias("median"))
    return each.groupBy("group").agg(F.transform(F.sort_array(F.collect_list(F.struct("feature", "median"))), lambda s: s["median"]).alias("medians"))  # one a feature


def first_estimate(bins: DataFrame) -> DataFrame:
    """(group, centre, deviation, scatter, inverse): medians, median absolute deviations, and their diagonal."""
    points = bins.select("group", "n", F.array(*means()).alias("x"))
    centre = stored(medians(points).withColumnRenamed("medians", "centre"), "quality-medians")
    away = points.join(centre, "group").select("group", "n", F.zip_with("x", "centre", lambda a, b: F.abs(a - b)).alias("x"))
    deviation = [F.greatest(F.lit(LEAST_DEVIATION[i]), F.lit(1.4826) * F.col("medians")[i]) for i in range(P)]
    scatter = matrix(lambda i, j: deviation[i] * deviation[i] + regular(i) if i == j else F.lit(0.0))
    return solved(centre.join(medians(away), "group").select("group", "centre", F.array(*deviation).alias("deviation"), scatter.alias("scatter")))


def starts(bins: DataFrame, first: DataFrame) -> DataFrame:
    """(group, start, centre, inverse, best, fell): three estimates of each group from which concentration begins."""
    z = [(x - F.col("centre")[i]) / F.col("deviation")[i] for i, x in enumerate(means())]
    long = F.sqrt(sum((x * x for x in z[1:]), z[0] * z[0]))
    sign = [F.col("centre")[i] + F.col("deviation")[i] * F.coalesce(z[i] / F.nullif(long, F.lit(0.0)), F.lit(0.0)) for i in range(P)]
    signs = bins.join(first, "group").select("group", *moments(sign, F.col("n")))
    out = None
    for k, part in enumerate((first, estimate(bins, "group"), estimate(signs, "group"))):
        part = part.select("group", F.lit(k).alias("start"), "centre", "inverse", F.lit(None).cast(BEST).alias("best"), F.lit(True).alias("fell"))
        out = part if out is None else out.unionByName(part)
    return stored(out, "quality-starts")


def minimum_covariance(bins: DataFrame, first: DataFrame) -> DataFrame:
    """(group, centre, scatter, log_det) of a stored table (group, MOMENTS): the nearest share of least determinant."""
    by = ["group", "start"]
    current = starts(bins, first)
    while True:
        active = current.where("fell")
        measured = bins.join(active.select(*by, "centre", "inverse"), "group").withColumn("d2", distance(means()))
        found = estimate(nearest(measured, SUPPORT, *by), *by).join(active.select(*by, F.col("best").alias("held")), by)
        less = F.col("held").isNull() | (F.col("log_det") < F.col("held.log_det"))
        best = F.when(less, F.struct("log_det", "centre", "scatter")).otherwise(F.col("held"))
        fell = F.col("held").isNull() | (F.col("held.log_det") - F.col("log_det") > SETTLED)
        after = found.select(*by, "centre", "inverse", best.alias("best"), fell.alias("fell"))
        current = stored(after.unionByName(current.where("not fell")), "quality-step")
        if current.where("fell").isEmpty():
            return current.groupBy("group").agg(F.min_by("best", F.struct("best.log_det", "start")).alias("best")).select("group", "best.*")


def widened() -> float:
    """By how much the scatter of a normal sample's nearest share is too narrow."""
    return SUPPORT / chi_square_share(chi_square_quantile(SUPPORT, P), P + 2)


def blended(own: DataFrame, larger: DataFrame) -> DataFrame:
    """(*, centre, scatter): of (group, within, n, centre, scatter), each with the estimate (group, centre, scatter) of what it lies within."""
    wide = larger.select(F.col("group").alias("within"), F.col("centre").alias("c"), F.col("scatter").alias("s"))
    share = F.col("n") / (F.col("n") + PRIOR_ROWS)
    mix = lambda a, b: share * a + (1 - share) * b
    made = {"centre": F.zip_with("centre", "c", mix), "scatter": F.zip_with("scatter", "s", lambda a, b: F.zip_with(a, b, mix))}
    return own.join(wide, "within").withColumns(made).drop("c", "s")


def estimates(bins: DataFrame) -> DataFrame:
    """(own, centre, inverse) by which each (language, source) is judged, of a stored table (own, pool, MOMENTS)."""
    every = bins.select("own", "pool", F.lit(EVERY).alias("every"), *MOMENTS)
    levels = stored(every.select(F.explode(F.array("own", "pool", "every")).alias("group"), *MOMENTS), "quality-levels")
    first = stored(first_estimate(levels), "quality-first")
    found = stored(minimum_covariance(levels, first).join(levels.groupBy("group").agg(F.sum("n").alias("n")), "group"), "quality-found")
    within = every.select(F.explode(F.array(F.struct(F.col("own").alias("group"), F.col("pool").alias("within"), F.lit(0).alias("level")), F.struct(F.col("pool").alias("group"), F.col("every").alias("within"), F.lit(1).alias("level")))).alias("w"))
    tree = found.join(within.select("w.*").distinct(), "group")
    narrow = F.transform("scatter", lambda row: F.transform(row, lambda v: v / widened()))  # medians see all documents
    top = blended(found.where(F.col("group") == EVERY).withColumn("within", F.col("group")), first.where(F.col("group") == EVERY).select("group", "centre", narrow.alias("scatter")))
    pools = blended(tree.where("level = 1"), top)
    owns = blended(tree.where("level = 0"), pools)
    return solved(owns.select(F.col("group").alias("own"), "centre", "scatter")).select("own", "centre", "inverse")


def judge(counted: DataFrame) -> DataFrame:
    """Adds base_failed, distance2 and kept to a stored table with the counts, lang and source."""
    tag = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-"))
    named = {"own": F.concat_ws("\x01", F.lit("own"), tag("lang"), tag("source")), "pool": F.concat_ws("\x01", F.lit("pool"), tag("lang"))}
    rows = counted.withColumns({"base_failed": base_failed(), **named}).select("*", *vectors())
    limit = chi_square_quantile(CUTOFF, P) * widened()
    with scratch() as keep:
        bins = stored(binned(rows.where(~F.col("base_failed")), "own", "pool"), "quality-bins")
        fitted = keep(stored(estimates(bins), "quality-estimates"))
    judged = rows.join(fitted, "own", "left")
    out = judged.withColumn("distance2", F.when(F.col("centre").isNotNull(), distance([F.col(f) for f in FEATURES])))
    return out.withColumn("kept", ~F.col("base_failed") & (F.coalesce("distance2", F.lit(0.0)) <= limit)).drop("own", "pool", "centre", "inverse", *FEATURES)


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang, source, counts, base_failed, distance2, kept) of every document."""
    return judge(stored(base_counts(docs, [id_col, "lang", "source"], text_col), "quality-counts"))

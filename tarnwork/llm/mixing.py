"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in a hashed order.  A document's virtual finish time
is its source's cumulative size up to it, divided by the source's target; a source may be
read up to ``MAX_EPOCHS`` times.  All queues are merged by finish time and cut at the total
budget.  No queue is ever held by one task: cumulative sums run inside hash buckets, whose
totals are summed first.

Edge cases: null texts and texts without words have size 0 and take 0 words; null sources
are one source, the last; rows that repeat are separate documents; null ids are mixed like
others, in the place of an empty id; an empty table gives an empty mix; texts of any length are
counted whole; other columns are dropped by ``mix`` and kept by ``mixed_documents``, whatever
their names.  The mix depends on the rows only, not on their order or partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwork.llm.common import SPACE_RUN, SPACES, free_name, scratch, small_side, stored

#: Weights by the rank of a source's name, repeating.
WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
#: Rows that share a hash bucket or a bucket of finish times, on average.
BUCKET_ROWS = 2000
MAX_BUCKET_BITS = 20


def words_of(text: str | Column) -> Column:
    """The words of a text, none for null."""
    c = F.col(text) if isinstance(text, str) else text
    trimmed = F.btrim(F.coalesce(c, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RUN))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target) of a table (source, size).

    The targets share the total size by weight, none above ``cap`` times its source: sources
    are filled in the order of cap / weight, and one is capped if the water level that fills
    it does not use up the total.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = per_source.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") - 1) % len(weights) + 1)
    w = ranked.select("source", "source_size", "rank", weight.alias("weight"), (F.lit(cap) * F.col("source_size")).alias("cap"))
    w = w.withColumn("level", F.col("cap").cast("double") / F.col("weight"))
    order = Window.orderBy("level", "rank")
    before, on = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    w = w.withColumns({
        "full": F.coalesce(F.sum("cap").over(before), F.lit(0)), "rest": F.sum("weight").over(on),
        "total": F.sum("source_size").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
    })
    w = w.withColumn("capped", F.col("level") * F.col("rest") + F.col("full") <= F.col("total"))
    every = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w = w.withColumns({"taken": F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(every), F.lit(0)), "open": F.sum(F.when(~F.col("capped"), F.col("weight"))).over(every)})
    share = F.col("weight") * ((F.col("total") - F.col("taken")).cast("double") / F.col("open"))
    return w.select("source", "source_size", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(share).alias("target"))


def _bits(rows: int) -> int:
    return min(MAX_BUCKET_BITS, max(0, (rows // BUCKET_ROWS).bit_length()))


def finish_times(rows: DataFrame, goal: DataFrame, n: int) -> DataFrame:
    """(row, size, epoch, finish): every reading of every document that may be taken.

    ``rows`` is (row, doc_id, source, size); ``goal`` comes from ``targets``.
    """
    order = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("bigint")
    hashed = rows.withColumn("key", order).withColumn("bucket", F.shiftright("key", 60 - _bits(n)))
    totals = hashed.groupBy("source", "bucket").agg(F.sum("size").alias("inside"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("inside").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("source", "bucket").orderBy("key", F.col("doc_id").asc_nulls_last(), "size", "row").rowsBetween(Window.unboundedPreceding, 0)
    summed = hashed.withColumn("inside", F.sum("size").over(within))
    queued = summed.join(offsets, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    queued = queued.select("row", "doc_id", "source", "size", "key", (F.col("offset") + F.col("inside")).alias("reached"))
    aims = goal.where("target > 0").select(F.col("source").alias("s"), "source_size", "target", F.least(F.lit(MAX_EPOCHS), F.ceil(F.col("target") / F.col("source_size"))).cast("int").alias("epochs"))
    read = queued.join(aims, F.col("source").eqNullSafe(F.col("s"))).withColumn("epoch", F.explode(F.sequence(F.lit(1), "epochs")))
    return read.select("row", "doc_id", "source", "size", "epoch", ((F.col("reached") + (F.col("epoch") - 1) * F.col("source_size")).cast("double") / F.col("target")).alias("finish"))


def taken_readings(read: DataFrame, budget: int, n: int) -> DataFrame:
    """The readings that the merged order takes before the budget is used up.

    Finish times are range-partitioned into buckets; only the bucket in which the budget ends
    is ordered row by row.
    """
    scale = 1 << _bits(n)
    cut = read.withColumn("bucket", F.floor(F.col("finish") * scale))
    totals = cut.groupBy("bucket").agg(F.sum("size").alias("inside"))
    running = totals.withColumn("after", F.sum("inside").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)))
    last = running.where(F.col("after") > budget).orderBy("bucket").limit(1).select("bucket", (F.col("after") - F.col("inside")).alias("used")).first()
    if last is None:
        return cut
    whole = cut.where(F.col("bucket") < last["bucket"])
    order = Window.partitionBy("bucket").orderBy("finish", F.col("source").asc_nulls_last(), F.col("doc_id").asc_nulls_last(), "epoch", "size", "row").rowsBetween(Window.unboundedPreceding, 0)
    edge = cut.where(F.col("bucket") == last["bucket"]).withColumn("after", F.sum("size").over(order) + last["used"])
    return whole.unionByName(edge.where(F.col("after") <= budget).drop("after"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(row, doc_id, source, size, source_size, target, times): how often each document is taken.

    ``row`` numbers the rows of ``docs`` as this call read them.
    """
    sized = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.size(words_of(text_col)).cast("bigint").alias("size"))
    return mix_sized(stored(sized, "mix-sizes"))


def mix_sized(rows: DataFrame) -> DataFrame:
    """The same for a stored table (row, doc_id, source, size)."""
    with scratch() as keep:
        goal = keep(stored(targets(rows), "mix-targets"))
        n, budget = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
        read = finish_times(rows, goal, n)
        times = taken_readings(read, budget, n).groupBy("row").agg(F.count("*").alias("times"))
    aims = goal.select(F.col("source").alias("s"), "source_size", "target")
    out = rows.join(times, "row", "left").join(aims, F.col("source").eqNullSafe(F.col("s")))
    return out.select("row", "doc_id", "source", "size", "source_size", "target", F.coalesce("times", F.lit(0)).alias("times"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken."""
    row, times, epoch = (free_name(docs, x) for x in ("mix_row", "mix_times", "mix_epoch"))
    with scratch() as keep:
        return _mixed(docs, keep, row, times, epoch, id_col, text_col, source_col)


def _mixed(docs: DataFrame, keep, row: str, times: str, epoch: str, id_col: str, text_col: str, source_col: str) -> DataFrame:
    kept = keep(stored(docs.withColumn(row, F.monotonically_increasing_id()), "mix-documents"))
    sized = kept.select(F.col(row).alias("row"), F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.size(words_of(text_col)).cast("bigint").alias("size"))
    taken = keep(stored(mix_sized(stored(sized, "mix-sizes")).where("times > 0").select(F.col("row").alias(row), F.col("times").cast("int").alias(times)), "mix-taken"))
    return kept.join(small_side(taken), row).withColumn(epoch, F.explode(F.sequence(F.lit(1), times))).drop(row, times, epoch)

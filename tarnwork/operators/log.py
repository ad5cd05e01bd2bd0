"""Session logs: scans, merges, packing, pairing and repair."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LOG = ("session_id", "seq")


def suffix(log: DataFrame, start: int) -> DataFrame:
    return log.where(F.col("seq") >= start)


def tail(log: DataFrame, n: int) -> DataFrame:
    """The last n events of every session."""
    w = Window.partitionBy("session_id").orderBy(F.desc("seq"))
    return log.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def broken(log: DataFrame) -> DataFrame:
    """Sessions whose seq is not contiguous from zero, and where it breaks."""
    w = Window.partitionBy("session_id").orderBy("seq")
    return log.withColumn("expected", F.row_number().over(w) - 1).where(F.col("seq") != F.col("expected")).groupBy("session_id").agg(F.min("expected").alias("expected"))


def latest(rows: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The row of the highest version of each key (upsert)."""
    names = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*names), F.col(version)).alias("_v")).select(*keys, "_v.*")


def apply_changes(rows: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Puts and deletes applied to a keyed table; of several changes the last by ``at`` counts."""
    last = latest(changes, [key], "at")
    kept = rows.join(last.select(key), key, "left_anti")
    return kept.unionByName(last.where("op = 'put'").select(*rows.columns))


def corpus(live: DataFrame, persisted: DataFrame, key: str = "id") -> DataFrame:
    """Live rows, and persisted ones that are not live; both availabilities told."""
    names = [c for c in live.columns if c != key]
    a, b = live.select(key, F.struct(*names).alias("_a")), persisted.select(key, F.struct(*names).alias("_b"))
    both = a.join(b, key, "full")
    return both.select(key, F.coalesce("_a", "_b").alias("_v"), F.col("_a").isNotNull().alias("live"), F.col("_b").isNotNull().alias("persisted")).select(key, "_v.*", "live", "persisted")


def snapshot_changes(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """(key, change): added, removed or modified between two snapshots."""
    b, a = before.select(key, F.col(value).alias("_b")), after.select(key, F.col(value).alias("_a"))
    change = F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "removed").when(F.col("_a") != F.col("_b"), "modified")
    return b.join(a, key, "full").select(key, change.alias("change")).where("change is not null")


PACK_LEAST, PACK_MOST, PACK_BYTES = 3, 1024, 1 << 20


def packed(log: DataFrame, kind: str, least: int = PACK_LEAST, most: int = PACK_MOST) -> DataFrame:
    """Runs of consecutive events of ``kind`` as rows (session_id, seq0, time0, n, dt, values).

    A run is cut every ``most`` events; pieces under ``least`` stay unpacked and are left out here.
    """
    w = Window.partitionBy("session_id").orderBy("seq")
    own = log.where(F.col("type") == kind).withColumn("run", F.col("seq") - F.row_number().over(w))
    in_run = Window.partitionBy("session_id", "run").orderBy("seq")
    cut = own.withColumns({"piece": F.floor((F.row_number().over(in_run) - 1) / most), "gap": F.col("time") - F.lag("time").over(in_run)})
    in_piece = Window.partitionBy("session_id", "run", "piece").orderBy("seq")
    cut = cut.withColumn("gap", F.when(F.row_number().over(in_piece) == 1, 0).otherwise(F.col("gap")))
    members = F.sort_array(F.collect_list(F.struct("seq", "gap", "value")))
    rows = cut.groupBy("session_id", "run", "piece").agg(F.min("seq").alias("seq0"), F.min_by("time", "seq").alias("time0"), F.count("*").alias("n"), members.alias("m"))
    return rows.where(F.col("n") >= least).select("session_id", "seq0", "time0", "n", F.transform("m", lambda x: x["gap"]).alias("dt"), F.transform("m", lambda x: x["value"]).alias("values"))


def unpacked(rows: DataFrame) -> DataFrame:
    """(session_id, seq, time, value): packed rows back to events."""
    total = F.aggregate(F.slice("dt", 1, F.col("k") + 1), F.lit(0).cast("bigint"), lambda a, x: a + x)
    each = rows.select("session_id", "seq0", "time0", "dt", F.posexplode("values").alias("k", "value"))
    return each.select("session_id", (F.col("seq0") + F.col("k")).alias("seq"), (F.col("time0") + total).alias("time"), "value")


def byte_bounded(rows: DataFrame, limit: int) -> DataFrame:
    """(session_id, seq, part): greedy parts whose texts stay within ``limit`` bytes, one text at least."""

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        part, used, out = 0, 0, []
        for size in pdf["size"]:
            if out and used + size > limit:
                part, used = part + 1, 0
            used += size
            out.append(part)
        return pd.DataFrame({"session_id": pdf["session_id"], "seq": pdf["seq"], "part": out})

    sized = rows.select("session_id", "seq", F.octet_length("text").alias("size"))
    return sized.groupBy("session_id").applyInPandas(cut, "session_id bigint, seq bigint, part bigint")


def paired_calls(log: DataFrame, call: str, result: str) -> DataFrame:
    """(session_id, seq, turn, result_seq, wait): each call and the first result after it in its turn."""
    w = Window.partitionBy("session_id", "turn").orderBy("seq").rowsBetween(1, Window.unboundedFollowing)
    nxt = F.first(F.when(F.col("type") == result, F.struct("seq", "time")), ignorenulls=True).over(w)
    return log.withColumn("_n", nxt).where(F.col("type") == call).select("session_id", "seq", "turn", F.col("_n.seq").alias("result_seq"), (F.col("_n.time") - F.col("time")).alias("wait"))


def orphan_results(log: DataFrame, call: str, result: str) -> DataFrame:
    """Results with no call before them in their turn."""
    w = Window.partitionBy("session_id", "turn").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    before = F.max(F.when(F.col("type") == call, F.col("seq"))).over(w)
    return log.withColumn("_c", before).where((F.col("type") == result) & F.col("_c").isNull()).select("session_id", "seq", "turn")


def closers(log: DataFrame, opened: str, closed: str) -> DataFrame:
    """(session_id, seq, type): an end event for every session whose last turn is still open."""
    last = log.groupBy("session_id").agg(
        F.max(F.when(F.col("type") == opened, F.col("seq"))).alias("o"), F.max(F.when(F.col("type") == closed, F.col("seq"))).alias("c"), F.max("seq").alias("last")
    )
    return last.where("o is not null and (c is null or c < o)").select("session_id", (F.col("last") + 1).alias("seq"), F.lit(closed).alias("type"))


def retained(log: DataFrame, budget: int) -> DataFrame:
    """The newest events of each session whose texts fit a byte budget; the newest always stays."""
    w = Window.partitionBy("session_id").orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, 0)
    used = log.withColumn("used", F.sum(F.octet_length("text")).over(w)).withColumn("back", F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("seq"))))
    return used.where((F.col("used") <= budget) | (F.col("back") == 1)).select("session_id", "seq", "used")


def timeline(spans: DataFrame, key: str) -> DataFrame:
    """Spans (key, id, start, end) with idle time between them taken out."""
    w = Window.partitionBy(key).orderBy("start", "id")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    idle = F.greatest(F.col("start") - before, F.lit(0))
    told = spans.withColumn("idle", F.coalesce(idle, F.lit(0))).withColumn("skipped", F.sum("idle").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return told.select(key, "id", "idle", (F.col("start") - F.col("skipped")).alias("from"), (F.col("end") - F.col("skipped")).alias("to"))


def overlapping(spans: DataFrame, low: int, high: int) -> DataFrame:
    return spans.where((F.col("start") <= high) & (F.col("end") >= low))

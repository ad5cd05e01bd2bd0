"""Aggregates over session logs.

Logs here have session_id, seq, type, time, and where needed turn, step and value.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwork.operators.prefix import running

STEP = ["session_id", "turn", "step"]


def order():
    """Events of a session in order."""
    return Window.partitionBy("session_id").orderBy("seq")


def of(kind: str, value: Column | str) -> Column:
    return F.when(F.col("type") == kind, F.col(value) if isinstance(value, str) else value)


def turns_and_steps(log: DataFrame) -> DataFrame:
    """Turn changes between successive steps (not distinct turns), and steps."""
    steps = log.where("type = 'step/start'")
    changed = F.coalesce(F.col("turn") != F.lag("turn").over(order()), F.lit(True))
    return steps.withColumn("changed", changed).groupBy("session_id").agg(F.count_if("changed").alias("turns"), F.count("*").alias("steps"))


def step_times(log: DataFrame) -> DataFrame:
    """(session, turn, step, start, first_token, message): when each step began, first spoke and answered."""
    return log.where("step > 0").groupBy(*STEP).agg(F.min(of("step/start", "time")).alias("start"), F.min(of("assistant/chunk", "time")).alias("first_token"), F.min(of("assistant/message", "time")).alias("message"))


def model_time(log: DataFrame) -> DataFrame:
    """Wall time of answered steps."""
    t = step_times(log).where("message is not null")
    return t.groupBy("session_id").agg(F.sum(F.greatest(F.lit(0), F.col("message") - F.col("start"))).alias("model_ms"), F.count("*").alias("answered"))


def first_token_time(log: DataFrame) -> DataFrame:
    t = step_times(log).where("first_token is not null")
    return t.groupBy("session_id").agg(F.sum(F.greatest(F.lit(0), F.col("first_token") - F.col("start"))).alias("ttft_ms"), F.count("*").alias("ttft_n"))


def decode_time(log: DataFrame) -> DataFrame:
    """Time from the first token to the answer, of steps that have both."""
    t = step_times(log).where("first_token is not null and message is not null and message >= first_token")
    return t.groupBy("session_id").agg(F.sum(F.col("message") - F.col("first_token")).alias("decode_ms"), F.count("*").alias("decoded"))


def usage(log: DataFrame, kind: str = "assistant/message") -> DataFrame:
    """Token totals; a sample for the same step as the sample just before replaces it."""
    samples = log.where(F.col("type") == kind)
    last = F.coalesce((F.lead("turn").over(order()) != F.col("turn")) | (F.lead("step").over(order()) != F.col("step")), F.lit(True))
    return samples.withColumn("last", last).where("last").groupBy("session_id").agg(F.round(F.sum("value"), 4).alias("tokens"), F.count("*").alias("samples"))


def pressure(log: DataFrame, window: float) -> DataFrame:
    """The last usage sample, what was added since, and their share of the context window."""
    last = log.where("type = 'assistant/message'").groupBy("session_id").agg(F.max("seq").alias("s"), F.max_by("value", "seq").alias("sample"))
    after = log.join(last, "session_id", "left").withColumn("new", F.when(F.col("s").isNull() | (F.col("seq") > F.col("s")), F.col("value")).otherwise(0.0))
    out = after.groupBy("session_id").agg(F.coalesce(F.max("sample"), F.lit(0.0)).alias("sample"), F.round(F.sum("new"), 4).alias("added"))
    return out.select("session_id", "sample", "added", F.round((F.col("sample") + F.col("added")) / window, 6).alias("pressure"))


def failure_rate(log: DataFrame, span_ms: int, most: int) -> DataFrame:
    """Share of failures among up to ``most`` samples of the last ``span_ms``, at every sample."""
    recent = Window.partitionBy("session_id").orderBy("time").rangeBetween(-span_ms, 0)
    rows = Window.partitionBy("session_id").orderBy("time", "seq").rowsBetween(-(most - 1), 0)
    failed = F.when(F.col("type") == "tool/result", 1.0).otherwise(0.0)
    r = log.withColumn("failed", failed).withColumns({"in_time": F.count("*").over(recent), "rate_time": F.avg("failed").over(recent), "rate_rows": F.avg("failed").over(rows)})
    return r.select("session_id", "seq", F.round(F.when(F.col("in_time") <= most, F.col("rate_time")).otherwise(F.col("rate_rows")), 6).alias("rate"))


def streaks(log: DataFrame, value: str = "type") -> DataFrame:
    """(session_id, seq, streak): the length so far of each run of equal values."""
    fresh = F.coalesce((F.lag(value).over(order()) != F.col(value)).cast("int"), F.lit(1))
    runs = log.withColumn("_f", fresh).withColumn("run", F.sum("_f").over(order().rowsBetween(Window.unboundedPreceding, 0)))
    return runs.select("session_id", "seq", F.row_number().over(Window.partitionBy("session_id", "run").orderBy("seq")).cast("bigint").alias("streak"))


def balance(log: DataFrame, up: str, down: str) -> DataFrame:
    """Running calls minus results; balanced where none is open."""
    step = F.when(F.col("type") == up, 1).when(F.col("type") == down, -1).otherwise(0)
    return log.withColumn("_s", step).select("session_id", "seq", F.sum("_s").over(order().rowsBetween(Window.unboundedPreceding, 0)).alias("open"))


def low_output(log: DataFrame, n: int, least: float) -> DataFrame:
    """Whether the last n answers, and at least n, were all under ``least``."""
    w = order().rowsBetween(-(n - 1), 0)
    own = log.where("type = 'assistant/message'")
    return own.select("session_id", "seq", ((F.count("*").over(w) == n) & (F.max("value").over(w) < least)).alias("low"))


def around(log: DataFrame, hits: DataFrame, before: int, after: int, most: int = 50) -> DataFrame:
    """(session_id, hit, seq): neighbours of hits, ``most`` for each at most."""
    near = log.select("session_id", "seq").join(hits.select("session_id", F.explode(F.sequence(F.col("seq") - min(before, most - 1), F.col("seq") + min(after, most - 1))).alias("seq"), F.col("seq").alias("hit")), ["session_id", "seq"])
    w = Window.partitionBy("session_id", "hit").orderBy("seq")
    return near.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).select("session_id", "hit", "seq")


def list_metadata(log: DataFrame) -> DataFrame:
    """(session_id, blank, last_prompt): whether no turn began, and when a person last spoke."""
    return log.groupBy("session_id").agg((F.count_if(F.col("type") == "turn/start") == 0).alias("blank"), F.max_by(of("turn/start", "time"), F.when(F.col("type") == "turn/start", F.col("seq"))).alias("last_prompt"))


def fingerprint(rows: DataFrame, key: str, member: str) -> DataFrame:
    """SHA-256 of each key's sorted multiset, of its distinct members and how often each occurs."""
    counted = rows.groupBy(key, member).agg(F.count("*").alias("n"))
    each = F.transform(F.sort_array(F.collect_list(F.struct(member, "n"))), lambda x: F.concat_ws(":", x[member], x["n"].cast("string")))
    return counted.groupBy(key).agg(F.sha2(F.array_join(each, "\n"), 256).alias("fingerprint"))


def allocate(rows: DataFrame, weight: str, total: int) -> DataFrame:
    """Whole shares of ``total`` in proportion to a weight, what is left dealt round robin by id."""
    whole = rows.agg(F.sum(weight).alias("whole"))
    given = rows.join(F.broadcast(whole)).withColumn("share", F.floor(F.lit(total) * F.col(weight) / F.col("whole")))  # one row
    rest = given.agg((F.lit(total) - F.sum("share")).alias("rest"))
    return running(given, [], ["id"], name="place").join(F.broadcast(rest)).select("id", (F.col("share") + (F.col("place") <= F.col("rest")).cast("int")).cast("bigint").alias("share"))


class Slots:
    """The positions of a list from which members go: the k-th that is left, in logarithmic time.

    A tree of partial sums (Fenwick) over all slots that will ever be used.  New members come
    last, so slots to come do not change where the k-th of those that are there is.
    """

    def __init__(self, n: int):
        self.tree = [i & -i for i in range(n + 1)]
        self.high = 1 << n.bit_length() >> 1

    def find(self, k: int) -> int:
        """The slot with ``k`` others left before it."""
        at, step, k = 0, self.high, k + 1
        while step:
            if at + step < len(self.tree) and self.tree[at + step] < k:
                at += step
                k -= self.tree[at]
            step >>= 1
        return at

    def remove(self, slot: int) -> None:
        i = slot + 1
        while i < len(self.tree):
            self.tree[i] -= 1
            i += i & -i


def surface_of(ops: list[tuple]) -> list[str]:
    """The surface of each of a session's events (seq, op, start, end), in order."""
    slots = Slots(sum(op == "append" for _, op, _, _ in ops))
    holder: list[int] = []  # by slot, the event that stands there
    left, out = 0, ["log-only"] * len(ops)
    for i, (_, op, start, end) in enumerate(ops):
        if op == "append":
            holder.append(i)
            left += 1
            out[i] = "current"
        elif op == "replace":
            if not 0 <= start <= end < left:
                raise ValueError(f"SURFACE_RANGE: {start}..{end} of {left}")
            first = slots.find(int(start))
            out[holder[first]], out[i] = "shadowed", "current"
            holder[first] = i  # the new event stands where the first one stood
            for _ in range(int(end) - int(start)):
                gone = slots.find(int(start) + 1)
                slots.remove(gone)
                out[holder[gone]] = "shadowed"
                left -= 1
    return out


def surface(log: DataFrame) -> DataFrame:
    """(session_id, seq, surface): current, shadowed or log-only after all positional replaces.

    A replace takes out the current events at positions ``start`` to ``end`` and puts itself in
    their place; later positions count what is there then, so each session is folded in order.
    Each event comes and goes once, so a session of n events takes n log n steps.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Whole sessions of rows in order; a session that goes on in the next batch waits for it."""
        events: list[tuple] = []
        keys: list[tuple] = []
        for pdf in batches:
            out: list[tuple] = []
            for session, seq, op, start, end in zip(*(pdf[c].tolist() for c in ("session_id", "seq", "op", "start", "end")), strict=True):
                if keys and keys[-1][0] != session:
                    out += [(*k, x) for k, x in zip(keys, surface_of(events), strict=True)]
                    keys, events = [], []
                keys.append((session, seq))
                events.append((seq, op, start, end))
            yield pd.DataFrame(out, columns=["session_id", "seq", "surface"])
        yield pd.DataFrame([(*k, x) for k, x in zip(keys, surface_of(events), strict=True)], columns=["session_id", "seq", "surface"])

    # many sessions a call, since each call costs far more than a short session
    spread = int(log.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    told = F.coalesce(F.col("session_id").cast("string"), F.lit("")).alias("session_id")  # null is a session too
    rows = log.select(told, "seq", "op", "start", "end").repartition(spread, "session_id").sortWithinPartitions("session_id", "seq")
    found = rows.mapInPandas(fold, "session_id string, seq bigint, surface string")
    return found.withColumn("session_id", F.expr("cast(nullif(session_id, '') as bigint)"))


def replaced_last(log: DataFrame) -> DataFrame:
    """The surface of logs in which each ``replace`` takes out just the event before it: set based."""
    nxt = F.lead("op").over(order())
    return log.select("session_id", "seq", F.when(F.col("op").isNull(), "log-only").when(nxt == "replace", "shadowed").otherwise("current").alias("surface"))

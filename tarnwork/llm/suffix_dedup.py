"""Suffix-array deduplication by distributed prefix doubling on position rank pairs.

A byte goes if a 200-byte string that covers it also starts somewhere else.  Ranks are
64-bit fingerprints, equal exactly when the strings are.  Ranking every position at every
doubling would move sixteen bytes for each byte of text; so the first rank is taken at the
positions that winnowing selects: of the 101 hundred-byte strings inside a 200-byte string,
the one with the least fingerprint.  Equal 200-byte strings select the same place, so the
positions that must be compared keep meeting, and none is lost.

1. Rank the selected positions by their first 100 bytes; those unique drop out.
2. Rank the rest by the whole stretch of 200-byte strings that select them.  Stretches that
   repeat are done: all their strings repeat.
3. Where stretches differ although their first 100 bytes agree, every position p of one
   stretch of each kind gets the rank pair (100 bytes from p, 100 bytes from p + 100), which is
   the rank at the threshold.  Spark deals and sorts them by first rank, and where a rank has
   many kinds of stretches also by the pair; pairs seen twice are repeats.

``every_position`` is the method without that selection: Spark sorts the rank pairs of all
positions at offsets of 8, 16, 32, 64 and 72 bytes and ranks them anew, and unique positions
drop out.  It gives the same rows and costs many times the shuffle; README has figures.

Edge cases: null texts are empty; texts under 200 bytes lose nothing; repeated rows, ids
included, are copies of each other and of anything else that equals them; null ids are kept; an
empty table gives an empty result; a very long text comes in overlapping pieces; other
columns, whatever their names, are dropped at once.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwork.llm import fingerprints as fp
from tarnwork.llm.common import discard, map_batches, stored, texts
from tarnwork.operators.prefix import running

LENGTH = 200
HALF = 100
_CHUNK = 1 << 17
_LONG = 1 << 22
_PLACE_BITS = np.uint64(24)  # a piece has fewer positions than this many bits can tell
_PLACE = np.uint64((1 << 24) - 1)


def _sliding_least(v: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while have * 2 <= width:
        v = np.minimum(v[:-have], v[have:])
        have *= 2
    return np.minimum(v[: len(v) - (width - have)], v[width - have :]) if have < width else v


def _pieces(offsets: np.ndarray):
    """(first row, end row, from byte, to byte); a long row comes in overlapping pieces."""
    for a, b in fp.row_groups(offsets, _CHUNK):
        low, high = int(offsets[a]), int(offsets[b])
        if high - low <= _LONG + LENGTH:
            yield a, b, low, high
        else:
            for at in range(low, high - LENGTH + 1, _LONG):
                yield a, b, at, min(high, at + _LONG + LENGTH - 1)


def stretches(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, start, more, rank100, rank_stretch): each selected position's stretch of 200-byte
    strings, which start at ``start`` to ``start + more`` in the row."""
    out = []
    for a, b, low, high in _pieces(offsets):
        n = high - low
        if n < LENGTH:
            continue
        part = data[low:high]
        row_ends = np.minimum(offsets[a + 1 : b + 1], high) - low
        row_starts = np.maximum(offsets[a:b], low) - low
        sums = fp.prefix_sums(part, 0)
        starts = np.arange(n - HALF + 1)
        ranks = fp.mix(fp.spans(sums, starts, starts + HALF, 0))
        packed = (ranks >> _PLACE_BITS) << _PLACE_BITS | starts.astype(np.uint64)
        chosen = (_sliding_least(packed, LENGTH - HALF + 1) & _PLACE).astype(np.int64)
        ends = np.repeat(row_ends, row_ends - row_starts)[: len(chosen)]
        inside = np.flatnonzero(np.arange(len(chosen)) + LENGTH <= ends)
        if not len(inside):
            continue
        chosen = chosen[inside]
        cut = np.flatnonzero((np.diff(chosen) != 0) | (np.diff(inside) != 1)) + 1
        first, last = inside[np.concatenate(([0], cut))], inside[np.concatenate((cut, [len(inside)])) - 1]
        place = chosen[np.concatenate(([0], cut))]
        whole = fp.spans(fp.prefix_sums(part, 1), first, last + LENGTH, 1) ^ fp.mix((place - first).astype(np.uint64))
        row = np.searchsorted(row_starts, first, side="right") - 1 + a
        out.append((row, first + low - offsets[row], last - first, ranks[place], whole))
    if not out:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


KEY = ["tid", "size"]
#: Kinds of stretches of a rank for each of its slots, in which pairs are compared.
GROUP_KINDS = 1024
#: Stretches that a task compares at a time.
GROUP_ROWS = 8192


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, tid, size, text): a text's key is the first 64 bits of its SHA-256 and its size."""
    t = texts(docs, id_col, text_col).withColumn("digest", F.sha2(text_col, 256))
    half = lambda at: F.conv(F.substring("digest", at, 8), 16, 10).cast("bigint")
    return t.select(id_col, F.shiftleft(half(1), 32).bitwiseOR(half(9)).alias("tid"), F.octet_length(text_col).alias("size"), F.col(text_col).alias("text"))


def selected(rows: DataFrame) -> DataFrame:
    """(rank, stretch, tid, size, start, more, copies) of every selected position of a text."""

    def work(batch: pa.RecordBatch) -> dict:
        row, start, more, rank, whole = stretches(*fp.buffer_of(batch.column(2)))
        pick = lambda k: batch.column(k).to_numpy(zero_copy_only=False)[row]
        return {"rank": rank.view(np.int64), "stretch": whole.view(np.int64), "tid": pick(0), "size": pick(1), "start": start.astype(np.int32), "more": more.astype(np.int32)}

    made = map_batches(rows.select(*KEY, "text"), work, "rank bigint, stretch bigint, tid bigint, size int, start int, more int", size_col="text")
    return made.groupBy(*made.columns).agg(F.count("*").alias("copies"))


def _pairs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, near, far): the rank pair of every 200-byte string of packed stretches."""
    count = np.diff(offsets) - LENGTH + 1
    row = np.repeat(np.arange(len(count)), count)
    place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    at = offsets[:-1][row] + place
    sums = fp.prefix_sums(data, 0)
    rank = lambda p: fp.mix(fp.spans(sums, p, p + HALF, 0))
    return row, place, rank(at), rank(at + HALF)


def _slot(near: np.ndarray, far: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """In which of a rank's slots a pair is compared."""
    return (fp.mix(near ^ (far * np.uint64(0x9E3779B97F4A7C15))) % slots.astype(np.uint64)).astype(np.int32)


def contexts(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """(rank, slot, slots, tid, size, start, unsure, bytes): the bytes of each source stretch.

    A rank with many kinds of stretches has several slots, and a stretch goes to each slot in
    which one of its rank pairs is compared.
    """
    wanted = sources.groupBy(*KEY).agg(F.collect_list(F.struct("rank", "start", "more", "unsure", "slots")).alias("parts"))  # bounded by the text
    one = rows.groupBy(*KEY).agg(F.first("text").alias("text"))  # copies are reduced before the shuffle
    kinds = {"rank": pa.int64(), "slot": pa.int32(), "slots": pa.int32(), "tid": pa.int64(), "size": pa.int32(), "start": pa.int32(), "unsure": pa.bool_(), "bytes": pa.binary()}

    def work(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {c: [] for c in kinds}
        for tid, size, text, parts in zip(*(batch.column(i) for i in range(4)), strict=True):
            data = text.as_buffer().to_pybytes()
            for p in parts.as_py():
                told, slots = data[p["start"] : p["start"] + p["more"] + LENGTH], [0]
                if p["slots"] > 1:
                    _, _, near, far = _pairs(np.frombuffer(told, np.uint8), np.array([0, len(told)]))
                    slots = np.unique(_slot(near, far, np.array([p["slots"]]))).tolist()
                for slot in slots:
                    made = (p["rank"], slot, p["slots"], tid.as_py(), size.as_py(), p["start"], p["unsure"], told)
                    for column, x in zip(out.values(), made, strict=True):
                        column.append(x)
        return {c: pa.array(x, kinds[c]) for c, x in out.items()}

    schema = "rank bigint, slot int, slots int, tid bigint, size int, start int, unsure boolean, bytes binary"
    return map_batches(one.join(wanted, KEY).select(*KEY, "text", "parts"), work, schema, size_col="text", piece_bytes=1 << 18)


def _twice(batch: pa.Table) -> pa.RecordBatch:
    """The unsure positions whose rank pair occurs twice in a table of whole rank groups."""
    row, place, near, far = _pairs(*fp.buffer_of(batch.column("bytes").combine_chunks()))
    column = lambda c: batch.column(c).to_numpy()
    here = _slot(near, far, column("slots")[row]) == column("slot")[row]
    row, place, near, far = row[here], place[here], near[here], far[here]
    order = np.lexsort((far, near))
    n, f = near[order], far[order]
    same = (n[1:] == n[:-1]) & (f[1:] == f[:-1])
    again = np.zeros(len(order), bool)
    again[1:] |= same
    again[:-1] |= same
    hit = order[again]
    hit = hit[column("unsure")[row[hit]]]
    start = (column("start")[row[hit]] + place[hit]).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(column("tid")[row[hit]], pa.int64()), pa.array(column("size")[row[hit]], pa.int32()), pa.array(start), pa.array(start + LENGTH, pa.int32())], ["tid", "size", "start", "end"])


def grouped_repeats(told: DataFrame) -> DataFrame:
    """(tid, size, start, end) of the repeated 200-byte strings of unsure stretches.

    Equal strings have equal first ranks and slots, so rows are dealt and sorted by these, and
    pairs are compared in a task, some thousands of stretches at a time, never splitting a slot.
    """

    def run(batches):
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows < GROUP_ROWS:
                continue
            whole = pa.Table.from_batches(held)
            rank, slot = whole.column("rank").to_numpy(), whole.column("slot").to_numpy()
            end = len(rank) - int(((rank == rank[-1]) & (slot == slot[-1])).sum())  # the last slot may go on
            if end:
                yield _twice(whole.slice(0, end))
            held, rows = whole.slice(end).to_batches(), whole.num_rows - end
        if rows:
            yield _twice(pa.Table.from_batches(held))

    return told.repartition("rank", "slot").sortWithinPartitions("rank", "slot").mapInArrow(run, "tid bigint, size int, start int, end int")


def repeats(rows: DataFrame) -> DataFrame:
    """(tid, size, start, end): stretches of bytes to remove from each text; they may overlap."""
    first = stored(selected(rows), "suffix-selected")
    # stored by itself, so that Spark may split the rows of a very frequent rank
    again = stored(first.groupBy("rank").agg(F.sum("copies").alias("seen")).where("seen > 1").select("rank"), "suffix-repeated")
    rest = stored(first.join(again, "rank"), "suffix-again")
    discard(first, again)
    kinds = stored(rest.groupBy("rank", "stretch").agg(F.sum("copies").alias("seen"), F.min(F.struct(*KEY, "start", "more")).alias("one")), "suffix-kinds")
    sure = stored(rest.join(kinds.where("seen > 1").select("rank", "stretch"), ["rank", "stretch"]).select(*KEY, "start", (F.col("start") + F.col("more") + LENGTH).alias("end")), "suffix-sure")
    discard(rest)
    mixed = kinds.groupBy("rank").agg(F.ceil(F.count("*") / GROUP_KINDS).cast("int").alias("slots"), F.min("seen").alias("least")).where("least = 1").select("rank", "slots")
    sources = stored(kinds.join(mixed, "rank").select("rank", "one.*", (F.col("seen") == 1).alias("unsure"), "slots"), "suffix-sources")
    discard(kinds)
    told = stored(contexts(rows, sources), "suffix-contexts")
    out = stored(sure.unionByName(grouped_repeats(told)), "suffix-repeats")
    discard(sure, sources, told)
    return out


#: Bytes that a position's first key has; doubled until two overlapping ones make ``LENGTH``.
WORD = 8


def first_keys(one: DataFrame) -> DataFrame:
    """(tid, size, start, copies, near): the first ``WORD`` bytes of every position of a text, as a number."""

    def work(batch: pa.RecordBatch) -> dict:
        data, offsets = fp.buffer_of(batch.column(2))
        count = np.maximum(0, np.diff(offsets) - WORD + 1)
        row = np.repeat(np.arange(len(count)), count)
        start = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        at = offsets[:-1][row] + start
        key = np.zeros(len(row), np.uint64)
        for k in range(WORD):
            key = key << np.uint64(8) | data[at + k].astype(np.uint64)
        pick = lambda k: batch.column(k).to_numpy(zero_copy_only=False)[row]
        return {"tid": pick(0), "size": pick(1), "start": start.astype(np.int32), "copies": pick(3), "near": key.view(np.int64)}

    return map_batches(one.select(*KEY, "text", "copies"), work, "tid bigint, size int, start int, copies bigint, near bigint", size_col="text", piece_bytes=1 << 20)


def ranked(pairs: DataFrame, *keys: str) -> DataFrame:
    """(tid, size, start, copies, rank): positions whose keys are not unique, ranked by the sorted keys."""
    again = pairs.groupBy(*keys).agg(F.sum("copies").alias("seen")).where("seen > 1").drop("seen")
    return stored(pairs.join(running(again, [], [*keys], name="rank"), [*keys]).select(*KEY, "start", "copies", "rank"), "suffix-ranks")


def every_position(rows: DataFrame) -> DataFrame:
    """What ``repeats`` gives, from the rank pairs of all positions."""
    one = rows.groupBy(*KEY).agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    now, width = ranked(first_keys(one), "near"), WORD
    while width < LENGTH:
        step = min(width, LENGTH - width)
        far = now.select(*KEY, (F.col("start") - step).alias("start"), F.col("rank").alias("far"))
        # where the string behind is unique the longer one is too: it drops out of the join
        pairs = now.withColumnRenamed("rank", "near").join(far, [*KEY, "start"])
        before, now = now, ranked(pairs, "near", "far")
        discard(before)
        width += step
    return now.select(*KEY, "start", (F.col("start") + LENGTH).alias("end"))


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping and touching spans as maximal ones."""
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    fresh = np.ones(len(start), bool)
    fresh[1:] = start[1:] > reach[:-1]
    last = np.append(np.flatnonzero(fresh)[1:] - 1, len(start) - 1)
    return start[fresh], reach[last]


def without_repeats(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """(tid, size, n_removed, spans, kept): each text that loses bytes, what goes, and what stays."""
    told = spans.groupBy(*KEY).agg(F.collect_list(F.struct("start", "end")).alias("parts"))  # bounded by the text
    one = rows.groupBy(*KEY).agg(F.first("text").alias("text"))

    def work(batch: pa.RecordBatch) -> dict:
        removed, cuts, kept = [], [], []
        for text, parts in zip(batch.column(2), batch.column(3), strict=True):
            data, flat = memoryview(text.as_buffer()), parts.values
            start, end = merged(*(flat.field(i).to_numpy() for i in range(2)))
            removed.append(int((end - start).sum()))
            cuts.append([{"start": a, "end": b} for a, b in zip(start.tolist(), end.tolist(), strict=True)])
            kept.append(b"".join(data[a:b] for a, b in zip([0, *end.tolist()], [*start.tolist(), len(data)], strict=True)))
        spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        return {"tid": batch.column(0), "size": batch.column(1), "n_removed": pa.array(removed, pa.int64()), "spans": pa.array(cuts, spans_type), "kept": pa.array(kept, pa.binary())}

    return map_batches(one.join(told, KEY).select(*KEY, "text", "parts"), work, "tid bigint, size int, n_removed bigint, spans array<struct<start:int,end:int>>, kept binary", size_col="text", piece_bytes=1 << 20)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", search: Callable[[DataFrame], DataFrame] = repeats) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    rows = keyed(docs, id_col, text_col)
    cut = without_repeats(rows, search(rows)).select(*KEY, "n_removed", F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
    cut = stored(cut, "suffix-cut")
    whole = rows.select(id_col, *KEY, F.sha2("text", 256).alias("whole_sha256"))
    out = whole.join(cut, KEY, "left")
    return out.select(
        id_col, F.col("size").cast("bigint").alias("n_bytes"), F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"), F.coalesce("kept_sha256", "whole_sha256").alias("kept_sha256")
    )

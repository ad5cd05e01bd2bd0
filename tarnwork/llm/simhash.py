"""SimHash near-duplicates: anchor points of covering codes.

A fingerprint has a bit where more than half of the hashes of the text's word shingles have
it; repeated shingles count.  Fingerprints link at ``THRESHOLD`` or fewer differing bits, and
the result is each document's connected component.

Anchor points are the words of a covering code of radius R: every fingerprint has one home, the
anchor next to it, which is at most R away.  A fingerprint within t of it is then at most R + t
from that anchor, so if fingerprints are copied to every anchor within R + t, each pair meets
at the home of either.  A code over all 64 bits with few copies does not exist (sphere counts
give a thousand copies for codes that can be decoded), so the bits are cut into blocks with a
code each: of any pair within 4 bits, one of three blocks differs in at most 1 bit, and one of
two in at most 2.  Blocks use the perfect Golay and Hamming codes, some with free bits, which
are their own anchors.  ``plan`` takes the blocks with the least cost of copies and
comparisons for the number of distinct fingerprints; every plan is exact.

Per anchor, homes are compared with all members, and only a spanning forest of the links is
returned, never all pairs.  Anchors with more than ``CELL`` members are cut into a grid of
cells, so no task holds a hot anchor.  Equal fingerprints are one class from the start.

Edge cases: null and empty texts and texts without words have the fingerprint zero and link
like any other; with fewer words than a shingle has, the whole sequence is the shingle; rows
that repeat, ids included, are one class and each get a row; null ids belong to classes but
name a component only where it has no other id (then it is null); an empty table gives an
empty result; texts of any length are read whole; other columns are dropped at once, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwork.llm import fingerprints as fp
from tarnwork.llm import words as w
from tarnwork.llm.common import id_type, map_batches, scratch, small_batches, small_side, stored, texts
from tarnwork.llm.components import components

WORDS = 4
SEED = 42
THRESHOLD = 4
#: Members of an anchor that one cell of its grid holds.
CELL = 4096
#: Comparisons that take as long as making, shuffling and sorting one copy.
COPY_COST = 250
#: Comparisons at once in a task, and shingles whose bits are summed at once.
AT_ONCE = 1 << 20
SHINGLES = 1 << 16
PIECE_BYTES = 1 << 20
_SPACE = w.byte_class(b" \t\n\x0b\x0c\r")

# Fingerprints.


def simhashes(data: np.ndarray, offsets: np.ndarray, width: int = WORDS, seed: int = SEED) -> np.ndarray:
    """The fingerprint of every row."""
    from xxhash import xxh64_intdigest

    text, starts, ends, row, _ = w.joined(data, ~_SPACE[data], offsets)
    text, rows = text.tobytes(), len(offsets) - 1
    n = np.bincount(row, minlength=rows)
    first = np.cumsum(n) - n
    here = np.arange(len(row)) - first[row]  # the word's place in its row
    opens = np.flatnonzero((here + width <= n[row]) | ((here == 0) & (n[row] < width)))
    closes = opens + np.minimum(width, n[row[opens]]) - 1
    a, b, row = starts[opens], ends[closes], row[opens]
    ones, shingles = np.zeros((rows, 64), np.int64), np.bincount(row, minlength=rows)
    for k in range(0, len(a), SHINGLES):
        hashes = np.fromiter((xxh64_intdigest(text[i:j], seed) for i, j in zip(a[k : k + SHINGLES].tolist(), b[k : k + SHINGLES].tolist(), strict=True)), np.uint64, min(SHINGLES, len(a) - k))
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        part = row[k : k + SHINGLES]
        runs = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        ones[part[runs]] += np.add.reduceat(bits, runs, axis=0, dtype=np.int32)
    return np.packbits(2 * ones > shingles[:, None], axis=1, bitorder="little").view("<u8").reshape(-1).astype(np.uint64)


def fingerprinted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) of every row; fp is the fingerprint's 64 bits as a signed number."""

    def work(batch: pa.RecordBatch) -> dict:
        return {id_col: batch.column(0), "fp": simhashes(*fp.buffer_of(batch.column(1))).view(np.int64)}

    return map_batches(texts(docs, id_col, text_col), work, f"{id_col} {id_type(docs, id_col)}, fp bigint", size_col=text_col, piece_bytes=PIECE_BYTES)


# Codes.


class Block(NamedTuple):
    """Bits [low, low + bits) under a code by name, which must match within ``near`` bits."""

    low: int
    bits: int
    code: str
    near: int


def parity(code: str) -> tuple[list[int], int]:
    """Parity checks by bit, and the covering radius, of a perfect code."""
    if code == "golay23":
        columns, x = [], 1
        for _ in range(23):  # powers of x modulo the generator polynomial
            columns.append(x)
            x <<= 1
            if x >> 11:
                x ^= 0xC75
        return columns, 3
    return list(range(1, int(code.removeprefix("hamming")) + 1)), 1


PLANS = (
    (Block(0, 23, "golay23", 1), Block(23, 23, "golay23", 1), Block(46, 18, "hamming15", 1)),
    (Block(0, 21, "hamming15", 1), Block(21, 21, "hamming15", 1), Block(42, 22, "hamming15", 1)),
    (Block(0, 32, "hamming31", 2), Block(32, 32, "hamming31", 2)),
)


@lru_cache(maxsize=None)
def patterns(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Changes of up to radius + near bits, ordered by syndrome and weight; where a syndrome's begin; the checks.

    From a word with a syndrome, the changes with this syndrome lead to anchors, the first to its home.
    """
    columns, radius = parity(block.code)
    columns = columns + [0] * (block.bits - len(columns))  # free bits are in no check
    found = [(0, 0, 0)]
    for weight in range(1, radius + block.near + 1):
        for bits in combinations(range(block.bits), weight):
            syndrome = change = 0
            for i in bits:
                syndrome ^= columns[i]
                change |= 1 << i
            found.append((syndrome, weight, change))
    found.sort()
    syndromes = np.array([x[0] for x in found])
    begin = np.searchsorted(syndromes, np.arange((1 << max(columns).bit_length()) + 1))
    return np.array([x[2] for x in found], np.uint64), begin, np.array(columns)


def copies_and_meetings(blocks: tuple[Block, ...]) -> tuple[float, float]:
    """Copies of a fingerprint, and the share of all fingerprints that it meets at its homes."""
    copies = meetings = 0.0
    for block in blocks:
        changes, begin, _ = patterns(block)
        checks = len(begin) - 1
        copies += len(changes) / checks
        meetings += len(changes) / 2.0**block.bits
    return copies, meetings


def plan(n: int) -> tuple[Block, ...]:
    """The cheapest blocks for ``n`` distinct fingerprints."""

    def cost(blocks: tuple[Block, ...]) -> float:
        copies, meetings = copies_and_meetings(blocks)
        return copies * COPY_COST + n * meetings

    return min(PLANS, key=cost)


def anchors_of(values: np.ndarray, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index, anchor, home): every anchor that a value is copied to, and whether it is its home."""
    changes, begin, columns = patterns(block)
    own = (values >> np.uint64(block.low)) & np.uint64((1 << block.bits) - 1)
    syndrome = np.zeros(len(values), np.int64)
    for i, column in enumerate(columns):
        syndrome ^= np.where((own >> np.uint64(i)) & np.uint64(1), column, 0)
    count = begin[syndrome + 1] - begin[syndrome]
    index = np.repeat(np.arange(len(values)), count)
    step = np.arange(len(index)) - np.repeat(np.cumsum(count) - count, count)
    return index, own[index] ^ changes[begin[syndrome[index]] + step], step == 0


# Links.


def copied(classes: DataFrame, blocks: tuple[Block, ...]) -> DataFrame:
    """(anchor, fp, home): the copies of every fingerprint; anchor is block and code word in one number."""

    def work(batch: pa.RecordBatch) -> dict:
        values = batch.column(0).to_numpy().view(np.uint64)
        found = [(*anchors_of(values, block), k) for k, block in enumerate(blocks)]
        anchor = np.concatenate([(a << np.uint64(2)) | np.uint64(k) for _, a, _, k in found])
        return {"anchor": anchor.view(np.int64), "fp": np.concatenate([values[i] for i, _, _, _ in found]).view(np.int64), "home": np.concatenate([h for _, _, h, _ in found])}

    return map_batches(classes.select("fp"), work, "anchor bigint, fp bigint, home boolean")


#: What a row does in its cell.
MEMBER, BOTH, HOME = 0, 1, 2


def cells(copies: DataFrame) -> DataFrame:
    """(cell, fp, role): who is compared in which cell.  Small anchors are one cell, large ones a grid of homes by members."""
    sizes = copies.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > CELL)
    large = stored(sizes.select("anchor", F.ceil(F.col("n") / CELL).cast("int").alias("side")), "simhash-large")
    rows = copies.join(small_side(large), "anchor", "left")
    own, every = F.pmod(F.xxhash64("fp"), F.col("side").cast("bigint")).cast("int"), F.sequence(F.lit(0), F.col("side") - 1)

    def placed(row: Column, column: Column, role: Column | int) -> Column:
        return F.struct(row.alias("i"), column.alias("j"), (F.lit(role) if isinstance(role, int) else role).alias("role"))

    one = F.array(placed(F.lit(0), F.lit(0), F.when(F.col("home"), BOTH).otherwise(MEMBER)))
    below = F.transform(every, lambda i: placed(i, own, MEMBER))
    across = F.when(F.col("home"), F.transform(every, lambda j: placed(own, j, HOME))).otherwise(F.slice(below, 1, 0))
    spread = rows.select("anchor", "fp", F.explode(F.when(F.col("side").isNull(), one).otherwise(F.concat(below, across))).alias("at"))
    return spread.select(F.xxhash64("anchor", "at.i", "at.j").alias("cell"), "fp", F.col("at.role").alias("role"))


def forest(members: np.ndarray, homes: np.ndarray, threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) within the threshold between homes and members that span the same components as all such links."""
    nodes = np.unique(np.concatenate((members, homes)))
    at, of = np.searchsorted(nodes, members), np.searchsorted(nodes, homes)
    parent = np.arange(len(nodes))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out, k, step = [], 0, 1
    while k < len(homes):
        own, label = of[k : k + step], parent[at]
        near = (np.bitwise_count(homes[k : k + step, None] ^ members[None, :]) <= threshold) & (parent[own][:, None] != label[None, :])
        a, b = np.nonzero(near)
        if len(a):
            pair = parent[own[a]] * np.int64(len(nodes)) + label[b]
            for i in np.unique(pair, return_index=True)[1]:  # one link for each two components
                x, y = root(own[a[i]]), root(at[b[i]])
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    out.append((own[a[i]], at[b[i]]))
            while (parent != parent[parent]).any():
                parent = parent[parent]
        k += step
        step = min(2 * step, max(1, AT_ONCE // max(1, len(members))))
    if not out:
        return nodes[:0], nodes[:0]
    a, b = np.array(out).T
    return nodes[a], nodes[b]


def links(rows: DataFrame) -> DataFrame:
    """(a, b): links that span the components within each cell."""
    small_batches(rows.sparkSession)
    together = rows.repartition("cell").sortWithinPartitions("cell")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # the cell that goes on in the next batch

        def linked(cell: np.ndarray, values: np.ndarray, role: np.ndarray) -> pa.RecordBatch:
            cuts = np.concatenate(([0], np.flatnonzero(cell[1:] != cell[:-1]) + 1, [len(cell)]))
            found = [forest(values[i:j][role[i:j] != HOME], values[i:j][role[i:j] != MEMBER]) for i, j in zip(cuts[:-1], cuts[1:], strict=True) if j - i > 1]
            a, b = (np.concatenate([x[side] for x in found] or [np.zeros(0, np.uint64)]).view(np.int64) for side in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            cell, values, role = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64), batch.column(2).to_numpy()
            last = int(np.searchsorted(cell, cell[-1], side="left"))
            if held and held[0][0][0] == cell[-1]:
                held.append((cell, values, role))
                continue
            done = [*held, (cell[:last], values[:last], role[:last])]
            held = [(cell[last:].copy(), values[last:].copy(), role[last:].copy())]
            yield linked(*(np.concatenate(x) for x in zip(*done, strict=True)))
        if held:
            yield linked(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return together.mapInArrow(compare, "a bigint, b bigint")


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", blocks: tuple[Block, ...] | None = None) -> DataFrame:
    """(id, fingerprint, component_id) of every row: the smallest id that links reach."""
    with scratch() as keep:
        rows = keep(stored(fingerprinted(docs, id_col, text_col), "simhash-rows"))
        classes = stored(rows.groupBy("fp").agg(F.min(id_col).alias("first")), "simhash-classes")
        copies = stored(copied(classes, blocks or plan(classes.count())), "simhash-copies")
        labels = components(stored(links(cells(copies)), "simhash-links"))
        marked = stored(classes.join(labels, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("component", "fp").alias("component")), "simhash-marked")
        least = marked.groupBy("component").agg(F.min("first").alias("component_id"))
        named = keep(stored(marked.join(least, "component").select("fp", "component_id"), "simhash-named"))
        out = rows.join(small_side(named), "fp", "left")
    return out.select(id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")

"""N-gram Jaccard join: exact links between documents by their word-shingle sets.

Two sets link when their Jaccard similarity is at least ``PERCENT``; the result is each
document's connected component.  Copies are one class and never paired.  Near copies meet the
pivots of their lists, and each other only where neither a pivot's component nor the overlaps
with a common pivot settle the pair.

1. Equal sets form one class.  Under the order of shingle hashes, linked sets must share at
   least s of their first n - ceil(0.75 n) + s shingles.  One aggregate finds the shingles
   that only one class has; classes without s shared ones are done.
2. The same over the whole sets of the rest: at least 0.75 n must be shared.
3. Shingles that more than ``FREQUENT`` of the remaining classes have (shared passages) are
   moved to the end of the order.  The prefixes of the new order are the inverted lists.
4. Size-aware search: sets up to a size boundary enumerate the 2-subsets of a prefix that is
   one longer, larger sets scan the inverted lists; the boundary is the one with the least
   total cost, found from a histogram by size.
5. Each class is verified against the pivot that shares most keys with it, and links merge
   classes into components; this goes on while it joins many.  Then only keys that still join
   different components are left.  Two sets a and b that met the same pivot p share at most
   min(|ap|, |bp|) + min(|a - p|, |b - p|) shingles, unshared ones not counted; cross pairs for
   which this is too few cannot link, and all others are verified, so no link is lost.

Edge cases: null and empty texts have 0 shingles and link with nothing, not even each other;
texts with fewer than five words have their whole sequence as one shingle; rows that repeat,
ids included, are equal sets and each get a row; null ids belong to classes but never name a
component that has another id; an empty table gives an empty result; texts of any length are
read whole, one slice at a time; other columns are dropped at once, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwork.llm import fingerprints as fp
from tarnwork.llm import shingles as sh
from tarnwork.llm.common import id_type, map_batches, scratch, small_side, stored, texts
from tarnwork.llm.components import components

PERCENT = 75
#: How far prefixes in the first pass go beyond the least that must be looked at.
MARGIN = 0.06
FREQUENT = 32
#: Pivots go on while at least this share of the pairs with them link; the last step is exact in any case.
PRODUCTIVE = 0.5
#: Comparisons that an entry of a long list costs: pivots stand for the rest of the list.
LIST_COST = 8
SALT_ROWS = 500
CLASS = ["d1", "d2", "n"]
MEMBER = ["cid", "n", "rank", "cap"]


def shared_least(n):
    """Shingles that a set of n must share with any set that it links to."""
    return (PERCENT * n + 99) // 100


def margin(n):
    return np.maximum(1, np.ceil(MARGIN * n)).astype(np.int64)


def _ragged(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64), pa.int64()))


def _digests(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.concatenate(([0], np.cumsum(counts)))
    out = []
    for salt in (0x51ED270B, 0x9B60933458E17D7D):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(fp.mix(values ^ np.uint64(salt)), dtype=np.uint64)))
        out.append((sums[first[1:]] - sums[first[:-1]]).view(np.int64))
    return out[0], out[1]


def _sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return sh.shingle_sets(*fp.buffer_of(column))


def sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, d1, d2, n, prefix): each row's set digest, size, and first shingles by hash."""

    def work(batch: pa.RecordBatch) -> dict:
        values, counts = _sets(batch.column(1))
        d1, d2 = _digests(values, counts)
        length = np.minimum(counts, counts - shared_least(counts) + margin(counts)) * (counts > 0)
        place = np.arange(len(values)) - np.repeat(np.cumsum(counts) - counts, counts)
        return {id_col: batch.column(0), "d1": d1, "d2": d2, "n": counts.astype(np.int32), "prefix": _ragged(values[place < np.repeat(length, counts)], length)}

    return map_batches(texts(docs, id_col, text_col), work, f"{id_col} {id_type(docs, id_col)}, d1 bigint, d2 bigint, n int, prefix array<bigint>", size_col=text_col)


def whole_sets(docs: DataFrame, text_col: str) -> DataFrame:
    """(d1, d2, n, shingles) of every row."""

    def work(batch: pa.RecordBatch) -> dict:
        values, counts = _sets(batch.column(0))
        d1, d2 = _digests(values, counts)
        return {"d1": d1, "d2": d2, "n": counts.astype(np.int32), "shingles": _ragged(values, counts)}

    return map_batches(docs.select(text_col), work, "d1 bigint, d2 bigint, n int, shingles array<bigint>", size_col=text_col)


def may_link(sketch: DataFrame) -> DataFrame:
    """The classes (d1, d2, n, first) that share enough of their prefix with others."""
    tokens = sketch.select("d1", F.explode("prefix").alias("token"))
    owners = tokens.groupBy("token").agg(F.min("d1").alias("low"), F.max("d1").alias("high"))
    alone = owners.where(F.col("low") == F.col("high")).groupBy("low").agg(F.count("*").alias("alone"))
    classes = sketch.where("n > 0").groupBy(*CLASS).agg(F.min(sketch.columns[0]).alias("first"), F.max(F.size("prefix")).alias("length"))
    joined = classes.join(alone, F.col("d1") == F.col("low"), "left")
    least = F.greatest(F.lit(1), F.ceil(F.lit(MARGIN) * F.col("n")))
    return joined.where(F.col("length") - F.coalesce("alone", F.lit(0)) >= least).select(*CLASS, "first")


def least_shared(n: str = "n") -> Column:
    return F.expr(f"({PERCENT} * {n} + 99) div 100")


def shared_sets(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The sets (cid, n, own, cap, shingles) that share enough with others, and the frequent shingles.

    ``own`` counts the shingles that no other set has, ``cap`` is the largest size of a partner.
    """
    tokens = sets.select("cid", F.explode("shingles").alias("token"))
    owners = tokens.groupBy("token").agg(F.count("*").alias("df"), F.min("cid").alias("cid"))
    told = owners.where((F.col("df") == 1) | (F.col("df") > FREQUENT)).select((F.col("df") == 1).alias("alone"), F.when(F.col("df") == 1, F.col("cid")).otherwise(F.col("token")).alias("key"))
    told = stored(told.groupBy("alone", "key").agg(F.count("*").alias("rows")), "join-told")
    alone = small_side(told.where("alone")).select(F.col("key").alias("cid"), F.col("rows").alias("own"))
    own = F.coalesce("own", F.lit(0))
    # an overlap of at most n - own allows partners up to this size
    cap = (F.floor((100 + PERCENT) * (F.col("n") - own) / PERCENT) - F.col("n")).cast("int")
    rest = sets.join(alone, "cid", "left").where(F.col("n") - own >= least_shared()).select("cid", "n", own.cast("int").alias("own"), cap.alias("cap"), "shingles")
    rest = stored(rest, "join-sets")
    return rest, small_side(told.where("not alone")).select(F.col("key").alias("token"))


def prefixes(sets: DataFrame, frequent: DataFrame) -> DataFrame:
    """(cid, n, own, cap, token, place): the prefixes, one token longer than lists need, frequent tokens last."""
    late = sets.select("cid", F.explode("shingles").alias("token")).join(frequent, "token").groupBy("cid").agg(F.collect_list("token").alias("late"))

    def work(batch: pa.RecordBatch) -> dict:
        cid, n, token, place, alone, most = [], [], [], [], [], []
        for c, k, own, last, one, cap in zip(*(batch.column(i) for i in range(6)), strict=True):
            own = own.values.to_numpy().view(np.uint64)
            if last.is_valid:
                behind = np.isin(own, last.values.to_numpy().view(np.uint64))
                own = np.concatenate([own[~behind], own[behind]])
            size = k.as_py()
            own = own[: size - shared_least(size) + 2]
            cid.append(np.full(len(own), c.as_py()))
            n.append(np.full(len(own), size, np.int32))
            alone.append(np.full(len(own), one.as_py(), np.int32))
            most.append(np.full(len(own), cap.as_py(), np.int32))
            token.append(own.view(np.int64))
            place.append(np.arange(len(own), dtype=np.int32))
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        return {"cid": join(cid, np.int64), "n": join(n, np.int32), "own": join(alone, np.int32), "cap": join(most, np.int32), "token": join(token, np.int64), "place": join(place, np.int32)}

    return map_batches(sets.join(late, "cid", "left").select("cid", "n", "shingles", "late", "own", "cap"), work, "cid bigint, n int, own int, cap int, token bigint, place int", size_col="shingles", piece_bytes=1 << 19)


def subsets(n: int) -> int:
    """2-subsets of the prefix of a set of n, which is one longer than lists need."""
    return math.comb(min(n, n - shared_least(n) + 2), 2)


def boundary(lists: DataFrame, sets: DataFrame) -> int:
    """The size up to which enumerating 2-subsets costs less than scanning lists."""
    most = 1  # beyond this size lists are cheaper however long they are
    while subsets(most + 1) <= LIST_COST * (most + 2 - shared_least(most + 1)):
        most += 1
    scans = {r[0]: r[1] for r in lists.where(F.col("n") <= most).groupBy("n").agg(F.sum(F.least("df", F.lit(LIST_COST)))).collect()}
    counts = {r[0]: r[1] for r in sets.where(F.col("n") <= most).groupBy("n").agg(F.count("*")).collect()}
    best = now = low = 0
    for n in range(1, most + 1):
        now += counts.get(n, 0) * subsets(n) - scans.get(n, 0)
        if now < low:
            best, low = n, now
    return best


def search_keys(sets: DataFrame, frequent: DataFrame) -> DataFrame:
    """(key, cid, n, rank, cap): sets that share a key may link; all links share one.

    In a list the cap is positional: if the token is the first that two sets share, they share
    at most what each has from its place on.  A link passes this at its first shared token.
    """
    rows = stored(prefixes(sets, frequent), "join-prefixes")
    lists = rows.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    rows = stored(rows.join(lists, "token"), "join-lists")
    limit = boundary(rows, sets)
    # lists: tokens that a larger set has, within the shorter prefix
    listed = rows.where(F.col("place") < F.col("n") - least_shared() + 1)
    scanned = listed.groupBy("token").agg(F.max("n").alias("largest")).where(F.col("largest") > limit).select("token")
    placed = F.floor((100 + PERCENT) * (F.col("n") - F.col("place")) / PERCENT) - F.col("n")
    by_list = listed.join(scanned, "token").select(F.col("token").alias("key"), "cid", "n", F.col("place").alias("rank"), F.least("cap", placed.cast("int")).alias("cap"))
    small = rows.where(F.col("n") <= limit).withColumnRenamed("own", "rank").groupBy(*MEMBER).agg(F.sort_array(F.collect_list("token")).alias("t"))  # a few tokens each
    pairs = F.flatten(F.transform("t", lambda a, i: F.transform(F.slice("t", i + 2, F.size("t")), lambda b: F.xxhash64(a, b))))
    by_pair = small.select(F.explode(pairs).alias("key"), *MEMBER)
    return stored(by_list.unionByName(by_pair), "join-keys")


def fits(other: str) -> Column:
    """Whether the sizes of a member and of another one, with columns named after it, allow a link."""
    return (F.col("n") <= F.col(f"{other}cap")) & (F.col(f"{other}n") <= F.col("cap"))


def linked(a: str, b: str, shared: str = "shared") -> Column:
    """Whether sets of these sizes link when they share so many."""
    return 100 * F.col(shared) >= PERCENT * (F.col(a) + F.col(b) - F.col(shared))


def overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, na, nb, shared) of pairs (a, b).  A set that many pairs share is salted by their number."""
    pairs = stored(pairs.withColumn("salt", F.pmod(F.xxhash64("a"), F.lit(1 << 30))), "join-pairs")
    often = small_side(stored(pairs.groupBy("b").agg(F.ceil(F.count("*") / SALT_ROWS).cast("int").alias("salts")), "join-often"))
    right = sets.join(often, F.col("cid") == F.col("b")).select("b", "n", "shingles", "salts", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("slot"))
    right = right.select("b", F.col("slot").alias("slot"), F.col("n").alias("nb"), F.col("shingles").alias("sb"))
    left = sets.select(F.col("cid").alias("a"), F.col("n").alias("na"), F.col("shingles").alias("sa")).join(small_side(pairs), "a")
    left = left.join(often, "b").select("a", "b", "na", "sa", (F.col("salt") % F.col("salts")).cast("int").alias("slot"))
    return stored(left.join(right.hint("merge"), ["b", "slot"]).select("a", "b", "na", "nb", F.size(F.array_intersect("sa", "sb")).alias("shared")), "join-overlaps")


def _labelled(keys: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return keys.withColumn("label", F.col("cid"))
    return keys.join(labels, F.col("cid") == F.col("node"), "left").select("key", *MEMBER, F.coalesce("component", "cid").alias("label"))


def _open(keys: DataFrame) -> DataFrame:
    """Keys whose members are not all of one component, without members whose partners must be smaller than all there."""
    parted = keys.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min("n").alias("least")).where("low < high").select("key", "least")
    return keys.join(parted, "key").where(F.col("cap") >= F.col("least")).drop("least")


def pivot_pairs(keys: DataFrame, turn: int) -> DataFrame:
    """(a, b): each member and, of the pivots of its keys, the one that shares most keys with it."""
    # first the most central member, with the fewest rarer shingles; then others by hash
    order = [F.col("rank")] if turn == 0 else []
    pivot = keys.groupBy("key").agg(F.min(F.struct(*order, F.xxhash64("cid", F.lit(turn)).alias("h"), "cid", "n", "cap", "label")).alias("v"))
    pivot = pivot.select("key", F.col("v.cid").alias("b"), F.col("v.n").alias("b_n"), F.col("v.cap").alias("b_cap"), F.col("v.label").alias("b_label"))
    meets = keys.join(pivot, "key").where((F.col("label") != F.col("b_label")) & fits("b_"))
    shared = meets.groupBy(F.col("cid").alias("a"), "b").agg(F.count("*").alias("keys"))
    return shared.groupBy("a").agg(F.max_by("b", F.struct("keys", "b")).alias("b"))


def against_pivot(measured: DataFrame, sets: DataFrame) -> DataFrame:
    """(cid, pivot, inside, outside): shingles of a set in its pivot, and others that some set shares."""
    met = measured.select(F.col("a").alias("cid"), F.col("b").alias("pivot"), F.col("shared").alias("inside"))
    alone = measured.select(F.col("b").alias("cid"), F.col("b").alias("pivot"), F.col("nb").alias("inside")).distinct()
    seen = met.unionByName(alone.join(met.select("cid"), "cid", "left_anti"))
    return seen.join(sets.select("cid", "n", "own"), "cid").select("cid", "pivot", "inside", F.greatest(F.lit(0), F.col("n") - F.col("own") - F.col("inside")).alias("outside"))


def may_share_enough() -> Column:
    """False where the overlaps with a common pivot show that two members share too few."""
    most = F.least("inside", "b_inside") + F.least("outside", "b_outside")
    too_few = (100 + PERCENT) * most < PERCENT * (F.col("n") + F.col("b_n"))
    return ~F.coalesce((F.col("pivot") == F.col("b_pivot")) & too_few, F.lit(False))


def link_components(sets: DataFrame, keys: DataFrame) -> DataFrame:
    """(node, component) over all links."""
    links = labels = seen = None
    turn, share = 0, 1.0
    while share >= PRODUCTIVE:
        keys = stored(_open(_labelled(keys.select("key", *MEMBER), labels)), "join-open")
        measured = overlaps(pivot_pairs(keys, turn), sets)
        seen = stored(against_pivot(measured, sets), "join-pivots") if seen is None else seen
        share = measured.agg(F.coalesce(F.avg(linked("na", "nb").cast("double")), F.lit(0.0))).first()[0]
        new = measured.where(linked("na", "nb")).select("a", "b")
        links = new if links is None else links.unionByName(new)
        labels = components(links)
        turn += 1
    members = stored(_open(_labelled(keys.select("key", *MEMBER), labels)).join(seen, "cid", "left"), "join-members")
    other = members.select("key", *(F.col(c).alias(o) for c, o in (("cid", "b"), ("n", "b_n"), ("cap", "b_cap"), ("label", "b_label"), ("pivot", "b_pivot"), ("inside", "b_inside"), ("outside", "b_outside"))))
    pairs = members.join(other, "key").where((F.col("label") < F.col("b_label")) & fits("b_") & may_share_enough()).select(F.col("cid").alias("a"), "b").distinct()
    return components(links.unionByName(overlaps(pairs, sets).where(linked("na", "nb")).select("a", "b")))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) of every row: the smallest id that links reach."""
    with scratch() as keep:
        sketch = keep(stored(sketches(docs, id_col, text_col), "join-sketches"))
        chosen = stored(may_link(sketch), "join-chosen")
        wanted = small_side(chosen).select(F.col("first").alias("_first"))
        rows = texts(docs, id_col, text_col).join(wanted, F.col(id_col).eqNullSafe(F.col("_first")), "left_semi")
        found = whole_sets(rows, text_col).join(small_side(chosen).select(*CLASS), CLASS, "left_semi").dropDuplicates(CLASS)
        sets = stored(found.withColumn("cid", F.monotonically_increasing_id()), "join-survivors")  # numbers are fixed once written
        shared, frequent = shared_sets(sets.select("cid", "n", "shingles"))
        labels = link_components(shared, search_keys(shared, frequent))
        classes = sketch.where("n > 0").groupBy(*CLASS).agg(F.min(id_col).alias("first"))
        by_class = sets.select(*CLASS, "cid").join(labels, F.col("cid") == F.col("node")).select(*CLASS, "component")
        marked = stored(classes.join(by_class, CLASS, "left"), "join-classes")
        least = marked.where("component is not null").groupBy(F.col("component").alias("c")).agg(F.min("first").alias("least"))
        named = marked.join(least, F.col("component") == F.col("c"), "left").select(*CLASS, F.coalesce("least", "first").alias("component_id"))
        named = keep(stored(named.select(*CLASS, "component_id"), "join-named"))
    out = sketch.select(id_col, *CLASS).join(named, CLASS, "left")
    return out.select(id_col, F.col("n").cast("bigint").alias("n_shingles"), F.coalesce("component_id", F.col(id_col)).alias("component_id"))

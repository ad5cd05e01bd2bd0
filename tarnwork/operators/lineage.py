"""Session trees and provenance graphs, by pointer doubling over stored tables.

A round doubles how far each pointer reaches, so rounds grow with the logarithm of the depth, and
every round is a join of two tables of the nodes' size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwork.storage import stored


def pointers(nodes: DataFrame) -> DataFrame:
    """(id, at): each node with its parent, where the parent is a node too."""
    known = nodes.select(F.col("id").alias("at"))
    return nodes.where("parent is not null").select("id", F.col("parent").alias("at")).join(known, "at", "left_semi").select("id", "at")


def rounds_for(n: int) -> int:
    """Doublings after which a walk among ``n`` nodes has ended, if it ends."""
    return max(1, n.bit_length()) + 1


def roots(nodes: DataFrame) -> DataFrame:
    """(id, root, depth, missing, cyclic) of every node (id, parent).

    ``missing`` tells that the walk ends at a parent that is no node, ``cyclic`` that it never ends;
    then there is no root and no depth.
    """
    nodes = stored(nodes.select("id", "parent"), "nodes")  # else what they come from is computed three times
    up = nodes.join(pointers(nodes), "id", "left")
    state = up.select("id", F.coalesce("at", "id").alias("at"), F.col("at").isNotNull().cast("bigint").alias("depth"), F.col("at").isNotNull().alias("more"), (F.col("at").isNull() & F.col("parent").isNotNull()).alias("missing"))
    state = stored(state, "roots")
    ended_rows, open_ = [state.where("not more")], state.where("more")  # ended rows are not written again
    for _ in range(rounds_for(state.count())):
        if open_.isEmpty():
            break
        beyond = reduce(DataFrame.unionByName, [*ended_rows, open_]).select(F.col("id").alias("at"), F.col("at").alias("next"), F.col("depth").alias("steps"), F.col("more").alias("on"), F.col("missing").alias("gone"))
        moved = open_.join(beyond, "at").select("id", F.col("next").alias("at"), (F.col("depth") + F.col("steps")).alias("depth"), F.col("on").alias("more"), F.col("gone").alias("missing"))
        moved = stored(moved, "roots")
        ended_rows, open_ = [*ended_rows, moved.where("not more")], moved.where("more")
    state = reduce(DataFrame.unionByName, [*ended_rows, open_])
    ended = lambda c: F.when(~F.col("more"), F.col(c))
    return state.select("id", ended("at").alias("root"), ended("depth").alias("depth"), F.coalesce(ended("missing"), F.lit(False)).alias("missing"), F.col("more").alias("cyclic"))


def ancestors(nodes: DataFrame, start: DataFrame) -> DataFrame:
    """(id, ancestor, depth) of every start id, by parent pointers; a cycle is an error."""
    jump = stored(pointers(nodes), "jumps")
    pairs = stored(start.select("id").distinct().select("id", F.col("id").alias("ancestor"), F.lit(0).cast("bigint").alias("depth")), "ancestors")
    step = 1
    for _ in range(rounds_for(jump.count())):
        if jump.isEmpty():
            return pairs.where("depth > 0")
        further = jump.select(F.col("id").alias("ancestor"), F.col("at").alias("next"))
        more = pairs.join(further, "ancestor").select("id", F.col("next").alias("ancestor"), (F.col("depth") + step).alias("depth"))
        pairs = stored(pairs.unionByName(more), "ancestors")
        jump = stored(jump.join(jump.select(F.col("id").alias("at"), F.col("at").alias("next")), "at").select("id", F.col("next").alias("at")), "jumps")
        step *= 2
    if not jump.isEmpty():
        raise ValueError("LINEAGE_CYCLE")
    return pairs.where("depth > 0")


def missing_parents(nodes: DataFrame) -> DataFrame:
    return nodes.where("parent is not null").join(nodes.select(F.col("id").alias("parent")), "parent", "left_anti").select("id", "parent")


def descendants(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, id, depth, path): the subtree of each root (id), to be ordered by path at every level by (created, id).

    The keys of the levels are joined last: a node's array has as many as it has ancestors.
    """
    key = lambda x: F.concat(F.lpad(x["created"].cast("string"), 16, "0"), F.lit(":"), F.lpad(x["ancestor"].cast("string"), 12, "0"))
    nodes = stored(nodes.select("id", "parent", "created"), "nodes")
    up = ancestors(nodes, nodes).unionByName(nodes.select("id", F.col("id").alias("ancestor"), F.lit(0).cast("bigint").alias("depth")))
    known = nodes.select(F.col("id").alias("ancestor"), "created").join(roots.select(F.col("id").alias("ancestor"), F.lit(True).alias("top")).distinct(), "ancestor", "left")
    keyed = up.join(known, "ancestor")
    # numbers, not the texts of keys, are shuffled, and only chains up to a root are made
    chains = keyed.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("depth", "ancestor", "created", "top"))).alias("chain"))
    each = chains.select("id", "chain", F.explode(F.filter("chain", lambda x: x["top"])).alias("top")).select("id", "chain", F.col("top.ancestor").alias("root"), F.col("top.depth").alias("depth"))
    path = F.array_join(F.transform(F.reverse(F.slice("chain", F.lit(1), (F.col("depth") + 1).cast("int"))), key), "/")
    return each.select("root", "id", "depth", path.alias("path"))


def source_links(log: DataFrame) -> DataFrame:
    """(session_id, seq, source_seq) from each event's list of sources."""
    return log.select("session_id", "seq", F.explode("sources").alias("source_seq"))

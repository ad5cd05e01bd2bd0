"""Dependency graphs: resolution, degrees, cycles, dead nodes and change impact.

Edges are (caller, callee).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Candidates that do not lower a confidence, and the largest pool of equal names that is evidence.
FREE_CANDIDATES = 3
LEAF_POOL = 256
#: Rows of a block of which all pairs are made.
PAIRED = 1024


def penalised(confidence: Column, candidates: Column) -> Column:
    """Many candidates lower the confidence."""
    return F.when(candidates <= FREE_CANDIDATES, confidence).otherwise(confidence * FREE_CANDIDATES / candidates)


def common_segments(a: Column, b: Column) -> Column:
    """How many leading path segments are equal."""
    same = F.zip_with(F.split(a, "/"), F.split(b, "/"), lambda x, y: F.coalesce(x == y, F.lit(False)))
    return F.aggregate(same, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, x: F.struct((s["n"] + (s["on"] & x).cast("int")).alias("n"), (s["on"] & x).alias("on")), lambda s: s["n"])


def degrees(edges: DataFrame) -> DataFrame:
    """(node, inward, outward) of every node with an edge."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("caller").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("callee").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e"))
    return ends.select("e.*").groupBy("node").agg(F.sum("i").alias("inward"), F.sum("o").alias("outward"))


def dead(nodes: DataFrame, edges: DataFrame, keep: str, outside: DataFrame | None = None) -> DataFrame:
    """Nodes that nothing calls, that nothing outside refers to, and whose name is not excluded."""
    found = nodes.where(~F.col("name").rlike(keep)).join(edges.select(F.col("callee").alias("node")), "node", "left_anti")
    return found if outside is None else found.join(outside.select("node"), "node", "left_anti")


def within(edges: DataFrame, seeds: DataFrame, hops: int, towards: str = "callee") -> DataFrame:
    """(node, hops): what the seeds reach in a few hops, and the fewest hops to it."""
    other = "caller" if towards == "callee" else "callee"
    reached = seeds.select("node", F.lit(0).alias("hops"))
    front = reached
    for hop in range(1, hops + 1):
        front = edges.join(front.select(F.col("node").alias(other)), other).select(F.col(towards).alias("node")).distinct().join(reached.select("node"), "node", "left_anti").withColumn("hops", F.lit(hop))
        reached = reached.unionByName(front)
    return reached


def mutual(edges: DataFrame) -> DataFrame:
    """(low, high): pairs that call each other, the cycles of length two."""
    back = edges.select(F.col("callee").alias("caller"), F.col("caller").alias("callee"))
    return edges.join(back, ["caller", "callee"]).where("caller < callee").select(F.col("caller").alias("low"), F.col("callee").alias("high"))


def trimmed(edges: DataFrame, store) -> DataFrame:
    """The edges without nodes that nothing enters or leaves, over and over: no cycle has them."""
    n = edges.count()
    while n:
        starts, ends = edges.select(F.col("caller").alias("callee")).distinct(), edges.select(F.col("callee").alias("caller")).distinct()
        edges = store(edges.join(ends, "caller", "left_semi").join(starts, "callee", "left_semi").select("caller", "callee"))
        before, n = n, edges.count()
        if n == before:
            break
    return edges


def strong_components(edges: DataFrame, store) -> DataFrame:
    """(node, component) of every node on a cycle: forward and backward reachability by colours.

    Nodes that cannot lie on a cycle leave first.  Each round every node takes the largest node that reaches it as its colour; nodes that
    reach their colour's root within the colour are its component and leave.  ``store`` writes
    a table and reads it again.
    """
    left = store(edges.select("caller", "callee").where("caller <> callee").distinct())
    left = trimmed(left, store)
    done = None
    while not left.isEmpty():
        nodes = left.select(F.explode(F.array("caller", "callee")).alias("node")).distinct()
        colour = store(nodes.withColumn("colour", F.col("node")))
        while True:
            into = left.join(colour, F.col("caller") == F.col("node")).groupBy("callee").agg(F.max("colour").alias("best"))
            after = store(colour.join(into, F.col("node") == F.col("callee"), "left").select("node", F.col("colour").alias("old"), F.greatest("colour", F.coalesce("best", "colour")).alias("colour")))
            colour = after.select("node", "colour")
            if after.where("old <> colour").isEmpty():
                break
        inside = left.join(colour.select(F.col("node").alias("caller"), F.col("colour").alias("a")), "caller").join(colour.select(F.col("node").alias("callee"), F.col("colour").alias("b")), "callee").where("a = b").select("caller", "callee", F.col("a").alias("colour"))
        inside = store(inside)
        found = store(colour.where("node = colour").select("node", "colour"))
        while True:
            more = inside.join(found.select(F.col("node").alias("callee"), F.col("colour").alias("c")), "callee").where("c = colour").select(F.col("caller").alias("node"), "colour").distinct().join(found, ["node", "colour"], "left_anti")
            more = store(more)
            if more.isEmpty():
                break
            found = store(found.unionByName(more))
        done = found if done is None else store(done.unionByName(found))
        gone = found.select("node")
        left = trimmed(store(left.join(gone.withColumnRenamed("node", "caller"), "caller", "left_anti").join(gone.withColumnRenamed("node", "callee"), "callee", "left_anti")), store)
    if done is None:
        return edges.select(F.col("caller").alias("node"), F.col("caller").alias("component")).limit(0)
    sized = done.groupBy("colour").agg(F.count("*").alias("n"), F.min("node").alias("component")).where("n > 1")
    return done.join(sized, "colour").select("node", "component")


#: Members of a cycle from which it is of a severity.
HIGH, MEDIUM = 5, 3


def severity(size: Column) -> Column:
    return F.when(size >= HIGH, "high").when(size >= MEDIUM, "medium").otherwise("low")


def dirty(edges: DataFrame, changed: DataFrame, rounds: int, budget: int, store) -> DataFrame:
    """(node, round): everything that depends on changed nodes, up to some rounds and nodes in all.

    Every round stores only the nodes that it finds; all rounds together are read as one table.
    """
    front = store(changed.select("node", F.lit(0).alias("round")))
    reached, n = front, front.count()
    for k in range(1, rounds + 1):
        front = store(edges.join(front.select(F.col("node").alias("callee")), "callee").select(F.col("caller").alias("node")).distinct().join(reached.select("node"), "node", "left_anti").withColumn("round", F.lit(k)))
        found = front.count()
        if not found:
            break
        reached, n = reached.unionByName(front), n + found
        if n > budget:
            break
    return reached


def as_of_chunk(lines: DataFrame, chunks: DataFrame) -> DataFrame:
    """(file_id, line, chunk): the last chunk of the file that starts at or before the line.

    Both sides are one sequence by line, so there is no range join.
    """
    both = lines.select("file_id", "line", F.lit(None).cast("bigint").alias("chunk"), F.lit(1).alias("kind")).unionByName(chunks.select("file_id", F.col("start_line").alias("line"), "chunk", F.lit(0).alias("kind")))
    w = Window.partitionBy("file_id").orderBy("line", "kind").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("chunk", F.last("chunk", ignorenulls=True).over(w)).where("kind = 1 and chunk is not null").select("file_id", "line", "chunk")


def call_kind(receiver: Column, name: Column, imported: Column) -> Column:
    """How a call is written."""
    return F.when(receiver.isNotNull() & name.rlike("^[A-Z]"), "constructor").when(receiver.isNotNull(), "method").when(imported, "imported").otherwise("local")


def call_shape(name: Column, imports: Column) -> Column:
    """How a call (``a.b``, ``b``) is written, given the names that its file imports."""
    leaf = F.substring_index(name, ".", -1)
    made = leaf.rlike("^[A-Z]") | (leaf == "__init__")
    return F.when(F.contains(name, F.lit(".")), F.when(made, "constructor").otherwise("method")).when(F.array_contains(imports, name), "imported").when(made, "constructor").otherwise("local")


def either_match(left: DataFrame, right: DataFrame, block: int = PAIRED) -> DataFrame:
    """The distinct pairs of keys of two tables (key, k) whose keys are equal, or that share a ``k`` that is not null.

    Pairs that share a ``k`` are made from blocks of keys. What is shared is told by each key's list of ``k``, so no pair
    comes twice, and is looked at only where a key has several.
    """
    a, b = left.columns[0], right.columns[0]
    own, their = (t.where(F.col(c).isNotNull()).groupBy(c).agg(F.collect_set("k").alias(name)) for t, c, name in ((left, a, "own_k"), (right, b, "their_k")))  # of one key
    one, many = own.where("size(own_k) = 1").select(a, F.get("own_k", F.lit(0)).alias("k")), own.where("size(own_k) > 1").select(a, "own_k", F.explode("own_k").alias("k"))
    by_one = equal_pairs(one, their.select(b, F.explode("their_k").alias("k")), "k", block)
    by_many = met_pairs(many.select(a, "own_k", "k").withColumn("shared", F.col("k")), their.select(b, "their_k", F.explode("their_k").alias("k")), "k", block)
    by_many = by_many.where(F.col("x.shared") == F.array_min(F.array_intersect("x.own_k", "y.their_k"))).select(f"x.{a}", f"y.{b}")
    by_key = own.join(their, F.col(a) == F.col(b)).where(~F.arrays_overlap("own_k", "their_k")).select(a, b)
    return by_one.unionByName(by_many).unionByName(by_key)


def tasks(spark: SparkSession) -> int:
    """How many tasks pairs of blocks are dealt over."""
    return 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def met_blocks(left: DataFrame, right: DataFrame, key: str, block: int) -> DataFrame:
    """(own, their): lists of rows of two tables, without the ``key`` that they share, for each pair of blocks of a key; null keys are left out.

    Rows of a key are cut by hash of the first column into blocks of about ``block`` rows; pairs of blocks are dealt evenly over all
    tasks, so no key stays in one.
    """

    def blocks(rows: DataFrame, name: str) -> DataFrame:
        sized = rows.groupBy(key).agg(F.ceil(F.count("*") / block).alias("parts"))
        told = [c for c in rows.columns if c != key]
        cut = rows.join(sized, key).withColumn("part", F.pmod(F.xxhash64(told[0]), F.col("parts")))
        row = F.col(told[0]) if len(told) == 1 else F.struct(*told)
        return cut.groupBy(key, "part").agg(F.collect_list(row).alias(name)).drop("part")  # about ``block`` of them

    return blocks(left, "own").join(blocks(right, "their"), key).select("own", "their").repartition(tasks(left.sparkSession))


def met_pairs(left: DataFrame, right: DataFrame, key: str, block: int) -> DataFrame:
    """(x, y): the pairs of rows of two tables whose ``key`` is equal, written out by the tasks that have their blocks."""
    rows = met_blocks(left, right, key, block).select(F.explode("own").alias("x"), "their")
    # coalesce() leaves the partitions as they are, but parts the two steps' generated code: one loop would hold all pairs of two blocks before it hands them on
    return rows.coalesce(tasks(left.sparkSession)).select("x", F.explode("their").alias("y"))


def equal_pairs(left: DataFrame, right: DataFrame, key: str, block: int = PAIRED) -> DataFrame:
    """The pairs of keys of two tables, each its first column, whose ``key`` is equal, as often as a join gives them; null keys of rows are left out.

    The shuffle carries blocks of keys, two numbers every ``block`` pairs.
    """
    a, b = left.columns[0], right.columns[0]
    return met_pairs(left.select(a, key), right.select(b, key), key, block).select(F.col("x").alias(a), F.col("y").alias(b))

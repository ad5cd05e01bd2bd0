"""Redaction of nested records: a waterfall of rules, the first that matches a value wins.

Records are ``VARIANT`` values.  They are opened level by level, so a round costs one join-free pass over
the values of a level, and put together again from the deepest level up.  A rule that matches an
object or a list replaces it whole, and nothing below it is looked at.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwork.storage import stored


class Rule(NamedTuple):
    """A value whose key and text match, both in whole if given, becomes ``put``; with ``inside`` only the parts of a text that match do."""

    name: str
    key: str | None
    text: str | None
    put: str
    inside: bool = False


#: Our own rules, for want of built-in ones: keys that name secrets, bearer tokens, addresses of mail.
RULES = (
    Rule("secret-key", r"(?i)^(.*[_-])?(password|secret|token|api[_-]?key)$", None, "[secret]"),
    Rule("bearer", None, r"Bearer [A-Za-z0-9._~+/=-]+", "Bearer [token]", True),
    Rule("mail", None, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "[mail]", True),
)


def redacted_text(rules: tuple[Rule, ...]) -> Column:
    """The JSON that stands for a value (key, text, json) by the first rule that matches, null for none."""
    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        match = F.lit(True)
        if rule.key is not None:
            match = match & F.coalesce(F.col("key").rlike(rule.key), F.lit(False))
        if rule.text is not None:
            match = match & F.coalesce(F.col("text").rlike(rule.text), F.lit(False))
        new = F.regexp_replace("text", rule.text, rule.put) if rule.inside and rule.text is not None else F.lit(rule.put)
        out = F.when(match, quoted(new)).otherwise(out)
    return out


def quoted(text: Column) -> Column:
    """A text as a JSON string."""
    return F.regexp_extract(F.to_json(F.struct(text.alias("t"))), r"(?s)^\{\"t\":(.*)\}$", 1)


def redact(records: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(id, json, hits) of (id, body), a JSON text each: the redacted record, its keys in order, and how many values were replaced.

    A body that is no JSON is withheld: its json is null.
    """
    kind = F.expr("CASE WHEN schema_of_variant(value) LIKE 'OBJECT<%' THEN 'object' WHEN schema_of_variant(value) LIKE 'ARRAY<%' THEN 'array' ELSE 'leaf' END")
    spread = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a small file is one task, whatever its rows cost
    front = records.repartition(spread, "id").select("id", F.lit("").alias("path"), F.lit(None).cast("string").alias("parent"), F.lit(0).alias("pos"), F.lit(None).cast("string").alias("key"), F.try_parse_json("body").alias("value"))
    front = front.where("value is not null")
    levels: list[DataFrame] = []
    while True:
        seen = front.withColumn("kind", kind).withColumn("text", F.when((F.col("kind") == "leaf") & F.expr("schema_of_variant(value) = 'STRING'"), F.expr("try_variant_get(value, '$', 'string')")))
        level = stored(seen.withColumn("put", redacted_text(rules)).select("id", "path", "parent", "pos", "key", "kind", "put", F.when(F.col("kind") == "leaf", F.to_json("value")).alias("json"), F.when((F.col("kind") != "leaf") & F.col("put").isNull(), F.to_json("value")).alias("inner")), "redaction-level")
        levels.append(level)
        inner = level.where("inner is not null")
        if inner.isEmpty():
            break
        open_ = inner.select("id", F.col("path").alias("parent"), F.parse_json("inner").alias("v"))
        open_.createOrReplaceTempView(view := f"redaction_{id(level)}")
        front = records.sparkSession.sql(f"SELECT o.id, concat(o.parent, '/', lpad(cast(e.pos AS string), 8, '0')) AS path, o.parent, e.pos, e.key, e.value FROM {view} o, LATERAL variant_explode(o.v) e")
        records.sparkSession.catalog.dropTempView(view)
    below = None
    for level in reversed(levels):
        made = level
        if below is not None:
            member = F.when(F.col("key").isNull(), F.col("json")).otherwise(F.concat(quoted(F.col("key")), F.lit(":"), F.col("json")))
            joined = below.groupBy("id", F.col("parent").alias("path")).agg(F.sort_array(F.collect_list(F.struct("pos", member.alias("m")))).alias("m"), F.sum("hits").alias("inside"))  # the members of one value
            made = level.join(joined.select("id", "path", F.array_join(F.transform("m", lambda x: x["m"]), ",").alias("members"), "inside"), ["id", "path"], "left")
        else:
            made = level.withColumns({"members": F.lit(None).cast("string"), "inside": F.lit(None).cast("bigint")})
        whole = F.coalesce("members", F.lit(""))
        json = F.coalesce("put", F.when(F.col("kind") == "object", F.concat(F.lit("{"), whole, F.lit("}"))).when(F.col("kind") == "array", F.concat(F.lit("["), whole, F.lit("]"))).otherwise(F.col("json")))
        below = stored(made.select("id", "parent", "pos", "key", json.alias("json"), (F.coalesce("inside", F.lit(0)) + F.col("put").isNotNull().cast("int")).cast("bigint").alias("hits")), "redaction-made")
    return records.select("id").join(below.select("id", "json", "hits"), "id", "left").select("id", "json", F.coalesce("hits", F.lit(0)).alias("hits"))

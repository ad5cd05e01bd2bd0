"""Row numbers and running sums in an order, without one task for a whole group.

Rows are range-partitioned by key and order, and numbered inside their partition; partition
totals, a few rows a key, give each partition its offset.  A key that holds most rows is
spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwork.storage import stored


def running(rows: DataFrame, by: list[str], order: list[Column | str], value: Column | None = None, name: str = "upto") -> DataFrame:
    """``rows`` with the running sum of ``value`` (or the row number) in each group, this row included.

    ``order`` must tell the rows of a group apart.
    """
    spread = rows.sparkSession.conf.get("spark.sql.shuffle.partitions")
    part, total, before = f"{name}_part", f"{name}_total", f"{name}_before"
    columns = rows.columns
    dealt = stored(rows.withColumn(name, F.lit(1).cast("bigint") if value is None else value).repartitionByRange(int(spread), *by, *order).withColumn(part, F.spark_partition_id()), "running")
    totals = dealt.groupBy(*by, part).agg(F.sum(name).alias(total))
    earlier = Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*by, part, F.coalesce(F.sum(total).over(earlier), F.lit(0)).alias(before))
    inside = Window.partitionBy(part, *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = dealt.withColumn(name, F.sum(name).over(inside))
    same = [summed[part] == offsets[part], *(summed[c].eqNullSafe(offsets[c]) for c in by)]
    return summed.join(offsets, same).select(*(summed[c] for c in columns), (summed[name] + offsets[before]).alias(name))

"""Running sums in order of a key, without ordering all rows in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Keys of one range.
RANGE = 4096


def running_before(rows: DataFrame, key: str, size: str) -> DataFrame:
    """rows with before, the sum of size over smaller keys: windows run inside ranges of RANGE keys, and only one row for each range is ordered globally."""
    ranged = rows.withColumn("range", F.floor(F.col(key) / RANGE))
    upto = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    bases = ranged.groupBy("range").agg(F.sum(size).alias("n")).select("range", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("base"))
    inside = Window.partitionBy("range").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    inside_sum = ranged.withColumn("inside", F.coalesce(F.sum(size).over(inside), F.lit(0)))
    return inside_sum.join(bases, "range").withColumn("before", F.col("base") + F.col("inside")).drop("range", "inside", "base")

"""Running sums over groups of any size."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a group that one task orders, about.
ROWS_PER_BUCKET = 20_000


def running_sum(df: DataFrame, group: str, key: str, value: str, rows: int, name: str = "before") -> DataFrame:
    """Add ``name``: the sum of ``value`` over the rows of the same group that come before.

    Rows are ordered by a hash of ``key``, then ``key``. The hash's first bits are the
    bucket: sums of the buckets are accumulated first, then the rows inside each. A group
    that holds a third of all rows is spread over as many tasks as its size asks for.
    ``rows`` is the number of rows of ``df``, about. A null value counts as 0.
    """
    bits = max(0, math.ceil(math.log2(max(1, rows) / ROWS_PER_BUCKET)))
    hashed = F.xxhash64(key)
    df = df.withColumn("_hash", hashed).withColumn("_bucket", F.shiftrightunsigned(hashed, 64 - bits) if bits else F.lit(0).cast("bigint"))
    worth = F.coalesce(F.col(value), F.lit(0)).cast("bigint")
    earlier = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(group, "_bucket").agg(F.sum(worth).alias("_sum"))
    sums = sums.select(group, "_bucket", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(group, "_bucket").orderBy("_hash", key).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_inside", F.coalesce(F.sum(worth).over(inside), F.lit(0)))
    return df.join(sums, [group, "_bucket"]).withColumn(name, F.col("_offset") + F.col("_inside")).drop("_hash", "_bucket", "_inside", "_offset")

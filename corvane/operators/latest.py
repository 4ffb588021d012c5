"""The valid row of each key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators.checked import BROADCAST_ROWS, measured


def latest_rows(df: DataFrame, keys: list[str], order: str = "loaded_at") -> DataFrame:
    """Keep, for each key, the row with the latest ``order`` value.

    Rows with a null key have no identity and are left out. A null ``order`` loses to
    any value; ties go to the row whose content hash is larger, so the choice does not
    depend on the partitioning. Equal rows count once. Extra columns are kept.

    ``row_number() = 1`` lets Spark insert a group limit below the exchange: each map
    task sends at most one row a key, so a key that holds a third of all rows does not
    pile up in one reducer.
    """
    rank, tie = _free(df, "_rank"), _free(df, "_tie")
    window = Window.partitionBy(*keys).orderBy(F.col(order).desc_nulls_last(), F.col(tie).desc())
    return (
        df.filter(_known(keys))
        .withColumn(tie, F.xxhash64(*[F.col(c) for c in df.columns]))
        .withColumn(rank, F.row_number().over(window))
        .filter(F.col(rank) == 1)
        .drop(rank, tie)
    )


def latest_wide_rows(df: DataFrame, key: str, order: str = "loaded_at") -> DataFrame:
    """``latest_rows`` for tables with long texts, of which few rows are superseded.

    A first pass reads only ``key`` and ``order`` and finds the keys delivered more than
    once. Where these are few enough to broadcast, the wide rows are filtered where they
    lie and never shuffled, but for those of keys with a tie, which go through
    ``latest_rows``; else all do. The rows are the same either way. The first pass is an
    eager job.
    """
    repeated, latest = _free(df, "_repeated"), _free(df, "_latest")
    per_order = df.filter(_known([key])).groupBy(key, order).agg(F.count("*").alias("_c"))
    per_key = per_order.groupBy(key).agg(
        F.max(order).alias(latest), F.sum("_c").alias("_n"), F.max_by("_c", order).alias("_at_latest")
    )
    again, rows = measured(per_key.filter("_n > 1"), "repeated-keys")
    if rows > BROADCAST_ROWS:
        return latest_rows(df, [key], order)
    tied = F.col("_at_latest").isNull() | (F.col("_at_latest") > 1)
    has_ties = bool(again.filter(tied).limit(1).count())
    side = F.broadcast(again.select(F.col(key).alias(repeated), F.when(~tied, F.col(latest)).alias(latest)))
    valid = (
        df.filter(_known([key]))
        .join(side, F.col(key) == F.col(repeated), "left")
        .filter(F.col(repeated).isNull() | (F.col(order) == F.col(latest)))
        .drop(repeated, latest)
    )
    if not has_ties:
        return valid
    return valid.unionByName(latest_rows(df.join(F.broadcast(again.filter(tied).select(key)), key, "left_semi").select(df.columns), [key], order))


def _known(keys: list[str]):
    return reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])


def _free(df: DataFrame, name: str) -> str:
    while name in df.columns:
        name += "_"
    return name

"""Joins that broadcast a side only after its size has been checked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.sources.shared import materialize

#: A side of at most so many rows of a few numbers (some tens of MB) may be broadcast.
BROADCAST_ROWS = 500_000


def measured(df: DataFrame, label: str) -> tuple[DataFrame, int]:
    """``df`` written to the shared folder, and its number of rows."""
    kept = materialize(df, label)
    return kept, kept.count()


def join_measured(df: DataFrame, side: DataFrame, rows: int, on: list[str], how: str) -> DataFrame:
    """Join with a narrow side of known size: broadcast up to ``BROADCAST_ROWS``, else shuffled.

    Both ways give the same rows. The first spares wide rows a shuffle.
    """
    return df.join(F.broadcast(side) if rows <= BROADCAST_ROWS else side, on, how)


def join_weighted(df: DataFrame, side: DataFrame, rows: int, on: list[str], heavy: Column) -> DataFrame:
    """Inner join with a narrow side, unique in ``on``, of known size, some rows of which match
    very many of ``df``. Beyond ``BROADCAST_ROWS`` only the ``heavy`` ones are broadcast,
    if they are few enough, so that none of their matches piles up in one task."""
    if rows <= BROADCAST_ROWS:
        return df.join(F.broadcast(side), on)
    few, n_few = measured(side.filter(heavy), "heavy")
    if n_few > BROADCAST_ROWS:
        return df.join(side, on)
    light = df.join(F.broadcast(few.select(*on)), on, "left_anti").join(side.filter(~heavy), on)
    return df.join(F.broadcast(few), on).unionByName(light)

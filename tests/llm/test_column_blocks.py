from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import near_duplicates as N
from tests.llm.test_near_duplicates import brute, corpus


@pytest.mark.parametrize("held", [50, 4_000_000])
@pytest.mark.parametrize("hot_columns", [1000, 3])
def test_hot_columns_count_as_often_as_sent(spark, monkeypatch, held, hot_columns):
    """A third of the rows share all their columns but a few: blocks stay within their size."""
    monkeypatch.setattr(N, "HOT_COLUMNS", hot_columns)
    monkeypatch.setattr(N, "SUB_BLOCK", 4)
    monkeypatch.setattr(N, "ENTRIES_PER_BLOCK", 400)
    monkeypatch.setattr(N, "ENTRIES_HELD", held, raising=False)
    used = []
    entries = N._entries

    def kept(columns, threshold, blocks):
        used.append((columns, blocks))
        return entries(columns, threshold, blocks)

    monkeypatch.setattr(N, "_entries", kept)
    rows = [(k, f"{' '.join(f'b{j}' for j in range(30))} unique{k}") for k in range(60)] + [(300 + k, t) for k, t in enumerate(corpus(9, 60))]
    found = N.NearDuplicates(spark.createDataFrame(rows, "i long, t string"), "i", "t", 3, 0.6, 20)
    got = [(r["a"], r["b"]) for r in found.pairs().collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, 3, 0.6, 20)
    columns, blocks = used[0]
    assert (columns.value.hot is None) == (hot_columns == 3)
    records = found.grams.join(found.copies.filter("id <> class_id").select("id"), "id", "left_anti").select("id", "n", "sketch", "grams")
    sent = records.mapInArrow(entries(columns, 0.6, blocks), N.ENTRY_SCHEMA).groupBy("block").agg(F.sum(F.length("columns") / 4).alias("n")).toPandas()["n"]
    if hot_columns > 3:
        assert blocks == np.ceil(sent.sum() / 400) and sent.max() <= 800


def test_counters(spark):
    """Counts of all records, added up from several tasks, few and many a block."""
    random.seed(6)
    grams = [sorted(random.sample(range(40), random.randint(1, 30))) for _ in range(3000)] + [[k * 7 + 1000] for k in range(60_000)]
    wide = [[g << (N.GRAM_BITS - 16) for g in x] for x in grams]
    df = spark.createDataFrame([(bytearray(N.pack(np.array(x, np.uint64)).tobytes()),) for x in wide], "grams binary").repartition(3)
    levels = N.column_counts(df, 16)
    want = np.bincount(np.array([g % (1 << 16) for x in grams for g in x]), minlength=1 << 16)
    assert (levels == np.minimum(np.rint(np.log2(want + 1.0) * 8), 255)).all() and want.max() > 255
    assert N.counters_for(0) == 16 and N.counters_for(10**12) == N.MOST_COUNTERS

from __future__ import annotations

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corvane.llm.ngram_counts import mark_terms, marked_terms, ngram_counts


def tokens(text):
    return [t for t in re.findall("[a-z0-9_#-]+", (text or "").lower()) if len(t) > 1]


def brute(texts, n):
    occurrences, records = Counter(), Counter()
    for text in texts:
        t = tokens(text)
        grams = [" ".join(t[k : k + n]) for k in range(len(t) - n + 1)]
        occurrences.update(grams)
        records.update(set(grams))
    return {g: (occurrences[g], records[g]) for g in occurrences}


@pytest.mark.parametrize("batch", [3, 10000])
@pytest.mark.parametrize("max_n", [1, 2, 4])
def test_against_brute_force(spark, max_n, batch):
    random.seed(max_n)
    words = ["aa", "bb", "Aa", "c", "dd-d", "#x", "é", "K", "İs", "ee_1"]
    texts = [random.choice([" ", "\n", ", "]).join(random.choice(words) for _ in range(random.randint(0, 25))) for _ in range(150)]
    texts += [None, "", " ", "a", "same text here"] + ["same text here"] * 40 + ["bb " * 3000]
    df = spark.createDataFrame([(t, 1, "x") for t in texts], "t string, n int, term string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = ngram_counts(df, "t", max_n).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len({(r["n"], r["term"]) for r in got}) == len(got)
    for n in range(1, max_n + 1):
        assert {r["term"]: (r["occurrences"], r["records"]) for r in got if r["n"] == n} == brute(texts, n)


def test_empty_and_marks(spark):
    df = spark.createDataFrame([(None,), ("",)], "t string")
    assert ngram_counts(df, "t").count() == 0 and ngram_counts(df.limit(0), "t", 3).count() == 0
    with pytest.raises(ValueError):
        ngram_counts(df, "t", 0)
    counts = spark.createDataFrame([("a", 2), ("b", 3), ("c", 21), ("d", 20)], "term string, records long")
    assert {r["term"]: r["mark"] for r in mark_terms(counts, 100).collect()} == {"a": "rare", "b": None, "c": "common", "d": None}
    assert mark_terms(counts, 5).filter(F.col("term") == "a").first()["mark"] == "rare"


def test_marked_terms_count_all_records(spark):
    texts = ["aa bb"] * 3 + ["aa"] * 3 + [None, "", "cc", "cc dd aa"]
    df = spark.createDataFrame([(t, 1) for t in texts], "t string, records int")
    got = {r["term"]: (r["occurrences"], r["records"], r["mark"]) for r in marked_terms(df, "t", common_above=0.5).collect()}
    assert got == {"aa": (7, 7, "common"), "bb": (3, 3, None), "cc": (2, 2, "rare"), "dd": (1, 1, "rare")}
    assert marked_terms(df.limit(0), "t").count() == 0


def test_blocks_are_cut_by_size(spark):
    df = spark.createDataFrame([(w * k,) for k, w in enumerate(["one two ", "two three ", "two "], 1)] * 20, "t string").coalesce(1)
    whole = sorted(map(tuple, ngram_counts(df, "t", 3).collect()))
    assert sorted(map(tuple, ngram_counts(df, "t", 3, block_bytes=16).collect())) == whole

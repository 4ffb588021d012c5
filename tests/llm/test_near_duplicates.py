from __future__ import annotations

import random
import re

import pytest

from corvane.llm import near_duplicates as N


def shingles(text, size, least):
    t = [x for x in re.findall("[a-z0-9_#-]+", (text or "").lower()) if len(x) > 1]
    return {tuple(t[k : k + size]) for k in range(len(t) - size + 1)} if len(t) >= least else set()


def brute(rows, size, threshold, least):
    sets = {i: s for i, t in rows if i is not None and (s := shingles(t, size, least))}
    ids = sorted(sets)
    out = set()
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if both and both / (len(sets[a]) + len(sets[b]) - both) >= threshold:
                out.add((a, b))
    return out


def corpus(seed, n=150):
    random.seed(seed)
    words = [f"w{k}" for k in range(40)] + ["Common", "the-the"]
    texts = []
    for _ in range(n):
        if texts and random.random() < 0.6:
            t = random.choice(texts).split()
            for _ in range(random.randint(0, 6)):
                at = random.randrange(max(1, len(t)))
                t[at : at + random.randint(0, 2)] = [random.choice(words) for _ in range(random.randint(0, 2))]
            texts.append(" ".join(t))
        else:
            texts.append(" ".join(random.choice(words) for _ in range(random.randint(0, 90))))
    return texts


@pytest.mark.parametrize(("size", "threshold", "least"), [(3, 0.6, 20), (5, 0.8, 1), (2, 0.3, 5), (1, 1.0, 1)])
@pytest.mark.parametrize("small_blocks", [False, True])
def test_against_brute_force(spark, monkeypatch, size, threshold, least, small_blocks):
    if small_blocks:  # many column blocks, and shared columns cut into sub-blocks
        monkeypatch.setattr(N, "ENTRIES_PER_BLOCK", 500)
        monkeypatch.setattr(N, "SUB_BLOCK", 8)
        monkeypatch.setattr(N, "PAIRS_HELD", 20)
    rows = list(enumerate(corpus(size)))
    rows += [(1000, None), (1001, ""), (None, rows[0][1]), (1002, rows[3][1]), (1003, rows[3][1].upper())]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "id2 long, text string, a int, grams string")
    found = N.NearDuplicates(df, "id2", "text", size, threshold, least)
    got = [(r["a"], r["b"]) for r in found.pairs().collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(rows, size, threshold, least)


def test_hot_group(spark, monkeypatch):
    """A third of all rows are copies, another third differ in one word each."""
    monkeypatch.setattr(N, "SUB_BLOCK", 16)
    monkeypatch.setattr(N, "CLASS_SLICE", 7)
    base = " ".join(f"b{k}" for k in range(60))
    rows = [(k, base) for k in range(60)] + [(100 + k, f"{base} unique{k}") for k in range(60)] + [(300 + k, t) for k, t in enumerate(corpus(9, 60))]
    found = N.NearDuplicates(spark.createDataFrame(rows, "i long, t string"), "i", "t", 3, 0.6, 20)
    got = {(r["a"], r["b"]) for r in found.pairs().collect()}
    assert got == brute(rows, 3, 0.6, 20)
    assert found.links().filter("a = 0").count() == 60  # copies take part once


def test_empty(spark):
    df = spark.createDataFrame([], "i long, t string")
    found = N.NearDuplicates(df, "i", "t")
    assert found.links().count() == 0 and found.pairs().count() == 0
    with pytest.raises(ValueError):
        N.NearDuplicates(df, "i", "t", threshold=0)

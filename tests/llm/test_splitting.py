from __future__ import annotations

import random

import numpy as np
import pytest

from corvane.llm.splitting import STRETCH, RangeMaximum, cuts, split_oversized, strengths


def test_range_maximum():
    random.seed(1)
    values = np.array([random.randint(0, 4) for _ in range(300)])
    table = RangeMaximum(values, 300)
    for _ in range(2000):
        a = random.randrange(300)
        b = random.randrange(a, 300)
        part = values[a : b + 1]
        assert table.best(a, b) == a + max(k for k, v in enumerate(part) if v == part.max())


def test_strengths():
    text = "One. Two\nthree\n\nfour\n\n# Five 。六"
    got = strengths(np.frombuffer(text.encode("utf-32-le"), np.uint32))
    at = lambda s: int(got[text.index(s)])
    assert (at("Two"), at("three"), at("four"), at("# Five"), at("Five"), at("六"), at("wo")) == (3, 4, 5, 6, 2, 3, 1)
    assert int(strengths(np.frombuffer("e\u0301".encode("utf-32-le"), np.uint32))[1]) == 0


TEXTS = {
    "words": lambda: " ".join("w" * random.randint(1, 12) for _ in range(4000)),
    "paragraphs": lambda: "\n\n".join(" ".join(f"word{random.randint(0, 99)}." for _ in range(random.randint(3, 40))) for _ in range(120)),
    "solid": lambda: "x" * 9000,
    "blanks": lambda: " " * 3000 + "\n" * 3000 + "end",
    "wide": lambda: "空的索引不会引起错误，而是得到一个空的结果。" * 300,
    "emoji": lambda: "😀e\u0301" * 3000,
    "crlf": lambda: "line one\r\nline two\r\n\r\n" * 400,
}


@pytest.mark.parametrize("kind", TEXTS)
@pytest.mark.parametrize(("limit", "overlap"), [(500, 50), (1000, 0), (64, 31), (7, 6), (300, 250)])
def test_cuts(kind, limit, overlap):
    random.seed(2)
    text = TEXTS[kind]()
    pieces = cuts(text, limit, overlap)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    for (a, b), (c, d) in zip(pieces, pieces[1:]):
        assert b - a <= limit and d - c <= limit and a < c <= b < d
        assert 0.8 * overlap - 1 <= b - c <= overlap
    assert "".join(text[max(a, e) : b] for (a, b), e in zip(pieces, [0, *(b for _, b in pieces)])) == text


def test_overlap_must_fit():
    for limit, overlap in ((10, 10), (10, 11), (10, -1)):
        with pytest.raises(ValueError):
            cuts("x" * 50, limit, overlap)


def test_natural_boundaries():
    random.seed(3)
    text = TEXTS["paragraphs"]()
    assert sum(text[b - 2 : b] == "\n\n" for _, b in cuts(text, 2000, 100)[:-1]) == len(cuts(text, 2000, 100)) - 1


def test_long_text_is_cut_alike_across_stretches():
    random.seed(4)
    text = " ".join("w" * random.randint(1, 12) + random.choice(["", ".", "\n"]) for _ in range(STRETCH // 3))
    text = text[: STRETCH - 6000] + "end.\n" + " " * 12000 + text[STRETCH - 6000 :]
    assert len(text) > 2 * STRETCH
    import corvane.llm.splitting as s

    whole, s.STRETCH = s.STRETCH, len(text) + 10
    try:
        want = cuts(text, 4800, 240)
    finally:
        s.STRETCH = whole
    assert cuts(text, 4800, 240) == want


def test_split(spark):
    rows = [(1, "\n " + "ab " * 100, "a"), (2, "ab " * 100, None), (3, "short", "a"), (4, None, "a"), (5, "ab " * 100, "b"), (6, "x" * 20, "a"), (6, "x" * 21, "a"), (None, "y" * 30, "a")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "i long, t string, site string, piece int, start int")
    limits = spark.createDataFrame([("a", 20, 4), ("b", None, None), ("*", 50, 0)], "source_site string, max_chars int, overlap_chars int")
    got = split_oversized(df, "i", "t", "site", limits).collect()
    assert {r["id"] for r in got} == {1, 2, 6, None}
    for i, text, limit in ((1, ("ab " * 100).strip(), 20), (2, ("ab " * 100).strip(), 50)):
        mine = sorted((r for r in got if r["id"] == i), key=lambda r: r["piece_no"])
        assert [r["piece_no"] for r in mine] == list(range(len(mine)))
        assert "".join(r["piece"][r["overlap"] :] for r in mine) == text
        assert all(len(r["piece"]) == r["length"] <= limit and text[r["start"] : r["start"] + r["length"]] == r["piece"] for r in mine)
    assert split_oversized(df, "i", "t", "site", limits.filter("source_site = 'a'")).filter("id = 2").count() == 0
    assert split_oversized(df.limit(0), "i", "t", "site", limits).count() == 0
    with pytest.raises(ValueError):
        split_oversized(df, "i", "t", "site", limits.withColumn("overlap_chars", limits["max_chars"]))
    assert split_oversized(df, "i", "t", "site", limits.limit(0)).count() == 0

from __future__ import annotations

import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corvane.llm import languages as L
from tests.conftest import SMALL

pytestmark = pytest.mark.skipif(not os.path.exists(L.VOCABULARY), reason="no vocabulary files here")


def test_forward_sums_all_segmentations():
    random.seed(1)
    pieces = [b"a", b"b", b"ab", b"ba", b"aab", b"bb"]
    p = np.random.default_rng(1).random((len(pieces), 2)) * 0.3
    number = {x: k for k, x in enumerate(pieces)}

    def total(word):
        if not word:
            return np.ones(2)
        return sum((p[k] * total(word[len(x) :]) for x, k in number.items() if word.startswith(x)), np.zeros(2))

    words = ["".join(random.choice("ab") for _ in range(random.randint(1, 9))).encode() for _ in range(40)]
    lattice = L.Lattice(pieces)
    assert np.allclose(np.exp(lattice.forward(words, p)), [total(w) for w in words])
    # each word is cut into pieces whose lengths add up to its own
    expected = lattice.expected(words, p, np.ones((len(words), 2)))
    assert np.allclose((expected * np.array([[len(x)] for x in pieces])).sum(axis=0), sum(map(len, words)))
    assert lattice.forward([], p).shape == (0, 2)


def test_words_of_any_length_are_taken_whole(monkeypatch):
    random.seed(2)
    pieces = [b"a", b"b", b"ab", b"ba", b"aab", b"bbabaab"]
    p = np.random.default_rng(2).random((len(pieces), 2)) * 1e-6
    words = ["".join(random.choice("ab") for _ in range(n)).encode() for n in (3, 700, 3000, 1)]

    def log_total(word):
        """Plain sums, scaled at each byte."""
        sums, log = [np.ones(2)], np.zeros(2)
        for end in range(1, len(word) + 1):
            new = sum((p[k] * sums[end - len(x)] for k, x in enumerate(pieces) if end >= len(x) and word[end - len(x) : end] == x), np.zeros(2))
            sums = [s / new for s in sums] + [np.ones(2)]
            log += np.log(new)
            sums[: max(0, len(sums) - 8)] = [np.zeros(2)] * max(0, len(sums) - 8)
        return log

    for size in (L.WORD_BYTES, 512):  # a word is looked up in several stretches, too
        monkeypatch.setattr(L, "WORD_BYTES", size)
        assert np.allclose(L.Lattice(pieces).forward(words, p), [log_total(w) for w in words])


def texts_of(prose):
    return [(int(r), int(n), [prose.words[c] for c, q in zip(prose.code, prose.paragraph) if q == k]) for k, (r, n) in enumerate(zip(prose.record, prose.number))]


def test_prose():
    got = texts_of(
        L.prose(
            pa.array(
                [
                    "# Heading\nfirst words\n \nsecond `code here` rest\n\n```py\nimport x\n\ny\n```\nthird «fremde Worte» on",
                    None,
                    "",
                    "  \n\t\n",
                    "```\nonly code\n```",
                    'say "quoted text" end "open\n\nnext',
                    "unclosed ` tick stays\n\n```\ncode to the end",
                    "caf&eacute; sÃ£o 空的。索引",
                ]
            )
        )
    )
    assert got == [
        (0, 0, ["first", "words"]),
        (0, 1, ["second", "rest"]),
        (0, 2, ["third", "on"]),
        (5, 0, ["say", "quoted", "text", "end", "open"]),
        (5, 1, ["next"]),
        (6, 0, ["unclosed", "tick", "stays"]),
        (7, 0, ["café", "são", "空的", "索引"]),
    ]


def test_spelled_words():
    assert L.spelled("snake_case") == L.spelled("CamelCase") == L.spelled("v2") == b""
    assert L.spelled("ÉTÉ") == " été".encode() and L.spelled("e\u0301") == L.spelled("é")
    long = L.spelled("空" * 30)
    assert b"".join(L.parts(long)) == long and all(len(x) <= L.SAMPLE_PART and x.decode() for x in L.parts(long)) and L.parts(b"") == []


@pytest.mark.parametrize(("label", "code"), [("en", "en"), (" ENG ", "en"), ("pt-BR", "pt"), ("zh_CN", "zh"), ("German", "de"), ("ko", None), ("und", None), ("", None), (None, None), ("english ", "en"), ("xen", None)])
def test_labels(spark, label, code):
    assert spark.createDataFrame([(label,)], "t string").select(L.label_code(F.col("t"))).first()[0] == code


@pytest.fixture(scope="module")
def model(spark):
    return L.fit_on(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "text", "lang", "doc_id")


def test_held_out_labels(spark, model):
    """Fitted at one scale, tested on other documents: where label and text name one language
    each they agree but for the labels that are wrong."""
    held = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", L.label_code(F.col("lang")).alias("label"))
    found = L.language_segments(held, "doc_id", "text", model).groupBy(F.col("id").alias("doc_id")).agg(F.collect_set("lang_code").alias("codes"))
    both = found.join(held, "doc_id").filter("label is not null and size(codes) = 1").select((F.col("codes")[0] == F.col("label")).alias("same")).collect()
    assert len(both) > 50 and sum(r["same"] for r in both) / len(both) > 0.85


def test_segments(spark, model):
    english = "There are several ways to read the value, and each of them returns the same result."
    german = "Die Einstellung wird geprüft, bevor das Modell den Wert übernimmt, und danach geschrieben."
    rows = [(1, f"{english}\n\n{german}\n\n{german}"), (2, german.upper()), (3, None), (4, "```\ncode\n```"), (5, f"{english} «{german}»"), (6, "snake_case CamelCase"), (7, "\n\n".join([english] * 500)), (7, english)]
    df = spark.createDataFrame([(i, t, "x", 1.0) for i, t in rows], "d long, text string, lang_code string, confidence double")
    got = sorted((r["id"], r["segment_no"], r["first_paragraph"], r["last_paragraph"], r["lang_code"]) for r in L.language_segments(df, "d", "text", model).collect())
    assert got == [(1, 0, 0, 0, "en"), (1, 1, 1, 2, "de"), (2, 0, 0, 0, "de"), (5, 0, 0, 0, "en"), (7, 0, 0, 0, "en"), (7, 0, 0, 499, "en")]
    assert all(0.5 < r["confidence"] <= 1 for r in L.language_segments(df, "d", "text", model).collect())
    assert L.language_segments(df.limit(0), "d", "text", model).count() == 0
    assert L.fit([], []).p.shape[1] == len(L.LANGUAGES)

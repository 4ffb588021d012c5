from __future__ import annotations

import re
import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvane.functions import text as X

PIECES = ["a", "Bb", "cache", "1", "12", "1234", "12345", " ", "  ", "\n", "\n\n", "\r\n", "\t", "\u00a0", "\u2028", "\x1c", "|", "| a | b |", "```", "`x`", "#", "## ", "# Title", "> ", "---", "-", "_", ".", "é", "e\u0301", "İ", "😀", "\x00", "!!! note", "    body", "???", "1 2 3 4 5 6 7"]
TEXTS = st.lists(st.sampled_from(PIECES), max_size=14).map("".join)
RUN = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


def column(spark, texts, f):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    return [r[0] for r in df.orderBy("k").select(f(F.col("t")).alias("x")).collect()]


def clean(s, limit=None):
    s = re.sub(r"`{3,}.*?`{3,}", " ", s, flags=re.S)
    s = re.sub(r"^\s*\|.*\|\s*$", " ", s, flags=re.M)
    s = re.sub(r"(?:^|\s)(?:\d{1,4}\s+){5,}\d{1,4}(?=\s|$)", " ", s)
    return re.sub(r"\s+", " ", s.replace("|", " ").replace("`", " ")).strip()[:limit]


def admonitions(doc):
    kept, skip = [], False
    for line in (doc or "").split("\n"):
        if line.strip().startswith(("!!!", "???")) or (skip and (not line.strip() or line.startswith(("    ", "\t")))):
            skip = True
        else:
            skip = False
            kept.append(line)
    return re.sub("\n{4,}", "\n\n\n", "\n".join(kept)).strip()


@RUN
@given(texts=st.lists(TEXTS, min_size=30, max_size=60))
def test_against_python(spark, texts):
    assert column(spark, texts, X.tokenize) == [[t for t in re.split("[^a-z0-9_#-]+", x.lower()) if len(t) > 1] for x in texts]
    assert column(spark, texts, X.strip) == [x.strip() for x in texts]
    assert column(spark, texts, X.collapse) == [re.sub(r"\s+", " ", x).strip() for x in texts]
    assert column(spark, texts, X.clean_snippet) == [clean(x, 420) for x in texts]
    assert column(spark, texts, X.drop_admonitions) == [admonitions(x) for x in texts]
    assert column(spark, texts, lambda c: X.substring_count(c, "a")) == [x.count("a") for x in texts]
    assert column(spark, texts, lambda c: X.substring_count(c, "")) == [x.count("") for x in texts]


def test_tokens(spark):
    got = column(spark, ["a bb ccc d eee", "test-value_name #tag", "", None, "BaseModel validation"], X.tokenize)
    assert got == [["bb", "ccc", "eee"], ["test-value_name", "#tag"], [], [], ["basemodel", "validation"]]


def test_snippet(spark):
    assert column(spark, ["1 2 3 4 5 6 7 8 text", "x" * 1000, "   content   ", "| a | b |\n```\ncode\n```\nkept"], X.clean_snippet) == ["text", "x" * 420, "content", "kept"]
    long = "é" * 300 + "Needle" + "y" * 300
    near = column(spark, [long, "no such word", "İ needle", None], lambda c: X.snippet(c, F.lit("needle")))
    assert near[0] == "é" * 120 + "Needle" + "y" * 194
    assert near[1:] == ["no such word", "İ needle", ""]
    assert column(spark, ["abc"], lambda c: X.snippet(c, F.lit(""))) == ["abc"]


@pytest.mark.parametrize(
    ("given_text", "expected"),
    [("### \n\ncontent", "content"), ("a" + "\n" * 100 + "b", "a\n\nb"), ("a\r\nb\x00c", "a\nbc"), ("   ", ""), (None, ""), ("x\n---\ny", "x\n\ny"), ("  a   b  \n  c ", "a b\nc"), ("é 😀", "é 😀"), (">\nq", "q")],
)
def test_normalize(spark, given_text, expected):
    assert column(spark, [given_text], X.normalize_text) == [expected]


@pytest.mark.parametrize(
    ("line", "expected"),
    [("# Main Title", (1, "Main Title", "main-title")), ("## API Reference (v2.0)", (2, "API Reference (v2.0)", "api-reference-v20")), ("plain", (0, "", "")), ("####### x", (0, "", "")), ("# ???", (1, "???", "")), (None, None)],
)
def test_heading(spark, line, expected):
    got = column(spark, [line], X.heading_info)[0]
    assert (got["title"] is None) if expected is None else tuple(got) == expected


def test_slug_classes(spark):
    letters = [chr(c) for c in range(0x20, 0x2FFF) if unicodedata.category(chr(c))[0] in "LNPSZ" and unicodedata.age(chr(c)) < "13"] if hasattr(unicodedata, "age") else [chr(c) for c in range(0x20, 0x250)]
    want = [re.sub(r"[-\s]+", "-", re.sub(r"[^\w\s-]", "", x.lower())) for x in letters]
    assert column(spark, letters, X.slug) == want


def test_truncation(spark):
    assert column(spark, ["abcdef", "abc", None], lambda c: X.truncated(c, 3, "!")) == ["abc!", "abc", None]
    assert column(spark, ["abcdef"], lambda c: X.truncated(c, 0, "!")) == ["abcdef"]


def test_admonition(spark):
    assert column(spark, ["First.\n\n!!! note\n    body\n\n    more\nRest", "a" + "\n" * 6 + "b", ""], X.drop_admonitions) == ["First.\n\nRest", "a\n\n\nb", ""]


def test_admonition_of_many_lines(spark):
    inside = "!!! note\n" + "    body\n\n" * 50_000
    assert column(spark, [f"First\n{inside}Rest", inside, "a\n" * 50_000 + "!!! x"], X.drop_admonitions) == ["First\nRest", "", ("a\n" * 50_000).strip()]

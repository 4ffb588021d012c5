from __future__ import annotations

import os

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvane.functions.token_sizes import TOKENIZER, count_tokens, encoding, tokenizer, with_token_counts
from corvane.operators.chunking import chunk_text

pytestmark = pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="no tokenizer files here")
PIECES = ["a", "word", " ", "  ", "\n", "\t", "\u00a0", "\u3000", "\u2028", "\x85", "'s", "é", "。", "1", "_", ".", "\r\n", "世界", "\x0b", "\x1c", "'", "😀", "<|endoftext|>"]


@pytest.fixture(scope="module")
def encoder():
    return encoding()


@settings(max_examples=60, deadline=None)
@given(texts=st.lists(st.one_of(st.none(), st.text(max_size=20), st.lists(st.sampled_from(PIECES), max_size=20).map("".join)), max_size=40))
def test_equals_the_tokenizer(encoder, texts):
    texts = [None if t is None else t.encode("utf-8", "ignore").decode() for t in texts]
    want = [len(encoder.encode_ordinary(t or "")) for t in texts]
    assert count_tokens(pa.array(texts, pa.string())).tolist() == want
    assert count_tokens(pa.array(["x", *texts, "y z"], pa.string()).slice(1, len(texts))).tolist() == want


def test_column(spark, encoder):
    df = spark.createDataFrame([(1, "one two three", 5), (2, None, 6), (3, "", 7)], "k int, t string, extra int")
    out = with_token_counts(df, "t", ["k", "extra"])
    assert {r["k"]: r["n_tokens"] for r in out.collect()} == {1: len(encoder.encode_ordinary("one two three")), 2: 0, 3: 0}
    assert out.columns == ["k", "extra", "n_tokens"] and with_token_counts(df.limit(0), "t", ["k"]).count() == 0


def test_chunks_by_tokens(spark, encoder):
    text = "\n\n".join(f"paragraph {k} " + "word " * (k % 9) for k in range(40))
    df = spark.createDataFrame([(1, text), (2, None), (3, "short")], "k int, t string")
    got = {r["k"]: r["c"] for r in df.select("k", chunk_text(F.col("t"), 50, tokenizer()).alias("c")).collect()}
    want, cur, n = [], [], 0
    for p in text.split("\n\n"):
        size = len(encoder.encode_ordinary(p))
        if n + size > 50 and cur:
            want.append("\n\n".join(cur))
            cur, n = [], 0
        cur.append(p)
        n += size
    assert got == {1: [*want, "\n\n".join(cur)], 2: [], 3: ["short"]}

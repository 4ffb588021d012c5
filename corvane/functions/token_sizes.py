"""Sizes of texts in tokens of a public tokenizer.

The rank files of byte-level BPE are split by a fixed pattern before any merge. The
pattern never joins across some places: before a blank that precedes a word, between a
word and other white space, and around the last white space of several. Texts are cut
there with numpy, and each distinct stretch is counted once by the tokenizer itself, so
the sizes are exact while the tokenizer sees a small part of the text.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.functions.spans import utf8_bytes
from corvane.operators.chunking import Counter

#: Folder and file of the ranks; the path is a parameter of everything that counts.
TOKENIZER = os.environ.get("CORVANE_TOKENIZER", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
# Fixed value: the pattern that belongs to the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Distinct stretches whose sizes a worker remembers.
REMEMBERED = 500_000

_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_loaded: dict[str, tuple] = {}


def encoding(path: str = TOKENIZER):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _worker_state(path: str):
    if path not in _loaded:
        _loaded[path] = (encoding(path), {})
    return _loaded[path]


def stretches(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of the stretches of all texts together."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    white = _WHITE[data]
    first = np.zeros(n, bool)  # first byte of a text
    first[offsets[:-1][(offsets[:-1] < offsets[1:])]] = True
    before = np.append(True, white[:-1]) | first  # white space or the text's beginning before
    follows = np.append(~white[1:], False)  # something else after, in the same text
    follows[:-1] &= ~first[1:]
    after_white = np.append(False, white[:-1]) & ~first
    after_blank = np.append(False, data[:-1] == 32) & ~first
    starts = first | (white & ~before) | (white & after_white & follows) | (~white & after_white & ~after_blank)
    return np.flatnonzero(starts)


def _has_wide_space(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Texts with white space outside ASCII; these are given to the tokenizer whole."""
    out = np.zeros(len(offsets) - 1, bool)
    if len(data) < 2:
        return out
    a, b = data[:-1], data[1:]
    at = np.flatnonzero(((a == 0xC2) & ((b == 0xA0) | (b == 0x85))) | ((a == 0xE2) & ((b == 0x80) | (b == 0x81))) | ((a == 0xE3) & (b == 0x80)) | ((a == 0xE1) & (b == 0x9A)))
    if len(at):
        c = data[np.minimum(at + 2, len(data) - 1)]
        lead, second = data[at], data[at + 1]
        real = (
            (lead == 0xC2)
            | ((lead == 0xE2) & (second == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF)))
            | ((lead == 0xE2) & (second == 0x81) & (c == 0x9F))
            | ((lead != 0xC2) & (lead != 0xE2) & (c == 0x80))
        )
        out[np.searchsorted(offsets, at[real], side="right") - 1] = True
    return out


def count_tokens(texts: pa.Array, path: str = TOKENIZER) -> np.ndarray:
    """Number of tokens of each text; 0 for null and empty ones."""
    encoder, known = _worker_state(path)
    data, offsets = utf8_bytes(texts)
    starts = stretches(data, offsets)
    sizes = np.zeros(len(offsets) - 1, np.int64)
    if not len(starts):
        return sizes
    ends = np.append(starts, len(data)).astype(np.int64)
    coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(data.tobytes())]).dictionary_encode()
    if len(known) > REMEMBERED:
        known.clear()
    each = np.empty(len(coded.dictionary), np.int64)
    for k, stretch in enumerate(coded.dictionary.to_pylist()):
        size = known.get(stretch)
        if size is None:
            size = len(encoder.encode_ordinary(stretch.decode()))
            if len(stretch) < 64:
                known[stretch] = size
        each[k] = size
    owner = np.searchsorted(offsets, starts, side="right") - 1
    sizes = np.bincount(owner, weights=each[coded.indices.to_numpy(zero_copy_only=False)], minlength=len(sizes)).astype(np.int64)
    for k in np.flatnonzero(_has_wide_space(data, offsets)):
        sizes[k] = len(encoder.encode_ordinary(data[offsets[k] : offsets[k + 1]].tobytes().decode()))
    return sizes


def with_token_counts(df: DataFrame, text: str, keep: list[str], path: str = TOKENIZER, name: str = "n_tokens") -> DataFrame:
    """The columns ``keep`` and the size of ``text`` in tokens, without the text."""
    source = df.select(*keep, F.col(text).alias("_text"))
    schema = source.drop("_text").schema.add(name, T.LongType())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                part = batch.slice(start, 2048)
                columns = [part.column(k) for k in range(len(keep))]
                yield pa.record_batch([*columns, pa.array(count_tokens(part.column(len(keep)), path))], names=[*keep, name])

    return source.mapInArrow(count, schema)


def tokenizer(path: str = TOKENIZER) -> Counter:
    """A counter for chunking that counts tokens of the rank file at ``path``."""

    @F.pandas_udf(T.IntegerType())
    def one(texts: pd.Series) -> pd.Series:
        return pd.Series(count_tokens(pa.array(texts, pa.string(), from_pandas=True), path))

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def many(lists: pd.Series) -> pd.Series:
        lengths = [0 if x is None else len(x) for x in lists]
        flat = [p for x in lists if x is not None for p in x]
        counts = count_tokens(pa.array(flat, pa.string()), path)
        ends = np.cumsum(lengths)
        return pd.Series([None if x is None else counts[e - n : e] for x, n, e in zip(lists, lengths, ends)], dtype=object)

    return Counter(one, many)

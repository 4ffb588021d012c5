"""Token spans of whole Arrow string arrays, found with numpy on their UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from corvane.functions.spans import runs, utf8_bytes

#: A token is a longest run of these bytes in lower-cased text, of at least ``MIN_LENGTH``.
TOKEN_BYTES = b"abcdefghijklmnopqrstuvwxyz0123456789_#-"
MIN_LENGTH = 2
#: Bytes of text whose tokens a task holds at once, about; a longer text is held whole.
TEXT_BYTES = 1 << 22

_IS_TOKEN = np.zeros(256, bool)
_IS_TOKEN[np.frombuffer(TOKEN_BYTES, np.uint8)] = True


@dataclass
class Tokens:
    """Tokens of a batch of texts, in text order."""

    record: np.ndarray  #: for each token the number of its text in the batch
    code: np.ndarray  #: for each token its number in ``dictionary``
    dictionary: pa.Array  #: distinct tokens, in order of first occurrence
    n_records: int


def text_slices(batches: Iterator[pa.RecordBatch], column: int, limit: int = TEXT_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches with about ``limit`` bytes of text in a column; a longer text stands alone."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(size, dtype=np.int64) // limit
        edges = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), batch.num_rows]
        for start, end in pairwise(edges):
            yield batch.slice(start, end - start)


def token_runs(lowered: pa.Array) -> Tokens:
    """Tokens of texts that are lower-cased already (Spark's ``lower`` does that)."""
    data, offsets = utf8_bytes(lowered)
    inside = _IS_TOKEN[data]
    starts, ends = runs(inside, offsets)
    length = ends - starts
    long = length >= MIN_LENGTH
    inside[starts[~long]] = False
    return coded(data[inside], starts[long], length[long], offsets)


def coded(inside: np.ndarray, starts: np.ndarray, length: np.ndarray, offsets: np.ndarray) -> Tokens:
    """Tokens from the bytes of all of them together, and where each starts in the texts."""
    at = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(length, out=at[1:])
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(at), pa.py_buffer(inside.tobytes()))
    coded = words.dictionary_encode()
    return Tokens(
        np.searchsorted(offsets, starts, side="right") - 1,
        coded.indices.to_numpy(zero_copy_only=False).astype(np.int64),
        coded.dictionary,
        len(offsets) - 1,
    )

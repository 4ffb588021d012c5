"""Stretches of whole Arrow string arrays, found with numpy on their UTF-8 bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def utf8_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts together and the offsets of each; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
    raw = texts.buffers()[2] if len(texts) else None
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True, which never reach across a text's border."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    border = offsets[1:-1]
    border = border[(border > 0) & (border < len(inside))]
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    before[border] = False
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    after[border - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1

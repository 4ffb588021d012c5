"""Words of texts in any script, beside the tokens of the core."""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa

from corvane.functions.spans import runs, utf8_bytes
from corvane.functions.tokens import TEXT_BYTES, Tokens, coded, text_slices
from corvane.functions.tokens import token_runs as tokenize

__all__ = ["TEXT_BYTES", "Tokens", "text_slices", "tokenize", "unicode_words"]

#: Han and Kana are written without spaces: each of these characters is a word.
SINGLE = ((0x3005, 0x3007), (0x3040, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x1AFF0, 0x1B16F), (0x20000, 0x3FFFF))
_LETTERS_END = 0x40000  # no letter, mark or number beyond, but for variation selectors


@cache
def _kinds() -> np.ndarray:
    """For each code point: 1 inside a word, 2 a word of its own, 3 blank, else 0."""
    kind = np.zeros(_LETTERS_END + 1, np.uint8)
    for c in range(_LETTERS_END):
        if c == 0x5F or unicodedata.category(chr(c))[0] in "LMN":
            kind[c] = 1
        elif chr(c).isspace() or unicodedata.category(chr(c)) in ("Cc", "Cf"):
            kind[c] = 3
    for first, last in SINGLE:
        kind[first : last + 1][kind[first : last + 1] == 1] = 2
    return kind


def _characters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each character starts, and its code point."""
    lead = (data & 0xC0) != 0x80
    lead[offsets[:-1][offsets[:-1] < len(data)]] = True
    at = np.flatnonzero(lead)
    first = data[at]
    code = first.astype(np.int32)
    padded = np.append(data, np.zeros(3, np.uint8))
    for size, low, high in ((2, 0xC0, 0xDF), (3, 0xE0, 0xEF), (4, 0xF0, 0xFF)):
        mine = np.flatnonzero((first >= low) & (first <= high))
        value = code[mine] & 0xFF >> size + 1
        for k in range(1, size):
            value = value << 6 | (padded[at[mine] + k] & 0x3F).astype(np.int32)
        code[mine] = value
    return at, code


def unicode_words(lowered: pa.Array) -> Tokens:
    """Words of texts in any script: longest runs of letters, marks, numbers and `_`, composed
    (NFC); each Han or Kana character is a word. In a text without any word each character
    but blanks is one. Takes texts that are lower-cased already."""
    composed = [t and unicodedata.normalize("NFC", t) for t in lowered.to_pylist()]  # Arrow's own NFC decomposes
    data, offsets = utf8_bytes(pa.array(composed, pa.large_string()))
    at, code = _characters(data, offsets)
    kind = _kinds()[np.minimum(code, _LETTERS_END)]
    border = np.searchsorted(at, offsets)  # texts in characters
    wordless = np.diff(np.append(0, np.cumsum((kind == 1) | (kind == 2)))[border]) == 0
    kind[(kind == 0) & np.repeat(wordless, np.diff(border))] = 2
    inside, single = (kind == 1) | (kind == 2), kind == 2
    starts, _ = runs(inside, border)
    start = single.copy()
    start[starts] = True
    start[1:] |= inside[1:] & single[:-1]
    width = np.diff(np.append(at, len(data)))
    in_words = np.flatnonzero(inside)
    first = np.flatnonzero(start[in_words])
    length = np.add.reduceat(width[in_words], first) if len(first) else np.zeros(0, np.int64)
    return coded(data[np.repeat(inside, width)], at[in_words[first]], length, offsets)

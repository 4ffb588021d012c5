"""Cutting oversized texts into overlapping pieces at natural boundaries.

Every place between two characters has a strength: a heading begins, a blank line ends,
a line ends, a sentence ends, a blank ends, or none of these. A sparse table over the
strengths (maxima of all stretches whose length is a power of two) answers in constant
time where the strongest place of a window is, the rightmost of equals. A piece ends at
the strongest place between half the limit (or the overlap, if that is more) and the
limit; the next one begins at the strongest place in the first fifth of the permitted
overlap before that cut.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.operators.checked import join_measured

EDGE = " \t\r\n"
#: A piece is not cut before this share of its limit; an overlap has at least this share of the permitted one.
LEAST_FILL, LEAST_OVERLAP = 0.5, 0.8
#: Characters whose strengths and table are held at once.
STRETCH = 1 << 17

PIECE_SCHEMA = "id bigint, piece_no int, start int, overlap int, length int, piece string"

_BLANK = np.array([ord(c) for c in " \t\r\n\x0b\x0c\x85\xa0\u2028\u2029\u3000"], np.uint32)
_STOP = np.array([ord(c) for c in ".!?;:。！？；…"], np.uint32)
_WIDE_STOP = np.array([ord(c) for c in "。！？；"], np.uint32)
_MARKS = np.array([c for c in range(0x300, 0x10000) if unicodedata.combining(chr(c))] + [0x200D, *range(0xFE00, 0xFE10)], np.uint32)


def strengths(chars: np.ndarray) -> np.ndarray:
    """Strength of a cut before each of these characters, and after the last: 0 to 6.

    6 before a heading, 5 after a blank line, 4 after a line, 3 after a sentence,
    2 after a blank, 1 within a word, 0 inside a combined character.
    """
    n = len(chars)
    out = np.ones(n + 1, np.int64)
    if not n:
        return out
    blank, feed, stop = np.isin(chars, _BLANK), chars == 10, np.isin(chars, _STOP)
    begins = np.flatnonzero(~blank[1:] & blank[:-1]) + 1  # a word begins after blanks
    out[begins] = 2
    # the last character that isn't blank, and the line feeds since then
    at = np.arange(n)
    last = np.maximum.accumulate(np.where(blank, -1, at))
    feeds = np.append(0, np.cumsum(feed))
    solid = last[begins - 1]
    since = feeds[begins] - feeds[np.maximum(solid, -1) + 1]
    out[begins[(solid >= 0) & stop[np.maximum(solid, 0)]]] = 3
    out[begins[since == 1]] = 4
    out[begins[since >= 2]] = 5
    out[begins[(since >= 1) & (chars[begins] == ord("#"))]] = 6
    wide = np.flatnonzero(np.isin(chars[:-1], _WIDE_STOP) & ~blank[1:] & ~stop[1:]) + 1
    out[wide] = np.maximum(out[wide], 3)
    low = np.flatnonzero(np.isin(chars, _MARKS) | ((chars == 10) & (np.append(0, chars[:-1]) == 13)))
    out[low] = 0
    return out


class RangeMaximum:
    """Sparse table of maxima; ties go to the right."""

    def __init__(self, strength: np.ndarray, longest: int):
        self.size = len(strength)
        self.levels = [(strength << 40) | np.arange(self.size)]
        while 2 << (len(self.levels) - 1) <= min(longest, self.size):
            below, half = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.maximum(below[:-half], below[half:]))

    def best(self, first: int, last: int) -> int:
        """The place of the greatest strength in first..last, both included."""
        level = (last - first + 1).bit_length() - 1
        row = self.levels[level]
        return int(max(row[first], row[last + 1 - (1 << level)])) & ((1 << 40) - 1)


def _solid_before(chars: np.ndarray, place: int) -> int:
    """The last character before ``place`` that isn't blank, however far back; else 0."""
    step = 4096
    while place > 0:
        start = max(0, place - step)
        solid = np.flatnonzero(~np.isin(chars[start:place], _BLANK))
        if len(solid):
            return start + int(solid[-1])
        place, step = start, step * 2
    return 0


def cuts(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Start and end of each piece, in characters. No piece is longer than ``limit``; each
    but the first begins at most ``overlap`` (less than ``limit``) before the end of the
    one before it."""
    if not 0 <= overlap < limit:
        raise ValueError(f"an overlap of {overlap} does not fit a limit of {limit}")
    chars = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    n = len(chars)
    if n <= limit:
        return [(0, n)]
    pieces, start, base, table = [], 0, 0, None
    while n - start > limit:
        if table is None or start + limit >= base + table.size - 1:
            base = start  # context before and after, so that strengths don't depend on the stretch
            before = base - _solid_before(chars, base)
            end = min(n, base + max(STRETCH, 2 * limit) + 1)
            strength = strengths(chars[base - before : min(n, end + 1)])[before : before + end - base + 1]
            table = RangeMaximum(strength, limit + 1)
        first = start + max(1, int(limit * LEAST_FILL), overlap + 1)  # the next piece begins after this one
        cut = base + table.best(first - base, start + limit - base)
        pieces.append((start, cut))
        start = cut
        if overlap:
            start = base + table.best(cut - overlap - base, cut - max(1, int(overlap * LEAST_OVERLAP)) - base)
    pieces.append((start, n))
    return pieces


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            text, end, rows = row["text"], 0, []
            for number, (a, b) in enumerate(cuts(text, row["limit"], row["overlap"])):
                rows.append((row["id"], number, a, end - a if number else 0, b - a, text[a:b]))
                end = b
            types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["id", "piece_no", "start", "overlap", "length", "piece"])


def split_oversized(df: DataFrame, id_column: str, text: str, group: str, limits: DataFrame, any_group: str = "*") -> DataFrame:
    """Pieces of every text longer than the limit of its ``group``.

    ``limits`` has ``source_site, max_chars, overlap_chars``; the row ``any_group`` holds
    for all groups that have none of their own, null included; without it these have no
    limit, nor have groups whose limit is null or below 1. An overlap that is negative or
    not below its limit is an error. Blanks, tabs, CR and LF at
    both ends of a text don't count and are not kept. Returns ``id, piece_no`` (from 0),
    ``start`` and ``length`` in characters of the stripped text, ``overlap`` with the
    piece before, ``piece``: cut at ``start + overlap`` and put together, the pieces give
    the text back. Null texts and those within the limit yield nothing; repeated rows
    yield repeated pieces. Each row is cut where it lies; nothing is shuffled. Other
    columns are not read.
    """
    narrow = df.select(F.col(id_column).cast("bigint").alias("id"), F.col(group).alias("_group"), F.btrim(F.col(text), F.lit(EDGE)).alias("text"))
    limits = limits.groupBy(F.col("source_site").alias("_group")).agg(
        F.min("max_chars").cast("int").alias("limit"), F.coalesce(F.min("overlap_chars"), F.lit(0)).cast("int").alias("overlap"), F.lit(True).alias("_named")
    )
    wrong = limits.filter("limit >= 1 and (overlap < 0 or overlap >= limit)").first()
    if wrong is not None:
        raise ValueError(f"an overlap of {wrong['overlap']} does not fit a limit of {wrong['limit']}")
    other = limits.filter(F.col("_group") == any_group).first()
    limited = join_measured(narrow, limits, limits.count(), ["_group"], "left")
    if other is not None:
        for column in ("limit", "overlap"):
            limited = limited.withColumn(column, F.when(F.col("_named").isNull(), F.lit(other[column])).otherwise(F.col(column)))
    over = limited.filter("limit >= 1 and length(text) > limit")
    return over.select("id", "text", "limit", "overlap").mapInArrow(_split, PIECE_SCHEMA)

"""How often every n-gram occurs, and in how many records.

Each task builds the suffix array of the block of records it is given: all token
positions, sorted by all the tokens that follow them within the record (ranks of
prefixes of doubled length). Neighbours share a prefix, whose length the ranks give; a
maximal stretch of neighbours that share at least n tokens is the interval of one n-gram,
and its length is the n-gram's number of occurrences. Two suffixes of one record in the
same interval would count the record twice, so each suffix is linked to the one before it
that belongs to the same record, and a link inside the interval takes one off: what is
left is the number of records. Blocks are cut by the size of their texts.

A record lies wholly in one block, so both numbers add up over blocks. Only the sums
per block are shuffled, so a term that a third of all records hold costs one row a
block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.tokens import TEXT_BYTES, Tokens, text_slices, tokenize
from corvane.sources.shared import materialize

SCHEMA = "term string, n int, occurrences bigint, records bigint"


def suffix_array(first: np.ndarray, record: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions sorted by all that follows in their record, and the number of tokens that
    each shares with the one before it. ``first`` has the tokens' ranks, from 1."""
    size = len(first)
    _, inverse, counts = np.unique(record, return_inverse=True, return_counts=True)
    left = np.cumsum(counts)[inverse] - np.arange(size)  # tokens to the record's end
    ranks = [first]  # ranks[k]: of the 2 to the power of k tokens from a position on
    distinct, step = len(np.unique(first)), 1
    while step < counts.max() and distinct < size:
        further = np.zeros(size, np.int64)
        inside = np.flatnonzero(left > step)
        further[inside] = ranks[-1][inside + step]
        values, rank = np.unique(ranks[-1] * (size + 1) + further, return_inverse=True)
        if len(values) == distinct:  # nothing told apart, so nothing will be
            break
        ranks.append(rank + 1)
        distinct, step = len(values), step * 2
    suffixes = np.argsort(ranks[-1], kind="stable")  # equal ones stay in text order
    x, y = suffixes[1:], suffixes[:-1]
    longest, common = np.minimum(left[x], left[y]), np.zeros(size - 1, np.int64)
    same = np.flatnonzero(ranks[-1][x] == ranks[-1][y])
    common[same] = longest[same]  # if the doubling went on, they would never differ
    apart = np.flatnonzero(ranks[-1][x] != ranks[-1][y])
    for k in range(len(ranks) - 1, -1, -1):
        at = apart[common[apart] < longest[apart]]
        at = at[ranks[k][x[at] + common[at]] == ranks[k][y[at] + common[at]]]
        common[at] += 1 << k
    return suffixes, np.minimum(common, longest)


def suffix_intervals(tokens: Tokens, max_n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For n = 1..max_n: n, a token position of each n-gram, its occurrences, its records."""
    size = len(tokens.code)
    if not size:
        return
    order = pc.sort_indices(tokens.dictionary).to_numpy(zero_copy_only=False)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(1, len(order) + 1)
    suffixes, common = suffix_array(rank[tokens.code], tokens.record)
    ends = np.searchsorted(tokens.record, tokens.record, side="right")
    record = tokens.record[suffixes]
    by_record = np.argsort(record, kind="stable")
    link = np.full(size, -1)
    same = record[by_record][1:] == record[by_record][:-1]
    link[by_record[1:][same]] = by_record[:-1][same]
    for n in range(1, max_n + 1):
        starts = np.flatnonzero(np.append(True, common < n))
        interval_start = np.repeat(starts, np.diff(np.append(starts, size)))
        occurrences = np.diff(np.append(starts, size))
        repeats = np.add.reduceat((link >= interval_start).astype(np.int64), starts)
        whole = (ends[suffixes] - suffixes)[starts] >= n  # else the record ends before the n-th token
        yield n, suffixes[starts][whole], occurrences[whole], (occurrences - repeats)[whole]


def _count_blocks(max_n: int, block_bytes: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = 0
        for batch in text_slices(batches, 0, block_bytes):
            rows += batch.num_rows
            tokens = tokenize(batch.column(0))
            for n, at, occurrences, records in suffix_intervals(tokens, max_n):
                words = [tokens.dictionary.take(pa.array(tokens.code[at + k])) for k in range(n)]
                term = words[0] if n == 1 else pc.binary_join_element_wise(*words, pa.scalar(" ", pa.large_string()))
                yield pa.record_batch(
                    [term.cast(pa.string()), pa.array(np.full(len(at), n, np.int32)), pa.array(occurrences), pa.array(records)],
                    names=["term", "n", "occurrences", "records"],
                )
        yield pa.record_batch(
            [pa.nulls(1, pa.string()), pa.array([0], pa.int32()), pa.array([0], pa.int64()), pa.array([rows], pa.int64())], names=["term", "n", "occurrences", "records"]
        )

    return count


def ngram_counts(df: DataFrame, text: str, max_n: int = 1, block_bytes: int = TEXT_BYTES) -> DataFrame:
    """Every n-gram of 1 to ``max_n`` tokens of column ``text`` with its occurrences and records.
    A task sorts the suffixes of about ``block_bytes`` of text at once.

    Every row of ``df`` is one record. Null and empty texts, and texts shorter than n
    tokens, hold no n-gram. Repeated rows are records of their own. Texts of any length
    are taken whole. An empty table yields no row. Other columns are not read.
    """
    if max_n < 1:
        raise ValueError("max_n must be at least 1")
    return _summed(df, text, max_n, block_bytes).filter("n > 0")


def _summed(df: DataFrame, text: str, max_n: int, block_bytes: int = TEXT_BYTES) -> DataFrame:
    """With one row more, of n = 0, whose ``records`` is the number of all records."""
    blocks = df.select(F.lower(F.col(text)).alias("text")).mapInArrow(_count_blocks(max_n, block_bytes), SCHEMA)
    return blocks.groupBy("term", "n").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def marked_terms(df: DataFrame, text: str, rare_below: int = 3, common_above: float = 0.2) -> DataFrame:
    """``term, n, occurrences, records, mark`` of all terms. The counts are written once; the
    number of records, those without text included, comes out of the same pass."""
    counts = materialize(_summed(df, text, 1), "term-counts")
    n_records = counts.filter("n = 0").agg(F.sum("records")).first()[0] or 0
    return mark_terms(counts.filter("n > 0"), n_records, rare_below, common_above)


def mark_terms(counts: DataFrame, n_records: int, rare_below: int = 3, common_above: float = 0.2) -> DataFrame:
    """Add ``mark``: `rare` (in fewer than ``rare_below`` records), `common` (in more than
    the share ``common_above`` of ``n_records``) or null. What is both counts as rare."""
    mark = F.when(F.col("records") < rare_below, "rare").when(F.col("records") > common_above * n_records, "common")
    return counts.withColumn("mark", mark)

"""The best records of many queries, block by block of records, with numpy."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from corvane.operators.index import K1, B

#: Scores are rounded to six digits: records that are equal then are less apart than this.
SLACK = 1.1e-6


@dataclass
class Asked:
    """Queries, each a run of ``term`` (numbers of postings' terms) and ``weight``."""

    query: np.ndarray  #: their numbers
    at: np.ndarray  #: where the run of each starts, and the end of the last
    term: np.ndarray
    weight: np.ndarray
    least: np.ndarray  #: a score that ``k`` records are known to have, -inf if there are none

    @classmethod
    def of(cls, rows: pa.Table) -> Asked:
        """From ``query, terms (array of term, weight), least``; a null ``least`` is unknown."""
        lists = rows.column("terms").combine_chunks()
        size = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        entries = lists.flatten()
        least = pc.fill_null(rows.column("least"), float("-inf"))
        return cls(rows.column("query").to_numpy(), np.concatenate([[0], np.cumsum(size)]), *(entries.field(c).to_numpy(zero_copy_only=False) for c in ("term", "weight")), least.to_numpy())


class Block:
    """All postings of some records. Each term's lie together, once by record and once the
    heaviest first."""

    def __init__(self, terms: np.ndarray, term: np.ndarray, record: np.ndarray, x: np.ndarray) -> None:
        """``terms``: sorted numbers of all terms that are asked for; ``record``: by order of ties."""
        n = int(record.max()) + 1 if len(record) else 1
        code = np.searchsorted(terms, term)
        by_record = np.argsort(code * n + record)
        self.record, self.x = record[by_record], x[by_record]
        code = code[by_record]
        self.at = np.searchsorted(code, np.arange(len(terms) + 1))
        heavy = np.lexsort((-self.x, code))
        self.heavy_record, self.falling = self.record[heavy], -self.x[heavy]
        #: the heaviest posting of each term; 0 where there is none
        self.most = np.zeros(len(terms))
        there = self.at[1:] > self.at[:-1]
        self.most[there] = -self.falling[self.at[:-1][there]]
        self.there = there

    def heaviest(self, code: int, count: int) -> np.ndarray:
        return self.heavy_record[self.at[code] : min(self.at[code] + count, self.at[code + 1])]

    def count_from(self, code: int, least: float) -> int:
        """How many postings of a term weigh as much or more."""
        return int(np.searchsorted(self.falling[self.at[code] : self.at[code + 1]], -least, side="right"))

    def scores(self, records: np.ndarray, codes: np.ndarray, weights: np.ndarray) -> np.ndarray:
        out = np.zeros(len(records))
        for code, w in zip(codes, weights, strict=True):
            own = slice(self.at[code], self.at[code + 1])
            listed = self.record[own]
            place = np.minimum(np.searchsorted(listed, records), len(listed) - 1)
            out += np.where(listed[place] == records, w * self.x[own][place], 0.0)
        return out

    def best(self, codes: np.ndarray, weights: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Records and rounded scores of the ``k`` best that hold one of these terms, all of
        which are in the block; of those below ``least`` any may be left out.

        With ``least`` above 0 a record reaches it only if one of its postings reaches the part
        of that term, for any parts that add up to ``least``. So only these are scored.
        """
        helps = weights > 0
        few = 4 * k
        if helps.all():  # then a record's score is no less than its part of any term
            records = _together([self.heaviest(c, few) for c in codes])
            scores = self.scores(records, codes, weights)
            if len(scores) >= k:
                least = max(least, float(np.partition(scores, len(scores) - k)[len(scores) - k]))
        bound = least - SLACK - 1e-9 * abs(least)
        if not bound > 0:
            return _top(everything := _together([self.heaviest(c, len(self.record)) for c in codes]), self.scores(everything, codes, weights), k)
        counts = self.prefixes(codes[helps], weights[helps], bound)
        if counts is None:
            return np.zeros(0, np.int64), np.zeros(0)
        if not helps.all() or max(counts) > few:
            records = _together([self.heaviest(c, n) for c, n in zip(codes[helps], counts, strict=True)])
            scores = self.scores(records, codes, weights)
        kept = scores >= bound
        return _top(records[kept], scores[kept], k)

    def prefixes(self, codes: np.ndarray, weights: np.ndarray, bound: float) -> list[int] | None:
        """How many of the heaviest postings of each term have all records that reach ``bound``:
        the longest lists are left out as far as the others alone must bring something, and
        these share what is missing by their heaviest postings. None if no record can."""
        most = weights * self.most[codes]
        if most.sum() < bound:
            return None
        order = np.argsort(self.at[codes] - self.at[codes + 1], kind="stable")  # longest first
        found, total = None, 0
        for out in range(len(codes)):
            missing = bound - most[order[:out]].sum() * (1 + 1e-12)
            if missing <= 0:
                break
            counts, share = [0] * len(codes), missing / most[order[out:]].sum()
            for j in order[out:]:
                counts[j] = self.count_from(codes[j], self.most[codes[j]] * share * (1 - 1e-12))
            if found is None or sum(counts) < total:
                found, total = counts, sum(counts)
        return found


def _together(parts: list[np.ndarray]) -> np.ndarray:
    return parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.int64)


def _top(records: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    rounded = np.copysign(np.floor(np.abs(scores) * 1e6 + 0.5) / 1e6, scores)
    first = np.lexsort((records, -rounded))[:k]
    return records[first], rounded[first]


def best_of_block(block: Block, asked: Asked, codes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of queries in ``asked``, records and scores; ``codes``: of the entries of ``asked``."""
    there = block.there[codes]
    part = np.maximum(asked.weight, 0) * block.most[codes]
    of = np.repeat(np.arange(len(asked.query)), np.diff(asked.at))
    reach = np.bincount(of, part, len(asked.query))
    can = (np.bincount(of, there, len(asked.query)) > 0) & ((reach >= asked.least - 2 * SLACK) | (asked.least <= 0))
    queries, records, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    for q in np.flatnonzero(can):
        own = slice(asked.at[q], asked.at[q + 1])
        held = there[own]
        found, score = block.best(codes[own][held], asked.weight[own][held], k, asked.least[q])
        found, score = found[kept := score >= asked.least[q] - SLACK], score[kept]
        queries.append(np.full(len(found), q))
        records.append(found)
        scores.append(score)
    return np.concatenate(queries), np.concatenate(records), np.concatenate(scores)


def block_scorer(shared, avgdl: float, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For ``mapInArrow`` over ``ord, term_no, tf, dl`` whose partitions hold whole records;
    gives ``query, ord, score``. ``shared``: the broadcast ``Asked``."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        asked, rows = shared.value, pa.Table.from_batches(parts)
        keys = rows.column("ord").combine_chunks().dictionary_encode()
        by_key = pc.array_sort_indices(keys.dictionary)
        place = np.empty(len(by_key), np.int64)
        place[by_key.to_numpy()] = np.arange(len(by_key))
        tf, dl = (rows.column(c).to_numpy().astype(np.float64) for c in ("tf", "dl"))
        terms, codes = np.unique(asked.term, return_inverse=True)
        term = rows.column("term_no").to_numpy()
        mine = np.isin(term, terms)
        x = tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))
        block = Block(terms, term[mine], place[keys.indices.to_numpy()][mine], x[mine])
        queries, records, scores = best_of_block(block, asked, codes, k)
        found = keys.dictionary.take(by_key.take(pa.array(records)))
        yield pa.record_batch([pa.array(asked.query[queries]), found, pa.array(scores)], names=["query", "ord", "score"])

    return score


def scored_blocks(hit: DataFrame, asked: DataFrame, blocks: int, avgdl: float, k: int) -> DataFrame:
    """``query, ord, score``: of each block of ``hit`` (ord, term_no, tf, dl) up to ``k`` records a
    query, among which are the best of all. ``asked`` (query, terms, least) comes to the driver."""
    shared = hit.sparkSession.sparkContext.broadcast(Asked.of(asked.select("query", "terms", "least").toArrow()))
    kind = hit.schema["ord"].dataType.simpleString()
    dealt = hit.select("ord", "term_no", "tf", "dl").repartition(blocks, "ord")
    return dealt.mapInArrow(block_scorer(shared, avgdl, k), f"query long, ord {kind}, score double")

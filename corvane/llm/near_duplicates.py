"""Records that are the same but for small edits.

Two records are alike if the Jaccard similarity of their sets of token n-grams reaches
a threshold. The records and their n-grams form a sparse incidence matrix D; all
overlaps are the entries of D times its transpose. The product is taken in blocks of
columns and never in full:

* The columns are put in one global order, rare n-grams first, from counts over all
  records. A record of n n-grams that shares enough with another one must share one of
  its first few columns with it; how many are few follows from both sizes. Only these
  entries are sent to the column blocks.
* Inside a column block each pair of entries of one column is a candidate. Sizes,
  positions and 256-bit parity sketches of both records bound their overlap from above;
  pairs below the overlap that the threshold demands are discarded before they leave
  the task.
* The overlap of the pairs that are left is counted over all columns.

All bounds are exact: no pair above the threshold is lost. Records with equal sets are
one class and take part once. Columns that surely no other record has are not sent. Of
columns that very many records may share the entries are counted one by one; those that
prove hot are cut into sub-blocks, and the pairs of sub-blocks are spread over tasks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.tokens import TEXT_BYTES, Tokens, text_slices, tokenize
from corvane.operators.checked import join_measured, join_weighted, measured
from corvane.sources.shared import materialize

GRAM_BITS = 40
GRAM_BYTES = GRAM_BITS // 8
SKETCH_BITS = 256
#: Columns are counted in hashed counters, one for so many entries of the matrix, of which
#: there are at least and at most 2 to the power of these; a counter takes one byte.
ENTRIES_PER_COUNTER, LEAST_COUNTERS, MOST_COUNTERS = 16, 16, 24
COUNTER_BLOCK = 1 << 16
#: Entries of the matrix that one task multiplies, about.
ENTRIES_PER_BLOCK = 4_000_000
#: Entries for which a block of its own is worth while, if there are cores for it.
LEAST_ENTRIES = 1_000_000
#: Entries that a task holds before it hands them on, about.
ENTRIES_HELD = 4_000_000
#: Candidates that a task holds before it hands them on.
PAIRS_HELD = 2_000_000
#: A column with more records than this is cut into sub-blocks.
SUB_BLOCK = 4096
#: Hot columns whose exact counts are broadcast, at most (16 bytes each); if there are
#: more, all are cut by their counters, which are never too low.
HOT_COLUMNS = 1_000_000
#: Copies of one set beyond which its records are joined by a broadcast of their own.
HOT_CLASS = 100_000
#: Copies of one set that one task expands into pairs, about.
CLASS_SLICE = 4096

_EPS = 1e-9
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
GRAM_SCHEMA = "id bigint, n int, key1 bigint, key2 bigint, sketch binary, grams binary"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _M2
    return x ^ (x >> np.uint64(29))


def pack(grams: np.ndarray) -> np.ndarray:
    """40-bit numbers as rows of five bytes."""
    return np.ascontiguousarray(grams.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :GRAM_BYTES]


def unpack(data: np.ndarray) -> np.ndarray:
    wide = np.zeros((len(data) // GRAM_BYTES, 8), np.uint8)
    wide[:, :GRAM_BYTES] = data.reshape(-1, GRAM_BYTES)
    return wide.reshape(-1).view("<u8")


def _binary(flat: np.ndarray, lengths: np.ndarray) -> pa.Array:
    at = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=at[1:])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(at), pa.py_buffer(flat.tobytes())]).cast(pa.binary())


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a binary column and the length of each value."""
    column = column.cast(pa.large_binary())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(0, np.int64)
    at = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    return np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]], np.diff(at)


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 1 << 14) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def _whole_texts(h: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """One hash for all ``n`` tokens (a few) of each text."""
    whole = n.astype(np.uint64)
    for k in range(n.max(initial=0)):
        longer = n > k
        whole[longer] = _mix(whole[longer] * _M3 + h[start[longer] + k] + np.uint64(k))
    return whole


def gram_sets(lowered: pa.Array, size: int, min_tokens: int, tokens_of: Callable[[pa.Array], Tokens] = tokenize, short_whole: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of each text: record numbers and 40-bit hashes, both ascending."""
    tokens = tokens_of(lowered)
    words = np.array([xxhash.xxh3_64_intdigest(w) for w in tokens.dictionary.to_pylist()], np.uint64)
    per_text = np.bincount(tokens.record, minlength=tokens.n_records)
    enough = per_text >= max(min_tokens, size)
    h = words[tokens.code] if len(words) else np.zeros(0, np.uint64)
    end = max(0, len(h) - size + 1)
    grams = np.zeros(end, np.uint64)
    for k in range(size):
        grams = _mix(grams * _M1 + h[k : k + end] + np.uint64(k))
    record = tokens.record[:end]
    whole = (record == tokens.record[size - 1 :][:end]) & enough[record]
    grams, record = grams[whole] >> np.uint64(64 - GRAM_BITS), record[whole]
    if short_whole:
        short = np.flatnonzero((per_text > 0) & ~enough)
        texts = _whole_texts(h, (np.cumsum(per_text) - per_text)[short], per_text[short])
        grams, record = np.append(grams, texts >> np.uint64(64 - GRAM_BITS)), np.append(record, short)
    both = np.sort((record.astype(np.uint64) << np.uint64(GRAM_BITS)) | grams)
    both = both[np.append(True, both[1:] != both[:-1])] if len(both) else both
    return (both >> np.uint64(GRAM_BITS)).astype(np.int64), both & np.uint64((1 << GRAM_BITS) - 1)


def _to_gram_rows(size: int, min_tokens: int, tokens_of: Callable[[pa.Array], Tokens], short_whole: bool):
    limit = TEXT_BYTES

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, 1, limit):
            record, grams = gram_sets(batch.column(1), size, min_tokens, tokens_of, short_whole)
            n = np.bincount(record, minlength=batch.num_rows)
            has = np.flatnonzero(n)
            if not len(has):
                continue
            starts = np.cumsum(n[has]) - n[has]
            key1 = np.add.reduceat(_mix(grams * _M1), starts).view(np.int64)
            key2 = np.add.reduceat(_mix(grams * _M3 + _M1), starts).view(np.int64)
            bits = np.bincount(record * SKETCH_BITS + (grams % np.uint64(SKETCH_BITS)).astype(np.int64), minlength=batch.num_rows * SKETCH_BITS)
            sketch = np.packbits((bits & 1).astype(bool).reshape(batch.num_rows, SKETCH_BITS)[has], axis=1)
            yield pa.record_batch(
                [
                    batch.column(0).take(pa.array(has)),
                    pa.array(n[has].astype(np.int32)),
                    pa.array(key1),
                    pa.array(key2),
                    _binary(sketch, np.full(len(has), SKETCH_BITS // 8)),
                    _binary(pack(grams), n[has] * GRAM_BYTES),
                ],
                names=["id", "n", "key1", "key2", "sketch", "grams"],
            )

    return convert


def gram_table(
    df: DataFrame, id_column: str, text: str, size: int, min_tokens: int, tokens_of: Callable[[pa.Array], Tokens] = tokenize, short_whole: bool = False
) -> DataFrame:
    """One row a record with at least ``min_tokens`` tokens (and at least one n-gram), or
    with ``short_whole`` at least one token."""
    source = df.select(F.col(id_column).cast("bigint").alias("id"), F.lower(F.col(text)).alias("text"))
    return source.filter("id is not null and text is not null").mapInArrow(_to_gram_rows(size, min_tokens, tokens_of, short_whole), GRAM_SCHEMA)


def counters_for(entries: int) -> int:
    """The logarithm of the number of counters for a matrix of so many entries."""
    return min(MOST_COUNTERS, max(LEAST_COUNTERS, math.ceil(math.log2(max(1, entries) / ENTRIES_PER_COUNTER))))


def column_counts(grams: DataFrame, log2: int) -> np.ndarray:
    """How many records hold an n-gram, by hashed counter, on a logarithmic scale of one byte.

    Counts cover all records. Each task sums its own and sends those above 0, three bytes
    each or one for every counter of a block, whichever is less, and a list of the larger
    ones; blocks of counters are then added up. The result is 16 MB at most.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << log2, np.uint32)
        for batch in batches:
            at = np.sort(unpack(_flat(batch.column(0))[0]) >> np.uint64(GRAM_BITS - log2))
            first = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else np.zeros(0, np.int64)
            where = at[first].astype(np.int64)
            more = np.diff(np.append(first, len(at))).astype(np.uint64)
            total[where] = np.minimum(total[where] + more, 2**32 - 1).astype(np.uint32)
        blocks = total.reshape(-1, COUNTER_BLOCK)
        for b in np.flatnonzero(blocks.any(axis=1)):
            used, large = np.flatnonzero(blocks[b]), np.flatnonzero(blocks[b] > 255)
            counts = np.minimum(blocks[b], 255).astype(np.uint8)
            few = 3 * len(used) < COUNTER_BLOCK
            parts = (used.astype(np.uint16) if few else used[:0], counts[used] if few else counts, large.astype(np.uint16), blocks[b][large] - 255)
            yield pa.record_batch([pa.array([b], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in parts)], names=["block", "used", "counts", "large", "beyond"])

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTER_BLOCK, np.int64)
        for batch in batches:
            for used, counts, large, beyond in zip(*(batch.column(c) for c in ("used", "counts", "large", "beyond"))):
                used, counts = np.frombuffer(used.as_buffer(), np.uint16), np.frombuffer(counts.as_buffer(), np.uint8)
                total[used if len(counts) < COUNTER_BLOCK else slice(None)] += counts
                total[np.frombuffer(large.as_buffer(), np.uint16)] += np.frombuffer(beyond.as_buffer(), np.uint32)
        level = np.minimum(np.rint(np.log2(total + 1.0) * 8), 255).astype(np.uint8)
        yield pa.record_batch([pa.array([key[0].as_py()], pa.int32()), pa.array([level.tobytes()], pa.binary())], names=["block", "counts"])

    summed = grams.select("grams").mapInArrow(partial, "block int, used binary, counts binary, large binary, beyond binary").groupBy("block").applyInArrow(add, "block int, counts binary")
    levels = np.zeros(1 << log2, np.uint8)
    for row in summed.collect():  # 256 rows of 64 KB at most
        levels[row["block"] * COUNTER_BLOCK : (row["block"] + 1) * COUNTER_BLOCK] = np.frombuffer(row["counts"], np.uint8)
    return levels


@dataclass
class Columns:
    """What every task knows of the columns: their counters' levels, and the hot ones."""

    levels: np.ndarray
    sub_block: int
    hot: np.ndarray | None = None  #: mixed numbers of the hot columns, ascending; None: go by the levels
    shares: np.ndarray | None = None  #: in how many pairs of sub-blocks an entry of each takes part

    def level(self, grams: np.ndarray) -> np.ndarray:
        log2 = len(self.levels).bit_length() - 1
        return self.levels[(grams >> np.uint64(GRAM_BITS - log2)).astype(np.int64)]

    def share(self, column: np.ndarray, level: np.ndarray) -> np.ndarray:
        if self.hot is None:
            return sub_blocks(np.exp2(level / 8.0) * 1.1 - 1, self.sub_block)
        out = np.ones(len(column), np.int64)
        if len(self.hot):
            at = np.minimum(np.searchsorted(self.hot, column), len(self.hot) - 1)
            is_hot = self.hot[at] == column
            out[is_hot] = self.shares[at[is_hot]]
        return out


def sub_blocks(records: np.ndarray, size: int) -> np.ndarray:
    """Into how many sub-blocks a column of so many records is cut. Each meets each other one,
    so an entry is sent as many times."""
    return np.maximum(np.ceil(records / size), 1).astype(np.int64)


def need(n_large, n_small, threshold: float):
    """The least overlap of two sets of these sizes whose similarity reaches the threshold."""
    return np.ceil(threshold / (1 + threshold) * (n_large + n_small) - _EPS).astype(np.int64)


def _n_first(n: np.ndarray, threshold: float) -> np.ndarray:
    """How many of a record's columns are sent to the blocks."""
    return n - np.ceil(threshold * n - _EPS).astype(np.int64) + 1


#: Levels up to this one are counts of 1: no other record has the column.
ALONE = 8


@dataclass
class Prefix:
    """Of a batch of records the entries of their first columns, record by record."""

    column: np.ndarray  #: 40 bits, mixed
    level: np.ndarray
    part: np.ndarray  #: place among the record's columns, in 256ths, rounded down
    owner: np.ndarray  #: number of the record in the batch


def prefix(columns: Columns, threshold: float, n: np.ndarray, grams: np.ndarray) -> Prefix:
    record = np.repeat(np.arange(len(n)), n)
    level = columns.level(grams)
    # record, level, 40 bits of the mixed column: any fixed order within a level will do
    column = _mix(grams * _M1) >> np.uint64(24)
    order = np.lexsort((column, level, record))
    column, level = column[order], level[order]
    place = np.arange(len(record)) - np.repeat(np.cumsum(n) - n, n)
    size = n[record]
    first = (place < _n_first(size, threshold)) & (level > ALONE)
    return Prefix(column[first], level[first], np.minimum(place[first] * 256 // size[first], 255).astype(np.uint8), record[first])


def _suspects(shared, threshold: float):
    """Entries of the first columns by column, where the counter says that it may be hot, and
    in a row without a column the number of all."""
    least = math.floor(8 * math.log2(SUB_BLOCK + 1))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            found = prefix(shared.value, threshold, batch.column(0).to_numpy().astype(np.int64), unpack(_flat(batch.column(1))[0]))
            column, times = np.unique(found.column[found.level >= least], return_counts=True)
            yield pa.record_batch([pa.array([None, *column.tolist()], pa.int64()), pa.array([len(found.column), *times.tolist()], pa.int64())], names=["column", "entries"])

    return count


def _entries(shared, threshold: float, blocks: int):
    """Send the first columns of each record to the blocks that multiply them.

    A row holds what one batch of records has in one block: per record its id, size and
    sketch, per entry the column, the record's place in the row and the entry's place
    among the record's columns, in 256ths, rounded down.
    """
    most = ENTRIES_HELD

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = shared.value
        for batch in _slices(batches):
            ids = batch.column(0).to_numpy()
            n = batch.column(1).to_numpy().astype(np.int64)
            sketches = _flat(batch.column(2))[0].reshape(len(ids), -1)
            found = prefix(columns, threshold, n, unpack(_flat(batch.column(3))[0]))
            share = columns.share(found.column, found.level)
            # entries of cut columns are many times as many when sent; a record's stay together
            held = (np.cumsum(np.bincount(found.owner, share, len(ids))) // most)[found.owner]
            edges = [0, *(np.flatnonzero(held[1:] != held[:-1]) + 1).tolist(), len(held)]
            for start, end in pairwise(edges):
                yield from emit(ids, n, sketches, *(x[start:end] for x in (found.column, found.part, found.owner, share)))

    def emit(ids, n, sketches, column, part, owner, share) -> Iterator[pa.RecordBatch]:
        cut = np.flatnonzero(share > 1)
        if len(cut):
            mine = (_mix(ids[owner[cut]].astype(np.uint64)) % share[cut].astype(np.uint64)).astype(np.int64)
            times = share[cut]
            which = np.repeat(np.arange(len(cut)), times)
            other = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)
            low, high = np.minimum(mine[which], other), np.maximum(mine[which], other)
            pair = _mix(column[cut][which] ^ (low.astype(np.uint64) << np.uint64(20)) ^ high.astype(np.uint64)) >> np.uint64(24)
            rest = np.flatnonzero(share == 1)
            column, part, owner = np.concatenate([column[rest], pair]), np.concatenate([part[rest], part[cut][which]]), np.concatenate([owner[rest], owner[cut][which]])
        block = (column % np.uint64(blocks)).astype(np.int64)
        order = np.argsort(block * len(ids) + owner, kind="stable")
        block, owner, column, part = block[order], owner[order], (column[order] // np.uint64(blocks)).astype(np.uint32), part[order]
        edges = np.append(np.flatnonzero(np.append(True, block[1:] != block[:-1])), len(block)) if len(block) else [0]
        rows = []
        for start, end in pairwise(edges):
            s = slice(start, end)
            who, local = np.unique(owner[s], return_inverse=True)
            rows.append((block[start], ids[who].tobytes(), n[who].astype(np.int32).tobytes(), sketches[who].tobytes(), column[s].tobytes(), local.astype(np.uint16).tobytes(), part[s].tobytes()))
        if rows:
            yield pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), *[pa.array([r[k] for r in rows], pa.binary()) for k in range(1, 7)]], names=["block", "ids", "sizes", "sketches", "columns", "owners", "parts"])

    return convert


ENTRY_SCHEMA = "block int, ids binary, sizes binary, sketches binary, columns binary, owners binary, parts binary"


def _as_batches(pairs: list[np.ndarray], ids: np.ndarray) -> Iterator[pa.RecordBatch]:
    if not pairs:
        return
    found = np.unique(np.concatenate(pairs))
    x, y = ids[found // len(ids)], ids[found % len(ids)]
    for at in range(0, len(found), 1 << 16):
        a, b = x[at : at + (1 << 16)], y[at : at + (1 << 16)]
        yield pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def _multiply(threshold: float):
    """Candidates of one block: pairs that the bounds don't rule out, as a rule each once."""
    most = PAIRS_HELD

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: list[list[np.ndarray]] = [[] for _ in range(6)]
        seen = 0
        for batch in batches:
            for row in zip(*[batch.column(c) for c in ("ids", "sizes", "sketches", "columns", "owners", "parts")]):
                ids = np.frombuffer(row[0].as_buffer(), np.int64)
                columns = np.frombuffer(row[3].as_buffer(), np.uint32)
                owners = np.frombuffer(row[4].as_buffer(), np.uint16)
                for k, x in enumerate((ids, np.frombuffer(row[1].as_buffer(), np.int32), np.frombuffer(row[2].as_buffer(), np.uint64).reshape(len(ids), -1), columns, (owners + np.int64(seen)).astype(np.int32), np.frombuffer(row[5].as_buffer(), np.uint8))):
                    got[k].append(x)
                seen += len(ids)
        if not seen:
            return
        # a part at a time, so that what was received is let go; places and sizes are 32 bits wide
        parts, owners, columns, sketches, sizes, ids = (np.concatenate(got.pop()) for _ in range(6))
        order = np.argsort((columns.astype(np.uint64) << np.uint64(32)) | sizes[owners].astype(np.uint64))
        columns, owners, parts = columns[order], owners[order], parts[order]
        del order
        n = sizes[owners]
        place = (parts.astype(np.int64) * n // 256).astype(np.int32)
        first = np.flatnonzero(np.append(True, columns[1:] != columns[:-1]))
        run = np.diff(np.append(first, len(columns)))
        ends = np.repeat((first + run).astype(np.int32), run)
        del columns, parts, first, run
        small = np.flatnonzero(place <= n - np.ceil(2 * threshold / (1 + threshold) * n - _EPS)).astype(np.int32)  # what the smaller record must show
        step, pairs, held = 0, [], 0
        while True:
            step += 1
            small = small[small < ends[small] - step]
            if not len(small):
                break
            large = small + step
            fits = n[small] >= threshold * n[large] - _EPS
            small = small[fits]  # sizes ascend: later ones don't fit either
            for at in range(0, len(small), 1 << 18):
                i = small[at : at + (1 << 18)]
                j = i + step
                least = need(n[j], n[i], threshold)
                k = (place[i] <= n[i] - least) & (place[j] <= n[j] - least) & (owners[i] != owners[j])
                i, j, least = owners[i[k]], owners[j[k]], least[k]
                apart = np.bitwise_count(sketches[i] ^ sketches[j]).sum(axis=1, dtype=np.int64)
                k = apart <= sizes[i] + sizes[j] - 2 * least
                if k.any():
                    i, j = i[k].astype(np.int64), j[k].astype(np.int64)
                    pairs.append(np.minimum(i, j) * len(ids) + np.maximum(i, j))
                    held += int(k.sum())
            if held > most:  # what comes again is dropped after the exchange
                yield from _as_batches(pairs, ids)
                pairs, held = [], 0
        yield from _as_batches(pairs, ids)

    return product


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _slices(batches, 4096):
        sets = []
        for name in ("grams_a", "grams_b"):
            flat, length = _flat(batch.column(name))
            owner = np.repeat(np.arange(batch.num_rows, dtype=np.uint64), length // GRAM_BYTES)
            sets.append((owner << np.uint64(GRAM_BITS)) | unpack(flat))
        both = np.sort(np.concatenate(sets))
        twice = both[1:][both[1:] == both[:-1]]
        overlap = np.bincount((twice >> np.uint64(GRAM_BITS)).astype(np.int64), minlength=batch.num_rows)
        yield pa.record_batch([batch.column("a"), batch.column("b"), batch.column("n_a"), batch.column("n_b"), pa.array(overlap)], names=["a", "b", "n_a", "n_b", "overlap"])


class NearDuplicates:
    """The links between the records of ``df`` and the classes of records with equal sets.

    ``id_column`` must be unique. Null ids and null, empty or too short texts take part
    in nothing. Equal texts are in one class. Texts are taken whole. Other columns are
    not read. An empty table has no class and no link. ``tokens_of`` finds the tokens of
    lower-cased texts. With ``short_whole`` the sequence of all its tokens is the one
    n-gram of a text that is too short.
    """

    def __init__(
        self,
        df: DataFrame,
        id_column: str,
        text: str,
        size: int = 5,
        threshold: float = 0.8,
        min_tokens: int = 1,
        tokens_of: Callable[[pa.Array], Tokens] = tokenize,
        short_whole: bool = False,
    ):
        if not 0 < threshold <= 1:
            raise ValueError("threshold must be above 0 and at most 1")
        self.spark, self.threshold = df.sparkSession, threshold
        self.grams = materialize(gram_table(df, id_column, text, size, min_tokens, tokens_of, short_whole), "grams")
        sets = ["n", "key1", "key2"]
        narrow = self.grams.select("id", *sets)
        equal, n_equal = measured(narrow.groupBy(*sets).agg(F.min("id").alias("class_id"), F.count("*").alias("copies")).filter("copies > 1"), "classes")
        members = join_weighted(narrow, equal, n_equal, sets, F.col("copies") > HOT_CLASS)
        self.n_classes = n_equal
        #: class_id and id of every record of a class of more than one, and in which of the class's slices it is
        slices = F.ceil(F.col("copies") / CLASS_SLICE).cast("int")
        members = members.select("class_id", "id", F.pmod(F.xxhash64("id"), slices).cast("int").alias("slice"), slices.alias("slices"))
        self.copies, self.n_copies = measured(members, "copies")

    def links(self) -> DataFrame:
        """Pairs (a, b), a < b, of class representatives that are alike, and their similarity."""
        t = self.threshold
        others = self.copies.filter("id != class_id").select("id")
        records = join_measured(self.grams, others, self.n_copies, ["id"], "left_anti")
        shared, sent = self._columns(records)
        cores = self.spark.sparkContext.defaultParallelism
        blocks = max(1, math.ceil(sent / ENTRIES_PER_BLOCK), min(cores, sent // LEAST_ENTRIES))
        entries = records.select("id", "n", "sketch", "grams").mapInArrow(_entries(shared, t, blocks), ENTRY_SCHEMA)
        # a block a task, wherever its number would be hashed to
        pairs = entries.repartitionById(blocks, F.col("block")).mapInArrow(_multiply(t), "a bigint, b bigint").distinct()
        pairs = materialize(pairs, "candidates")
        used, n_used = measured(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "candidate-ids")
        sets = join_measured(self.grams.select("id", "n", "grams"), used, n_used, ["id"], "left_semi")
        # both sides read one exchange of the sets, by id
        counted = pairs.join(sets.alias("x"), F.col("a") == F.col("x.id")).join(sets.alias("y"), F.col("b") == F.col("y.id"))
        counted = counted.select("a", "b", F.col("x.n").alias("n_a"), F.col("y.n").alias("n_b"), F.col("x.grams").alias("grams_a"), F.col("y.grams").alias("grams_b"))
        counted = counted.mapInArrow(_overlaps, "a bigint, b bigint, n_a int, n_b int, overlap bigint")
        similarity = F.col("overlap") / (F.col("n_a") + F.col("n_b") - F.col("overlap"))
        return counted.withColumn("similarity", similarity).filter(F.col("similarity") >= t).select("a", "b", "similarity")

    def _columns(self, records: DataFrame):
        """What tasks must know of the columns, and how many entries will be sent."""
        sc, t = self.spark.sparkContext, self.threshold
        log2 = counters_for(records.agg(F.sum("n")).first()[0] or 0)
        columns = Columns(column_counts(records, log2), SUB_BLOCK, np.zeros(0, np.uint64), np.zeros(0, np.int64))
        counted = records.select("n", "grams").mapInArrow(_suspects(sc.broadcast(columns), t), "column bigint, entries bigint")
        counted = counted.groupBy("column").agg(F.sum("entries").alias("entries")).filter(F.col("column").isNull() | (F.col("entries") > SUB_BLOCK))
        counted, n_hot = measured(counted, "hot-columns")
        sent = counted.filter("column is null").agg(F.sum("entries")).first()[0] or 0
        if n_hot > HOT_COLUMNS:
            columns.hot = None
            return sc.broadcast(columns), sent
        hot = counted.filter("column is not null").orderBy("column").collect()  # HOT_COLUMNS rows at most
        columns.hot = np.array([r["column"] for r in hot], np.uint64)
        each = np.array([r["entries"] for r in hot], np.int64)
        columns.shares = sub_blocks(each, SUB_BLOCK)
        return sc.broadcast(columns), sent + int((each * (columns.shares - 1)).sum())

    def pairs(self, links: DataFrame | None = None) -> DataFrame:
        """All pairs (a, b), a < b, of records that are alike, copies included. The members of
        a class are joined slice by slice, so that a class of very many copies is spread over tasks."""
        links = (links if links is not None else self.links()).select("a", "b")
        each_slice = F.explode(F.sequence(F.lit(0), F.coalesce("slices", F.lit(1)) - 1))
        classes, member = self.copies.filter("id = class_id").select("class_id", "slices"), self.copies.select("class_id", "id", "slice")
        for side in ("a", "b"):
            links = join_measured(links, classes.withColumnRenamed("class_id", side), self.n_classes, [side], "left").withColumn("slice", each_slice)
            links = links.join(member.withColumnRenamed("class_id", side), [side, "slice"], "left").filter("id is not null or slices is null")
            links = links.withColumn(side, F.coalesce("id", side)).drop("id", "slice", "slices")
        between = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        others = self.copies.select("class_id", F.col("id").alias("b"), each_slice.alias("slice"))
        within = member.withColumnRenamed("id", "a").join(others, ["class_id", "slice"]).filter("a < b").select("a", "b")
        return between.unionByName(within)

"""The language of every text, paragraph by paragraph.

The model holds, for each language, a probability of every piece of a fixed public
vocabulary. A word can be cut into pieces in many ways; its probability in a language is
the sum over all of them, which a forward pass over the word's bytes computes: the sum
for a prefix is that of each shorter prefix times the probability of the piece between.
All pieces of the vocabulary take part, and words of any length are taken whole; the pass
keeps only the sums that the longest piece reaches back to. The probability of a paragraph
is the product over its words.

The pieces' probabilities are fitted by expectation maximisation on a bounded sample of
labelled documents. Labels are wrong at times, so that a first model relabels the
paragraphs of the sample, and the final one is fitted on these.
"""

from __future__ import annotations

import base64
import html
import os
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, pairwise

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.spans import runs, utf8_bytes

VOCABULARY = os.environ.get("CORVANE_VOCABULARY", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
LANGUAGES = ("de", "en", "es", "fr", "it", "ja", "nl", "pt", "ru", "zh")
#: The model is fitted on at most so many labelled documents of each language.
SAMPLE_DOCUMENTS = 400
#: For fitting only, the words of the sample are cut into parts of at most so many bytes.
SAMPLE_PART = 48
#: Bytes of words that are looked up in the vocabulary at once, about.
WORD_BYTES = 1 << 16
#: Every so many bytes the forward sums are scaled back to 1, and all along by a factor
#: a byte, so that no word is too long for floating point.
RESCALE, LIFT = 16, 6.0
EM_ROUNDS, RELABEL_ROUNDS, SMOOTHING = 3, 2, 0.05
#: A paragraph is held to be in another language than most of its text only if that is
#: more probable by this factor's logarithm.
MARGIN = 6.0
#: Words of at most so many bytes are remembered by a worker, and how many of them.
REMEMBERED_BYTES, REMEMBERED = 64, 200_000

# ISO 639 codes and English names of the languages.
CODES = {
    "de": ("de", "deu", "ger", "german"),
    "en": ("en", "eng", "english"),
    "es": ("es", "spa", "spanish"),
    "fr": ("fr", "fra", "fre", "french"),
    "it": ("it", "ita", "italian"),
    "ja": ("ja", "jpn", "japanese"),
    "nl": ("nl", "nld", "dut", "dutch"),
    "pt": ("pt", "por", "portuguese"),
    "ru": ("ru", "rus", "russian"),
    "zh": ("zh", "zho", "chi", "chinese"),
}


def label_code(label: Column) -> Column:
    """The language that a label names, by code or English name, case, outer blanks and what
    follows `-` or `_` ignored; null if it names none of ``LANGUAGES``."""
    named = F.trim(F.regexp_extract(F.lower(F.trim(label)), r"^([^-_]*)", 1))
    code = F.lit(None).cast("string")
    for language, names in CODES.items():
        code = F.when(named.isin(*names), language).otherwise(code)
    return code


# ---- prose of a batch of texts, on their UTF-8 bytes

_WHITE = np.zeros(256, bool)
_WHITE[[9, 11, 12, 13, 32]] = True
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), 95, *range(97, 123), *range(128, 256)]] = True
_PIECE = re.compile(rb" ?[a-z\x80-\xff]+")
#: What a word of a natural language doesn't have: digits, underscores, capitals inside.
_IDENTIFIER = re.compile(r"[0-9_]|[a-zß-öø-ÿ][A-ZÀ-ÖØ-Þ]")


@dataclass
class Prose:
    """Words of the prose of a batch. Paragraphs are numbered through the batch."""

    record: np.ndarray  #: for each paragraph with words, the number of its text
    number: np.ndarray  #: for each paragraph with words, its number within the text, from 0
    paragraph: np.ndarray  #: for each word, the place of its paragraph in these
    code: np.ndarray  #: for each word, its number in ``words``
    words: list[str]  #: distinct words as written


def _repaired(texts: pa.Array) -> pa.Array:
    """Character references, and UTF-8 that was read as Latin-1, put right."""
    values = texts.to_pylist()
    changed = False
    for k, text in enumerate(values):
        if text and "&" in text and ";" in text:
            text = html.unescape(text)
        if text and ("Ã" in text or "Â" in text or "Ð" in text or "Ñ" in text):
            text = re.sub("[\u0080-ÿ]{2,}", _undo, text)
        if text is not values[k]:
            values[k], changed = text, True
    return pa.array(values, pa.large_string()) if changed else texts


def _undo(found: re.Match) -> str:
    try:
        return found[0].encode("latin-1").decode("utf-8")
    except UnicodeDecodeError:
        return found[0]


def _odd_inside(mark: np.ndarray, base: np.ndarray) -> np.ndarray:
    """True from each odd mark to the even one after it; ``base``: marks before the paragraph."""
    return ((np.cumsum(mark, dtype=np.int32) - base) & 1).astype(bool) | mark


def prose(texts: pa.Array) -> Prose:
    """Paragraphs are separated by empty or blank lines. Headings, fenced code, code between
    backticks, quotations between quotation marks and identifiers aren't prose."""
    data, offsets = utf8_bytes(_repaired(texts))
    none = Prose(*(np.zeros(0, np.int64) for _ in range(4)), [])
    n = len(data)
    if not n:
        return none
    # lines; a text's border ends a line too
    begins_text = np.unique(offsets[:-1][offsets[:-1] < offsets[1:]])
    starts = np.unique(np.concatenate([begins_text, np.flatnonzero(data[:-1] == 10) + 1]))
    ends = np.append(starts[1:], n)
    length = ends - starts
    solid = np.flatnonzero(~(_WHITE[data] | (data == 10)))
    place = np.searchsorted(solid, starts)
    first = np.append(solid, n)[place]  # of each line the first byte that isn't white
    blank = first >= ends
    padded = np.append(data, np.zeros(4, np.uint8))
    lead = [padded[np.minimum(first + k, n)] for k in range(3)]
    fence = ~blank & (((lead[0] == 96) & (lead[1] == 96) & (lead[2] == 96)) | ((lead[0] == 126) & (lead[1] == 126) & (lead[2] == 126)))
    owner = np.searchsorted(offsets, starts, side="right") - 1
    new_text = np.append(True, owner[1:] != owner[:-1])
    line_of_text = np.maximum.accumulate(np.where(new_text, np.arange(len(starts)), 0))
    fences = np.cumsum(fence)
    code = ((fences - (fences - fence)[line_of_text]) & 1).astype(bool) | fence
    heading = ~blank & (lead[0] == 35)
    # paragraphs: a new one after a blank line, a fence or a text's beginning
    breaks = blank | fence
    paragraph = np.cumsum(new_text | np.append(False, breaks[:-1]) | breaks) - 1
    keep_line = ~(blank | code | heading)
    keep = np.repeat(keep_line, length)
    first_line = np.unique(paragraph, return_index=True)[1]
    # spans between marks, closed at the paragraph's end
    line_paragraph_start = starts[first_line][paragraph]
    for mark in (data == 96, data == 34):
        mark &= keep
        total = np.append(0, np.cumsum(mark, dtype=np.int32))
        odd = np.add.reduceat(mark, starts[first_line], dtype=np.int64) & 1  # an odd mark is left over: no spans
        base = np.repeat(total[line_paragraph_start], length)
        inside = _odd_inside(mark, base) & np.repeat(odd[paragraph] == 0, length)
        keep &= ~inside
    opened = np.zeros(n, np.int8)
    for lead_byte, second, third, worth in ((0xC2, 0xAB, None, 1), (0xC2, 0xBB, None, -1), (0xE2, 0x80, 0x9E, 1), (0xE2, 0x80, 0x9C, 1), (0xE2, 0x80, 0x9D, -1), (0xE3, 0x80, 0x8C, 1), (0xE3, 0x80, 0x8D, -1)):
        at = np.flatnonzero(data[:-1] == lead_byte)
        at = at[data[at + 1] == second]
        if third is not None:
            at = at[at + 2 < n]
            at = at[data[at + 2] == third]
        opened[at] = worth
    if opened.any():
        depth = np.cumsum(opened, dtype=np.int32)
        depth -= np.repeat((depth - opened)[line_paragraph_start], length)
        last = np.append(starts[first_line][1:], n) - 1
        balanced = depth[last] == 0
        keep &= ~((depth > 0) & np.repeat(balanced[paragraph], length))
    letters = _WORD[data] & keep
    # punctuation outside ASCII: U+0080-00BF, U+2000-2FFF, U+3000-303F, U+FF00-FFxx, symbols beyond the BMP
    for lead_byte, seconds, size in ((0xC2, None, 2), (0xE2, None, 3), (0xE3, (0x80,), 3), (0xEF, (0xBC, 0xBD), 3), (0xF0, None, 4)):
        at = np.flatnonzero(data == lead_byte)
        if seconds:
            at = at[np.isin(padded[at + 1], seconds)]
        for k in range(size):
            letters[np.minimum(at + k, n - 1)] = False
    a, b = runs(letters, offsets)
    if not len(a):
        return none
    length = b - a
    at = np.zeros(len(a) + 1, np.int64)
    np.cumsum(length, out=at[1:])
    coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(a), [None, pa.py_buffer(at), pa.py_buffer(data[letters].tobytes())]).dictionary_encode()
    words = [w.decode("utf-8", "ignore") for w in coded.dictionary.to_pylist()]
    line = np.searchsorted(starts, a, side="right") - 1
    used, inverse = np.unique(paragraph[line], return_inverse=True)
    record = owner[first_line][used]
    number = np.arange(len(record)) - np.searchsorted(record, record)
    return Prose(record, number, inverse, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), words)


def spelled(word: str) -> bytes:
    """A word as the model sees it: composed, lower case, with a blank before it; empty if it
    is an identifier."""
    return b"" if _IDENTIFIER.search(word) else b" " + unicodedata.normalize("NFC", word).lower().encode()


def parts(word: bytes, limit: int = SAMPLE_PART) -> list[bytes]:
    """A spelled word in parts of at most ``limit`` bytes, cut between characters."""
    out, start = [], 0
    while len(word) - start > limit:
        end = start + limit
        while word[end] & 0xC0 == 0x80:
            end -= 1
        out.append(word[start:end])
        start = end
    return [*out, word[start:]] if word else []


# ---- the model


def read_vocabulary(path: str) -> list[bytes]:
    """All pieces that can occur in a word, ASCII in lower case, and every single byte. No word
    holds a digit, a punctuation mark of ASCII, or a blank but the one before it."""
    with open(path, "rb") as f:
        pieces = {base64.b64decode(line.split()[0]).lower() for line in f}
    return sorted({p for p in pieces if _PIECE.fullmatch(p)} | {bytes([b]) for b in range(256)})


class Lattice:
    """Where the pieces of a vocabulary occur in words."""

    def __init__(self, vocabulary: list[bytes]):
        # bytes as characters, as the automaton takes text; one beyond them parts the words
        self.automaton = ahocorasick.Automaton()
        for k, piece in enumerate(vocabulary):
            self.automaton.add_word(piece.decode("latin-1"), k)
        self.automaton.make_automaton()
        self.length = np.array([len(p) for p in vocabulary])
        self.longest = int(self.length.max())

    def edges(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Word, start, end and number of every piece in them, by end, then word."""
        sizes = np.array([len(w) for w in words])
        begin = np.cumsum(sizes + 1) - sizes - 1
        found = np.fromiter(chain.from_iterable(self.automaton.iter("\u0100".join(w.decode("latin-1") for w in words))), np.int64).reshape(-1, 2)
        word = np.searchsorted(begin, found[:, 0], side="right") - 1
        end = found[:, 0] - begin[word] + 1
        order = np.lexsort((word, end))
        word, end, piece = word[order], end[order], found[order, 1]
        return word, end - self.length[piece], end, piece

    def forward(self, words: list[bytes], p: np.ndarray) -> np.ndarray:
        """Log-probability of each word under each column of ``p``, over all segmentations."""
        out = np.zeros((len(words), p.shape[1]))
        longest_first = sorted(range(len(words)), key=lambda k: -len(words[k]))
        lifted = p * np.exp(LIFT * self.length)[:, None]
        at = 0
        while at < len(longest_first):
            total, end = 0, at
            while end < len(longest_first) and (end == at or total + len(words[longest_first[end]]) <= WORD_BYTES):
                total += len(words[longest_first[end]])
                end += 1
            group = longest_first[at:end]
            out[group] = self._forward([words[k] for k in group], lifted)
            at = end
        return out

    def _forward(self, words: list[bytes], lifted: np.ndarray) -> np.ndarray:
        sizes = np.array([len(w) for w in words])  # descending
        ring = np.zeros((self.longest + 1, len(words), lifted.shape[1]))
        ring[0] = 1
        scale = np.zeros((len(words), lifted.shape[1]))
        for first in range(0, int(sizes[0]), WORD_BYTES):  # once, but for a word longer than that
            back = max(0, first - self.longest)
            active = int(np.searchsorted(-sizes, -first, side="left"))
            word, start, end, piece = self.edges([w[back : first + WORD_BYTES] for w in words[:active]])
            start, end = start + back, end + back
            lows = np.searchsorted(end, np.arange(first + 1, min(first + WORD_BYTES, int(sizes[0])) + 2))
            for k, (low, high) in enumerate(pairwise(lows.tolist())):
                at = first + 1 + k
                part = ring[start[low:high] % len(ring), word[low:high]] * lifted[piece[low:high]]
                active = int(word[high - 1]) + 1  # every byte is a piece, so each word has an end here
                ring[at % len(ring), :active] = np.add.reduceat(part, np.searchsorted(word[low:high], np.arange(active)), axis=0)
                if at % RESCALE == 0:
                    most = ring[:, :active].max(axis=0)
                    ring[:, :active] /= most
                    scale[:active] += np.log(most)
        last = ring[sizes % len(ring), np.arange(len(words))]
        return np.log(last + 1e-300) + scale - LIFT * sizes[:, None]

    def expected(self, words: list[bytes], p: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Expected occurrences of each piece in short words, by forward and backward sums."""
        counts = np.zeros_like(p)
        lifted = p * np.exp(LIFT * self.length)[:, None]
        order = sorted(range(len(words)), key=lambda k: -len(words[k]))
        per_group = max(1, WORD_BYTES // SAMPLE_PART)
        for group in (order[k : k + per_group] for k in range(0, len(order), per_group)):
            sizes = np.array([len(words[k]) for k in group])
            word, start, end, piece = self.edges([words[k] for k in group])
            alpha = np.zeros((int(sizes[0]) + 1, len(group), p.shape[1]))
            beta = np.zeros_like(alpha)
            alpha[0], beta[sizes, np.arange(len(group))] = 1, 1
            # every byte is a piece, so each word has an edge to each of its places and from each
            for low, high in pairwise(np.searchsorted(end, np.arange(1, int(sizes[0]) + 2)).tolist()):
                part = alpha[start[low:high], word[low:high]] * lifted[piece[low:high]]
                active = int(word[high - 1]) + 1
                alpha[end[low], :active] = np.add.reduceat(part, np.searchsorted(word[low:high], np.arange(active)), axis=0)
            back = np.lexsort((word, -start))
            word, start, end, piece = word[back], start[back], end[back], piece[back]
            for low, high in pairwise(np.searchsorted(-start, np.arange(1 - int(sizes[0]), 2)).tolist()):
                part = beta[end[low:high], word[low:high]] * lifted[piece[low:high]]
                active = int(word[high - 1]) + 1
                beta[start[low], :active] = np.add.reduceat(part, np.searchsorted(word[low:high], np.arange(active)), axis=0)
            share = weight[group] / (alpha[sizes, np.arange(len(group))] + 1e-300)
            times = alpha[start, word] * lifted[piece] * beta[end, word] * share[word]
            for k in range(p.shape[1]):
                counts[:, k] += np.bincount(piece, weights=times[:, k], minlength=len(counts))
        return counts


@dataclass
class Model:
    languages: tuple[str, ...]
    vocabulary: list[bytes]
    p: np.ndarray  #: piece by language

    def __post_init__(self):
        self.lattice = Lattice(self.vocabulary)
        self.known: dict[str, np.ndarray] = {}

    def score(self, words: list[str]) -> np.ndarray:
        """Log-probability of each word in each language; 0 for identifiers."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        out = np.zeros((len(words), len(self.languages)))
        new, texts = [], []
        for k, word in enumerate(words):
            score = self.known.get(word)
            if score is not None:
                out[k] = score
                continue
            text = spelled(word)
            if text:
                new.append(k)
                texts.append(text)
        if new:
            out[new] = self.lattice.forward(texts, self.p)
            for k, text in zip(new, texts):
                if len(text) <= REMEMBERED_BYTES:
                    self.known[words[k]] = out[k].copy()
        return out

    def paragraphs(self, found: Prose) -> np.ndarray:
        """Log-probability of each paragraph in each language."""
        scores = self.score(found.words)
        out = np.empty((len(found.record), len(self.languages)))
        for k in range(out.shape[1]):
            out[:, k] = np.bincount(found.paragraph, weights=scores[found.code, k], minlength=len(found.record))
        return out

    def __getstate__(self):
        return (self.languages, self.vocabulary, self.p)

    def __setstate__(self, state):
        self.languages, self.vocabulary, self.p = state
        self.__post_init__()


def fit(texts: list[str], labels: list[str], languages: tuple[str, ...] = LANGUAGES, path: str = VOCABULARY) -> Model:
    """Fit on labelled texts; labels may be wrong at times."""
    vocabulary = read_vocabulary(path)
    place = {c: k for k, c in enumerate(languages)}
    found = prose(pa.array(texts, pa.large_string()))
    label = np.array([place[c] for c in labels], np.int64)[found.record] if len(found.record) else np.zeros(0, np.int64)
    cut = [parts(spelled(w)) for w in found.words]
    flat = sorted({x for c in cut for x in c})
    spot = {x: k for k, x in enumerate(flat)}
    model = Model(tuple(languages), vocabulary, np.full((len(vocabulary), len(languages)), 1 / len(vocabulary)))
    for again in range(RELABEL_ROUNDS + 1):
        if again:
            label = model.paragraphs(found).argmax(axis=1)
        weight = np.zeros((len(flat), len(languages)))
        pairs, times = np.unique(label[found.paragraph] * max(1, len(found.words)) + found.code, return_counts=True)
        for pair, n in zip(pairs.tolist(), times.tolist()):
            language, word = divmod(pair, len(found.words))
            for x in cut[word]:
                weight[spot[x], language] += n
        for _ in range(EM_ROUNDS):
            counts = model.lattice.expected(flat, model.p, weight) + SMOOTHING
            model.p = counts / counts.sum(axis=0)
        model.known.clear()
    return model


def labelled_sample(df: DataFrame, text: str, lang: str, id_column: str, documents: int = SAMPLE_DOCUMENTS) -> DataFrame:
    """At most ``documents`` texts of each label, those of the least hash of their id. Only ids
    and hashes are ranked; the texts chosen, a bounded number, are fetched where they lie."""
    labelled = df.select(F.col(id_column).alias("_id"), label_code(F.col(lang)).alias("label"), F.xxhash64(id_column).alias("_h"), F.xxhash64(text).alias("_t"), F.col(text).alias("text"))
    usable = labelled.filter("_id is not null and label is not null and text is not null and length(text) between 1 and 20000")
    keys = ["_id", "label", "_h", "_t"]
    window = Window.partitionBy("label").orderBy("_h", "_id", "_t")
    chosen = usable.select(keys).distinct().withColumn("_k", F.row_number().over(window)).filter(F.col("_k") <= documents).drop("_k")
    return usable.join(F.broadcast(chosen), keys, "left_semi").dropDuplicates(keys).select("text", "label")  # documents of each of LANGUAGES


def fit_on(df: DataFrame, text: str, lang: str, id_column: str, languages: tuple[str, ...] = LANGUAGES, path: str = VOCABULARY) -> Model:
    rows = sorted(labelled_sample(df, text, lang, id_column).filter(F.col("label").isin(*languages)).collect())
    return fit([r["text"] for r in rows], [r["label"] for r in rows], languages, path)


SEGMENT_SCHEMA = "id bigint, segment_no int, first_paragraph int, last_paragraph int, words int, lang_code string, confidence double"


def segments_of(model: Model, found: Prose) -> list[np.ndarray]:
    """Per segment: record, first and last paragraph, words, language, confidence.

    A paragraph takes the language of most of its text unless another one is better by
    ``MARGIN``; neighbours of one language form a segment. A paragraph of identifiers only
    has no language. Confidence is the posterior probability of a segment's language, all
    being equally likely at first; as words of one text depend on each other, n words
    count as their square root.
    """
    logs = model.paragraphs(found)
    natural = np.array([not _IDENTIFIER.search(w) for w in found.words])
    words = np.bincount(found.paragraph, weights=natural[found.code], minlength=len(found.record)).astype(np.int64)
    use = np.flatnonzero(words > 0)
    if not len(use):
        return [np.zeros(0)] * 6
    record, number, logs, words = found.record[use], found.number[use], logs[use], words[use]
    best = logs.argmax(axis=1)
    # the language of most words of each text, among the paragraphs' own best
    votes = np.zeros((record.max() + 1, len(model.languages)))
    np.add.at(votes, (record, best), words)
    main = votes.argmax(axis=1)[record]
    row = np.arange(len(use))
    best = np.where(logs[row, best] - logs[row, main] > MARGIN, best, main)
    starts = np.flatnonzero(np.append(True, (record[1:] != record[:-1]) | (best[1:] != best[:-1])))
    total = np.add.reduceat(logs, starts, axis=0) / np.sqrt(np.add.reduceat(words, starts))[:, None]
    total -= total.max(axis=1, keepdims=True)
    posterior = np.exp(total) / np.exp(total).sum(axis=1, keepdims=True)
    last = np.append(starts[1:], len(use)) - 1
    language = best[starts]
    return [record[starts], number[starts], number[last], np.add.reduceat(words, starts), language, posterior[np.arange(len(starts)), language]]


def language_segments(df: DataFrame, id_column: str, text: str, model: Model) -> DataFrame:
    """Each run of paragraphs of one language, with its confidence.

    ``segment_no`` counts from 0 in the text; paragraphs are counted among those with
    words. Null, empty and blank texts, and texts without prose, yield nothing. Texts are
    taken whole; nothing is shuffled. Other columns are not read.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)  # vocabulary times languages, a fixed size

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                record, first, last, words, language, confidence = segments_of(model, prose(batch.column(1)))
                if not len(record):
                    continue
                number = np.arange(len(record)) - np.searchsorted(record, record)
                names = pa.array(model.languages).take(pa.array(language))
                columns = [batch.column(0).take(pa.array(record)), *(pa.array(x.astype(np.int32)) for x in (number, first, last, words)), names, pa.array(confidence)]
                yield pa.record_batch(columns, names=["id", "segment_no", "first_paragraph", "last_paragraph", "words", "lang_code", "confidence"])

    source = df.select(F.col(id_column).cast("bigint").alias("id"), F.col(text).alias("text")).filter("text is not null")
    return source.mapInArrow(label, SEGMENT_SCHEMA)

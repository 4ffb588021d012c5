"""Packing paragraphs into chunks under a token limit."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions.text import strip

MAX_TOKENS = 1200
CHARS_PER_TOKEN = 4


@dataclass(frozen=True)
class Counter:
    """Sizes of texts: ``one`` of a string column, ``many`` of an array of strings. A counter
    in SQL needs only the first; a Python function can't run inside ``transform``."""

    one: Callable[[Column], Column]
    many: Callable[[Column], Column]

    @classmethod
    def of(cls, one: Callable[[Column], Column]) -> Counter:
        return cls(one, lambda texts: F.transform(texts, one))


#: An estimate that needs no vocabulary: four characters a token.
by_chars = Counter.of(lambda text: F.ceil(F.length(text) / CHARS_PER_TOKEN).cast("int"))
by_words = Counter.of(lambda text: F.size(F.filter(F.split(text, r"(?U)[\s\x1c-\x1f]+"), lambda w: w != "")))


def greedy(text: Column, limit: int, counter: Counter, separator: str = "\n\n") -> Column:
    """Paragraphs put together while their counts (separators not counted) stay within the
    limit; a paragraph above it stays whole."""
    paragraphs = F.split(text, separator.replace("\n", "\\n"))
    # the state holds where chunks begin, not their text, so that no step copies paragraphs
    none = F.struct(paragraphs.alias("p"), F.array().cast("array<int>").alias("starts"), F.lit(0).alias("k"), F.lit(0).alias("n"))

    def add(s: Column, n: Column) -> Column:
        opens = (F.size(s["starts"]) == 0) | (s["n"] + n > limit)
        starts = F.when(opens, F.array_append(s["starts"], s["k"])).otherwise(s["starts"])
        return F.struct(s["p"].alias("p"), starts.alias("starts"), (s["k"] + 1).alias("k"), F.when(opens, n).otherwise(s["n"] + n).alias("n"))

    def join(s: Column) -> Column:
        end = lambda i: F.coalesce(F.get(s["starts"], i + 1), s["k"])
        return F.transform(s["starts"], lambda start, i: F.concat_ws(separator, F.slice(s["p"], start + 1, end(i) - start)))

    return F.aggregate(F.transform(counter.many(paragraphs), lambda n: n.cast("int")), none, add, join)


def chunk_markdown(text: Column, limit: int = MAX_TOKENS, counter: Counter = by_chars, separator: str = "\n\n") -> Column:
    """What fits is one stripped chunk, even if empty; else stripped chunks without empty ones."""
    text = F.coalesce(text, F.lit(""))
    packed = F.filter(F.transform(greedy(text, limit, counter, separator), strip), lambda c: c != "")
    return F.when(counter.one(text) <= limit, F.array(strip(text))).otherwise(packed)


def chunk_text(text: Column, limit: int = MAX_TOKENS, counter: Counter = by_chars, separator: str = "\n\n") -> Column:
    """Null and empty give none, what fits is left as it is, else chunks that aren't stripped."""
    none = F.array().cast("array<string>")
    return F.when(F.coalesce(text, F.lit("")) == "", none).when(counter.one(text) <= limit, F.array(text)).otherwise(greedy(text, limit, counter, separator))


def slices(text: Column, limit: int = MAX_TOKENS) -> Column:
    """Fixed slices of four characters a token, for texts that can't be counted."""
    width = limit * CHARS_PER_TOKEN
    count = F.ceil(F.length(text) / width).cast("int")
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.substring(text, k * width + 1, F.lit(width)))
    )

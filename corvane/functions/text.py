"""Text functions as column expressions.

Spark's regular expressions are Java's. ``WS`` is the class that equals Python's ``\\s``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"[\s\x1c-\x1f]"
#: the same, within a line
BLANK = r"[\s\x1c-\x1f&&[^\n]]"

# Patterns and limits that results depend on.
TOKEN = "[a-z0-9_#-]{2,}"
FENCE = "(?s)`{3,}.*?`{3,}"
PIPE_ROW = rf"(?mdU)^{WS}*\|.*\|{WS}*$"
NUMBER_BURST = rf"(?U)(?:^|{WS})(?:\d{{1,4}}{WS}+){{5,}}\d{{1,4}}(?={WS}|\z)"
SNIPPET_LENGTH = 420
LEAD_LENGTH = 800
SNIPPET_BEFORE, SNIPPET_AFTER = 120, 200
SECTION_LENGTH = 4000
TEXT_MARKER = "\n\n[... truncated ...]"
HTML_MARKER = "\n<!-- ... truncated ... -->"


def strip(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, rf"(?U)^{WS}+", ""), rf"(?U){WS}+\z", "")


def collapse(c: Column) -> Column:
    """Each run of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, rf"(?U){WS}+", " "))


def tokenize(c: Column) -> Column:
    """Runs of ``a-z 0-9 _ # -`` in lower-cased text, of two characters or more; null as none.

    One pass of matches; splitting at the other characters and filtering by length gives
    the same at six times the cost.
    """
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(TOKEN), F.lit(0))


def count_tokens(c: Column) -> Column:
    return F.regexp_count(F.lower(F.coalesce(c, F.lit(""))), F.lit(TOKEN))


def without_noise(c: Column) -> Column:
    """Drop fenced blocks, pipe-table rows and bursts of line numbers; white space collapsed."""
    for pattern in (FENCE, PIPE_ROW, NUMBER_BURST):
        c = F.regexp_replace(c, pattern, " ")
    return collapse(F.translate(c, "|`", "  "))


def clean_snippet(c: Column) -> Column:
    return F.substring(without_noise(c), 1, SNIPPET_LENGTH)


def snippet(text: Column, needle: Column, one_line: bool = False) -> Column:
    """A window around the first occurrence of ``needle`` in the lower-cased text, else the
    beginning. ``one_line``: line feeds of the window become blanks before it is cleaned."""
    text = F.coalesce(text, F.lit(""))
    at = F.when(needle == "", 0).otherwise(F.instr(F.lower(text), needle))
    start = F.greatest(at - 1 - SNIPPET_BEFORE, F.lit(0))
    window = F.substring(text, start + 1, at - 1 + SNIPPET_AFTER - start)
    if one_line:
        window = F.translate(window, "\n", " ")
    return clean_snippet(F.when(at > 0, window).otherwise(F.substring(text, 1, LEAD_LENGTH)))


def substring_count(c: Column, needle: str) -> Column:
    """Non-overlapping occurrences; of an empty needle one more than there are characters."""
    if needle == "":
        return F.length(c) + 1
    return ((F.length(c) - F.length(F.replace(c, F.lit(needle), F.lit("")))) / len(needle)).cast("int")


def normalize_text(c: Column) -> Column:
    """Tidy lines: no CR or NUL, no empty headings, dividers and quotes, single blanks,
    one blank line at most between lines. Null gives ''."""
    c = strip(F.coalesce(c, F.lit("")))
    c = F.regexp_replace(c, "[\r\x00]", "")
    for mark in ("#+", "[-*_]+", ">"):
        c = F.regexp_replace(c, rf"(?mdU)^{WS}*{mark}{WS}*$", "")
    lines = F.transform(F.split(c, "\n"), collapse)
    kept = F.concat_ws("\n", lines)
    return strip(F.regexp_replace(kept, "\n{3,}", "\n\n"))


def drop_admonitions(doc: Column) -> Column:
    """Leave out `!!!` and `???` blocks (with what follows blank or indented), keep at most
    two blank lines together, strip. Possessive, so that long blocks are matched in one
    pass; null gives ''."""
    blank = f"{BLANK}*+"
    line, end = "[^\n]*+", "(?![^\n])"
    block = rf"(?U)(?:\A|\n){blank}(?:!!!|\?\?\?){line}(?:\n(?:(?: {{4}}|\t){line}|{blank}{end}))*+"
    kept = F.regexp_replace(F.coalesce(doc, F.lit("")), block, "")
    return strip(F.regexp_replace(kept, "\n{4,}", "\n\n\n"))


def slug(c: Column) -> Column:
    kept = F.regexp_replace(F.lower(c), rf"(?U)[^\p{{L}}\p{{N}}_\s\x1c-\x1f-]", "")
    return F.regexp_replace(kept, rf"(?U)[-\s\x1c-\x1f]+", "-")


_HEADING = rf"(?dU)^(#{{1,6}}){WS}+(.+)$"


def heading_info(line: Column) -> Column:
    """struct(level, title, anchor) of a Markdown heading line, else (0, '', '')."""
    marks, title = F.regexp_extract(line, _HEADING, 1), F.regexp_extract(line, _HEADING, 2)
    title = strip(title)
    return F.struct(F.length(marks).alias("level"), title.alias("title"), slug(title).alias("anchor"))


def truncated(c: Column, limit: int | None, marker: str) -> Column:
    """The first ``limit`` characters and the marker where there are more; no limit if it
    is null, zero or negative."""
    if not limit or limit <= 0:
        return c
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit(marker))).otherwise(c)

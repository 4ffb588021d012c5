"""HTML functions for columns: Arrow-batched UDFs around the tree of ``htmldom``."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.functions import htmldom
from corvane.functions.text import SECTION_LENGTH, without_noise

SECTIONS = T.ArrayType(
    T.StructType([T.StructField("anchor", T.StringType()), T.StructField("title", T.StringType()), T.StructField("level", T.IntegerType()), T.StructField("markdown", T.StringType())])
)
HEADINGS = T.ArrayType(T.StructType([T.StructField("anchor", T.StringType()), T.StructField("title", T.StringType())]))


def _text(html: str | None, separator: str) -> str:
    return htmldom.parse(html).text(separator)


@F.pandas_udf(T.StringType())
def text_by_line(html: pd.Series) -> pd.Series:
    """All text, pieces joined by line feeds; null gives ''."""
    return html.map(lambda h: _text(h, "\n"))


@F.pandas_udf(T.StringType())
def text_by_blank(html: pd.Series) -> pd.Series:
    return html.map(lambda h: _text(h, " "))


@F.pandas_udf(T.StringType())
def main_text(html: pd.Series) -> pd.Series:
    """Text of the main content without boilerplate."""
    return html.map(lambda h: htmldom.without_boilerplate(htmldom.parse(h)).text("\n"))


@F.pandas_udf(SECTIONS)
def _sections(html: pd.Series) -> pd.Series:
    def cut(h: str | None) -> list[dict]:
        found = htmldom.sections(htmldom.without_boilerplate(htmldom.parse(h)))
        return [{"anchor": a, "title": t, "level": n, "markdown": htmldom.markdown(c)} for a, t, n, c in found]

    return html.map(cut)


def sections(html: Column) -> Column:
    """array of struct(anchor, title, level, markdown) of the main content. The Markdown is
    cleaned: fenced code, table rows and bursts of numbers are gone, all in one line."""
    clean = lambda s: F.struct(s["anchor"].alias("anchor"), s["title"].alias("title"), s["level"].alias("level"), without_noise(s["markdown"]).alias("markdown"))
    return F.transform(_sections(html), clean)


@F.pandas_udf(T.StringType())
def _page_markdown(html: pd.Series) -> pd.Series:
    return html.map(lambda h: htmldom.markdown(htmldom.without_boilerplate(htmldom.parse(h)).children))


def page_markdown(html: Column) -> Column:
    """The main content as one line of cleaned Markdown."""
    return without_noise(_page_markdown(html))


@F.pandas_udf(HEADINGS)
def headings(html: pd.Series) -> pd.Series:
    return html.map(lambda h: [{"anchor": a, "title": t} for a, t in htmldom.headings(htmldom.parse(h))])


@F.pandas_udf(T.StringType())
def _section_text(html: pd.Series, anchor: pd.Series) -> pd.Series:
    return pd.Series([htmldom.section_text(htmldom.parse(h), a) if a else "" for h, a in zip(html, anchor)], dtype=object)


def section_text(html: Column, anchor: Column) -> Column:
    """The first 4,000 characters of a section; '' if there is none."""
    return F.substring(_section_text(html, anchor), 1, SECTION_LENGTH)


@F.pandas_udf(T.StringType())
def decode_lossy(content: pd.Series) -> pd.Series:
    """UTF-8 with invalid bytes dropped."""
    return content.map(lambda b: None if b is None else bytes(b).decode("utf-8", "ignore"))


@F.pandas_udf(T.StringType())
def decode_strict(content: pd.Series) -> pd.Series:
    """UTF-8, null where a byte is invalid."""

    def decode(b: bytes | None) -> str | None:
        try:
            return None if b is None else bytes(b).decode("utf-8")
        except UnicodeDecodeError:
            return None

    return content.map(decode)

"""Retrieval of pages, sections and API pages from ``pages(site, rel, html)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.html import section_text, text_by_line
from corvane.functions.text import HTML_MARKER, SECTION_LENGTH, TEXT_MARKER, normalize_text, truncated
from corvane.functions.urls import api_address, page_file
from corvane.schema import Sites


def page_views(pages: DataFrame, sites: Sites, max_chars: int | None = None) -> DataFrame:
    """``url, path, text, html, truncated, text_length, html_length, max_chars`` of each page.

    Lengths are those before the cut. A limit that is null, zero or negative cuts nothing.
    """
    text, html = F.col("_text"), F.coalesce("html", F.lit(""))
    limit = max_chars if max_chars and max_chars > 0 else None
    over = (F.length(text) > limit) | (F.length(html) > limit) if limit else F.lit(False)
    return pages.withColumn("_text", normalize_text(text_by_line("html"))).select(
        sites.display_url(F.col("site"), F.col("rel")).alias("url"), F.col("rel").alias("path"), truncated(text, limit, TEXT_MARKER).alias("text"),
        truncated(html, limit, HTML_MARKER).alias("html"), over.alias("truncated"), F.length(text).alias("text_length"), F.length(html).alias("html_length"), F.lit(max_chars).cast("int").alias("max_chars"),
    )


def section_views(pages: DataFrame, sites: Sites, anchor: Column) -> DataFrame:
    """``url, path, anchor, section, truncated``; a section of just the limit counts as cut."""
    found = pages.select("site", "rel", anchor.alias("anchor"), section_text(F.col("html"), anchor).alias("section"))
    url = F.concat(sites.display_url(F.col("site"), F.col("rel")), F.lit("#"), F.col("anchor"))
    return found.select(url.alias("url"), F.col("rel").alias("path"), "anchor", "section", (F.length("section") >= SECTION_LENGTH).alias("truncated"))


def api_views(pages: DataFrame, sites: Sites, symbols: DataFrame, anchor: Column | None = None, aliases: dict[str, str] | None = None) -> DataFrame:
    """``symbol, url, text, section`` of the page that documents each symbol, on the first
    site; the whole text as it is, or the section if an anchor is given.

    ``symbols`` has the column symbol and may have ``address``, the page of each; where that
    is missing or null it follows from ``aliases``. The url is the address as it is, and
    the anchor if there is one. A page is parsed once, however many symbols it documents.
    Text and section of a symbol whose page is missing are null.
    """
    given = F.col("address") if "address" in symbols.columns else F.lit(None).cast("string")
    wanted = symbols.select("symbol", F.coalesce(given, api_address(F.col("symbol"), aliases)).alias("address"))
    wanted = wanted.withColumn("rel", page_file(F.col("address")))
    first = pages.filter(F.col("site") == sites.first.name).select("rel", "html")
    none = F.lit(None).cast("string")
    used = first.join(wanted.select("rel").distinct(), "rel", "left_semi")
    parsed = used.select("rel", (text_by_line("html") if anchor is None else none).alias("text"), (none if anchor is None else section_text(F.col("html"), anchor)).alias("section"))
    base = sites.display_url(F.lit(sites.first.name), F.col("address"))
    url = base if anchor is None else F.concat(base, F.lit("#"), anchor)
    return wanted.join(parsed, "rel", "left").select("symbol", url.alias("url"), "text", "section")

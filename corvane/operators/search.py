"""The whole search: rank three times as many as asked for, then filter, then cut."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.text import snippet
from corvane.operators.index import Index
from corvane.operators.rank import best_records, fetch, query_tokens, substring_top
from corvane.schema import Sites

DEFAULT_K, MOST_K, OVERSAMPLE = 10, 50, 3


def clamp_k(k: object) -> int:
    try:
        return max(1, min(MOST_K, int(k)))  # type: ignore[call-overload]
    except (TypeError, ValueError):
        return DEFAULT_K


def bm25_hits(index: Index, query: str, k: int, sites: Sites) -> DataFrame:
    """Best records with display url and snippet; records are fetched after the cut."""
    top = best_records(index, query, k)
    needle = F.lit(" ".join(query_tokens(query)))
    return fetch(index, top).select(
        "ord", "score", "title", sites.display_url(F.col("source_site"), F.col("page")).alias("url"), "anchor",
        snippet(F.col("md_text"), needle).alias("snippet"), F.lit(None).cast("string").alias("heading_title"), "page", "source_site",
    )


def substring_hits(records: DataFrame, query: str, k: int, sites: Sites) -> DataFrame:
    top = substring_top(records, query, k)
    return top.select(
        "ord", F.col("score").cast("double").alias("score"), "title", sites.display_url(F.col("source_site"), F.col("page")).alias("url"), F.lit(None).cast("string").alias("anchor"),
        snippet(F.col("md_text"), F.lit(query.lower()), one_line=True).alias("snippet"), F.lit(None).cast("string").alias("heading_title"), "page", "source_site",
    )


def site_filter(hits: DataFrame, site: str | None, sites: Sites) -> DataFrame:
    """By the display url; an unknown site filters nothing."""
    known = sites.named(site) if site else None
    return hits.filter(F.col("url").startswith(known.local_base)) if known else hits


def heading_filter(hits: DataFrame, heading: str | None, headings: DataFrame | None = None) -> DataFrame:
    """By a part of the snippet or, given ``headings`` (page, pos, title), by the page's first
    heading that contains it, which becomes ``heading_title``."""
    if not heading:
        return hits
    part = heading.lower()
    found: Column = F.lower("snippet").contains(part)
    if headings is None:
        return hits.filter(found)
    first = headings.filter(F.lower("title").contains(part)).groupBy("page").agg(F.min_by("title", "pos").alias("_heading"))
    hits = hits.join(first, "page", "left").withColumn("heading_title", F.col("_heading"))
    return hits.filter(found | F.col("_heading").isNotNull()).drop("_heading")


def keyword_filter(hits: DataFrame, keywords: str | None) -> DataFrame:
    """Every word must be a part of title and snippet, case ignored."""
    for word in (keywords or "").lower().split():
        hits = hits.filter(F.lower(F.concat_ws(" ", "title", "snippet")).contains(word))
    return hits


def search(
    source: Index | DataFrame, query: str, sites: Sites, k: object = DEFAULT_K, site: str | None = None, heading: str | None = None, keywords: str | None = None, headings: DataFrame | None = None
) -> DataFrame:
    """``ord, score, title, url, anchor, snippet, heading_title`` of the best hits.

    With an index the ranking is BM25, with plain records the substring fallback. The
    filters apply to the best ``3 k`` only, so there can be fewer than ``k`` hits though
    more records match; they are never pushed below that cut.
    """
    k = clamp_k(k)
    hits = bm25_hits(source, query, OVERSAMPLE * k, sites) if isinstance(source, Index) else substring_hits(source, query, OVERSAMPLE * k, sites)
    hits = keyword_filter(heading_filter(site_filter(hits, site, sites), heading, None if isinstance(source, Index) else headings), keywords)
    return hits.orderBy(F.desc("score"), "ord").limit(k).select("ord", "score", "title", "url", "anchor", "snippet", "heading_title")

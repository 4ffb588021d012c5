"""Records of HTML pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.html import page_markdown, sections
from corvane.functions.urls import with_anchor
from corvane.operators.chunking import MAX_TOKENS, Counter, by_chars, chunk_markdown


def html_records(pages: DataFrame, base_url: Column | str, max_tokens: int = MAX_TOKENS, counter: Counter = by_chars, separator: str = "\n\n") -> DataFrame:
    """Records of ``(path, text, source_site)``, ordered by ``path, pos, part``; an empty
    section gives one record with an empty text. Null pages count as empty."""
    base = F.rtrim(F.lit(base_url) if isinstance(base_url, str) else base_url, F.lit("/"))
    cut = pages.select("path", "source_site", F.posexplode(sections(F.col("text"))).alias("pos", "s"))
    parts = cut.select("path", "source_site", "pos", "s", F.posexplode(chunk_markdown(F.col("s.markdown"), max_tokens, counter, separator)).alias("part", "md_text"))
    last = F.element_at(F.split("path", "/"), -1)
    title = F.when(F.col("s.title") != "", F.col("s.title")).when(last != "", last).otherwise("index")
    return parts.select(
        "path", "pos", "part", title.alias("title"), F.col("s.anchor").alias("anchor"), F.col("s.level").alias("heading_level"), "md_text",
        with_anchor(F.concat(base, F.lit("/"), F.col("path")), F.col("s.anchor")).alias("url"), F.col("path").alias("page"), "source_site",
    )


def markdown_snapshots(pages: DataFrame) -> DataFrame:
    """``name, markdown``: the main content of each page, named by site and path."""
    name = F.concat("source_site", F.lit("-"), F.regexp_replace(F.translate("path", "/", "_"), r"\.html$", ""), F.lit(".md"))
    return pages.select(name.alias("name"), page_markdown(F.col("text")).alias("markdown"))

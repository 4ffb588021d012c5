"""Markdown texts cut into sections at their headings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.text import heading_info, strip
from corvane.functions.urls import api_url, docstring_page, markdown_page, markdown_url, with_anchor
from corvane.operators.chunking import MAX_TOKENS, Counter, by_chars, chunk_text

_SPACE = r"[\s\x1c-\x1f&&[^\n]]"
#: Before each heading line. A heading inside a code fence counts like any other.
BEFORE_HEADING = rf"(?mdU)(?=^#{{1,6}}{_SPACE}+[^\n])"


def sections(text: Column) -> Column:
    """array of struct(level, title, anchor, body). Text before the first heading has level
    0 and no anchor; the heading's line isn't part of the body. Blank bodies are dropped."""
    pieces = F.split(F.coalesce(text, F.lit("")), BEFORE_HEADING)

    def cut(piece: Column) -> Column:
        line = F.substring_index(piece, "\n", 1)
        info = heading_info(line)
        headed = info["level"] > 0
        body = F.when(headed, F.substring(piece, F.length(line) + 2, F.length(piece))).otherwise(piece)
        return F.struct(
            info["level"].alias("level"),
            F.when(headed, info["title"]).alias("title"),
            F.when(headed, info["anchor"]).alias("anchor"),
            strip(body).alias("body"),
        )

    return F.filter(F.transform(pieces, cut), lambda s: s["body"] != "")


def markdown_records(files: DataFrame, base_url: Column | str, max_tokens: int = MAX_TOKENS, counter: Counter = by_chars) -> DataFrame:
    """Records of Markdown files ``(path, text, source_site)``, ordered by ``path, pos, part``.

    Nothing is shuffled: a text is cut inside its row. Null texts yield nothing. The title
    is the heading, else the file's stem.
    """
    page = markdown_page(F.col("path"))
    stem = F.regexp_extract("path", r"([^/]*?)(\.[^./]*)?$", 1)
    cut = files.select("path", "text", "source_site").filter("text is not null").select("*", F.posexplode(sections(F.col("text"))).alias("pos", "s"))
    parts = cut.select("path", "source_site", "pos", "s", F.posexplode(chunk_text(F.col("s.body"), max_tokens, counter)).alias("part", "md_text"))
    return parts.select(
        "path", "pos", "part",
        F.when(F.coalesce("s.title", F.lit("")) != "", F.col("s.title")).otherwise(stem).alias("title"),
        F.col("s.anchor").alias("anchor"), F.col("s.level").cast("int").alias("heading_level"), "md_text",
        with_anchor(markdown_url(page, base_url), F.col("s.anchor")).alias("url"), page.alias("page"), "source_site",
    )


def docstring_records(symbols: DataFrame, base_url: Column | str, max_tokens: int = MAX_TOKENS, counter: Counter = by_chars) -> DataFrame:
    """Records of documented symbols ``(path, symbol_name, doc, walk_order, source_site)``;
    ``doc`` is free of admonitions, and symbols whose ``doc`` is empty are dropped."""
    anchor = F.replace(F.lower(F.col("symbol_name")), F.lit("."), F.lit("-"))
    parts = symbols.filter("doc <> ''").select("*", F.posexplode(chunk_text(F.col("doc"), max_tokens, counter)).alias("part", "md_text"))
    return parts.select(
        "path", F.col("walk_order").alias("pos"), "part", F.col("symbol_name").alias("title"), anchor.alias("anchor"), F.lit(0).alias("heading_level"),
        "md_text", with_anchor(api_url(F.col("symbol_name"), base_url), anchor).alias("url"), docstring_page(F.col("path")).alias("page"), "source_site",
    )


def union_records(branches: list[DataFrame]) -> DataFrame:
    """Bag union of record branches; ``branch`` keeps their order. Nothing is deduplicated."""
    out = branches[0].withColumn("branch", F.lit(0))
    for k, df in enumerate(branches[1:], 1):
        out = out.unionByName(df.withColumn("branch", F.lit(k)))
    return out

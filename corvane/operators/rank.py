"""Ranking: BM25, many queries at once, and substring counts."""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.text import TOKEN, substring_count, tokenize
from corvane.operators.batch import scored_blocks
from corvane.operators.checked import join_measured, join_weighted
from corvane.operators.index import B, K1, Index
from corvane.sources.shared import materialize

#: Postings that a task of ``bm25_many`` holds, about (some 100 bytes each).
BLOCK_POSTINGS = 2_000_000
#: One of so many blocks comes first, if there are more than two for each core.
EARLY = 16
#: Terms of all distinct queries that are sent to the tasks at once, about (some 20 bytes each).
ENTRIES_AT_ONCE = 2_000_000
#: Records from which on a term is common.
COMMON = 10_000


def query_tokens(query: str) -> list[str]:
    """The tokens of a query text, as ``tokenize`` cuts records."""
    return re.findall(TOKEN, query.lower())


def weight(tf: Column, dl: Column, avgdl: float) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def any_of(column: str, values: list) -> Column:
    """Equal to one of a few values, as equalities: unlike a long IN list these all reach
    the Parquet scan, where row groups without any of the values are skipped."""
    return reduce(lambda a, b: a | b, [F.col(column) == F.lit(v) for v in values], F.lit(False))


def bm25_scores(index: Index, query: str) -> DataFrame:
    """``ord, score`` of the records that hold a token of the query; repeated tokens count
    again. Only the postings of these tokens are read, whose weights come first."""
    times = Counter(query_tokens(query))
    known = index.terms.filter(any_of("term", list(times))).select("term", "idf").collect() if times else []  # one row a token of the query
    weights = {r["term"]: r["idf"] * times[r["term"]] for r in known}
    w = F.create_map(*[F.lit(x) for t in weights.items() for x in t])[F.col("term")] if weights else F.lit(0.0)
    hit = index.postings.filter(any_of("term", list(weights)))
    return hit.groupBy("ord").agg(F.round(F.sum(w * weight(F.col("tf"), F.col("dl"), index.avgdl)), 6).alias("score"))


def best_records(index: Index, query: str, k: int) -> list[tuple]:
    """(ord, score) of the ``k`` best records, ties by ``ord``.

    Records without any token of the query score 0 and fill up what is missing; the other
    records are looked at only where fewer than ``k`` score more than that.
    """
    order = [F.desc("score"), F.asc("ord")]
    top = bm25_scores(index, query).orderBy(*order).limit(max(0, k)).collect() if query_tokens(query) else []
    if len(top) < k or any(r["score"] <= 0 for r in top):
        scored = index.docs.select("ord").join(bm25_scores(index, query), "ord", "left").select("ord", F.coalesce("score", F.lit(0.0)).alias("score"))
        top = scored.orderBy(*order).limit(max(0, k)).collect()
    return [(r["ord"], r["score"]) for r in top]


def bm25_top(index: Index, query: str, k: int = 10) -> DataFrame:
    """``ord, score`` of the ``k`` best records, which come to the driver."""
    return _as_frame(index, best_records(index, query, k))


def _as_frame(index: Index, top: list[tuple]) -> DataFrame:
    return index.records.sparkSession.createDataFrame(top, f"ord {index.records.schema['ord'].dataType.simpleString()}, score double").coalesce(1)


def fetch(index: Index, top: list[tuple]) -> DataFrame:
    """The records of a ranking of a few rows (ord, score), with their scores."""
    return index.records.filter(any_of("ord", [r[0] for r in top])).join(F.broadcast(_as_frame(index, top)), "ord")


def bm25_many(index: Index, queries: DataFrame, k: int = 10, key: str = "query_id", text: str = "text") -> DataFrame:
    """``query_id, rank, ord, score`` of the ``k`` best records of each query that hold one
    of its tokens. Queries without tokens yield nothing.

    Queries of the same tokens are answered once. The postings of all their terms are dealt out
    by record, so that a task has all of some records and keeps only its ``k`` best of each
    query; pairs of query and record are neither shuffled nor written. Where there are many
    blocks, a few of them come first and tell what score a record must have in the others.
    """
    tokens = queries.select(F.col(key).alias("query_id"), F.explode(tokenize(F.col(text))).alias("term"))
    asked = tokens.groupBy("query_id", "term").agg(F.count("*").alias("times")).join(index.terms, "term")
    asked = materialize(asked.select("query_id", "term", "df", (F.col("times") * F.col("idf")).alias("w")), "asked")
    terms = materialize(asked.select("term", "df").distinct().withColumn("term_no", F.monotonically_increasing_id()), "asked-terms")
    n_terms, n_postings = terms.agg(F.count("*"), F.coalesce(F.sum("df"), F.lit(0))).first()
    numbered = join_weighted(asked.drop("df"), terms, n_terms, ["term"], F.col("df") > COMMON)
    members = materialize(numbered.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct(F.col("term_no").alias("term"), F.col("w").alias("weight")))).alias("terms")), "asked-queries")
    classes = materialize(members.select("terms").distinct().withColumn("query", F.monotonically_increasing_id()), "asked-classes")
    n_classes, n_entries = classes.agg(F.count("*"), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
    members = join_measured(members, classes, n_entries, ["terms"], "inner").select("query_id", "query")

    hit = join_weighted(index.postings, terms, n_terms, ["term"], F.col("df") > COMMON).select("ord", "term_no", "tf", "dl")
    cores = hit.sparkSession.sparkContext.defaultParallelism
    blocks = max(cores, math.ceil(n_postings / BLOCK_POSTINGS))
    passes = max(1, math.ceil(n_entries / ENTRIES_AT_ONCE))
    unknown = classes.withColumn("least", F.lit(None).cast("double"))
    early = max(cores, blocks // EARLY)
    if blocks < 2 * early:
        scored = _in_passes(hit, unknown, passes, blocks, index.avgdl, k)
    else:
        hit = materialize(hit, "asked-postings")
        turn = F.pmod(F.xxhash64("ord"), F.lit(blocks)) < early
        first = materialize(_in_passes(hit.filter(turn), unknown, passes, early, index.avgdl, k), "early")
        least = _best(first, k).filter(F.col("rank") == k).select("query", F.col("score").alias("least"))
        known = materialize(classes.join(least, "query", "left"), "asked-least")
        scored = first.unionByName(_in_passes(hit.filter(~turn), known, passes, blocks - early, index.avgdl, k))
    best = _best(scored, k)
    return join_measured(members, best, n_classes * max(1, k), ["query"], "inner").select("query_id", "rank", "ord", "score")


def _best(scored: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query").orderBy(F.desc("score"), "ord")
    return scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def _in_passes(hit: DataFrame, asked: DataFrame, passes: int, blocks: int, avgdl: float, k: int) -> DataFrame:
    parts = [asked.filter(F.pmod(F.xxhash64("query"), F.lit(passes)) == i) for i in range(passes)]
    return reduce(DataFrame.unionByName, [scored_blocks(hit, part, blocks, avgdl, max(1, k)) for part in parts])


def substring_top(records: DataFrame, query: str, k: int = 10, key: str = "ord", title: str = "title", text: str = "md_text") -> DataFrame:
    """The fallback ranker: three points for each occurrence of the lower-cased query in
    the title, one for each in the text; only positive scores. An empty query is found
    before every character and at the end."""
    needle = query.lower()
    in_title, in_text = (substring_count(F.lower(F.coalesce(F.col(c), F.lit(""))), needle) for c in (title, text))
    scored = records.withColumn("score", (3 * in_title + in_text).cast("bigint")).filter("score > 0")
    return scored.orderBy(F.desc("score"), key).limit(max(0, k))

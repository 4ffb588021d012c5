"""The inverted index: postings, term, record and corpus statistics as tables."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.text import count_tokens
from corvane.functions.tokens import text_slices, token_runs
from corvane.sources.files import delete, exists, list_names, write_marker
from corvane.sources.shared import materialize, shared_path

# The ranking's parameters.
K1, B, EPSILON = 1.5, 0.75, 0.25


@dataclass
class Index:
    """``records`` (ord, ...), ``docs`` (ord, dl), ``postings`` (term, ord, tf, dl), ``terms``
    (term, df, idf); of the corpus the number of records, their average length, the average
    raw idf of all terms."""

    records: DataFrame
    docs: DataFrame
    postings: DataFrame
    terms: DataFrame
    n: int
    avgdl: float
    avg_idf: float


def doc_lengths(records: DataFrame, text: str = "md_text", key: str = "ord") -> DataFrame:
    return records.select(F.col(key).alias("ord"), count_tokens(F.col(text)).alias("dl"))


def term_frequencies(records: DataFrame, text: str = "md_text", key: str = "ord") -> DataFrame:
    """``ord, dl, term, tf``. A record's tokens lie in one row and are counted there, a batch of
    records at once; nothing is shuffled."""
    source = records.select(F.col(key).alias("ord"), F.lower(F.col(text)).alias("_text"))
    kind = source.schema["ord"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, 1):
            tokens = token_runs(batch.column(1))
            words = max(1, len(tokens.dictionary))
            pairs, times = np.unique(tokens.record * words + tokens.code, return_counts=True)
            record = pairs // words
            length = np.bincount(tokens.record, minlength=batch.num_rows).astype(np.int32)
            term = tokens.dictionary.take(pa.array(pairs % words)).cast(pa.string())
            yield pa.record_batch([batch.column(0).take(pa.array(record)), pa.array(length[record]), term, pa.array(times.astype(np.int32))], names=["ord", "dl", "term", "tf"])

    return source.mapInArrow(count, f"ord {kind}, dl int, term string, tf int")


def raw_idf(n, df):
    return F.log(n - df + 0.5) - F.log(df + 0.5)


def weighted_terms(frequencies: DataFrame, n: int, path: str) -> tuple[DataFrame, float]:
    """``term, df, idf`` of ``n`` records, and the average raw idf; written to ``path`` between."""
    terms = frequencies.groupBy("term").agg(F.count("*").alias("df")).withColumn("raw", raw_idf(F.lit(n), F.col("df")))
    terms.write.mode("overwrite").parquet(path)
    raw = frequencies.sparkSession.read.parquet(path)
    avg_idf = raw.agg(F.avg("raw")).first()[0] or 0.0
    idf = F.when(F.col("raw") >= 0, F.col("raw")).otherwise(EPSILON * avg_idf)
    return raw.select("term", "df", idf.alias("idf")), avg_idf


def scan_index(records: DataFrame, text: str = "md_text", key: str = "ord") -> Index:
    """The index for one use that reads all postings: they stay in the order in which records
    are read, and ``records`` and ``docs`` are not stored. No text is shuffled or written."""
    spark = records.sparkSession
    records = records.withColumn("ord", F.col(key)) if key != "ord" else records
    postings = materialize(term_frequencies(records, text).select("term", "ord", "tf", "dl"), "frequencies")
    n, total = records.count(), postings.agg(F.coalesce(F.sum("tf"), F.lit(0))).first()[0]
    terms, avg_idf = weighted_terms(postings, n, shared_path(spark, "raw-terms"))
    return Index(records, doc_lengths(records, text), postings, terms, n, total / n if n else 0.0, float(avg_idf))


def build_index(records: DataFrame, path: str | None = None, text: str = "md_text", key: str = "ord", cluster: int | None = None) -> Index:
    """Compute the index once and write it as a new generation below ``path`` (default: the
    shared folder). Its marker is written last, so that queries go on reading the
    generation before until then; that one is kept for them, older ones are deleted.

    ``key`` must be unique; it breaks ties. Null texts count as records without tokens.
    Postings are laid out by term and records by ``ord``, so that a query reads the row
    groups of its terms, and then those of the records that it returns.
    """
    spark = records.sparkSession
    root = path or shared_path(spark, "index")
    kept = generations(spark, root)
    path = f"{root}/g{(kept[-1] if kept else 0) + 1:08d}"
    delete(spark, path)  # of a build that failed
    records = records.withColumn("ord", F.col(key)) if key != "ord" else records
    parts = cluster or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # written first where it is computed: a range exchange looks at its input twice
    records = materialize(records, "records")
    records.repartitionByRange(parts, "ord").sortWithinPartitions("ord").write.mode("overwrite").parquet(f"{path}/records")
    stored = spark.read.parquet(f"{path}/records")
    doc_lengths(stored, text).write.mode("overwrite").parquet(f"{path}/docs")
    frequencies = materialize(term_frequencies(stored, text).select("term", "ord", "tf", "dl"), "frequencies")
    frequencies.repartitionByRange(parts, "term", "ord").sortWithinPartitions("term", "ord").write.mode("overwrite").parquet(f"{path}/postings")
    n, total = spark.read.parquet(f"{path}/docs").agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
    terms, avg_idf = weighted_terms(frequencies, n, f"{path}/raw_terms")
    terms.repartitionByRange(max(1, parts // 4), "term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/terms")
    stats = spark.range(1).select(F.lit(n).cast("bigint").alias("n"), F.lit(total / n if n else 0.0).alias("avgdl"), F.lit(float(avg_idf)).alias("avg_idf"))
    stats.write.mode("overwrite").parquet(f"{path}/corpus")
    write_marker(spark, f"{path}.current")
    for old in kept[:-1]:
        delete(spark, f"{root}/g{old:08d}.current")
        delete(spark, f"{root}/g{old:08d}")
    return load_index(spark, root)


def generations(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the finished generations of an index, the current one last."""
    names = list_names(spark, root) if exists(spark, root) else []
    return sorted(int(n[1:-8]) for n in names if n.startswith("g") and n.endswith(".current"))


def load_index(spark: SparkSession, path: str) -> Index:
    """The current generation of the index below ``path``."""
    kept = generations(spark, path)
    if not kept:
        raise FileNotFoundError(f"no index in {path}")
    path = f"{path}/g{kept[-1]:08d}"
    n, avgdl, avg_idf = spark.read.parquet(f"{path}/corpus").select("n", "avgdl", "avg_idf").first()
    records, docs, postings, terms = (spark.read.parquet(f"{path}/{t}") for t in ("records", "docs", "postings", "terms"))
    return Index(records, docs, postings, terms, n, avgdl, avg_idf)

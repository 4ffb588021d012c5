"""Streaming ingestion: term counts and postings kept up as records arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from corvane.functions.text import tokenize
from corvane.operators.index import term_frequencies
from corvane.sources.files import exists, is_folder
from corvane.sources.shared import shared_path


def stream(spark: SparkSession, folder: str, schema: StructType, form: str = "parquet", files_per_batch: int = 100, only: str | None = None) -> DataFrame:
    """Files of a folder as they arrive. ``only`` names one table in it: a folder of files,
    or a single file."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(form)
    if only is None:
        return reader.load(folder)
    if is_folder(spark, f"{folder}/{only}"):
        return reader.load(f"{folder}/{only}")
    return reader.option("pathGlobFilter", only).load(folder)


def term_count_stream(records: DataFrame, target: str, offsets: str, text: str = "md_text") -> StreamingQuery:
    """Count the terms of arriving records: each batch writes its own counts below ``target``,
    in a folder of its own, so one that is repeated is counted once. No state is kept and
    nothing is written twice; ``term_counts`` adds the batches up."""

    def write(batch: DataFrame, number: int) -> None:
        terms = batch.select(F.explode(tokenize(F.col(text))).alias("term")).groupBy("term").agg(F.count("*").alias("occurrences"))
        terms.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return records.writeStream.foreachBatch(write).option("checkpointLocation", offsets).trigger(availableNow=True).start()


def term_counts(spark: SparkSession, target: str) -> DataFrame:
    """Occurrences of every term in all batches so far."""
    if not exists(spark, target):
        return spark.createDataFrame([], "term string, occurrences bigint")
    batches = spark.read.schema("term string, occurrences bigint").option("recursiveFileLookup", True).parquet(target)
    return batches.groupBy("term").agg(F.sum("occurrences").alias("occurrences"))


def daily_counts(records: DataFrame, time: str = "loaded_at", late: str = "7 days") -> DataFrame:
    """Rows a day of arrival; a day is final, and its state dropped, once ``late`` has passed."""
    days = records.withWatermark(time, late).groupBy(F.window(time, "1 day"))
    return days.agg(F.count("*").alias("n")).select(F.col("window.start").alias("day"), "n")


def run_available(result: DataFrame, mode: str = "complete", label: str = "stream") -> DataFrame:
    """Process what has arrived and return the result table (in complete mode the last one)."""
    spark = result.sparkSession
    target = shared_path(spark, label)

    def write(batch: DataFrame, number: int) -> None:
        # a batch that is repeated after a failure overwrites its own folder
        batch.write.mode("overwrite").parquet(target if mode == "complete" else f"{target}/batch={number}")

    query = result.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", shared_path(spark, f"{label}-offsets")).trigger(availableNow=True).start()
    query.awaitTermination()
    found = spark.read.schema(result.schema).parquet(target) if mode == "complete" else spark.read.schema(result.schema).option("recursiveFileLookup", True).parquet(target)
    return found


def append_postings(records: DataFrame, index_path: str, offsets: str, text: str = "md_text", key: str = "ord") -> StreamingQuery:
    """Append the postings and lengths of arriving records below ``index_path``; each batch
    has a folder of its own, so one that is repeated is written once."""

    def write(batch: DataFrame, number: int) -> None:
        postings = term_frequencies(batch, text, key).select("term", "ord", "tf", "dl")
        postings.sortWithinPartitions("term", "ord").write.mode("overwrite").parquet(f"{index_path}/postings/batch={number}")

    return records.writeStream.foreachBatch(write).option("checkpointLocation", offsets).trigger(availableNow=True).start()

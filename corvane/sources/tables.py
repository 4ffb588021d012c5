"""The tables of a data folder, one Parquet file or folder each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: A table above this many bytes is never dealt out anew: it has splits of its own to read.
SPREAD_BYTES = 256 << 20


def splits(spark: SparkSession, sizes: list[int]) -> int:
    """Into how many splits Spark cuts files of these sizes, about."""
    most = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return sum(max(1, -(-size // most)) for size in sizes)


def file_sizes(df: DataFrame) -> list[int]:
    """Bytes of the files that a frame reads; empty if it is made of anything else."""
    jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    paths = [jvm.org.apache.hadoop.fs.Path(f) for f in df._jdf.inputFiles()]
    return [p.getFileSystem(conf).getFileStatus(p).getLen() for p in paths]


def spread(df: DataFrame) -> DataFrame:
    """Rows of a small table of fewer splits than there are cores, dealt out to all of them.

    A file of a few MB is read by one task, which would leave the other cores idle while
    it parses texts in Python. A table of more than ``SPREAD_BYTES``, or with a split for
    each core, is left as it is; so at most ``SPREAD_BYTES`` are shuffled for this.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if len(df._jdf.inputFiles()) >= cores:
        return df
    sizes = file_sizes(df)  # of fewer files than cores
    return df.repartition(cores) if sum(sizes) <= SPREAD_BYTES and splits(df.sparkSession, sizes) < cores else df

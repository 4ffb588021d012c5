"""File sources and sinks of the search side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.functions.html import decode_lossy, decode_strict
from corvane.functions.pysource import SYMBOL_SCHEMA, symbol_batches
from corvane.functions.text import drop_admonitions
from corvane.schema import RECORD, RECORD_COLUMNS


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, on whatever file system the session reads."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(conf).exists(where)


def is_folder(spark: SparkSession, path: str) -> bool:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(conf).getFileStatus(where).isDirectory()


def read_jsonl(spark: SparkSession, paths: list[str], schema: T.StructType = RECORD) -> DataFrame:
    """Records of JSON-lines files in order: ``ord`` is (file, line). Blank lines are
    skipped, missing files too; a malformed line is an error when the rows are read.

    Within a file the order is that of the byte ranges Spark cuts it into and of the lines
    in each, which is what ``monotonically_increasing_id`` counts in a scan of one file.
    """
    found = [p for p in paths if exists(spark, p)]
    parts = [
        spark.read.schema(schema).option("mode", "FAILFAST").json(p).withColumn("file_no", F.lit(k)).withColumn("line_no", F.monotonically_increasing_id())
        for k, p in enumerate(found)
    ]
    if not parts:
        return spark.createDataFrame([], schema.add("ord", T.LongType()) if "ord" not in schema.fieldNames() else schema)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    # file number in the upper bits; partition and row of the scan below
    return out.withColumn("ord", F.shiftleft(F.col("file_no").cast("bigint"), 53) + F.col("line_no")).drop("file_no", "line_no")


def write_jsonl(records: DataFrame, path: str, single_file: bool = False) -> int:
    """Write records as JSON lines, nulls included, and return their number.

    By default each partition writes its own file, in order of ``ord`` across files where
    there is such a column; ``single_file`` is for small exports.
    """
    df = records.orderBy("ord") if "ord" in records.columns else records
    df = df.select(*[c for c in RECORD_COLUMNS if c in df.columns])
    (df.coalesce(1) if single_file else df).write.mode("overwrite").option("ignoreNullFields", False).json(path)
    return records.sparkSession.read.text(path).count()


def read_files(spark: SparkSession, folder: str, pattern: str, decode: Column | None = None) -> DataFrame:
    """``path`` (below the folder) and ``text`` of all matching files, at any depth."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    full = F.regexp_replace("path", r"^file:/+", "/")
    root = folder.removeprefix("file://").rstrip("/") + "/"
    return raw.select(F.regexp_replace(full, "^.*?" + java_literal(root), "").alias("path"), (decode_lossy(F.col("content")) if decode is None else decode).alias("text"))


def java_literal(s: str) -> str:
    """A literal for Java's regular expressions."""
    return "\\Q" + s.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def read_html(spark: SparkSession, folder: str) -> DataFrame:
    """HTML files; invalid bytes are dropped."""
    return read_files(spark, folder, "*.html")


def read_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """Markdown files; those that aren't UTF-8 are left out."""
    return read_files(spark, folder, "*.md", decode_strict(F.col("content"))).filter("text is not null")


def read_python_symbols(spark: SparkSession, folder: str) -> DataFrame:
    """Documented symbols of Python files; files that don't parse yield nothing."""
    files = read_files(spark, folder, "*.py", decode_strict(F.col("content"))).filter("text is not null")
    return python_symbols(files.withColumn("file_id", F.xxhash64("path")))


def python_symbols(files: DataFrame) -> DataFrame:
    """``file_id, path, symbol_type, symbol_name, parent_class, line_number, doc, walk_order``
    of documented modules, classes, functions and methods of ``(file_id, path, text)``."""
    source = files.select("file_id", "path", F.col("text").alias("source_text"), F.col("path").alias("_path"))
    found = source.mapInArrow(symbol_batches(1), f"_path string, {SYMBOL_SCHEMA}").withColumnRenamed("_path", "path")
    found = found.withColumn("doc", drop_admonitions(F.col("own_docstring"))).filter("own_docstring <> ''")
    return found.drop("own_docstring", "bases", "base_origins", "code", "name")


def read_search_index(spark: SparkSession, path: str) -> DataFrame:
    """The documents of a prebuilt search index: location, title, text."""
    schema = "docs array<struct<location:string,title:string,text:string>>"
    return spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("docs").alias("d")).select("d.*")


def file_stats(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """One row: number and bytes of matching files; zeros where the folder is missing."""
    if not exists(spark, folder):
        return spark.range(1).select(F.lit(0).cast("bigint").alias("files"), F.lit(0).cast("bigint").alias("bytes"))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder).select("length")
    return files.agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def count_jsonl(spark: SparkSession, path: str) -> int:
    """Lines that aren't blank; 0 where the file is missing."""
    return spark.read.text(path).filter(F.trim("value") != "").count() if exists(spark, path) else 0


def delete(spark: SparkSession, path: str) -> bool:
    """Delete a file or folder, if it is there."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(conf).delete(where, True)


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    return sorted(f.getPath().getName() for f in where.getFileSystem(conf).listStatus(where))


def write_marker(spark: SparkSession, path: str) -> None:
    """An empty file."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(conf).create(where, True).close()

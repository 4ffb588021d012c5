"""What changed between full snapshots of a table.

The last snapshot is kept as an index: one narrow row a record with the hash of its
compared text, in files bucketed by record. The rows of the next snapshot are reduced to
the same form and bucketed alike, so that the probe joins bucket with bucket and shuffles
nothing. The texts themselves are fetched only for records whose hashes differ. Then the
new index takes the place of the old one. The index outlives the session: a delivery can
be compared with the one of the day before.
"""

from __future__ import annotations

import math
import re
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.operators.checked import join_measured, measured
from corvane.sources.files import delete, exists, list_names, write_marker
from corvane.sources.shared import materialize, shared_path

#: Records in a bucket of the index, about, when it is made.
RECORDS_PER_BUCKET = 500_000
#: blank, tab, CR, LF and no-break space
LAYOUT = "[ \\t\\r\\n\\u00a0]+"


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, no slashes at the end of the path; path, query and
    fragment keep their case. A url without a scheme keeps its case throughout."""
    parts = "(?s)^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)(.*)$"
    head, path, rest = (F.regexp_extract(url, parts, k) for k in (1, 2, 3))
    return F.concat(F.lower(head), F.rtrim(path, F.lit("/")), rest)


def layout_free(text: Column) -> Column:
    """Null as empty, each run of layout characters as one blank, none at the ends."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), LAYOUT, " "))


def snapshot_index(df: DataFrame, snapshot: str, record: Column, text: Column, order: str, row_id: str) -> DataFrame:
    """One row a snapshot and record: the hash of its valid row's text, and that row's id.

    The valid row has the latest ``order``; null loses, ties go to the larger ``row_id``.
    Rows whose snapshot or record is null are left out. Texts are hashed before the
    shuffle, and the group limit under ``row_number`` sends one row a record and map
    task, so that a record which holds a third of all rows does no harm.
    """
    narrow = df.select(
        F.col(snapshot).alias("snapshot"), record.cast("string").alias("record"), F.xxhash64(text).alias("hash"), F.col(order).alias("_order"), F.col(row_id).cast("bigint").alias("row_id")
    ).filter("snapshot is not null and record is not null")
    latest = Window.partitionBy("snapshot", "record").orderBy(F.col("_order").desc_nulls_last(), F.col("row_id").desc())
    return narrow.withColumn("_rank", F.row_number().over(latest)).filter("_rank = 1").select("snapshot", "record", "hash", "row_id")


def probe(old: DataFrame, new: DataFrame) -> DataFrame:
    """Records of two indexes that differ: ``record, diff_kind, old_row, new_row``."""
    old = old.select("record", F.col("hash").alias("old_hash"), F.col("row_id").alias("old_row"))
    new = new.select("record", F.col("hash").alias("new_hash"), F.col("row_id").alias("new_row"))
    kind = F.when(F.col("old_hash").isNull(), "added").when(F.col("new_hash").isNull(), "removed").when(F.col("old_hash") != F.col("new_hash"), "changed")
    return old.join(new, "record", "full_outer").withColumn("diff_kind", kind).filter("diff_kind is not null").select("record", "diff_kind", "old_row", "new_row")


@dataclass
class _Version:
    number: int
    buckets: int

    @property
    def folder(self) -> str:
        return f"v{self.number:08d}-{self.buckets}"


class SnapshotIndex:
    """The index of the last snapshot of a table, in the folder ``path``.

    A version is a folder of files bucketed by record. The current one is the highest
    that has a marker file; the marker is written last, so that a delivery which fails on
    its way leaves the index as it was. The version before is kept for readers of the
    last changes, older ones are deleted.
    """

    def __init__(self, spark: SparkSession, path: str, records_per_bucket: int = RECORDS_PER_BUCKET):
        self.spark, self.path, self.records_per_bucket = spark, path.rstrip("/"), records_per_bucket

    def _versions(self) -> list[_Version]:
        names = list_names(self.spark, self.path) if exists(self.spark, self.path) else []
        marked = (re.fullmatch(r"v(\d+)-(\d+)\.current", name) for name in names)
        return sorted((_Version(int(m[1]), int(m[2])) for m in marked if m), key=lambda v: v.number)

    def _table(self, version: _Version) -> DataFrame:
        """The files of a version as a bucketed table; its name means nothing beyond this session."""
        name = f"snapshot_index_{uuid.uuid4().hex}"
        self.spark.sql(
            f"create table {name} (record string, hash bigint, row_id bigint) using parquet"
            f" clustered by (record) sorted by (record) into {version.buckets} buckets location '{self.path}/{version.folder}'"
        )
        return self.spark.table(name)

    def current(self) -> DataFrame | None:
        """``record, hash, row_id`` of the last snapshot; None before the first."""
        versions = self._versions()
        return self.spark.read.schema("record string, hash bigint, row_id bigint").parquet(f"{self.path}/{versions[-1].folder}") if versions else None

    def advance(self, delivery: DataFrame, rows: int | None = None) -> DataFrame | None:
        """Take ``delivery`` (record, hash, row_id, as ``snapshot_index`` gives them) as the new snapshot
        and return what changed since the last one, as ``probe`` does; None for the first.

        The number of buckets follows from the first delivery's ``rows`` (counted if not
        given); it is doubled as long as a delivery holds more than twice as many records
        a bucket. Only that once is one side of the probe shuffled.
        """
        versions = self._versions()
        rows = delivery.count() if rows is None else rows
        buckets = versions[-1].buckets if versions else max(1, math.ceil(rows / self.records_per_bucket))
        while rows > 2 * buckets * self.records_per_bucket:
            buckets *= 2
        new = _Version(versions[-1].number + 1 if versions else 1, buckets)
        delete(self.spark, f"{self.path}/{new.folder}")  # of a delivery that failed
        name = f"snapshot_index_{uuid.uuid4().hex}"
        writer = delivery.select("record", "hash", "row_id").repartition(buckets, "record").write.format("parquet").bucketBy(buckets, "record").sortBy("record")
        writer.option("path", f"{self.path}/{new.folder}").saveAsTable(name)
        changes = materialize(probe(self._table(versions[-1]), self.spark.table(name)), "changes") if versions else None
        drop_index_tables(self.spark)
        write_marker(self.spark, f"{self.path}/{new.folder}.current")  # the swap
        for old in versions[:-1]:
            delete(self.spark, f"{self.path}/{old.folder}.current")
            delete(self.spark, f"{self.path}/{old.folder}")
        return changes


def snapshot_changes(
    df: DataFrame, snapshot: str, record: Column, text: Column, order: str = "loaded_at", row_id: str = "row_id", index_path: str | None = None
) -> DataFrame:
    """Records added, removed or changed in each snapshot of ``df`` since the delivery before it.

    Returns ``snapshot, record, diff_kind, old_row, new_row``. Gaps in the numbers don't
    matter; the first snapshot yields nothing, and so does an empty table. The snapshots
    are reduced in one pass and then taken one after the other, as if each were delivered
    on its day; ``index_path`` is where the index is kept (default: the shared folder).
    Only the snapshots' numbers and sizes, one row a delivery, come to the driver.
    """
    spark = df.sparkSession
    index = SnapshotIndex(spark, index_path or shared_path(spark, "snapshot-index"))
    path, changes = shared_path(spark, "snapshots"), shared_path(spark, "snapshot-changes")
    reduced = snapshot_index(df, snapshot, record, text, order, row_id)
    reduced.write.partitionBy("snapshot").parquet(path)
    everything = spark.read.schema(reduced.schema).parquet(path) if any(n.startswith("snapshot=") for n in list_names(spark, path)) else spark.createDataFrame([], reduced.schema)
    schema = f"snapshot {reduced.schema['snapshot'].dataType.simpleString()}, record string, diff_kind string, old_row bigint, new_row bigint"
    deliveries = sorted(tuple(r) for r in everything.groupBy("snapshot").count().collect())
    found = False
    for number, rows in deliveries:
        step = index.advance(everything.filter(F.col("snapshot") == number), rows)
        if step is not None:
            step.withColumn("snapshot", F.lit(number)).select("snapshot", "record", "diff_kind", "old_row", "new_row").write.mode("append").parquet(changes)
            found = True
    return spark.read.schema(schema).parquet(changes) if found else spark.createDataFrame([], schema)


def with_values(changes: DataFrame, df: DataFrame, value: str, row_id: str = "row_id") -> DataFrame:
    """Fetch ``value`` of the old and the new row of each change, for changed records only."""
    kept, rows = measured(changes.filter("diff_kind = 'changed'"), "changes")
    wanted, n = measured(kept.select(F.explode(F.array("old_row", "new_row")).alias(row_id)).distinct(), "changed-rows")
    values = join_measured(df.select(row_id, value), wanted, n, [row_id], "left_semi")
    for side in ("old", "new"):
        kept = kept.join(values.select(F.col(row_id).alias(f"{side}_row"), F.col(value).alias(f"{side}_{value}")), f"{side}_row", "left")
    return kept


def drop_index_tables(spark: SparkSession) -> int:
    """Forget the names under which this session has read index files; the files stay."""
    names = [t.name for t in spark.catalog.listTables() if t.name.startswith("snapshot_index_")]
    for name in names:
        spark.sql(f"drop table if exists {name}")
    return len(names)

from __future__ import annotations

import random

from pyspark.sql import functions as F

from corvane.operators.snapshots import SnapshotIndex, canonical_url, layout_free, snapshot_changes, snapshot_index
from corvane.queries import QUERIES
from corvane.sources.files import list_names
from tests.conftest import SMALL


def reduced(spark, number):
    df = spark.read.parquet(f"{SMALL}/chunk_snapshot.parquet").filter(F.col("snapshot_no") == number)
    return snapshot_index(df, "snapshot_no", canonical_url(F.col("url")), layout_free(F.col("md_text")), "loaded_at", "row_id")


def test_deliveries_one_by_one(spark, tmp_path):
    """Each with a new index object, as in a session of its own."""
    want = {tuple(r) for r in QUERIES["p5_found"](spark, SMALL).collect()}
    numbers = sorted({r[0] for r in spark.read.parquet(f"{SMALL}/chunk_snapshot.parquet").select("snapshot_no").distinct().collect()})
    got, path = set(), str(tmp_path / "index")
    for k, number in enumerate(numbers):
        changes = SnapshotIndex(spark, path).advance(reduced(spark, number))
        assert (changes is None) == (k == 0)
        if changes is not None:
            got |= {(number, r["record"], r["diff_kind"]) for r in changes.collect()}
        assert sum(n.endswith(".current") for n in list_names(spark, path)) <= 2
    assert got == want
    assert SnapshotIndex(spark, path).current().count() == reduced(spark, numbers[-1]).count()
    assert SnapshotIndex(spark, path).advance(reduced(spark, numbers[-1])).count() == 0


def test_probe_shuffles_nothing(spark, tmp_path):
    index = SnapshotIndex(spark, str(tmp_path / "index"), records_per_bucket=50)
    rows = lambda n: spark.range(n).select(F.col("id").cast("string").alias("record"), F.col("id").alias("hash"), F.col("id").alias("row_id"))
    assert index.advance(rows(200)) is None
    (version,) = index._versions()
    assert version.buckets == 4
    from corvane.operators.snapshots import probe

    plan = probe(index._table(version), index._table(version))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "SortMergeJoin" in plan
    # more buckets once there are more than twice as many records in each
    assert {r["diff_kind"] for r in index.advance(rows(900)).collect()} == {"added"}
    assert [v.buckets for v in index._versions()] == [4, 16]
    assert index.advance(rows(0)).filter("diff_kind = 'removed'").count() == 900 and index.current().count() == 0


def test_a_delivery_that_failed_leaves_the_index(spark, tmp_path):
    index = SnapshotIndex(spark, str(tmp_path / "index"))
    rows = spark.createDataFrame([("a", 1, 1), ("b", 2, 2)], "record string, hash long, row_id long")
    index.advance(rows)
    rows.write.parquet(f"{index.path}/v00000002-1")  # no marker: never became current
    changes = index.advance(rows.filter("record = 'a'").withColumn("hash", F.lit(7).cast("long")))
    assert sorted(tuple(r) for r in changes.collect()) == [("a", "changed", 1, 1), ("b", "removed", 2, None)]


def test_bulk_equals_brute_force(spark):
    random.seed(1)
    rows = [(k, random.choice([1, 2, 4, 5]), f"u{random.randint(0, 30)}", random.choice(["x", "y", None]), k) for k in range(300)] + [(900, None, "u1", "x", 1), (901, 1, None, "x", 1)]
    df = spark.createDataFrame(rows, "row_id long, snapshot_no int, url string, md_text string, loaded_at long")
    valid: dict = {}
    for _, n, u, t, at in sorted(rows, key=lambda r: r[4]):
        if n is not None and u is not None:
            valid.setdefault(n, {})[u] = t or ""
    want, numbers = set(), sorted(valid)
    for before, n in zip(numbers, numbers[1:]):
        a, b = valid[before], valid[n]
        want |= {(n, u, "added") for u in b.keys() - a.keys()} | {(n, u, "removed") for u in a.keys() - b.keys()} | {(n, u, "changed") for u in a.keys() & b.keys() if a[u] != b[u]}
    out = snapshot_changes(df, "snapshot_no", F.col("url"), layout_free(F.col("md_text")))
    assert {(r["snapshot"], r["record"], r["diff_kind"]) for r in out.collect()} == want and out.count() == len(want)

"""What plans must not do, and settings that must be right."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from corvane.schema import MAX_SITES, Sites
from corvane.sources import shared, tables
from tests.conftest import SMALL


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_only_small_tables_are_dealt_out(spark, tmp_path, monkeypatch):
    few = spark.read.parquet(f"{SMALL}/doc_chunk.parquet")
    assert "Exchange" in plan_of(tables.spread(few))
    monkeypatch.setattr(tables, "SPREAD_BYTES", 1000)
    assert "Exchange" not in plan_of(tables.spread(few))
    monkeypatch.undo()
    # few files, but as many splits as cores
    monkeypatch.setattr(tables, "splits", lambda spark, sizes: 100)
    assert "Exchange" not in plan_of(tables.spread(few))
    monkeypatch.undo()
    path = str(tmp_path / "many")
    few.repartition(8).write.parquet(path)
    assert "Exchange" not in plan_of(tables.spread(spark.read.parquet(path)))
    assert tables.splits(spark, [1, 0, 300 << 20]) == 5
    assert tables.spread(spark.range(3)).count() == 3


def test_sites_are_all_taken_or_refused(spark):
    many = spark.range(MAX_SITES).select(F.format_string("s%04d", "id").alias("repo_name"), F.lit("https://x.example").alias("base_url"))
    assert len(Sites.from_config(many).all) == MAX_SITES
    with pytest.raises(ValueError):
        Sites.from_config(many.union(spark.createDataFrame([("one more", "https://x.example")])))


def test_a_cluster_must_name_its_shared_folder():
    class Conf:
        def get(self, name, default):
            return default

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError):
        shared.shared_dir(Session())

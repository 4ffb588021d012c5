from __future__ import annotations

import pytest

from corvane.llm.queries import QUERIES, SQL
from tests.compare import assert_equal, connect
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, con, name):
    assert_equal(spark, con, SMALL, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0


def test_group_rows(spark):
    groups = QUERIES["p2_groups"](spark, SMALL).collect()
    pairs = {(r["chunk_id_a"], r["chunk_id_b"]) for r in QUERIES["p2_found"](spark, SMALL).collect()}
    group = {r["chunk_id"]: r["group_id"] for r in groups}
    assert len(group) == len(groups) and set(group) == {x for p in pairs for x in p}
    assert all(group[a] == group[b] for a, b in pairs)

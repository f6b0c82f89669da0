"""Every query with oracle SQL gives the oracle's rows; the others give rows."""

from __future__ import annotations

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.parity import difference, oracle

QUERIES, SQL = queries(), oracle_sql()
FAMILIES = {
    "sc": 7, "tx": 11, "fl": 13, "lg": 2, "sa": 2, "ge": 7, "sp": 8, "lb": 13,
    "nm": 7, "ml": 6, "ev": 6, "ch": 16, "st": 3,
}


@pytest.fixture(scope="module")
def con():
    return oracle("/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_oracle(spark, sf_dir, con, name):
    assert difference(QUERIES[name](spark, sf_dir), con, SQL[name]) is None


# The text-preparation queries are run by their own tests.
OWN = {q for q in QUERIES if q.startswith("op") or q == "pipeline"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - OWN))
def test_gives_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_every_operator_is_registered():
    for family, size in FAMILIES.items():
        for n in range(1, size + 1):
            assert any(q.startswith(f"{family}{n}_") for q in QUERIES), f"{family}{n}"


def test_entry(spark):
    found = entry(spark)
    assert found.columns == ["job_id", "text", "expected_salary", "expected_experience_years"]
    assert found.count() > 0

from __future__ import annotations

import pytest

from tests.session import make_session

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = make_session()
    yield session
    session.stop()


@pytest.fixture
def sf_dir():
    return SF_DIR


@pytest.fixture
def column(spark):
    """Apply a column function to a list of values of one type."""
    from pyspark.sql import functions as F

    def apply(values, fn, kind="string"):
        rows = [(n, v) for n, v in enumerate(values)]
        df = spark.createDataFrame(rows, f"n int, v {kind}")
        out = df.select("n", fn(F.col("v")).alias("out")).orderBy("n").collect()
        return [r["out"] for r in out]
    return apply

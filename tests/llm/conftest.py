from __future__ import annotations

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def make_docs(spark):
    """Documents of the given texts (or (doc_id, text) pairs), in the table's columns."""
    def make(texts, schema: str = SCHEMA):
        rows = [t if isinstance(t, tuple) else (n, t) for n, t in enumerate(texts)]
        return spark.createDataFrame([(n, t, "en", "src0", len(t) if t is not None else None) for n, t in rows], schema)
    return make


@pytest.fixture
def clashing():
    """Add columns with the names that operators use inside."""
    def add(df):
        for name in ("key", "rep", "component", "kept", "a", "b", "n", "group", "slot", "shard", "spans", "score",
                     "toxic_", "row", "line", "host_", "h", "start", "length", "offset", "text_"):
            df = df.withColumn(name, F.lit("x"))
        return df
    return add


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")

"""Table layouts and the boundary between missing labels and NULL.

Stored tables mark a missing label with -1; inside the engine a missing label is
NULL, so aggregates skip it without special cases.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import (
    ArrayType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)

RAW_POSTING = StructType([
    StructField("job_id", LongType()),
    StructField("job_title", StringType()),
    StructField("description", StringType()),
    StructField("min_annual_salary_usd", DoubleType()),
    StructField("max_annual_salary_usd", DoubleType()),
    StructField("country_codes", StringType()),
    StructField("remote", IntegerType()),
    StructField("state_code", StringType()),
])

EXAMPLE = StructType([
    StructField("text", StringType()),
    StructField("expected_salary", LongType()),
    StructField("expected_experience_years", LongType()),
])

LABEL_RESULT = StructType([
    StructField("years", IntegerType()),
    StructField("expected_salary", LongType()),
])

NORM_STATS = StructType([
    StructField("target", StringType()),
    StructField("mean", DoubleType()),
    StructField("std", DoubleType()),
])

PREDICTION = StructType([
    StructField("experience_years", IntegerType()),
    StructField("expected_salary", LongType()),
])

MESSAGE = StructType([
    StructField("role", StringType()),
    StructField("content", StringType()),
])
MESSAGES = ArrayType(MESSAGE)

STREAM_LINE = StructType([
    StructField("request_id", LongType()),
    StructField("line_no", LongType()),
    StructField("line", StringType()),
])

TOOL_CALL = StructType([
    StructField("id", StringType()),
    StructField("name", StringType()),
    StructField("arguments", StringType()),
])

TARGETS = ["expected_experience_years", "expected_salary"]


def is_missing(label: Column) -> Column:
    """True for NULL, NaN and the stored marker -1. Never NULL itself."""
    return label.isNull() | F.isnan(label.cast("double")) | (label == -1)


def labels_to_null(df: DataFrame) -> DataFrame:
    """Stored form to engine form: missing labels become NULL."""
    return df.withColumns({
        c: F.when(~is_missing(F.col(c)), F.col(c)) for c in TARGETS if c in df.columns
    })


def labels_to_stored(df: DataFrame) -> DataFrame:
    """Engine form to stored form: missing labels become -1."""
    return df.withColumns({
        c: F.when(is_missing(F.col(c)), -1).otherwise(F.col(c)).cast("bigint")
        for c in TARGETS if c in df.columns
    })


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """Columns of `schema` in order; absent ones as typed NULL, extras dropped."""
    return df.select([
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schema.fields
    ])


def check_same_columns(left: DataFrame, right: DataFrame) -> None:
    """Refuse to append rows whose columns or types differ."""
    a, b = dict(left.dtypes), dict(right.dtypes)
    if a != b:
        differing = sorted(k for k in {*a, *b} if a.get(k) != b.get(k))
        raise ValueError(f"tables differ in columns {differing}")

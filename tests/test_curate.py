from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from postlake.functions import pay, place, quality
from postlake.operators import curate
from postlake.schemas import RAW_POSTING, is_missing, labels_to_null, labels_to_stored


def test_digits_follow_python(spark):
    points = [p for p in range(1, 0x110000) if not 0xD800 <= p <= 0xDFFF]
    rows = spark.createDataFrame([(chr(p),) for p in points], "s string")
    out = rows.select("s", quality.title_numeric_only(F.col("s")).alias("o")).toPandas()
    assert set(out[out.o].s) == {s for s in map(chr, points) if s.isdigit() or s == " "}


@pytest.mark.parametrize("title, skipped", [
    ("Server", True), ("server", False), ("Device Driver Developer", True),
    ("Sous Chef", True), ("Data Engineer", False), ("Scheffler Analyst", True),
    ("Sandwich Artist ®", True), ("Buyer ", False), ("COOK", True),
])
def test_denied_titles(column, title, skipped):
    assert column([title], quality.should_skip_title) == [skipped]


@pytest.mark.parametrize("codes, first", [
    ('["US"]', "US"), ('["GB","US"]', "GB"), ("[]", ""), (None, ""), ("not json", ""),
    ('"US"', "U"), ("[null]", ""), ('[""]', ""), ("['US']", ""), ('["US"] x', ""), ('{"a":1}', ""),
])
def test_first_country(column, codes, first):
    assert column([codes], place.first_country) == [first]


@pytest.mark.parametrize("low, high, salary", [
    (None, None, -1), (float("nan"), None, -1), (10.9, None, 10), (None, 7.2, 7),
    (3.0, 4.0, 3), (-3.0, -4.0, -3), (0.0, 0.0, 0), (9.0, 1.0, 5), (1e30, 5.0, 5),
])
def test_expected_salary(spark, low, high, salary):
    df = spark.createDataFrame([(low, high)], "lo double, hi double")
    assert df.select(pay.expected_salary(F.col("lo"), F.col("hi"))).first()[0] == salary


@pytest.mark.parametrize("remote, country, state, label", [
    (1, "US", "CA", "Remote"), (0, "", "CA", "Unknown"), (None, "US", "ca", "United States California"),
    (0, "US", None, "United States"), (0, "US", "Zz", "United States Zz"), (0, "GB", "CA", "United Kingdom"),
    (0, "XX", "", "XX"), (0, "us", "", "us"),
])
def test_location(spark, remote, country, state, label):
    df = spark.createDataFrame([(remote, country, state)], "r int, c string, s string")
    assert df.select(place.location_label(F.col("r"), F.col("c"), F.col("s"))).first()[0] == label


def test_rendered_text_reads_back(spark):
    df = spark.createDataFrame([("Remote", "A [DESC]: b", "x [TITLE]: y\nz")], "l string, t string, d string")
    text = place.render_text(F.col("l"), F.col("t"), F.col("d"))
    parts = place.parse_rendered_text(F.col("text"))
    row = df.select(text.alias("text")).select(*parts.values()).first()
    assert tuple(row) == ("Remote", "A", "b [DESC]: x [TITLE]: y\nz")


def test_order_of_reasons_and_whole_funnel(spark):
    rows = [
        (1, "", "d", "en"), (2, "12 3", "d", "xx"), (3, "Cook", "d", "fr"), (4, "Cook", "d", "en"),
        (5, "Analyst", "d", "en"), (6, "Analyst", "<p>", "en"), (7, None, None, "en"),
    ]
    df = spark.createDataFrame(rows, "job_id long, job_title string, description string, lang string")
    reasons = curate.with_skip_reason(df, lambda text: F.col("lang") == "en")
    found = dict(reasons.select("job_id", "skip_reason").collect())
    assert found == {1: "no_title_desc", 2: "title_numeric", 3: "not_english", 4: "skip_jobs",
                     5: None, 6: "no_title_desc", 7: "no_title_desc"}
    assert dict(curate.funnel(reasons).collect()) == {
        "no_title_desc": 3, "title_numeric": 1, "not_english": 1, "skip_jobs": 1, "kept": 1}


def test_english_only_asked_of_rows_that_pass(spark):
    rows = [(1, "Cook", "d"), (2, "77", "d"), (3, "Analyst", "d")]
    df = spark.createDataFrame(rows, "job_id long, job_title string, description string")
    full = df.select("*", *[F.lit(None).cast(f.dataType).alias(f.name)
                            for f in RAW_POSTING.fields if f.name not in df.columns])
    built = curate.build_examples(full, lambda text: F.when(
        text.rlike("Cook|77"), F.raise_error(F.lit("asked")).cast("boolean")).otherwise(F.lit(True)))
    assert [r["text"] for r in built.collect()] == ["[LOCATION]: Unknown [TITLE]: Analyst [DESC]: d"]


def test_missing_labels(spark):
    df = spark.createDataFrame(
        [(-1.0, 5.0), (float("nan"), -1.0), (None, 0.0)],
        "expected_salary double, expected_experience_years double")
    missing = df.select(is_missing(F.col("expected_salary")), is_missing(F.col("expected_experience_years")))
    assert [tuple(r) for r in missing.collect()] == [(True, False), (True, True), (True, False)]
    assert [tuple(r) for r in labels_to_null(df).collect()] == [(None, 5.0), (None, None), (None, 0.0)]
    assert [tuple(r) for r in labels_to_stored(labels_to_null(df)).collect()] == [(-1, 5), (-1, -1), (-1, 0)]

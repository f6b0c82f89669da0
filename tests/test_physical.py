"""What the plans of the main queries must and must not contain."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from postlake.operators.curate import build_examples
from postlake.schemas import RAW_POSTING
from postlake.sources.tables import scan_postings

QUERIES = queries()


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def operators(df, name: str) -> int:
    return len(re.findall(rf"\b{name}\b", plan(df)))


NATIVE = [q for q in QUERIES if q.split("_")[0] in {
    "tx1", "tx2", "fl7", "fl8", "ge6", "lb10", "lb11", "nm3", "ev4", "ch2", "ch5", "ch9", "ch11", "ch15", "ch16",
} and not q.endswith("language_id")]


@pytest.mark.parametrize("name", NATIVE)
def test_no_python_workers(spark, sf_dir, name):
    assert not re.search(r"EvalPython|InPandas|PythonUDF", plan(QUERIES[name](spark, sf_dir)))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_joins(spark, sf_dir, name):
    if name.startswith(("ml", "st", "lb13", "sc", "op", "pipeline", "ev4_eval_fitted")):
        pytest.skip("runs jobs when built")
    assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin", plan(QUERIES[name](spark, sf_dir)))


@pytest.mark.parametrize("name", ["fl2_title_numeric_only", "fl4_skip_title_exact", "fl5_skip_title_substring", "fl6_should_skip_title"])
def test_title_checks_read_no_text(spark, sf_dir, name):
    read = re.findall(r"ReadSchema: struct<([^>]*)>", plan(QUERIES[name](spark, sf_dir)))
    assert read and not any("text" in r for r in read)


def test_cleaning_is_evaluated_once(spark, sf_dir):
    # One ICU call and four replacements for each of title and description.
    text = plan(QUERIES["ge6_build_examples"](spark, sf_dir))
    assert text.count("java_method") == 2
    assert text.count("[^>]++") == 2
    assert "Exchange hash" not in text


@pytest.mark.parametrize("name, shuffles", [
    ("tx1_preprocess_text", 0), ("fl8_funnel", 1), ("nm1_log1p_salary", 0), ("ev4_eval_report", 1),
    ("ge1_first_country", 0), ("lb3_label_requests", 0), ("ch9_response_text", 0), ("sp4_hash_split", 0),
])
def test_shuffles(spark, sf_dir, name, shuffles):
    found = operators(QUERIES[name](spark, sf_dir), "Exchange")
    spread = operators(QUERIES[name](spark, sf_dir), "RoundRobinPartitioning")
    assert found - spread == shuffles


def test_absent_titles_are_left_in_the_files(spark, tmp_path):
    folder = str(tmp_path / "raw")
    spark.createDataFrame([], RAW_POSTING).write.parquet(folder)
    built = build_examples(scan_postings(spark, folder), lambda text: F.lit(True))
    text = plan(built)
    assert "IsNotNull(job_title)" in text and "IsNotNull(description)" in text
    assert operators(built, "Exchange") == 0


def test_report_scans_once(spark, sf_dir):
    assert operators(QUERIES["ev4_eval_report"](spark, sf_dir), "FileScan") == 1


def test_sample_moves_no_rows(spark, sf_dir):
    assert operators(QUERIES["sp2_take_n"](spark, sf_dir), "Exchange") == 0
    assert operators(QUERIES["sp3_positional_split"](spark, sf_dir), "Exchange") == 0


def test_columns_are_pruned(spark, sf_dir):
    text = plan(QUERIES["ev1_mae"](spark, sf_dir))
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in text

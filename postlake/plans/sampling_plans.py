"""SP: shuffles, samples, splits, appends. Portable hashes where SQL checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from postlake.lists import PREDICT_SAMPLE_SIZE, PREVIEW_SAMPLE_SIZE, SHUFFLE_SEED
from postlake.operators import sampling
from postlake.plans import inputs as i
from postlake.plans.registry import query
from postlake.sources.tables import union_append

ORDER = ["h", "row_id"]
HASHED = {
    "scored": i.SCORED,
    "hashed": "SELECT *, (row_id * 7919 + 42) % 10007 AS h FROM scored",
    "placed": "SELECT *, row_number() OVER (ORDER BY h, row_id) AS place FROM hashed",
}


def portable(spark, sf_dir):
    rows = i.view(spark, sf_dir, i.SCORED)
    return rows.withColumn("h", sampling.arithmetic_hash("row_id", SHUFFLE_SEED))


def hashed(spark, sf_dir):
    rows = i.view(spark, sf_dir, i.SCORED)
    return rows.withColumn("h", sampling.order_hash("row_id", seed=SHUFFLE_SEED))


@query("sp1_seeded_shuffle", i.with_views(
    "SELECT row_id, split, pred_salary, place - 1 AS position FROM placed", **HASHED))
def sp1(spark, sf_dir):
    shuffled = sampling.seeded_shuffle(portable(spark, sf_dir), ORDER)
    return shuffled.select("row_id", "split", "pred_salary", "position")


@query("sp2_take_n", i.with_views(
    "SELECT row_id, pred_salary FROM placed WHERE place <= 5150", **HASHED))
def sp2(spark, sf_dir):
    return sampling.take_n(portable(spark, sf_dir), ORDER, 5150).select("row_id", "pred_salary")


@query("sp3_positional_split", i.with_views("""
SELECT row_id, pred_salary, CASE WHEN place <= 5000 THEN 'train' ELSE 'val' END AS split
FROM placed WHERE place <= 5150""", **HASHED))
def sp3(spark, sf_dir):
    rows = portable(spark, sf_dir).drop("split")
    return sampling.positional_split(rows, ORDER, 5000, 150).select("row_id", "pred_salary", "split")


#: Rows sorted at most in the narrowed forms: low, so the histogram walk runs on these tables.
NARROW_SORT_ROWS = 100


@query("sp2_take_n_narrowed", i.with_views(
    "SELECT row_id, pred_salary FROM placed WHERE place <= 5150", **HASHED))
def sp2_narrowed(spark, sf_dir):
    rows = portable(spark, sf_dir)
    return sampling.take_n(rows, ORDER, 5150, sort_rows=NARROW_SORT_ROWS).select("row_id", "pred_salary")


@query("sp3_positional_split_narrowed", i.with_views("""
SELECT row_id, pred_salary, CASE WHEN place <= 5000 THEN 'train' ELSE 'val' END AS split
FROM placed WHERE place <= 5150""", **HASHED))
def sp3_narrowed(spark, sf_dir):
    rows = portable(spark, sf_dir).drop("split")
    return sampling.positional_split(rows, ORDER, 5000, 150, sort_rows=NARROW_SORT_ROWS).select(
        "row_id", "pred_salary", "split")


@query("sp4_hash_split", i.with_views("""
SELECT row_id, CASE WHEN h % 1000 < 960 THEN 'train' WHEN h % 1000 < 980 THEN 'val' ELSE 'test' END AS split
FROM hashed""", **HASHED))
def sp4(spark, sf_dir):
    rows = portable(spark, sf_dir)
    return rows.select("row_id", sampling.hash_split(F.col("h") % 1000, 960, 20).alias("split"))


@query("sp5_union_append", i.with_views("""
SELECT row_id, expected_salary, CAST(NULL AS VARCHAR) AS split FROM scored WHERE split <> 'train'
UNION ALL SELECT row_id, expected_salary, split FROM scored""", scored=i.SCORED))
def sp5(spark, sf_dir):
    rows = i.view(spark, sf_dir, i.SCORED).select("row_id", "expected_salary", "split")
    return union_append(rows, rows.filter("split <> 'train'").drop("split"))


@query("sp6_sample_n", i.with_views(
    f"SELECT row_id, pred_years, pred_salary FROM placed WHERE place <= {PREDICT_SAMPLE_SIZE}", **HASHED))
def sp6(spark, sf_dir):
    drawn = sampling.sample_n(portable(spark, sf_dir), ORDER, PREDICT_SAMPLE_SIZE)
    return drawn.select("row_id", "pred_years", "pred_salary")


@query("sp7_sample_without_replacement", i.with_views(
    "SELECT row_id, pred_years, pred_salary FROM placed WHERE place <= 20", **HASHED))
def sp7(spark, sf_dir):
    drawn = sampling.sample_n(portable(spark, sf_dir), ORDER, PREVIEW_SAMPLE_SIZE)
    return drawn.select("row_id", "pred_years", "pred_salary")


@query("sp8_first_k", i.with_views(
    "SELECT row_id, pred_years, pred_salary FROM scored ORDER BY row_id LIMIT 5", scored=i.SCORED))
def sp8(spark, sf_dir):
    rows = i.view(spark, sf_dir, i.SCORED).select("row_id", "pred_years", "pred_salary")
    return sampling.first_k(rows, "row_id", 5)

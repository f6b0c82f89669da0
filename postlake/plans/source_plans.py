"""SC: sources, sinks and profiles. Sinks write under the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from postlake.functions import quality
from postlake.lists import SHUFFLE_SEED
from postlake.operators import curate, normalize
from postlake.operators.sampling import arithmetic_hash
from postlake.plans import inputs as i
from postlake.plans.curation_plans import gold_english
from postlake.plans.registry import query
from postlake.plans.target_plans import VIEWS, described_sql, logged
from postlake.schemas import EXAMPLE, RAW_POSTING, TARGETS, conform
from postlake.sources import profile, tables
from postlake.sources.scratch import scratch_path

COLUMNS = ["text", *reversed(TARGETS)]
TRAINED = "SELECT {}, text, expected_salary, expected_experience_years FROM training"


def examples(spark, sf_dir):
    return i.view(spark, sf_dir, i.TRAINING)


def _stored_splits(spark, sf_dir):
    folder = scratch_path(spark, "examples")
    for split in tables.SPLITS:
        part = conform(examples(spark, sf_dir).filter(F.col("split") == split), EXAMPLE)
        tables.write_examples(part, f"{folder}/{split}.parquet")
    return folder


@query("sc1_scan_postings", i.with_views("""
SELECT job_id, job_title, description, min_annual_salary_usd, max_annual_salary_usd, country_codes,
  remote, CAST(NULL AS VARCHAR) AS state_code FROM postings""", postings=i.POSTINGS))
def sc1(spark, sf_dir):
    # The stored files lack state_code, which reads as NULL.
    folder = scratch_path(spark, "postings")
    stored = conform(i.view(spark, sf_dir, i.POSTINGS), RAW_POSTING).drop("state_code")
    tables.write_examples(stored, folder)
    return tables.scan_postings(spark, folder)


@query("sc2_scan_examples", i.with_views(TRAINED.format("split"), training=i.TRAINING))
def sc2(spark, sf_dir):
    return tables.scan_examples(spark, _stored_splits(spark, sf_dir))


@query("sc3_write_examples", i.with_views(
    "SELECT text, expected_salary, expected_experience_years FROM training", training=i.TRAINING))
def sc3(spark, sf_dir):
    path = scratch_path(spark, "written")
    tables.write_examples(conform(examples(spark, sf_dir), EXAMPLE), path)
    return spark.read.schema(EXAMPLE).parquet(path)


@query("sc4_append_examples", i.with_views("""
SELECT text, expected_salary, expected_experience_years FROM training
UNION ALL SELECT text, expected_salary, expected_experience_years FROM training WHERE split = 'val'
""", training=i.TRAINING))
def sc4(spark, sf_dir):
    path = scratch_path(spark, "appended")
    tables.write_examples(conform(examples(spark, sf_dir), EXAMPLE), path)
    new = examples(spark, sf_dir).filter("split = 'val'")
    tables.append_examples(conform(new, EXAMPLE), path)
    return spark.read.schema(EXAMPLE).parquet(path)


@query("curate_split_append", i.curated(f"""
SELECT split, text, expected_salary, expected_experience_years FROM training
UNION ALL SELECT CASE WHEN place <= 40 THEN 'train' ELSE 'val' END, text, expected_salary, expected_experience_years
FROM (SELECT *, row_number() OVER (ORDER BY (job_id * 7919 + {SHUFFLE_SEED}) % 10007, job_id) AS place FROM examples)
WHERE place <= 50""", training=i.TRAINING))
def curate_job(spark, sf_dir):
    folder = _stored_splits(spark, sf_dir)
    curate.curate_split_append(
        i.view(spark, sf_dir, i.POSTINGS), gold_english,
        lambda df: df.withColumn("h", arithmetic_hash("job_id", SHUFFLE_SEED)), ["h", "job_id"], folder, 40, 10)
    return tables.scan_examples(spark, folder)


@query("sc5_stats_json", i.with_views(f"""
SELECT '{TARGETS[0]}' AS target, round(my, 6) AS mean, round(sy, 6) AS std FROM stats
UNION ALL SELECT '{TARGETS[1]}', round(ms, 6), round(ss, 6) FROM stats""", **VIEWS))
def sc5(spark, sf_dir):
    path = scratch_path(spark, "norm_stats")
    tables.write_stats(normalize.fit_norm_stats(logged(spark, sf_dir)), path)
    return tables.read_stats(spark, path).select(
        "target", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query("sc6_row_counts", i.with_views("""
SELECT split, count(*) AS n_rows,
  count(*) FILTER (expected_experience_years <> -1 AND expected_salary <> -1) AS n_complete
FROM scored GROUP BY split""", scored=i.SCORED))
def sc6(spark, sf_dir):
    years, salary = map(F.col, TARGETS)
    return profile.row_counts(
        i.view(spark, sf_dir, i.SCORED), quality.has_both_labels(years, salary))


@query("sc7_head", i.with_views("SELECT * FROM scored ORDER BY row_id LIMIT 5", scored=i.SCORED))
def sc7_head(spark, sf_dir):
    return profile.head(i.view(spark, sf_dir, i.SCORED), ["row_id"], 5)


@query("sc7_columns_and_types")
def sc7_columns(spark, sf_dir):
    return profile.column_profile(i.view(spark, sf_dir, i.SCORED))


@query("sc7_profile", i.with_views(
    described_sql("scored", [(t, t) for t in TARGETS]), scored=i.SCORED))
def sc7(spark, sf_dir):
    return profile.describe(i.view(spark, sf_dir, i.SCORED), TARGETS)

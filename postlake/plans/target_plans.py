"""NM and EV: normalisation of targets and error metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from postlake.functions import numeric
from postlake.operators import metrics, normalize
from postlake.plans import inputs as i
from postlake.plans.registry import query
from postlake.schemas import TARGETS

YEARS, SALARY = TARGETS
COMPLETE = "SELECT * FROM scored WHERE expected_experience_years <> -1 AND expected_salary <> -1"
LOGGED = """
SELECT row_id, split, CAST(expected_experience_years AS DOUBLE) AS years, ln(1 + expected_salary) AS salary
FROM complete
"""
STATS = """
SELECT avg(years) AS my, stddev_samp(years) AS sy, avg(salary) AS ms, stddev_samp(salary) AS ss
FROM logged WHERE split = 'train'
"""
VIEWS = {"scored": i.SCORED, "complete": COMPLETE, "logged": LOGGED, "stats": STATS}
NORMED = "SELECT row_id, split, (years - my) / sy AS years, (salary - ms) / ss AS salary FROM logged, stats"


def complete(spark, sf_dir):
    return normalize.drop_missing(i.view(spark, sf_dir, i.SCORED))


def logged(spark, sf_dir):
    return normalize.log_targets(complete(spark, sf_dir).select("row_id", "split", *TARGETS))


def normed(spark, sf_dir):
    rows = logged(spark, sf_dir)
    return normalize.apply_zscore(rows, normalize.fit_norm_stats(rows))


@query("nm1_log1p_salary", i.with_views(
    "SELECT row_id, round(salary, 6) AS salary FROM logged", **VIEWS))
def nm1(spark, sf_dir):
    return logged(spark, sf_dir).select("row_id", F.round(SALARY, 6).alias("salary"))


@query("nm2_fit_norm_stats", i.with_views(f"""
SELECT '{YEARS}' AS target, round(my, 6) AS mean, round(sy, 6) AS std FROM stats
UNION ALL SELECT '{SALARY}', round(ms, 6), round(ss, 6) FROM stats""", **VIEWS))
def nm2(spark, sf_dir):
    stats = normalize.fit_norm_stats(logged(spark, sf_dir))
    return stats.select("target", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query("nm3_apply_zscore", i.with_views("""
SELECT row_id, split, round(years, 6) AS years, round(salary, 6) AS salary FROM normed""",
    **VIEWS, normed=NORMED))
def nm3(spark, sf_dir):
    return normed(spark, sf_dir).select(
        "row_id", "split", F.round(YEARS, 6).alias("years"), F.round(SALARY, 6).alias("salary"))


@query("nm4_denorm", i.with_views("""
SELECT row_id, round(years, 6) AS years FROM logged""", **VIEWS))
def nm4(spark, sf_dir):
    # Undoing the normalisation gives the labels back.
    rows = logged(spark, sf_dir)
    stats = normalize.fit_norm_stats(rows)
    back = numeric.denorm(F.col(YEARS), *normalize.constants(stats)[YEARS])
    return normalize.apply_zscore(rows, stats).select("row_id", F.round(back, 6).alias("years"))


@query("nm5_denorm_salary", i.with_views("""
SELECT row_id, round(CAST(expected_salary AS DOUBLE), 3) AS salary FROM complete""", **VIEWS))
def nm5(spark, sf_dir):
    rows = logged(spark, sf_dir)
    stats = normalize.fit_norm_stats(rows)
    back = numeric.denorm_salary(F.col(SALARY), *normalize.constants(stats)[SALARY])
    return normalize.apply_zscore(rows, stats).select("row_id", F.round(back, 3).alias("salary"))


@query("nm6_safe_int", i.with_views("""
SELECT row_id, CAST(greatest(0, round_even(v, 0)) AS BIGINT) AS n,
  CASE WHEN row_id % 5 = 0 THEN 0 ELSE CAST(greatest(0, round_even(pred_years, 0)) AS BIGINT) END AS years
FROM (SELECT *, row_id / 2.0 - 100 AS v FROM scored)""", scored=i.SCORED))
def nm6(spark, sf_dir):
    broken = F.when(F.col("row_id") % 10 == 0, float("nan")).when(
        F.col("row_id") % 5 == 0, float("inf")).otherwise(F.col("pred_years"))
    return i.view(spark, sf_dir, i.SCORED).select(
        "row_id", numeric.safe_int(F.col("row_id") / 2.0 - 100).alias("n"),
        numeric.safe_int(broken).alias("years"))


def described_sql(table, columns):
    """The oracle's profile of named columns."""
    return " UNION ALL ".join(f"""
SELECT '{label}' AS name, count({c}) AS count, round(avg({c}), 3) AS mean, round(stddev_samp({c}), 3) AS std,
  round(CAST(min({c}) AS DOUBLE), 3) AS min, round(quantile_cont({c}, 0.25), 3) AS p25, round(quantile_cont({c}, 0.5), 3) AS p50,
  round(quantile_cont({c}, 0.75), 3) AS p75, round(CAST(max({c}) AS DOUBLE), 3) AS max FROM {table}""" for label, c in columns)


@query("nm7_norm_check", i.with_views(
    described_sql("(SELECT * FROM normed WHERE split = 'train')", [(YEARS, "years"), (SALARY, "salary")]),
    **VIEWS, normed=NORMED))
def nm7(spark, sf_dir):
    return normalize.norm_check(normed(spark, sf_dir))


def _pair(target):
    pred = "pred_years" if target == YEARS else "pred_salary"
    return F.col(pred), F.col(target)


REPORT_SQL = """
  round(avg(abs(pred_years - expected_experience_years)), 6) AS exp_mae_years,
  round(sqrt(avg(pow(pred_years - expected_experience_years, 2))), 6) AS exp_rmse_years,
  round(avg(CASE WHEN abs(pred_years - expected_experience_years) <= 1 THEN 100.0 ELSE 0.0 END), 6) AS exp_within_1yr,
  round(avg(CASE WHEN abs(pred_years - expected_experience_years) <= 2 THEN 100.0 ELSE 0.0 END), 6) AS exp_within_2yr,
  round(avg(abs(pred_salary - expected_salary)), 4) AS salary_mae_usd,
  round(sqrt(avg(pow(pred_salary - expected_salary, 2))), 4) AS salary_rmse_usd,
  round(avg(CASE WHEN abs(pred_salary - expected_salary) <= 10000 THEN 100.0 ELSE 0.0 END), 6) AS salary_within_10k,
  round(avg(CASE WHEN abs(pred_salary - expected_salary) <= 20000 THEN 100.0 ELSE 0.0 END), 6) AS salary_within_20k
"""
PLACES = {"salary_mae_usd": 4, "salary_rmse_usd": 4}


def rounded(report):
    """Sums of doubles depend on their order; compare a fixed number of places."""
    figures = [c for c in report.columns if c.startswith(("exp_", "salary_"))]
    return report.withColumns({c: F.round(c, PLACES.get(c, 6)) for c in figures})


@query("ev1_mae", i.with_views("""
SELECT round(avg(abs(pred_years - expected_experience_years)), 6) AS years,
  round(avg(abs(pred_salary - expected_salary)), 4) AS salary FROM complete""", **VIEWS))
def ev1(spark, sf_dir):
    return complete(spark, sf_dir).agg(
        F.round(metrics.mae(*_pair(YEARS)), 6).alias("years"),
        F.round(metrics.mae(*_pair(SALARY)), 4).alias("salary"))


@query("ev2_rmse", i.with_views("""
SELECT round(sqrt(avg(pow(pred_years - expected_experience_years, 2))), 6) AS years,
  round(sqrt(avg(pow(pred_salary - expected_salary, 2))), 4) AS salary FROM complete""", **VIEWS))
def ev2(spark, sf_dir):
    return complete(spark, sf_dir).agg(
        F.round(metrics.rmse(*_pair(YEARS)), 6).alias("years"),
        F.round(metrics.rmse(*_pair(SALARY)), 4).alias("salary"))


@query("ev3_within_n", i.with_views("""
SELECT round(avg(CASE WHEN abs(pred_years - expected_experience_years) <= 1 THEN 100.0 ELSE 0.0 END), 6) AS years,
  round(avg(CASE WHEN abs(pred_salary - expected_salary) <= 10000 THEN 100.0 ELSE 0.0 END), 6) AS salary
FROM complete""", **VIEWS))
def ev3(spark, sf_dir):
    return complete(spark, sf_dir).agg(
        F.round(metrics.within_n(*_pair(YEARS), 1), 6).alias("years"),
        F.round(metrics.within_n(*_pair(SALARY), 10_000), 6).alias("salary"))


@query("ev4_eval_report", i.with_views(f"SELECT {REPORT_SQL} FROM complete", **VIEWS))
def ev4(spark, sf_dir):
    return rounded(metrics.eval_report(complete(spark, sf_dir)))


@query("ev5_mse_losses", i.with_views("""
SELECT split, round(le, 4) AS loss_exp, round(ls, 0) AS loss_salary, round(le + ls, 0) AS loss FROM (
  SELECT split, avg(pow(pred_years - expected_experience_years, 2)) AS le,
    avg(pow(pred_salary - expected_salary, 2)) AS ls FROM complete GROUP BY split)""", **VIEWS))
def ev5(spark, sf_dir):
    losses = metrics.mse_losses(complete(spark, sf_dir), "split")
    return losses.select(
        "split", F.round("loss_exp", 4).alias("loss_exp"),
        F.round("loss_salary", 0).alias("loss_salary"), F.round("loss", 0).alias("loss"))


MODEL_NAME = "CASE row_id % 3 WHEN 0 THEN 'small' WHEN 1 THEN 'base' ELSE 'large' END"


@query("ev6_eval_by_slice", i.with_views(f"""
SELECT split, model, count(*) AS n_rows, {REPORT_SQL}
FROM (SELECT *, {MODEL_NAME} AS model FROM complete) GROUP BY ROLLUP (split, model)""", **VIEWS))
def ev6(spark, sf_dir):
    rows = complete(spark, sf_dir).withColumn("model", F.expr(MODEL_NAME))
    return rounded(metrics.eval_by_slice(rows, ["split", "model"], totals=True))


@query("ml3_select_best", i.with_views(f"""
SELECT model, round(loss, 0) AS loss FROM (
  SELECT {MODEL_NAME} AS model, avg(pow(pred_years - expected_experience_years, 2))
    + avg(pow(pred_salary - expected_salary, 2)) AS loss FROM complete WHERE split = 'val' GROUP BY 1)
ORDER BY loss, model LIMIT 1""", **VIEWS))
def ml3(spark, sf_dir):
    rows = complete(spark, sf_dir).filter("split = 'val'").withColumn("model", F.expr(MODEL_NAME))
    best = metrics.select_best(metrics.mse_losses(rows, "model"), "model")
    return best.select("model", F.round("loss", 0).alias("loss"))

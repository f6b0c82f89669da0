"""ML: features, regression, prediction."""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from postlake.lists import PREDICT_SAMPLE_SIZE
from postlake.operators import metrics, modeling, normalize, sampling
from postlake.plans import inputs as i
from postlake.plans.registry import query
from postlake.schemas import TARGETS
from postlake.sources.scratch import scratch_path
from postlake.sources.tables import spread


def training(spark, sf_dir):
    return spread(i.view(spark, sf_dir, i.TRAINING))


def fitted(spark, sf_dir):
    return modeling.TextRegressor.fit(training(spark, sf_dir))


@query("ml1_featurize_text", i.with_views(r"""
SELECT row_id, n AS n_words, CAST(n AS BIGINT) AS n_counted
FROM (SELECT row_id, CAST(len([w FOR w IN regexp_split_to_array(lower(text), '[^\p{L}\p{M}\p{N}\p{Pc}]+') IF w <> '']) AS INTEGER) AS n
      FROM training)""", training=i.TRAINING))
def ml1(spark, sf_dir):
    rows = training(spark, sf_dir)
    pipeline = modeling.featurize_text().fit(rows.filter("split = 'train'"))
    features = pipeline.transform(rows)
    counted = F.aggregate(vector_to_array("counts"), F.lit(0.0), lambda total, n: total + n)
    return features.select(
        "row_id", F.size("words").alias("n_words"), counted.cast("bigint").alias("n_counted"))


@query("ml2_fit_two_target")
def ml2(spark, sf_dir):
    rows = normalize.log_targets(training(spark, sf_dir))
    rows = normalize.apply_zscore(rows, normalize.fit_norm_stats(rows))
    train = rows.filter("split = 'train'")
    featurizer = modeling.featurize_text().fit(train)
    heads = modeling.fit_two_target(featurizer.transform(train), 0.5)
    scored = heads.transform(featurizer.transform(rows)).withColumnsRenamed(
        {"z_years": "pred_years", "z_salary": "pred_salary"})
    return metrics.mse_losses(scored, "split")


@query("ml2_fit_one_feature", i.with_views("""
SELECT 'years' AS target, round(regr_slope(expected_experience_years, n), 6) AS slope,
  round(regr_intercept(expected_experience_years, n), 6) AS intercept FROM lengths
UNION ALL SELECT 'salary', round(regr_slope(expected_salary, n), 6), round(regr_intercept(expected_salary, n), 6)
FROM lengths""", training=i.TRAINING, lengths="""
SELECT CAST(expected_experience_years AS DOUBLE) AS expected_experience_years,
  CAST(expected_salary AS DOUBLE) AS expected_salary, length(text) / 1000.0 AS n FROM training"""))
def ml2_one_feature(spark, sf_dir):
    """Both heads on the text length alone, without penalty: plain least squares."""
    rows = training(spark, sf_dir).withColumn("features", array_to_vector(F.array(F.length("text") / 1000.0)))
    heads = modeling.fit_two_target(rows, 0.0).stages
    lines = [
        F.struct(F.lit(name).alias("target"), F.round(F.lit(float(h.coefficients[0])), 6).alias("slope"),
                 F.round(F.lit(float(h.intercept)), 6).alias("intercept"))
        for name, h in zip(("years", "salary"), heads)
    ]
    return spark.range(1).select(F.inline(F.array(*lines)))


@query("ml4_save_load_model", i.with_views(
    "SELECT row_id, true AS same FROM training", training=i.TRAINING))
def ml4(spark, sf_dir):
    """Whether the model gives every row the same predictions before and after a reload."""
    path = scratch_path(spark, "model")
    model, rows = fitted(spark, sf_dir), training(spark, sf_dir).select("row_id", "text")
    model.save(path)
    renamed = {"pred_years": "years_before", "pred_salary": "salary_before"}
    before = model.predict(rows).withColumnsRenamed(renamed)
    both = modeling.TextRegressor.load(spark, path).predict(before)
    same = F.col("pred_years").eqNullSafe(F.col("years_before")) & F.col("pred_salary").eqNullSafe(F.col("salary_before"))
    return both.select("row_id", same.alias("same"))


@query("ev4_eval_fitted_model")
def ev4_fitted(spark, sf_dir):
    """The report on the fitted model's own predictions for the rows held out as test."""
    test = training(spark, sf_dir).filter("split = 'test'")
    return metrics.eval_report(fitted(spark, sf_dir).predict(test))


@query("ml6_predict_sample")
def ml6_sample(spark, sf_dir):
    """Sample, predict, compare."""
    drawn = sampling.sample_n(
        training(spark, sf_dir).withColumn("h", sampling.order_hash("row_id", seed=42)), ["h", "row_id"], PREDICT_SAMPLE_SIZE)
    return modeling.compare_predictions(fitted(spark, sf_dir).predict(drawn), "row_id")


@query("ml5_predict_batch")
def ml5(spark, sf_dir):
    predicted = fitted(spark, sf_dir).predict(training(spark, sf_dir))
    return predicted.select("row_id", *TARGETS, "pred_years", "pred_salary")


def length_model():
    """A stand-in for an external model: normalised targets from the text length."""
    def predict(texts: np.ndarray) -> np.ndarray:
        n = np.array([len(t) for t in texts], dtype=np.int64)
        return np.stack([(n % 5) / 4 - 0.5, (n % 9) / 8 - 0.5], axis=1).astype(np.float32)
    return predict


STATS_SQL = """
SELECT avg(expected_experience_years) AS my, stddev_samp(expected_experience_years) AS sy,
  avg(ln(1 + expected_salary)) AS ms, stddev_samp(ln(1 + expected_salary)) AS ss
FROM training WHERE split = 'train'
"""
EXTERNAL_SQL = i.with_views("""
SELECT row_id,
  CAST(greatest(0, round_even(CAST((n % 5) / 4.0 - 0.5 AS DOUBLE) * sy + my, 0)) AS INTEGER) AS pred_years,
  CAST(greatest(0, round_even(exp(CAST((n % 9) / 8.0 - 0.5 AS DOUBLE) * ss + ms) - 1, 0)) AS BIGINT) AS pred_salary
FROM (SELECT *, length(text) AS n FROM training), stats""", training=i.TRAINING, stats=STATS_SQL)


@query("ml5_predict_external", EXTERNAL_SQL)
def ml5_external(spark, sf_dir):
    rows = training(spark, sf_dir)
    stats = normalize.fit_norm_stats(normalize.log_targets(rows))
    predicted = modeling.predict_external(rows, length_model, stats)
    return predicted.select("row_id", "pred_years", "pred_salary")


@query("ml6_compare_predictions", i.with_views("""
SELECT row_id, (CAST(expected_experience_years AS BIGINT) + 1) || ' vs ' || expected_experience_years AS exp,
  '$' || format('{:,}', expected_salary + 500) || ' vs ' || '$' || format('{:,}', expected_salary) AS salary,
  replace(left(text, 80), chr(10), ' ') AS preview FROM training""", training=i.TRAINING))
def ml6(spark, sf_dir):
    rows = training(spark, sf_dir).withColumns({
        "pred_years": F.col("expected_experience_years") + 1,
        "pred_salary": F.col("expected_salary") + 500,
    })
    return modeling.compare_predictions(rows, "row_id")

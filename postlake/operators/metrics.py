"""Error metrics of predictions against labels (EV family)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def mae(pred: Column, label: Column) -> Column:
    """EV1: mean absolute error."""
    return F.avg(F.abs(pred - label))


def mse(pred: Column, label: Column) -> Column:
    """EV5: mean squared error over rows, not over batches."""
    return F.avg(F.pow(pred - label, F.lit(2.0)))


def rmse(pred: Column, label: Column) -> Column:
    """EV2: root mean squared error."""
    return F.sqrt(mse(pred, label))


def within_n(pred: Column, label: Column, n: float) -> Column:
    """EV3: percent of rows off by at most n."""
    return F.avg((F.abs(pred - label) <= n).cast("double")) * 100


def report_columns(
    pred_years: Column, years: Column, pred_salary: Column, salary: Column
) -> list[Column]:
    """The eight figures of the report as aggregates of one pass."""
    return [
        mae(pred_years, years).alias("exp_mae_years"),
        rmse(pred_years, years).alias("exp_rmse_years"),
        within_n(pred_years, years, 1).alias("exp_within_1yr"),
        within_n(pred_years, years, 2).alias("exp_within_2yr"),
        mae(pred_salary, salary).alias("salary_mae_usd"),
        rmse(pred_salary, salary).alias("salary_rmse_usd"),
        within_n(pred_salary, salary, 10_000).alias("salary_within_10k"),
        within_n(pred_salary, salary, 20_000).alias("salary_within_20k"),
    ]


def _scored_columns() -> list[Column]:
    return report_columns(
        F.col("pred_years"), F.col("expected_experience_years"),
        F.col("pred_salary"), F.col("expected_salary"),
    )


def eval_report(scored: DataFrame) -> DataFrame:
    """EV4: one row."""
    return scored.agg(*_scored_columns())


def eval_by_slice(scored: DataFrame, slices: list[str], totals: bool = False) -> DataFrame:
    """EV6: the report per slice; with `totals` also per prefix of `slices` and overall."""
    grouped = scored.rollup(*slices) if totals else scored.groupBy(*slices)
    return grouped.agg(F.count(F.lit(1)).alias("n_rows"), *_scored_columns())


def mse_losses(scored: DataFrame, *by: str) -> DataFrame:
    """EV5: loss per target and their sum, per group of `by`."""
    losses = scored.groupBy(*by).agg(
        mse(F.col("pred_years"), F.col("expected_experience_years")).alias("loss_exp"),
        mse(F.col("pred_salary"), F.col("expected_salary")).alias("loss_salary"),
    )
    return losses.withColumn("loss", F.col("loss_exp") + F.col("loss_salary"))


def select_best(losses: DataFrame, candidate: str) -> DataFrame:
    """ML3: the candidate with the lowest loss, the first one on a tie."""
    return losses.orderBy("loss", candidate).limit(1)

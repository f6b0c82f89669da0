"""Two-target text regression on Spark ML (ML family)."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
from pyspark.ml.functions import predict_batch_udf
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, FloatType

from postlake.functions import numeric
from postlake.functions.text import format_dollars, preview
from postlake.lists import PREDICT_BATCH_SIZE
from postlake.operators.metrics import mse_losses
from postlake.operators.normalize import (
    SALARY,
    YEARS,
    apply_zscore,
    constants,
    fit_norm_stats,
    log_targets,
)
from postlake.sources.scratch import cut_lineage
from postlake.sources.tables import read_stats, write_stats

FEATURES = 1 << 9
REG_PARAMS = (0.05, 0.5, 2.0)


def featurize_text(features: int = FEATURES) -> Pipeline:
    """ML1: words of any script, hashed term counts, inverse document frequency."""
    return Pipeline(stages=[
        RegexTokenizer(inputCol="text", outputCol="words", pattern=r"(?U)\W+"),
        HashingTF(inputCol="words", outputCol="counts", numFeatures=features),
        IDF(inputCol="counts", outputCol="features"),
    ])


def fit_two_target(train: DataFrame, reg_param: float) -> PipelineModel:
    """ML2: one regression per target on shared features, squared loss with L2 penalty.

    The normal equations need one pass over the rows; their matrix is bounded by
    the number of features squared, which featurize_text fixes.
    """
    def regression(target: str, output: str) -> LinearRegression:
        return LinearRegression(
            featuresCol="features", labelCol=target, predictionCol=output,
            regParam=reg_param, solver="normal",
        )
    stages = [regression(YEARS, "z_years"), regression(SALARY, "z_salary")]
    return Pipeline(stages=stages).fit(train)


def candidate_losses(
    candidates: dict[float, PipelineModel], validation: DataFrame
) -> dict[float, float]:
    """Summed validation loss of each candidate, a few numbers each."""
    losses = {}
    for reg_param, model in candidates.items():
        scored = model.transform(validation).withColumnsRenamed(
            {"z_years": "pred_years", "z_salary": "pred_salary"}
        )
        losses[reg_param] = mse_losses(scored).first()["loss"]
    return losses


@dataclass
class TextRegressor:
    """Fitted features, the best pair of regressions and the train statistics."""

    features: PipelineModel
    heads: PipelineModel
    stats: DataFrame
    losses: dict[float, float]

    @classmethod
    def fit(
        cls, examples: DataFrame, features: int = FEATURES,
        reg_params: Iterable[float] = REG_PARAMS,
    ) -> "TextRegressor":
        """ML1-ML3 on complete examples with a `split` column.

        Term counts and normalised targets are written once; document frequencies are
        fitted on them and features are their product with the weights, so texts are cut
        into words once, and every candidate reads the written counts.
        """
        logged = log_targets(examples)
        stats = cut_lineage(fit_norm_stats(logged), "stats")
        *counting, weighting = featurize_text(features).getStages()
        counted = cut_lineage(
            PipelineModel(counting).transform(apply_zscore(logged, stats)).select("split", "counts", YEARS, SALARY),
            "counts",
        )
        featurizer = PipelineModel([*counting, weighting.fit(counted.filter("split = 'train'"))])
        ready = featurizer.stages[-1].transform(counted).select("split", "features", YEARS, SALARY)
        train, validation = ready.filter("split = 'train'"), ready.filter("split = 'val'")
        candidates = {r: fit_two_target(train, r) for r in reg_params}
        losses = candidate_losses(candidates, validation)
        best = min(losses, key=lambda r: losses[r])
        return cls(featurizer, candidates[best], stats, losses)

    def predict(self, texts: DataFrame) -> DataFrame:
        """ML5: predictions in years and dollars next to the input columns."""
        scored = self.heads.transform(self.features.transform(texts))
        return scored.select(
            *texts.columns, *real_predictions(self.stats, F.col("z_years"), F.col("z_salary"))
        )

    def save(self, path: str) -> None:
        """ML4"""
        self.features.write().overwrite().save(f"{path}/features")
        self.heads.write().overwrite().save(f"{path}/heads")
        write_stats(self.stats, f"{path}/norm_stats")
        rows = [(float(r), float(loss)) for r, loss in self.losses.items()]
        spark = self.stats.sparkSession
        spark.createDataFrame(rows, "reg_param double, val_loss double").coalesce(1) \
            .write.mode("overwrite").json(f"{path}/losses")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "TextRegressor":
        """ML4"""
        losses = spark.read.schema("reg_param double, val_loss double").json(f"{path}/losses")
        return cls(
            PipelineModel.load(f"{path}/features"),
            PipelineModel.load(f"{path}/heads"),
            read_stats(spark, f"{path}/norm_stats"),
            {r["reg_param"]: r["val_loss"] for r in losses.collect()},
        )


def real_predictions(stats: DataFrame, z_years: Column, z_salary: Column) -> list[Column]:
    """Normalised predictions as whole years and dollars."""
    train = constants(stats)
    years = numeric.safe_int(numeric.denorm(z_years, *train[YEARS]))
    salary = numeric.safe_int(numeric.denorm_salary(z_salary, *train[SALARY]))
    return [years.cast("int").alias("pred_years"), salary.alias("pred_salary")]


def predict_external(
    texts: DataFrame,
    make_predict: Callable[[], Callable[[np.ndarray], np.ndarray]],
    stats: DataFrame,
    batch_size: int = PREDICT_BATCH_SIZE,
) -> DataFrame:
    """ML5 with an injected model: text batch to an (n, 2) array of normalised targets."""
    predicted = predict_batch_udf(
        make_predict, return_type=ArrayType(FloatType()), batch_size=batch_size
    )(F.col("text"))
    scored = texts.withColumn("z", predicted)
    z_years, z_salary = (F.col("z")[i].cast("double") for i in (0, 1))
    return scored.select(*texts.columns, *real_predictions(stats, z_years, z_salary))


def compare_predictions(predicted: DataFrame, key: str) -> DataFrame:
    """ML6: predicted against expected with a text preview."""
    return predicted.select(
        key,
        F.concat_ws(" vs ", F.col("pred_years"), F.col(YEARS)).alias("exp"),
        F.concat_ws(
            " vs ", format_dollars(F.col("pred_salary")), format_dollars(F.col(SALARY))
        ).alias("salary"),
        preview(F.col("text")).alias("preview"),
    )

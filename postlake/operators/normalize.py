"""Target normalisation with train statistics (NM1-NM3, NM7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from postlake.functions import numeric, quality
from postlake.schemas import TARGETS
from postlake.sources.profile import describe

YEARS, SALARY = TARGETS


def drop_missing(df: DataFrame) -> DataFrame:
    """FL12: rows with both labels."""
    return df.filter(quality.has_both_labels(F.col(YEARS), F.col(SALARY)))


def log_targets(df: DataFrame) -> DataFrame:
    """NM1: salary on the log1p scale, on every split; years as double."""
    return df.withColumns({
        YEARS: F.col(YEARS).cast("double"),
        SALARY: numeric.log1p_salary(F.col(SALARY)),
    })


def fit_norm_stats(df: DataFrame) -> DataFrame:
    """NM2: mean and sample deviation per target, train rows only, in one pass."""
    pairs = [
        F.struct(
            F.lit(t).alias("target"), F.avg(t).alias("mean"), F.stddev_samp(t).alias("std")
        ) for t in TARGETS
    ]
    return df.filter("split = 'train'").agg(F.array(*pairs).alias("s")).select(F.inline("s"))


def constants(stats: DataFrame) -> dict[str, tuple[Column, Column]]:
    """Mean and deviation per target as columns of any query.

    All four come from one scalar subquery, which runs once and is joined with
    nothing.
    """
    def of(target: str) -> Column:
        return F.max(F.when(F.col("target") == target, F.struct("mean", "std"))).alias(target)

    row = stats.agg(*map(of, TARGETS)).select(F.struct(*TARGETS)).scalar()
    return {t: (row[t]["mean"], row[t]["std"]) for t in TARGETS}


def apply_zscore(df: DataFrame, stats: DataFrame) -> DataFrame:
    """NM3: every split with the train statistics."""
    train = constants(stats)
    return df.withColumns({t: numeric.zscore(F.col(t), *train[t]) for t in TARGETS})


def norm_check(normalised: DataFrame) -> DataFrame:
    """NM7: profile of the normalised train targets."""
    return describe(normalised.filter("split = 'train'"), TARGETS)

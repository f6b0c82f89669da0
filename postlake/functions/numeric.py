"""Normalisation arithmetic and the integer guard for predictions (NM family)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def log1p_salary(salary: Column) -> Column:
    """NM1"""
    return F.log1p(salary.cast("double"))


def zscore(value: Column, mean: Column, std: Column) -> Column:
    """NM3: NULL where the spread is zero."""
    return F.try_divide(value - mean, std)


def denorm(value: Column, mean: Column, std: Column) -> Column:
    """NM4"""
    return value * std + mean


def denorm_salary(value: Column, mean: Column, std: Column) -> Column:
    """NM5"""
    return F.expm1(denorm(value, mean, std))


def safe_int(value: Column) -> Column:
    """NM6: round half to even, never below 0; NULL, NaN and infinity give 0."""
    v = value.cast("double")
    positive = (v > 0) & ~F.isnan(v) & (v != float("inf"))
    whole = F.coalesce(F.rint(v).try_cast("bigint"), F.lit(2**63 - 1))
    return F.when(positive, whole).otherwise(F.lit(0).cast("bigint"))

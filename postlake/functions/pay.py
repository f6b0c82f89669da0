"""Expected salary from the posted bounds (SA family)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def parse_pay_bound(bound: Column) -> Column:
    """SA1: whole dollars, truncated toward zero; NULL and NaN give NULL."""
    return F.nullif(bound, F.lit(float("nan"))).try_cast("bigint")


def expected_salary(low: Column, high: Column) -> Column:
    """SA2: midpoint of both bounds, else the one given, else -1.

    Zero and reversed bounds are accepted. The sum is taken in double precision,
    so bounds near the end of the bigint range cannot overflow.
    """
    lo, hi = parse_pay_bound(low), parse_pay_bound(high)
    midpoint = ((lo.cast("double") + hi.cast("double")) / F.lit(2.0)).try_cast("bigint")
    return F.coalesce(midpoint, lo, hi, F.lit(-1).cast("bigint"))

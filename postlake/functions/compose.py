"""Helpers for values that several later steps read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F


def derive(df: DataFrame, keep: list[str], **columns: Column) -> DataFrame:
    """Select `keep` plus `columns`, computing each derived column once per row.

    A plain `select` followed by a filter on its result lets the optimizer copy
    the expression into the filter below, so costly text cleaning would run twice
    for every row kept. A one-element `inline` is a generator, which filters do
    not move through; it stays inside whole-stage codegen.
    """
    packed = F.struct(*[expr.alias(name) for name, expr in columns.items()])
    return df.select(*keep, F.inline(F.array(packed)))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` computed once, however often `body` mentions it."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))

"""Building JSON text out of JSON fragments held in columns."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, functions as F


def as_json(value: Any) -> Column:
    """A Python value as a JSON literal; a string column as a JSON string."""
    if isinstance(value, Column):
        # A one-element array without its brackets; a string keeps its quotes.
        return F.when(value.isNotNull(), F.btrim(F.to_json(F.array(value)), F.lit("[]")))
    return F.lit(json.dumps(value, ensure_ascii=False, separators=(",", ":")))


def fields(members: dict[str, Column]) -> Column:
    """`"key":value` pairs with commas; a member whose fragment is NULL is left out."""
    return F.concat_ws(",", *[F.concat(F.lit(f'"{k}":'), v) for k, v in members.items()])


def json_object(members: dict[str, Column]) -> Column:
    return F.concat(F.lit("{"), fields(members), F.lit("}"))


def not_empty(text: Column) -> Column:
    """NULL for the empty string, so that `concat_ws` leaves it out."""
    return F.nullif(text, F.lit(""))

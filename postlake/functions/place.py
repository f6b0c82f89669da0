"""Location label and the rendered posting text (GE family)."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, functions as F

from postlake.functions.compose import let
from postlake.lists import COUNTRY_NAMES, US_STATE_NAMES

STRICT_JSON = {"allowSingleQuotes": "false"}
RENDERED = r"(?s)\A\[LOCATION\]: (.*?) \[TITLE\]: (.*?) \[DESC\]: (.*)\z"


def _lookup(names: dict[str, str], code: Column, fallback: Column) -> Column:
    entries = ", ".join(f"'{text}'" for text in chain.from_iterable(names.items()))
    return F.coalesce(F.try_element_at(F.expr(f"map({entries})"), code), fallback)


def first_country(codes: Column) -> Column:
    """GE1: first element of a JSON array of codes, '' when there is none.

    Malformed JSON, NULL, `[]`, `[null]` and `[""]` give ''. A JSON string gives
    its first character, as indexing a string does. Wrapping the value in
    brackets before parsing makes trailing text after the array an error.
    """
    wrapped = F.from_json(F.concat(F.lit("["), codes, F.lit("]")), "array<string>", STRICT_JSON)

    def chosen(values: Column) -> Column:
        value = F.when(F.size(values) == 1, F.get(values, F.lit(0)))
        listed = F.get(F.from_json(value, "array<string>", STRICT_JSON), F.lit(0))
        is_text = F.startswith(F.ltrim(codes), F.lit('"'))
        return F.when(is_text, F.left(value, F.lit(1))).otherwise(listed)

    return F.coalesce(let(wrapped, chosen), F.lit(""))


def country_name(code: Column) -> Column:
    """GE2: case-sensitive; an unknown code stands for itself."""
    return _lookup(COUNTRY_NAMES, code, code)


def state_name(code: Column) -> Column:
    """GE3: looked up in upper case; an unknown code keeps its own case."""
    given = F.coalesce(code, F.lit(""))
    return _lookup(US_STATE_NAMES, F.upper(given), given)


def location_label(remote: Column, country: Column, state: Column) -> Column:
    """GE4: remote first, then unknown, then US with state, then country."""
    us = F.trim(F.concat_ws(" ", country_name(country), state_name(state)))
    return (
        F.when(F.coalesce(remote, F.lit(0)) != 0, "Remote")
        .when(country == "", "Unknown")
        .when(country == "US", us)
        .otherwise(country_name(country))
    )


def render_text(location: Column, title: Column, description: Column) -> Column:
    """GE5"""
    return F.concat(
        F.lit("[LOCATION]: "), location, F.lit(" [TITLE]: "), title,
        F.lit(" [DESC]: "), description,
    )


def parse_rendered_text(text: Column) -> dict[str, Column]:
    """GE7: location, title and description back out of a rendered text."""
    parts = ["location", "title", "description"]
    return {p: F.regexp_extract(text, RENDERED, i) for i, p in enumerate(parts, start=1)}

"""Parsing of labelling replies (LB8-LB10)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from postlake.functions import charclass
from postlake.functions.compose import let
from postlake.functions.text import SPACE_CLASS
from postlake.lists import MAX_YEARS

FENCE = "```"
NUMERIC_TYPES = r"^(BIGINT|DOUBLE|FLOAT|DECIMAL.*|BOOLEAN)$"


def _trim_space(text: Column) -> Column:
    return F.regexp_replace(text, rf"\A[{SPACE_CLASS}]++|[{SPACE_CLASS}]++\z", "")


def _ascii_digits(text: Column) -> Column:
    given, plain = charclass.decimal_digits()
    return F.when(
        F.octet_length(text) > F.char_length(text), F.translate(text, given, plain)
    ).otherwise(text)


def parse_years_only(reply: Column) -> Column:
    """LB8: the first whole number of one or two digits within 0..20."""
    numbers = F.regexp_extract_all(_ascii_digits(reply), F.lit(r"(?U)\b(\d{1,2})\b"), F.lit(1))
    years = F.transform(numbers, lambda n: n.try_cast("int"))
    return F.get(F.filter(years, lambda n: n.between(0, MAX_YEARS)), F.lit(0))


def strip_code_fence(reply: Column) -> Column:
    """LB9: drop a leading fence line, language tag included, and the closing fence."""
    def unfenced(trimmed: Column) -> Column:
        opened = F.regexp_replace(trimmed, rf"(?U)\A{FENCE}\w*\n?", "")
        closed = F.regexp_replace(opened, rf"\n?{FENCE}[{SPACE_CLASS}]*\z", "")
        return F.when(F.startswith(trimmed, F.lit(FENCE)), closed).otherwise(trimmed)

    return let(_trim_space(reply), unfenced)


def parse_years_and_price(reply: Column) -> Column:
    """LB10: struct(years, expected_salary) from a JSON object, NULL if it fails.

    `years` must be a JSON number or boolean and land in 0..20 once truncated. The
    salary may be absent or null, a number, or a string holding an integer
    (underscores may separate its digits); any other salary fails the whole reply.
    The value is parsed inside brackets so that text after the object is an error.
    """
    def parsed(body: Column) -> Column:
        framed = F.startswith(body, F.lit("{")) & F.endswith(body, F.lit("}"))
        return F.when(framed, F.try_parse_json(F.concat(F.lit("["), body, F.lit("]"))))

    return let(let(_trim_space(strip_code_fence(reply)), parsed), _years_and_price)


def _years_and_price(parsed: Column) -> Column:
    def at(path: str, kind: str) -> Column:
        return F.try_variant_get(parsed, path, kind)

    def kind_of(path: str) -> Column:
        return F.schema_of_variant(at(path, "variant"))

    def whole(path: str) -> Column:
        truth = F.when(kind_of(path) == "BOOLEAN", at(path, "boolean").cast("bigint"))
        return F.coalesce(truth, at(path, "double").try_cast("bigint"))

    years_path, salary_path = "$[0].years", "$[0].expected_salary"
    years = F.when(kind_of(years_path).rlike(NUMERIC_TYPES), whole(years_path))
    salary_kind = F.coalesce(kind_of(salary_path), F.lit("VOID"))
    salary_text = _trim_space(_ascii_digits(at(salary_path, "string")))
    salary = F.when(salary_kind.rlike(NUMERIC_TYPES), whole(salary_path)).when(
        salary_kind == "STRING", F.replace(salary_text, F.lit("_"), F.lit("")).try_cast("bigint")
    )
    salary_ok = (
        (salary_kind == "VOID")
        | salary_kind.rlike(NUMERIC_TYPES)
        | ((salary_kind == "STRING") & salary_text.rlike(r"\A[+-]?[0-9]+(_[0-9]+)*\z"))
    )
    alone = at("$[1]", "variant").isNull()
    accepted = alone & years.between(0, MAX_YEARS) & salary_ok
    return F.when(
        accepted,
        F.struct(years.cast("int").alias("years"), salary.alias("expected_salary")),
    )

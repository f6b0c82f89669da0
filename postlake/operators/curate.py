"""Raw postings to labelled examples (FL7, FL8, GE6)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from postlake.functions import pay, place, quality
from postlake.functions.compose import derive
from postlake.functions.text import combine_text, preprocess_text
from postlake.lists import NEW_TRAIN_SIZE, NEW_VAL_SIZE
from postlake.operators.sampling import positional_split
from postlake.schemas import EXAMPLE, conform
from postlake.sources.scratch import cut_lineage
from postlake.sources.tables import append_examples

KEPT = "kept"

English = Callable[[Column], Column]


RAW_FIELDS = {"title": "job_title", "desc": "description"}


def clean_fields(df: DataFrame, fields: tuple[str, ...] = ("title", "desc")) -> DataFrame:
    """Replace the raw title and description by cleaned `title` and `desc`, or by those of
    `fields` alone: what is not asked for is neither cleaned nor read."""
    rest = [c for c in df.columns if c not in RAW_FIELDS.values()]
    return derive(df, rest, **{f: preprocess_text(F.col(RAW_FIELDS[f])) for f in fields})


def with_skip_reason(df: DataFrame, english: English) -> DataFrame:
    """FL7: cleaned rows with the first failing check, NULL when none fails.

    `english` maps the combined text to a boolean column. Every row is asked,
    because the reason depends on the language even for denied titles.
    """
    title, desc = F.col("title"), F.col("desc")
    reason = quality.skip_reason(title, desc, english(combine_text(title, desc)))
    return clean_fields(df).withColumn("skip_reason", reason)


def funnel(reasons: DataFrame) -> DataFrame:
    """FL8: rows per skip reason and rows kept; reasons that never occur count 0."""
    reason = F.col("skip_reason")
    counts = reasons.agg(
        *[F.count_if(F.coalesce(reason == r, F.lit(False))).alias(r) for r in quality.SKIP_REASONS],
        F.count_if(reason.isNull()).alias(KEPT),
    )
    return counts.unpivot([], [*quality.SKIP_REASONS, KEPT], "skip_reason", "n")


def build_examples(df: DataFrame, english: English, key: str = "job_id") -> DataFrame:
    """GE6: clean, filter, price, locate and render postings.

    Only clean rows are wanted here, so rows without a title or description leave at
    the scan, and the language check, the costly one, runs after the deny lists.
    """
    title, desc = F.col("title"), F.col("desc")
    present = F.col("job_title").isNotNull() & F.col("description").isNotNull()
    kept = (
        clean_fields(df.filter(present))
        .filter(quality.has_title_desc(title, desc))
        .filter(~quality.title_numeric_only(title) & ~quality.should_skip_title(title))
        .filter(english(combine_text(title, desc)))
    )
    location = place.location_label(F.col("remote"), F.col("country"), F.col("state_code"))
    priced = pay.expected_salary(F.col("min_annual_salary_usd"), F.col("max_annual_salary_usd"))
    return derive(
        kept, [key, "title", "desc", "remote", "state_code",
               "min_annual_salary_usd", "max_annual_salary_usd"],
        country=place.first_country(F.col("country_codes")),
    ).select(
        key,
        place.render_text(location, title, desc).alias("text"),
        priced.alias("expected_salary"),
        F.lit(-1).cast("bigint").alias("expected_experience_years"),
    )


def curate_split_append(
    postings: DataFrame, english: English, order: Callable[[DataFrame], DataFrame], keys: list[str], folder: str,
    n_train: int = NEW_TRAIN_SIZE, n_val: int = NEW_VAL_SIZE,
) -> None:
    """The curation job: clean and filter postings, draw a sample, split it, and append it to
    the tables `train.parquet` and `val.parquet` of `folder`; `test.parquet` is left alone.

    `order` adds the `keys` that the sample is drawn by. Examples are written once before
    they are drawn from, so texts are cleaned and scored once.
    """
    examples = cut_lineage(order(build_examples(postings, english)), "curated")
    drawn = positional_split(examples, keys, n_train, n_val)
    for split in ("train", "val"):
        append_examples(conform(drawn.filter(F.col("split") == split), EXAMPLE), f"{folder}/{split}.parquet")

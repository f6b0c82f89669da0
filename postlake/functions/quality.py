"""Row predicates of the curation and labelling jobs (FL family)."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, functions as F

from postlake.functions import charclass
from postlake.lists import ENGLISH_THRESHOLD, SKIP_TITLE_FRAGMENTS, SKIP_TITLES
from postlake.schemas import is_missing

SKIP_REASONS = ["no_title_desc", "title_numeric", "not_english", "skip_jobs"]


def has_title_desc(title: Column, description: Column) -> Column:
    """FL1, on cleaned text."""
    return (title != "") & (description != "")


def title_numeric_only(title: Column) -> Column:
    """FL2, on cleaned text: nothing but digits and spaces (empty counts)."""
    return title.rlike(rf"\A[{charclass.digits()}\x20]*\z")


def is_confident_english(lang: Column, probability: Column) -> Column:
    """FL3: labelled English with probability above, not at, the threshold."""
    return (lang == "en") & (probability > ENGLISH_THRESHOLD)


def skip_title_exact(title: Column) -> Column:
    """FL4: case-sensitive membership in the deny list."""
    return title.isin(SKIP_TITLES)


def skip_title_substring(title: Column) -> Column:
    """FL5: the lower-cased title contains a denied fragment anywhere."""
    lowered = F.lower(title)
    return reduce(or_, [F.contains(lowered, F.lit(x)) for x in SKIP_TITLE_FRAGMENTS])


def should_skip_title(title: Column) -> Column:
    """FL6"""
    return skip_title_exact(title) | skip_title_substring(title)


def skip_reason(title: Column, description: Column, english: Column) -> Column:
    """FL7: the first check that fails, NULL for a clean row."""
    failed = [
        ~has_title_desc(title, description),
        title_numeric_only(title),
        ~english,
        should_skip_title(title),
    ]
    reason = F.when(failed[0], SKIP_REASONS[0])
    for check, name in zip(failed[1:], SKIP_REASONS[1:]):
        reason = reason.when(check, name)
    return reason


def needs_work(years: Column, salary: Column) -> Column:
    """FL10: either label is missing."""
    return is_missing(years) | is_missing(salary)


def has_valid_pay(salary: Column) -> Column:
    """FL11"""
    return ~is_missing(salary)


def has_both_labels(years: Column, salary: Column) -> Column:
    """FL12"""
    return ~needs_work(years, salary)

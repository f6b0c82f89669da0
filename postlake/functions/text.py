"""Text cleaning and display expressions (TX family).

All of these are `Column -> Column` and stay in the JVM, NFKC included: Spark
ships ICU for its collations, and `java_method` reaches its normalizer. Being an
ordinary expression it is skipped by `when` for ASCII-only text.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from postlake.functions import charclass
from postlake.lists import PREVIEW_CHARS, PROMPT_CHARS

# The whitespace code points of Python's `\s`.
SPACE_CLASS = (
    r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a"
    r"\u2028\u2029\u202f\u205f\u3000"
)


def nfkc(text: Column) -> Column:
    """TX2: Unicode NFKC; only text with non-ASCII characters is normalised."""
    composed = F.java_method(
        F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True)
    )
    return F.when(F.octet_length(text) > F.char_length(text), composed).otherwise(text)


def strip_tags(text: Column) -> Column:
    """TX3: each `<...>` becomes a space; may span lines, entities are kept."""
    return F.regexp_replace(text, r"<[^>]++>", " ")


def strip_urls(text: Column) -> Column:
    """TX4: each http(s):// or www. run of non-space becomes a space.

    The look-ahead rejects most characters before the alternatives are tried.
    """
    return F.regexp_replace(text, rf"(?=[hw])(?:https?://|www\.)[^{SPACE_CLASS}]++", " ")


def collapse_ws(text: Column) -> Column:
    """TX5: each whitespace run becomes one space.

    A run that is one space already is left alone, and printable ASCII is rejected
    by one range check.
    """
    space = rf"[[^!-~]&&[{SPACE_CLASS}]]"
    other_space = rf"[[^\x20-~]&&[{SPACE_CLASS}]]"
    return F.regexp_replace(text, rf"\x20{space}++|{other_space}{space}*+", " ")


def drop_control(text: Column) -> Column:
    """TX6: remove control, format, private-use and unassigned characters.

    Java's own table of characters may be older than Python's, so a character
    that Java calls unassigned goes only if Python puts it in category C too. The
    first class lets plain ASCII pass without looking at the rest.
    """
    known = r"\p{Cc}\p{Cf}\p{Co}\p{Cs}"
    newer = rf"[\p{{Cn}}&&[{charclass.other_category()}]]"
    return F.regexp_replace(text, rf"[[^\x20-\x7e]&&[{known}{newer}]]", "")


def strip(text: Column) -> Column:
    """TX7: outer spaces off. After TX5 no other whitespace is left."""
    return F.trim(text)


def preprocess_text(text: Column) -> Column:
    """TX1: the whole cleaning chain; the order of the steps matters.

    Each step mentions its input once, so the chain is evaluated once.
    """
    cleaned = F.coalesce(nfkc(text), F.lit(""))
    for step in (strip_tags, strip_urls, collapse_ws, drop_control, strip):
        cleaned = step(cleaned)
    return cleaned


def combine_text(title: Column, description: Column) -> Column:
    """TX8"""
    return F.concat_ws(" ", title, description)


def truncate_prompt(text: Column, chars: int = PROMPT_CHARS) -> Column:
    """TX9: the first `chars` code points; NULL gives the empty string."""
    return F.substring(F.coalesce(text, F.lit("")), 1, chars)


def preview(text: Column, chars: int = PREVIEW_CHARS) -> Column:
    """TX10: the first `chars` code points on one line."""
    return F.translate(F.substring(text, 1, chars), "\n", " ")


def format_dollars(amount: Column) -> Column:
    """TX11: whole dollars with thousands separators."""
    return F.concat(F.lit("$"), F.format_number(amount, 0))


def format_fixed(value: Column, places: int) -> Column:
    """TX11: a fixed number of decimals."""
    return F.printf(F.lit(f"%.{places}f"), value.cast("double"))

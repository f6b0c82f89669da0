from __future__ import annotations

import re
import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from postlake.functions import text as tx

POINTS = [p for p in range(1, 0x110000) if not 0xD800 <= p <= 0xDFFF]
# Outlined letters that are newer than Python's tables: dropped by the rule,
# normalised to plain letters by Spark's ICU.
NEWER = range(0x1CCD6, 0x1CCFA)


def cleaned(text: str) -> str:
    """The cleaning rule in plain Python."""
    text = unicodedata.normalize("NFKC", text.strip())
    for pattern in (r"<[^>]+>", r"https?://\S+|www\.\S+", r"\s+"):
        text = re.sub(pattern, " ", text)
    return "".join(c for c in text if unicodedata.category(c)[0] != "C").strip()


def test_every_code_point(spark):
    rows = spark.createDataFrame([(p, f"a{chr(p)} b") for p in POINTS], "p int, s string")
    out = rows.select("p", "s", tx.preprocess_text(F.col("s")).alias("out")).toPandas()
    wrong = [p for p, s, o in zip(out.p, out.s, out.out) if o != cleaned(s)]
    assert set(wrong) <= set(NEWER)


@pytest.mark.parametrize("given_text, expected", [
    (None, ""), ("", ""), ("  a \n\t b ", "a b"), ("<b>x</b>", "x"), ("<a\nhref='q'>x", "x"),
    ("a < b and c > d", "a d"), ("see https://x.y/z?q=1 now", "see now"),
    ("WWW.X.Y www.x.y", "WWW.X.Y"), ("a &amp; b", "a &amp; b"), ("a​b", "ab"),
    ("a ​ b", "a  b"), ("ﬁt ①", "fit 1"), ("ＡＢ", "AB"), ("x y\x1cz", "x y z"),
    ("https:// x", "https:// x"), ("<>", "<>"), ("p", "p"),
])
def test_cleaning(column, given_text, expected):
    assert column([given_text], tx.preprocess_text) == [expected]


PIECES = st.lists(st.sampled_from(
    ["<", ">", "b", " ", "\n", "\t", "http://", "https://a", "www.", "é", "é", " ",
     " ", "​", "ﬁ", "\x85", "\x1f", "A", "😀", "h", "w", "www", "﻿"]), max_size=12)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(PIECES.map("".join), min_size=20, max_size=60))
def test_cleaning_matches_the_rule(column, texts):
    assert column(texts, tx.preprocess_text) == [cleaned(t) for t in texts]


def test_display(column):
    assert column([1234567, -5], tx.format_dollars, "bigint") == ["$1,234,567", "$-5"]
    assert column([2.25, 3.0], lambda c: tx.format_fixed(c, 1), "double") == ["2.3", "3.0"]
    assert column(["a\nb" + "x" * 100], tx.preview) == ["a b" + "x" * 77]
    assert column(["😀" * 4000, None], tx.truncate_prompt) == ["😀" * 3500, ""]

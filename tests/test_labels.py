from __future__ import annotations

import json
import math
import re

import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from postlake.functions import numeric, replies
from postlake.lists import PROMPT_YEARS_ONLY
from postlake.operators import labels, normalize


def years_only(text):
    """The rule in plain Python."""
    found = [int(m) for m in re.findall(r"\b(\d{1,2})\b", (text or "").strip())]
    return next((n for n in found if 0 <= n <= 20), None)


def years_and_price(text):
    """The rule in plain Python; NaN is not part of it."""
    s = (text or "").strip()
    if s.startswith("```"):
        s = re.sub(r"\n?```\s*$", "", re.sub(r"^```\w*\n?", "", s))
    try:
        obj = json.loads(s)
        years, salary = obj.get("years"), obj.get("expected_salary")
        if not isinstance(years, (int, float)) or not 0 <= int(years) <= 20:
            return None
        return (int(years), None if salary is None else int(salary))
    except (ValueError, TypeError, AttributeError, OverflowError):
        return None


@pytest.mark.parametrize("reply", [
    "5", "About 3-5 years", "100", "25, then 7", "none", "", None, "5years or 2.5", "20 21", "٣ years", "a1 02",
])
def test_years_only(column, reply):
    assert column([reply], replies.parse_years_only) == [years_only(reply)]


VALUE = st.one_of(
    st.integers(-5, 30), st.booleans(), st.none(), st.floats(-3, 25).map(lambda x: round(x, 3)),
    st.sampled_from(["3", " 12 ", "1_000", "+7", "-7", "abc", "", "1__0", "2.5", "1e3", [1], {"a": 1}]))
OBJECT = st.dictionaries(st.sampled_from(["years", "expected_salary", "note"]), VALUE, max_size=3)
WRAP = st.sampled_from(["%s", " %s\n", "```json\n%s\n```", "```\n%s```  ", "```%s", "%s thanks", "x %s", "[%s]", "%s,%s"])


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(OBJECT, WRAP), min_size=60, max_size=90))
def test_years_and_price(column, cases):
    texts = [w.replace("%s", json.dumps(o)) for o, w in cases]
    found = column(texts, replies.parse_years_and_price)
    assert [None if r is None else tuple(r) for r in found] == [years_and_price(t) for t in texts]


def requests(n):
    return pd.DataFrame({"prompt": [str(i) for i in range(n)]})


def test_only_429_is_tried_again():
    calls = []

    def responder(batch):
        calls.append(list(batch["prompt"]))
        return [(None, "429 slow down") if p == "0" else (None, "500") if p == "1" else (p, None)
                for p in batch["prompt"]]
    out = labels.retry_calls(responder, requests(4), attempts=4, wait_seconds=0)
    assert calls == [["0", "1", "2", "3"], ["0"], ["0"], ["0"]]
    assert list(out["attempts"]) == [4, 1, 1, 1]
    assert list(out["error"]) == ["429 slow down", "500", None, None]
    assert list(out["reply"]) == [None, None, "2", "3"]


def test_a_raised_error_fails_its_request_alone():
    def one_bad(batch):
        if "3" in set(batch["prompt"]):
            raise RuntimeError("bad request")
        return [(p, None) for p in batch["prompt"]]
    out = labels.retry_calls(one_bad, requests(9), attempts=3, wait_seconds=0)
    assert list(out["reply"]) == [None if n == 3 else str(n) for n in range(9)]
    assert out["error"][3] == "bad request" and list(out["attempts"]) == [1] * 9

    def responder(batch):
        raise RuntimeError("HTTP 429")
    out = labels.retry_calls(responder, requests(2), attempts=3, wait_seconds=0)
    assert list(out["attempts"]) == [3, 3] and set(out["error"]) == {"HTTP 429"}


def test_fallback_in_order():
    def make():
        def respond(batch):
            return [("ok", None) if (m, p) in {("o1", "0"), ("grok-3", "1")} else
                    ("", None) if m == "o1" else (None, "down")
                    for m, p in zip(batch["model"], batch["prompt"])]
        return respond
    chain = [("openai", "o1"), ("openai", "grok-3"), ("grok", "grok-3"), ("nobody", "x")]
    out = labels.with_fallback(make, chain)()(requests(3))
    assert out[:2] == [("ok", None), ("ok", None)]
    assert out[2] == (None, "All models failed: Model o1 failed\nModel grok-3 failed: down\n")
    assert labels.with_fallback(make, [])()(requests(1)) == [(None, labels.NO_MODELS)]


def make_counting_responder(folder):
    """Replies by row, leaving one file per call."""
    def make():
        import pathlib
        import uuid

        def respond(batch):
            assert set(batch["max_tokens"].map(type)) == {int} and set(batch["temperature"]) == {0}
            for prompt in batch["prompt"]:
                (pathlib.Path(folder) / f"{prompt}-{uuid.uuid4().hex}").touch()
            return [("7" if s == PROMPT_YEARS_ONLY else '{"years": 4, "expected_salary": 900}', None)
                    if p != "bad" else (None, "500") for p, s in zip(batch["prompt"], batch["system_message"])]
        return respond
    return make


def test_fill_labels_asks_once_and_only_where_needed(spark, tmp_path):
    rows = [(1, "both", 5, 3), (2, "years", 5, -1), (3, "price", -1, 2), (4, "bad", -1, -1), (5, None, -1, -1)]
    df = spark.createDataFrame(
        rows, "row_id long, text string, expected_salary long, expected_experience_years long")
    filled, summary = labels.fill_labels(
        df, "row_id", make_counting_responder(str(tmp_path)), wait_seconds=0)
    found = {r["row_id"]: (r["expected_experience_years"], r["expected_salary"]) for r in filled.collect()}
    assert found == {1: (3, 5), 2: (7, 5), 3: (4, 900), 5: (4, 900)}
    assert summary.first().asDict() == {"total": 5, "found": 4, "updated": 3, "removed": 1}
    assert sorted(p.name.split("-")[0] for p in tmp_path.iterdir()) == ["", "bad", "price", "years"]


def test_model_shares_are_repeatable(spark):
    df = spark.range(20_000)
    chosen = labels.assign_model(labels.model_draw("id", seed=1))["provider"].alias("p")
    one = df.repartition(1).select("id", chosen)
    assert one.exceptAll(df.repartition(7).select("id", chosen)).count() == 0
    assert 0.23 < one.filter("p = 'grok'").count() / 20_000 < 0.27


@pytest.mark.parametrize("value, whole", [
    (2.5, 2), (3.5, 4), (-4.0, 0), (math.nan, 0), (math.inf, 0), (-math.inf, 0), (None, 0), (0.5, 0), (1.5, 2),
])
def test_safe_int(column, value, whole):
    assert column([value], numeric.safe_int, "double") == [whole]


def test_train_statistics_only_and_back_again(spark):
    rows = [("train", 1, 10), ("train", 3, 1000), ("val", 100, 7), ("test", 5, 0)]
    df = spark.createDataFrame(rows, "split string, expected_experience_years long, expected_salary long")
    logged = normalize.log_targets(df)
    stats = normalize.fit_norm_stats(logged)
    found = {r["target"]: (r["mean"], r["std"]) for r in stats.collect()}
    assert found["expected_experience_years"] == (2.0, pytest.approx(math.sqrt(2)))
    normed = normalize.apply_zscore(logged, stats)
    back = numeric.denorm_salary(
        F.col("expected_salary"), *normalize.constants(stats)["expected_salary"])
    assert [round(r[0], 6) for r in normed.select(back).collect()] == [10, 1000, 7, 0]
    flat = normalize.fit_norm_stats(logged.filter("expected_experience_years = 1"))
    assert normalize.apply_zscore(logged, flat).first()["expected_salary"] is None

"""LB: labelling requests, replies and their application."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from postlake.functions import replies as rp
from postlake.lists import LABEL_MODELS, PROMPT_YEARS_AND_PRICE, PROMPT_YEARS_ONLY, PROVIDER_MODELS
from postlake.operators import labels
from postlake.operators.sampling import arithmetic_hash
from postlake.plans import inputs as i
from postlake.plans.registry import query

SEED = 11
PORTABLE_DRAWS = 10007
GROK, OPENAI = (f"{p}/{m}" for p, m, _ in LABEL_MODELS)

MODEL_SQL = f"""CASE WHEN (row_id * 7919 + {SEED}) % 10007 < 2502 THEN '{GROK}' ELSE '{OPENAI}' END"""
PROMPT_SQL = f"""CASE WHEN expected_salary <> -1 THEN {i.quoted(PROMPT_YEARS_ONLY)}
  ELSE {i.quoted(PROMPT_YEARS_AND_PRICE)} END"""

# The reply rules of the fixture, stated for the oracle on its JSON functions.
YEARS_ONLY_SQL = r"""
list_filter(list_transform(regexp_extract_all(reply, '\b(\d{1,2})\b', 1), lambda n: CAST(n AS INTEGER)),
  lambda n: n BETWEEN 0 AND 20)[1]
"""
PARSED = r"""
SELECT row_id, reply, body,
  CASE WHEN json_type(body, '$.years') IN ('BIGINT', 'UBIGINT', 'DOUBLE')
       THEN CAST(trunc(CAST(body->>'$.years' AS DOUBLE)) AS INTEGER)
       WHEN json_type(body, '$.years') = 'BOOLEAN'
       THEN CAST(CAST(body->>'$.years' AS BOOLEAN) AS INTEGER) END AS years,
  json_type(body, '$.expected_salary') AS kind,
  CASE WHEN json_type(body, '$.expected_salary') IN ('BIGINT', 'UBIGINT', 'DOUBLE')
         OR regexp_full_match(body->>'$.expected_salary', '\s*[+-]?\d+\s*')
       THEN CAST(trunc(CAST(body->>'$.expected_salary' AS DOUBLE)) AS BIGINT) END AS salary
FROM (SELECT *, CASE WHEN json_valid(reply) AND reply LIKE '{%' THEN reply END AS body FROM fixture)
"""
ACCEPTED = """
SELECT row_id, years, salary FROM parsed
WHERE years BETWEEN 0 AND 20 AND (kind IS NULL OR kind = 'NULL' OR salary IS NOT NULL)
"""
PRICED = {"fixture": i.REPLIES, "parsed": PARSED, "accepted": ACCEPTED}

APPLIED = f"""
SELECT l.row_id, l.text, l.expected_salary <> -1 AS years_only,
  l.expected_salary = -1 OR l.expected_experience_years = -1 AS work,
  CASE WHEN l.expected_salary <> -1 THEN y.years ELSE a.years END AS new_years,
  CASE WHEN l.expected_salary = -1 THEN a.salary END AS new_salary,
  l.expected_experience_years, l.expected_salary
FROM labelled l
LEFT JOIN accepted a USING (row_id)
LEFT JOIN (SELECT row_id, {YEARS_ONLY_SQL} AS years FROM fixture) y USING (row_id)
"""
LABEL_VIEWS = {**PRICED, "labelled": i.LABELLED, "applied": APPLIED}
FILLED_SQL = """
SELECT row_id,
  CASE WHEN work THEN CAST(new_years AS BIGINT) ELSE expected_experience_years END AS expected_experience_years,
  CASE WHEN work THEN coalesce(new_salary, expected_salary) ELSE expected_salary END AS expected_salary
FROM applied WHERE NOT work OR new_years IS NOT NULL
"""


def labelled(spark, sf_dir):
    return i.view(spark, sf_dir, i.LABELLED)


def replies(spark, sf_dir):
    return i.view(spark, sf_dir, i.REPLIES)


def draw():
    return arithmetic_hash("row_id", SEED)


def with_replies(spark, sf_dir):
    """Examples next to their recorded replies; both sides unique by row_id."""
    return labelled(spark, sf_dir).join(
        replies(spark, sf_dir).select("row_id", "reply"), "row_id", "left")


@query("lb1_assign_model", i.with_views(
    f"SELECT row_id, {MODEL_SQL} AS model FROM labelled", labelled=i.LABELLED))
def lb1(spark, sf_dir):
    chosen = labels.assign_model(draw(), PORTABLE_DRAWS)
    return labelled(spark, sf_dir).select(
        "row_id", F.concat_ws("/", chosen["provider"], chosen["model"]).alias("model"))


@query("lb2_choose_prompt", i.with_views(
    f"SELECT row_id, {PROMPT_SQL} AS system_message FROM labelled", labelled=i.LABELLED))
def lb2(spark, sf_dir):
    return labelled(spark, sf_dir).select(
        "row_id", labels.choose_prompt(F.col("expected_salary")).alias("system_message"))


@query("lb3_label_requests", i.with_views(f"""
SELECT row_id, split_part({MODEL_SQL}, '/', 1) AS provider, split_part({MODEL_SQL}, '/', 2) AS model,
  {PROMPT_SQL} AS system_message, left(text, 3500) AS prompt, 0 AS temperature, 256 AS max_tokens
FROM labelled WHERE expected_salary = -1 OR expected_experience_years = -1""", labelled=i.LABELLED))
def lb3(spark, sf_dir):
    return labels.label_requests(labelled(spark, sf_dir), "row_id", draw(), PORTABLE_DRAWS)


def canned_responder():
    """Answers from the request alone; refuses some on their first try with a 429."""
    def respond(requests: pd.DataFrame):
        results = []
        for prompt, system, attempt in zip(
                requests["prompt"], requests["system_message"], requests["attempt"]):
            n = len(prompt)
            if n % 7 == 0 and attempt == 1:
                results.append((None, "429 Too Many Requests"))
            elif n % 11 == 0:
                results.append((None, "500 Server Error"))
            elif system == PROMPT_YEARS_ONLY:
                results.append((f"{n % 20} years", None))
            else:
                results.append(
                    ('{"years": %d, "expected_salary": %d}' % (n % 20, 50_000 + n), None))
        return results
    return respond


RESPONSE_SQL = f"""
SELECT row_id,
  CASE WHEN n % 7 <> 0 AND n % 11 = 0 OR n % 77 = 0 THEN NULL
       WHEN expected_salary <> -1 THEN (n % 20) || ' years'
       ELSE '{{"years": ' || (n % 20) || ', "expected_salary": ' || (50000 + n) || '}}' END AS reply,
  CASE WHEN n % 11 = 0 THEN '500 Server Error' END AS error
FROM (SELECT *, length(left(text, 3500)) AS n FROM labelled
      WHERE expected_salary = -1 OR expected_experience_years = -1)
"""


def asked(spark, sf_dir):
    work = labels.quality.needs_work(F.col("expected_experience_years"), F.col("expected_salary"))
    found = labels.respond_in_rounds(
        labelled(spark, sf_dir).filter(work), "row_id", draw(), canned_responder, wait_seconds=0, draws=PORTABLE_DRAWS)
    return found.select("row_id", F.struct("reply", "error", "attempts").alias("r"))


@query("lb4_call_responder", i.with_views(RESPONSE_SQL, labelled=i.LABELLED))
def lb4(spark, sf_dir):
    # The last error stays beside the reply; a retried 429 leaves none.
    return asked(spark, sf_dir).select("row_id", "r.reply", "r.error")


@query("lb5_retry_policy", i.with_views("""
SELECT row_id, CASE WHEN n % 7 = 0 THEN 2 ELSE 1 END AS attempts, CASE WHEN n % 11 = 0 THEN '500 Server Error' END AS error
FROM (SELECT *, length(left(text, 3500)) AS n FROM labelled
      WHERE expected_salary = -1 OR expected_experience_years = -1)""", labelled=i.LABELLED))
def lb5(spark, sf_dir):
    return asked(spark, sf_dir).select("row_id", "r.attempts", "r.error")


def raising_responder():
    """As the canned one without refusals, but fails outright on a batch with certain lengths."""
    answer = canned_responder()

    def respond(requests: pd.DataFrame):
        if any(len(prompt) % 50 == 0 for prompt in requests["prompt"]):
            raise ValueError("unreadable request")
        return answer(requests.assign(attempt=2))
    return respond


@query("lb4_isolated_failures", i.with_views("""
SELECT row_id, CASE WHEN n % 50 <> 0 THEN reply END AS reply,
  CASE WHEN n % 50 = 0 THEN 'unreadable request' ELSE error END AS error
FROM responses JOIN (SELECT row_id, length(left(text, 3500)) AS n FROM labelled) USING (row_id)""",
    labelled=i.LABELLED, responses=RESPONSE_SQL))
def lb4_isolated(spark, sf_dir):
    work = labels.quality.needs_work(F.col("expected_experience_years"), F.col("expected_salary"))
    found = labels.respond_in_rounds(
        labelled(spark, sf_dir).filter(work), "row_id", draw(), raising_responder, wait_seconds=0, draws=PORTABLE_DRAWS)
    return found.select("row_id", "reply", "error")


CHAIN = [("openai", "gpt-4o-mini"), ("grok", "gpt-4o"), ("claude", "claude-sonnet-4-20250514")]


@query("lb6_fallback_chain", i.with_views("""
SELECT request_id,
  CASE WHEN error_1 IS NULL AND reply_1 <> '' THEN reply_1 WHEN error_3 IS NULL THEN reply_3 END AS reply,
  CASE WHEN error_1 IS NULL AND reply_1 <> '' THEN 'gpt-4o-mini'
       WHEN error_3 IS NULL THEN 'claude-sonnet-4-20250514' END AS model,
  CASE WHEN (error_1 IS NOT NULL OR reply_1 = '') AND error_3 IS NOT NULL THEN
    'All models failed: Model gpt-4o-mini failed' || coalesce(': ' || error_1, '') || chr(10)
    || 'Model claude-sonnet-4-20250514 failed: ' || error_3 || chr(10) END AS error
FROM attempts""", attempts=i.ATTEMPTS))
def lb6(spark, sf_dir):
    given = [("reply_1", "error_1"), ("reply_2", None), ("reply_3", "error_3")]
    attempts = F.array(*[
        F.struct(
            F.lit(p).alias("provider"), F.lit(m).alias("model"), F.col(reply).alias("reply"),
            (F.col(error) if error else F.lit(None).cast("string")).alias("error"),
        ) for (p, m), (reply, error) in zip(CHAIN, given)
    ])
    rows = i.view(spark, sf_dir, i.ATTEMPTS).withColumn("attempts", attempts)
    return rows.withColumn("outcome", labels.fallback_chain(F.col("attempts"))).select(
        "request_id", "outcome.reply", "outcome.model", "outcome.error")


PAIRS_SQL = ", ".join(f"('{p}', '{m}')" for p, ms in PROVIDER_MODELS.items() for m in ms)
ASKED_PAIRS = """
SELECT d.doc_id AS request_id,
  CASE d.doc_id % 4 WHEN 0 THEN 'openai' WHEN 1 THEN 'grok' WHEN 2 THEN 'claude' ELSE 'gemini' END AS provider,
  CASE d.doc_id % 5 WHEN 0 THEN 'gpt-4o' WHEN 1 THEN 'grok-3' WHEN 2 THEN 'claude-3-haiku-20240307'
    WHEN 3 THEN 'gemini-2.5-pro' ELSE 'unknown-model' END AS model
FROM documents d
"""


@query("lb7_valid_model_pairs", i.with_views(f"""
SELECT request_id, provider, model FROM asked
WHERE (provider, model) IN (SELECT (p, m) FROM (VALUES {PAIRS_SQL}) AS v(p, m))""", asked=ASKED_PAIRS))
def lb7(spark, sf_dir):
    # A constant of 46 rows.
    pairs = F.broadcast(labels.valid_model_pairs(spark))
    return i.view(spark, sf_dir, ASKED_PAIRS).join(pairs, ["provider", "model"], "left_semi").select(
        "request_id", "provider", "model")


@query("lb8_parse_years_only", i.with_views(
    f"SELECT row_id, {YEARS_ONLY_SQL} AS years FROM fixture", fixture=i.REPLIES))
def lb8(spark, sf_dir):
    return replies(spark, sf_dir).select("row_id", rp.parse_years_only(F.col("reply")).alias("years"))


FENCED = """
SELECT d.doc_id AS row_id, CASE d.doc_id % 3 WHEN 0 THEN concat('```json', chr(10), d.text, chr(10), '``` ')
  WHEN 1 THEN concat('```', chr(10), d.text, '```') ELSE d.text END AS reply, trim(d.text) AS bare
FROM documents d
"""


@query("lb9_strip_code_fence", i.with_views(r"""
SELECT row_id, CASE WHEN starts_with(trim(reply), '```')
  THEN regexp_replace(regexp_replace(trim(reply), '^```\w*\n?', ''), '\n?```\s*$', '')
  ELSE regexp_replace(reply, '^\s+|\s+$', '', 'g') END AS body FROM fenced""", fenced=FENCED))
def lb9(spark, sf_dir):
    rows = i.view(spark, sf_dir, FENCED)
    return rows.select("row_id", rp.strip_code_fence(F.col("reply")).alias("body"))


@query("lb10_parse_years_and_price", i.with_views("""
SELECT f.row_id, a.years, a.salary FROM fixture f LEFT JOIN accepted a USING (row_id)""", **PRICED))
def lb10(spark, sf_dir):
    rows = replies(spark, sf_dir).withColumn("found", rp.parse_years_and_price(F.col("reply")))
    return rows.select("row_id", "found.years", F.col("found.expected_salary").alias("salary"))


@query("lb11_apply_labels", i.with_views("""
SELECT row_id, CASE WHEN NOT work THEN 'untouched' WHEN new_years IS NULL THEN 'failed' ELSE 'updated' END AS status,
  CASE WHEN work AND new_years IS NOT NULL THEN CAST(new_years AS BIGINT)
       ELSE expected_experience_years END AS expected_experience_years,
  CASE WHEN work AND new_years IS NOT NULL THEN coalesce(new_salary, expected_salary)
       ELSE expected_salary END AS expected_salary
FROM applied""", **LABEL_VIEWS))
def lb11(spark, sf_dir):
    rows = labels.label_with_replies(with_replies(spark, sf_dir), F.col("reply"))
    return rows.select("row_id", "status", "expected_experience_years", "expected_salary")


@query("fl13_drop_failed", i.with_views(FILLED_SQL, **LABEL_VIEWS))
def fl13(spark, sf_dir):
    rows = labels.label_with_replies(with_replies(spark, sf_dir), F.col("reply"))
    return labels.drop_failed(rows).select("row_id", "expected_experience_years", "expected_salary")


@query("lb12_label_summary", i.with_views("""
SELECT count(*) AS total, count(*) FILTER (work) AS found,
  count(*) FILTER (work AND new_years IS NOT NULL) AS updated,
  count(*) FILTER (work AND new_years IS NULL) AS removed FROM applied""", **LABEL_VIEWS))
def lb12(spark, sf_dir):
    rows = labels.label_with_replies(with_replies(spark, sf_dir), F.col("reply"))
    return labels.label_summary(rows)


@query("lb13_fill_labels", i.with_views(f"""
SELECT l.row_id,
  CASE WHEN r.reply IS NULL THEN l.expected_experience_years ELSE length(left(l.text, 3500)) % 20 END AS expected_experience_years,
  CASE WHEN r.reply IS NULL OR l.expected_salary <> -1 THEN l.expected_salary
       ELSE 50000 + length(left(l.text, 3500)) END AS expected_salary
FROM labelled l LEFT JOIN responses r USING (row_id)
WHERE r.row_id IS NULL OR r.reply IS NOT NULL""", labelled=i.LABELLED, responses=RESPONSE_SQL))
def lb13(spark, sf_dir):
    filled, _ = labels.fill_labels(
        labelled(spark, sf_dir), "row_id", canned_responder, seed=SEED, wait_seconds=0)
    return filled.select("row_id", "expected_experience_years", "expected_salary")

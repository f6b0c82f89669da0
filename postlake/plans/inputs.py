"""Inputs of the registered queries, derived from the given tables.

The SQL views read the same in Spark and in the oracle. `CLEAN`, `PLACE` and the
like are the oracle's own statement of the rules, written apart from the engine's.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from postlake.lists import COUNTRY_NAMES, SKIP_TITLE_FRAGMENTS, SKIP_TITLES, US_STATE_NAMES
from postlake.sources.tables import spread

TABLES = "documents|labels|pages|conversations|orders|benchmark"

POSTINGS = """
SELECT d.doc_id AS job_id,
  CASE WHEN d.doc_id % 23 = 0 THEN NULL
       WHEN d.doc_id % 29 = 0 THEN CAST(d.doc_id AS STRING)
       ELSE CASE d.doc_id % 11
         WHEN 0 THEN 'Server' WHEN 1 THEN '  Senior   Software Engineer ' WHEN 2 THEN 'Device Driver Developer'
         WHEN 3 THEN 'Data Analyst' WHEN 4 THEN 'Pastry Chef' WHEN 5 THEN 'server' WHEN 6 THEN 'Buyer'
         WHEN 7 THEN '<b>Data Engineer</b>' WHEN 8 THEN '12 34' ELSE 'Product Manager' END END AS job_title,
  CASE WHEN d.doc_id % 31 = 0 THEN ''
       WHEN d.doc_id % 13 = 0 THEN concat('<p>', d.text, '</p> see https://jobs.example.org/', CAST(d.doc_id AS STRING), ' now')
       ELSE d.text END AS description,
  CASE WHEN d.doc_id % 3 = 0 THEN NULL ELSE CAST(30000 + (d.doc_id * 37) % 90000 AS DOUBLE) + 0.75 END AS min_annual_salary_usd,
  CASE WHEN d.doc_id % 4 = 0 THEN NULL ELSE CAST(50000 + (d.doc_id * 53) % 120000 AS DOUBLE) + 0.5 END AS max_annual_salary_usd,
  CASE d.doc_id % 9 WHEN 0 THEN '["US"]' WHEN 1 THEN '["GB","US"]' WHEN 2 THEN '[]' WHEN 3 THEN NULL
       WHEN 4 THEN 'not json' WHEN 5 THEN '["XX"]' WHEN 6 THEN '"US"' ELSE '["US","CA"]' END AS country_codes,
  CASE WHEN d.doc_id % 10 = 0 THEN 1 WHEN d.doc_id % 17 = 0 THEN NULL ELSE 0 END AS remote,
  CASE d.doc_id % 6 WHEN 0 THEN 'CA' WHEN 1 THEN 'ny' WHEN 2 THEN '' WHEN 3 THEN NULL WHEN 4 THEN 'ZZ' ELSE 'TX' END AS state_code,
  d.lang AS lang
FROM documents d
"""

SCORED = """
SELECT o_orderkey AS row_id,
  CASE WHEN o_orderkey % 100 < 96 THEN 'train' WHEN o_orderkey % 100 < 98 THEN 'val' ELSE 'test' END AS split,
  CASE WHEN o_orderkey % 19 = 0 THEN -1 ELSE o_orderkey % 21 END AS expected_experience_years,
  CASE WHEN o_orderkey % 17 = 0 THEN -1 ELSE CAST(floor(o_totalprice) AS BIGINT) END AS expected_salary,
  CAST(o_orderkey % 21 AS DOUBLE) + CAST((o_orderkey * 7) % 41 - 20 AS DOUBLE) / 10.0 AS pred_years,
  o_totalprice + CAST((o_orderkey * 7919) % 60001 - 30000 AS DOUBLE) AS pred_salary
FROM orders
"""

REPLIES = """
SELECT d.doc_id AS row_id,
  CASE WHEN d.doc_id % 4 = 0 THEN 1 ELSE 0 END AS years_only,
  CASE WHEN d.doc_id % 4 = 0 THEN
    CASE d.doc_id % 7 WHEN 0 THEN '5' WHEN 1 THEN 'About 3-5 years' WHEN 2 THEN '100' WHEN 3 THEN '25, then 7'
      WHEN 4 THEN 'none stated' WHEN 5 THEN '' ELSE '5years or 2.5' END
  ELSE
    CASE d.doc_id % 13 WHEN 0 THEN '{"years": 3, "expected_salary": 105000}' WHEN 1 THEN '{"years": 21, "expected_salary": 90000}'
      WHEN 2 THEN '{"years": 4}' WHEN 3 THEN '{"years": "3", "expected_salary": 1}' WHEN 4 THEN '{"years": 3.9, "expected_salary": "88000"}'
      WHEN 5 THEN '[1, 2]' WHEN 6 THEN '{"years": 3} thanks' WHEN 7 THEN 'sorry' WHEN 8 THEN '{"years": null, "expected_salary": 5}'
      WHEN 9 THEN '{"years": 0, "expected_salary": 45000.7}' WHEN 10 THEN '{"years": 6, "expected_salary": "abc"}'
      WHEN 11 THEN '{"years": true}' ELSE NULL END
  END AS reply
FROM documents d
"""

# Examples with some labels missing; the salary is known where `years_only` is 1.
LABELLED = """
SELECT d.doc_id AS row_id, d.text AS text,
  CASE WHEN d.doc_id % 4 = 0 THEN 40000 + (d.doc_id * 17) % 100000 ELSE -1 END AS expected_salary,
  CASE WHEN d.doc_id % 6 = 0 THEN d.doc_id % 21 ELSE -1 END AS expected_experience_years
FROM documents d
"""

# Examples with all labels, for fitting. Pay grows with the quality of the text.
TRAINING = """
SELECT d.doc_id AS row_id, d.text AS text,
  CASE WHEN d.doc_id % 10 < 8 THEN 'train' WHEN d.doc_id % 10 = 8 THEN 'val' ELSE 'test' END AS split,
  CAST(CASE d.lang WHEN 'en' THEN 3 WHEN 'fr' THEN 6 WHEN 'de' THEN 9 ELSE 12 END + d.doc_id % 3 AS BIGINT) AS expected_experience_years,
  CAST(CASE d.lang WHEN 'en' THEN 60000 WHEN 'fr' THEN 80000 WHEN 'de' THEN 100000 ELSE 120000 END + (d.doc_id * 37) % 9000 AS BIGINT) AS expected_salary
FROM documents d
"""

# Replies of three configured models per request; one pair is not on offer.
ATTEMPTS = """
SELECT d.doc_id AS request_id,
  CASE d.doc_id % 3 WHEN 0 THEN 'first answer' WHEN 1 THEN '' ELSE NULL END AS reply_1,
  CASE WHEN d.doc_id % 3 = 2 THEN concat('429 for ', CAST(d.doc_id AS STRING)) END AS error_1,
  'never used' AS reply_2,
  CASE WHEN d.doc_id % 5 = 0 THEN NULL ELSE 'third answer' END AS reply_3,
  CASE WHEN d.doc_id % 5 = 0 THEN 'timeout' END AS error_3
FROM documents d
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """For costly text work: the given files hold one row group each."""
    return spread(table(spark, sf_dir, name))


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """One of the views above over the Parquet files of `sf_dir`."""
    located = re.sub(
        rf"\bFROM ({TABLES})\b", lambda m: f"FROM parquet.`{sf_dir}/{m[1]}.parquet`", sql
    )
    return spark.sql(located)


def with_views(body: str, **views: str) -> str:
    """Oracle SQL with the named views in front."""
    ctes = ",\n".join(f"{name} AS ({sql.strip()})" for name, sql in views.items())
    return f"WITH {ctes}\n{body.strip()}"


# --- the oracle's statement of the rules --------------------------------------

SPACES = (
    r"[\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)


def replaced(text: str, pattern: str, by: str = " ") -> str:
    return f"regexp_replace({text}, '{pattern}', '{by}', 'g')"


def no_tags(text: str) -> str:
    return replaced(text, "<[^>]+>")


def no_urls(text: str) -> str:
    return replaced(text, r"https?://\S+|www\.\S+")


def one_space(text: str) -> str:
    return replaced(text, SPACES + "+")


def no_control(text: str) -> str:
    return replaced(text, r"[\p{Cc}\p{Cf}\p{Co}]", "")


def clean(text: str) -> str:
    return f"trim({no_control(one_space(no_urls(no_tags(f'coalesce({text}, {chr(39) * 2})'))))})"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def looked_up(code: str, names: dict[str, str], fallback: str) -> str:
    arms = " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in names.items())
    return f"CASE {code} {arms} ELSE {fallback} END"


FIRST_COUNTRY = """
CASE WHEN country_codes IS NULL OR NOT json_valid(country_codes) THEN ''
     WHEN json_type(country_codes) = 'VARCHAR' THEN left(country_codes->>'$', 1)
     ELSE coalesce(country_codes->>'$[0]', '') END
"""
COUNTRY_NAME = looked_up("country", COUNTRY_NAMES, "country")
STATE_NAME = looked_up("upper(state_code)", US_STATE_NAMES, "coalesce(state_code, '')")
LOCATION = f"""
CASE WHEN coalesce(remote, 0) <> 0 THEN 'Remote' WHEN country = '' THEN 'Unknown'
     WHEN country = 'US' THEN trim('United States ' || {STATE_NAME})
     ELSE {COUNTRY_NAME} END
"""
LOW, HIGH = (f"CAST(trunc({b}_annual_salary_usd) AS BIGINT)" for b in ("min", "max"))
EXPECTED_SALARY = f"""
CASE WHEN {LOW} IS NULL OR {HIGH} IS NULL THEN coalesce({LOW}, {HIGH}, -1)
     ELSE CAST(trunc(({LOW} + {HIGH}) / 2.0) AS BIGINT) END
"""
DENIED_EXACT = f"title IN ({', '.join(map(quoted, dict.fromkeys(SKIP_TITLES)))})"
DENIED_FRAGMENT = f"regexp_matches(lower(title), '{'|'.join(SKIP_TITLE_FRAGMENTS)}')"
NUMERIC_TITLE = "regexp_full_match(title, '[0-9 ]*')"

CLEANED = f"""
SELECT * EXCLUDE (job_title, description), {clean('job_title')} AS title,
  {clean('description')} AS "desc", {FIRST_COUNTRY} AS country
FROM postings
"""
REASONS = f"""
SELECT *, CASE WHEN title = '' OR "desc" = '' THEN 'no_title_desc'
  WHEN {NUMERIC_TITLE} THEN 'title_numeric' WHEN lang <> 'en' THEN 'not_english'
  WHEN {DENIED_EXACT} OR {DENIED_FRAGMENT} THEN 'skip_jobs' END AS skip_reason
FROM cleaned
"""
EXAMPLES = f"""
SELECT job_id,
  '[LOCATION]: ' || {LOCATION} || ' [TITLE]: ' || title || ' [DESC]: ' || "desc" AS text,
  {EXPECTED_SALARY} AS expected_salary, CAST(-1 AS BIGINT) AS expected_experience_years
FROM reasons WHERE skip_reason IS NULL
"""
CURATION = {"postings": POSTINGS, "cleaned": CLEANED, "reasons": REASONS, "examples": EXAMPLES}


def curated(body: str, upto: str = "examples", **more: str) -> str:
    """Oracle SQL over the curation views up to the one named."""
    names = list(CURATION)[: list(CURATION).index(upto) + 1]
    return with_views(body, **{n: CURATION[n] for n in names}, **more)

"""FL, SA, GE: predicates, funnel, salary, location, examples."""

from __future__ import annotations

from pyspark.sql import functions as F

from postlake.functions import pay, place, quality
from postlake.operators import curate, normalize
from postlake.plans import inputs as i
from postlake.plans.registry import query
from postlake.schemas import TARGETS, is_missing
from postlake.sources.tables import spread




def gold_english(text):
    """The given language column in place of a fitted model."""
    return F.col("lang") == "en"


def postings(spark, sf_dir):
    return spread(i.view(spark, sf_dir, i.POSTINGS))


def cleaned(spark, sf_dir):
    return curate.clean_fields(postings(spark, sf_dir))


def scored(spark, sf_dir):
    return i.view(spark, sf_dir, i.SCORED)


def _on_cleaned(name, oracle_expr, fn):
    @query(name, i.curated(f"SELECT job_id, {oracle_expr} AS out FROM cleaned", upto="cleaned"))
    def run(spark, sf_dir):
        titles = curate.clean_fields(postings(spark, sf_dir), ("title",))
        return titles.select("job_id", fn().alias("out"))


_on_cleaned("fl2_title_numeric_only", i.NUMERIC_TITLE, lambda: quality.title_numeric_only(F.col("title")))
_on_cleaned("fl4_skip_title_exact", i.DENIED_EXACT, lambda: quality.skip_title_exact(F.col("title")))
_on_cleaned("fl5_skip_title_substring", i.DENIED_FRAGMENT,
            lambda: quality.skip_title_substring(F.col("title")))
_on_cleaned("fl6_should_skip_title", f"({i.DENIED_EXACT} OR {i.DENIED_FRAGMENT})",
            lambda: quality.should_skip_title(F.col("title")))


@query("fl1_has_title_desc", i.curated(
    "SELECT job_id, title, \"desc\" FROM cleaned WHERE title <> '' AND \"desc\" <> ''", upto="cleaned"))
def fl1(spark, sf_dir):
    rows = cleaned(spark, sf_dir).select("job_id", "title", "desc")
    return rows.filter(quality.has_title_desc(F.col("title"), F.col("desc")))


@query("fl7_skip_reason", i.curated("SELECT job_id, skip_reason FROM reasons", upto="reasons"))
def fl7(spark, sf_dir):
    return curate.with_skip_reason(postings(spark, sf_dir), gold_english).select("job_id", "skip_reason")


FUNNEL_SQL = i.curated("""
SELECT name AS skip_reason, (SELECT count(*) FROM reasons WHERE coalesce(skip_reason, 'kept') = name) AS n
FROM (VALUES ('no_title_desc'), ('title_numeric'), ('not_english'), ('skip_jobs'), ('kept')) AS v(name)
""", upto="reasons")


@query("fl8_funnel", FUNNEL_SQL)
def fl8(spark, sf_dir):
    return curate.funnel(curate.with_skip_reason(postings(spark, sf_dir), gold_english))


@query("fl9_is_missing", i.with_views("""
SELECT row_id, expected_experience_years = -1 AS years_missing, expected_salary = -1 AS salary_missing
FROM scored""", scored=i.SCORED))
def fl9(spark, sf_dir):
    return scored(spark, sf_dir).select(
        "row_id",
        is_missing(F.col("expected_experience_years")).alias("years_missing"),
        is_missing(F.col("expected_salary")).alias("salary_missing"),
    )


@query("fl10_needs_work", i.with_views("""
SELECT row_id FROM scored WHERE expected_experience_years = -1 OR expected_salary = -1
""", scored=i.SCORED))
def fl10(spark, sf_dir):
    years, salary = map(F.col, TARGETS)
    return scored(spark, sf_dir).filter(quality.needs_work(years, salary)).select("row_id")


@query("fl11_has_valid_pay", i.with_views(
    "SELECT row_id, expected_salary FROM scored WHERE expected_salary <> -1", scored=i.SCORED))
def fl11(spark, sf_dir):
    rows = scored(spark, sf_dir).select("row_id", "expected_salary")
    return rows.filter(quality.has_valid_pay(F.col("expected_salary")))


@query("fl12_drop_missing", i.with_views("""
SELECT row_id, split, expected_experience_years, expected_salary FROM scored
WHERE expected_experience_years <> -1 AND expected_salary <> -1""", scored=i.SCORED))
def fl12(spark, sf_dir):
    rows = scored(spark, sf_dir).select("row_id", "split", *TARGETS)
    return normalize.drop_missing(rows)


@query("sa1_parse_pay_bound", i.with_views(
    f"SELECT job_id, {i.LOW} AS low, {i.HIGH} AS high FROM postings", postings=i.POSTINGS))
def sa1(spark, sf_dir):
    return postings(spark, sf_dir).select(
        "job_id",
        pay.parse_pay_bound(F.col("min_annual_salary_usd")).alias("low"),
        pay.parse_pay_bound(F.col("max_annual_salary_usd")).alias("high"),
    )


@query("sa2_expected_salary", i.with_views(
    f"SELECT job_id, {i.EXPECTED_SALARY} AS expected_salary FROM postings", postings=i.POSTINGS))
def sa2(spark, sf_dir):
    salary = pay.expected_salary(F.col("min_annual_salary_usd"), F.col("max_annual_salary_usd"))
    return postings(spark, sf_dir).select("job_id", salary.alias("expected_salary"))


def _with_country(spark, sf_dir):
    return postings(spark, sf_dir).withColumn("country", place.first_country(F.col("country_codes")))


COUNTRIES = f"SELECT *, {i.FIRST_COUNTRY} AS country FROM postings"


@query("ge1_first_country", i.with_views(
    "SELECT job_id, country FROM countries", postings=i.POSTINGS, countries=COUNTRIES))
def ge1(spark, sf_dir):
    return _with_country(spark, sf_dir).select("job_id", "country")


@query("ge2_country_name", i.with_views(
    f"SELECT job_id, {i.COUNTRY_NAME} AS country_name FROM countries",
    postings=i.POSTINGS, countries=COUNTRIES))
def ge2(spark, sf_dir):
    return _with_country(spark, sf_dir).select(
        "job_id", place.country_name(F.col("country")).alias("country_name"))


@query("ge3_state_name", i.with_views(
    f"SELECT job_id, {i.STATE_NAME} AS state_name FROM postings", postings=i.POSTINGS))
def ge3(spark, sf_dir):
    return postings(spark, sf_dir).select(
        "job_id", place.state_name(F.col("state_code")).alias("state_name"))


@query("ge4_location_label", i.with_views(
    f"SELECT job_id, {i.LOCATION} AS location FROM countries",
    postings=i.POSTINGS, countries=COUNTRIES))
def ge4(spark, sf_dir):
    label = place.location_label(F.col("remote"), F.col("country"), F.col("state_code"))
    return _with_country(spark, sf_dir).select("job_id", label.alias("location"))


@query("ge5_render_text", i.curated(f"""
SELECT job_id, '[LOCATION]: ' || {i.LOCATION} || ' [TITLE]: ' || title || ' [DESC]: ' || "desc" AS text
FROM cleaned""", upto="cleaned"))
def ge5(spark, sf_dir):
    rows = cleaned(spark, sf_dir)
    country = place.first_country(F.col("country_codes"))
    location = place.location_label(F.col("remote"), country, F.col("state_code"))
    return rows.select("job_id", place.render_text(location, F.col("title"), F.col("desc")).alias("text"))


@query("ge6_build_examples", i.curated("SELECT * FROM examples"))
def ge6(spark, sf_dir):
    return curate.build_examples(postings(spark, sf_dir), gold_english)


@query("ge7_parse_rendered_text", i.curated(f"""
SELECT job_id, {i.LOCATION} AS location, title, "desc" AS description
FROM reasons WHERE skip_reason IS NULL""", upto="reasons"))
def ge7(spark, sf_dir):
    parts = place.parse_rendered_text(F.col("text"))
    return ge6(spark, sf_dir).select("job_id", *[c.alias(n) for n, c in parts.items()])

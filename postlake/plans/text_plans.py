"""TX: text cleaning and display."""

from __future__ import annotations

from pyspark.sql import functions as F

from postlake.functions import text as tx
from postlake.plans import inputs as i
from postlake.plans.registry import query


def _documents(name, oracle_expr, fn):
    """A text expression over whole documents."""
    @query(name, f"SELECT doc_id, {oracle_expr} AS out FROM documents")
    def run(spark, sf_dir):
        return i.table(spark, sf_dir, "documents").select("doc_id", fn(F.col("text")).alias("out"))


def _pages(name, oracle_expr, fn):
    """A text expression over whole pages."""
    @query(name, f"SELECT page_id, {oracle_expr} AS out FROM pages")
    def run(spark, sf_dir):
        return i.spread_table(spark, sf_dir, "pages").select("page_id", fn(F.col("html")).alias("out"))


_pages("tx1_preprocess_text", i.clean("html"), tx.preprocess_text)
_pages("tx3_strip_tags", i.no_tags("html"), tx.strip_tags)
_pages("tx4_strip_urls", i.no_urls("html"), tx.strip_urls)
_pages("tx5_collapse_ws", i.one_space("html"), tx.collapse_ws)
_documents("tx6_drop_control", i.no_control("text"), tx.drop_control)
_documents("tx7_strip", "trim(text)", tx.strip)
_documents("tx9_truncate_prompt", "left(text, 3500)", tx.truncate_prompt)
_documents("tx10_preview", "replace(left(text, 80), chr(10), ' ')", tx.preview)


@query("tx2_nfkc", "SELECT doc_id, text AS out FROM documents")
def tx2(spark, sf_dir):
    # Wide forms of the text's own letters give NFKC something to undo.
    wide = F.translate("text", "abcdefghijklmnopqrstuvwxyz", "ａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ")
    docs = i.table(spark, sf_dir, "documents")
    return docs.select("doc_id", tx.nfkc(wide).alias("out"))


@query("tx8_combine_text", i.curated(
    "SELECT job_id, title || ' ' || \"desc\" AS out FROM cleaned", upto="cleaned"))
def tx8(spark, sf_dir):
    from postlake.operators.curate import clean_fields
    cleaned = clean_fields(i.view(spark, sf_dir, i.POSTINGS))
    return cleaned.select("job_id", tx.combine_text(F.col("title"), F.col("desc")).alias("out"))


@query("tx11_format_money", i.with_views("""
SELECT row_id, '$' || format('{:,}', CAST(round_even(pred_salary, 0) AS BIGINT)) AS salary,
  printf('%.1f', round(pred_years, 1)) AS years
FROM scored""", scored=i.SCORED))
def tx11(spark, sf_dir):
    scored = i.view(spark, sf_dir, i.SCORED)
    return scored.select(
        "row_id",
        tx.format_dollars(F.col("pred_salary")).alias("salary"),
        tx.format_fixed(F.round("pred_years", 1), 1).alias("years"),
    )

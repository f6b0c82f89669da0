"""ST: the incremental jobs, run to the end over the given documents."""

from __future__ import annotations

from postlake.plans import inputs as i
from postlake.plans.curation_plans import FUNNEL_SQL, gold_english
from postlake.plans.label_plans import RESPONSE_SQL, SEED, canned_responder
from postlake.plans.registry import query
from postlake.sources.scratch import scratch_path
from postlake.streaming import jobs


def _streamed(spark, sf_dir, sql):
    """One of the input views over documents, as a stream.

    A stream reads folders, so a table that is a single file is picked out of its
    folder; its one row group is dealt over all cores.
    """
    table = i.table(spark, sf_dir, "documents")
    reader = spark.readStream.schema(table.schema)
    if [f.rsplit("/", 1)[-1] for f in table.inputFiles()] == ["documents.parquet"]:
        stream = reader.option("pathGlobFilter", "documents.parquet").parquet(sf_dir)
        stream = stream.repartition(spark.sparkContext.defaultParallelism)
    else:
        stream = reader.parquet(f"{sf_dir}/documents.parquet")
    stream.createOrReplaceTempView("streamed_documents")
    return spark.sql(sql.replace("FROM documents d", "FROM streamed_documents d"))


@query("st1_stream_curate", i.curated("SELECT * FROM examples"))
def st1(spark, sf_dir):
    out, checkpoint = (scratch_path(spark, n) for n in ("curated", "curated-checkpoint"))
    postings = _streamed(spark, sf_dir, i.POSTINGS)
    jobs.stream_curate(postings, gold_english, out, checkpoint).awaitTermination()
    return spark.read.parquet(out)


@query("st2_stream_fill_labels", i.with_views("""
SELECT l.row_id,
  CASE WHEN r.reply IS NULL THEN l.expected_experience_years ELSE length(left(l.text, 3500)) % 20 END AS expected_experience_years,
  CASE WHEN r.reply IS NULL OR l.expected_salary <> -1 THEN l.expected_salary
       ELSE 50000 + length(left(l.text, 3500)) END AS expected_salary
FROM labelled l LEFT JOIN responses r USING (row_id)
WHERE r.row_id IS NULL OR r.reply IS NOT NULL""", labelled=i.LABELLED, responses=RESPONSE_SQL))
def st2(spark, sf_dir):
    out, checkpoint = (scratch_path(spark, n) for n in ("filled", "filled-checkpoint"))
    examples = _streamed(spark, sf_dir, i.LABELLED)
    jobs.stream_fill_labels(
        examples, "row_id", canned_responder, out, checkpoint, seed=SEED, wait_seconds=0
    ).awaitTermination()
    return spark.read.parquet(out).select("row_id", "expected_experience_years", "expected_salary")


@query("st3_stream_funnel", FUNNEL_SQL)
def st3(spark, sf_dir):
    out, checkpoint = (scratch_path(spark, n) for n in ("funnel", "funnel-checkpoint"))
    postings = _streamed(spark, sf_dir, i.POSTINGS)
    jobs.stream_funnel(postings, gold_english, out, checkpoint).awaitTermination()
    return jobs.latest_totals(spark, out)

"""Incremental jobs on Structured Streaming (ST family).

Each takes its checkpoint folder, handles what is new and stops. Run again, it
continues where it was.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from postlake.lists import RETRY_SECONDS
from postlake.operators import labels
from postlake.operators.curate import English, build_examples, funnel, with_skip_reason
from postlake.schemas import RAW_POSTING

FILES_PER_TRIGGER = 10_000


def stream_postings(spark: SparkSession, folder: str) -> DataFrame:
    """New posting files of a folder, a bounded number per trigger."""
    return (
        spark.readStream.schema(RAW_POSTING)
        .option("maxFilesPerTrigger", FILES_PER_TRIGGER).parquet(folder)
    )


def stream_curate(
    postings: DataFrame, english: English, out: str, checkpoint: str
) -> StreamingQuery:
    """ST1: new postings, through the batch curation, appended to a file table."""
    return (
        build_examples(postings, english).writeStream.format("parquet")
        .option("path", out).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )


def stream_fill_labels(
    examples: DataFrame, key: str, make_responder: Callable[[], labels.Responder],
    out: str, checkpoint: str, seed: int = 0, wait_seconds: float = RETRY_SECONDS,
) -> StreamingQuery:
    """ST2: label in resumable chunks.

    A chunk is one folder named by its batch id, replaced when the batch is run
    again, so a restart neither loses nor repeats rows. Its replies are written down
    first, under `_replies`; a batch that is run again reads them in place of calling.
    Calls go through one ledger of paid replies, `_ledger`, so a batch that failed while
    asking asks only what it had not been answered yet. Replies count as stored only
    beside a marker with their number of rows, written after them.
    """
    def label_chunk(chunk: DataFrame, batch_id: int) -> None:
        path, marker = f"{out}/_replies/{batch_id}", f"{out}/_replies/{batch_id}.done"
        replies = _complete_replies(chunk.sparkSession, path, marker)
        if replies is None:  # never written, or not to its end: asked again, the ledger pays nothing twice
            draw = labels.model_draw(key, seed=seed)
            replies = labels.ask(chunk, key, draw, make_responder, wait_seconds=wait_seconds, path=path,
                                 ledger=f"{out}/_ledger")
            chunk.sparkSession.createDataFrame([(replies.count(),)], "rows long").coalesce(1).write \
                .mode("overwrite").json(marker)
        kept = labels.drop_failed(labels.with_stored_replies(chunk, key, replies)).select(*chunk.columns)
        kept.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return (
        examples.writeStream.foreachBatch(label_chunk)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def _complete_replies(spark: SparkSession, path: str, marker: str) -> DataFrame | None:
    """The stored replies of a batch if their marker is there and counts as many rows."""
    try:
        expected = spark.read.schema("rows long").json(marker).first()
        replies = spark.read.parquet(path)
    except AnalysisException:
        return None
    return replies if expected is not None and replies.count() == expected["rows"] else None


def stream_funnel(
    postings: DataFrame, english: English, out: str, checkpoint: str
) -> StreamingQuery:
    """ST3: running counts per skip reason. Every batch writes its totals to a folder of
    its own; `latest_totals` reads the newest one, so totals never vanish meanwhile."""
    def keep_latest(totals: DataFrame, batch_id: int) -> None:
        totals.coalesce(1).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    reasons = with_skip_reason(postings, english)
    counts = funnel(reasons)
    return (
        counts.writeStream.foreachBatch(keep_latest).outputMode("complete")
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def latest_totals(spark: SparkSession, out: str) -> DataFrame:
    """ST3: the totals of the newest batch; a handful of rows per batch are stored."""
    totals = spark.read.parquet(out)
    newest = totals.agg(F.max("batch")).first()[0]
    return totals.filter(F.col("batch") == newest).drop("batch")

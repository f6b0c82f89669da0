"""A ledger of paid model replies, and retries as rounds (LB4, LB5, LB13, ST2).

Every distinct request is known by the SHA-256 of its fields. Outcomes are appended to a
Parquet ledger, one row per call: (request_hash, reply, error, attempt). A round asks, once
each, the requests that have no final outcome there; a refusal with a 429 is not final and
waits for the next round. Between rounds the driver waits; no task sleeps holding a core.

Run again on the same ledger, nothing that was answered is asked again: a lost executor
or a failed job costs at most the calls of the tasks that had not finished writing.
Each call carries one request, so a request that makes the responder raise fails alone
and no answered request is asked a second time.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, functions as F

from postlake.lists import LABEL_ATTEMPTS, RETRY_SECONDS
from postlake.sources.scratch import scratch_path

LEDGER = "request_hash string, reply string, error string, attempt int"
#: Requests one task asks at most: what a lost task has to pay again.
REQUESTS_PER_TASK = 2_000


def request_hash(request: Column) -> Column:
    """SHA-256 of a request struct in JSON form: equal requests share one reply."""
    return F.sha2(F.to_json(request), 256)


def refused(error: Column) -> Column:
    """A refusal that a later round may ask again: a 429."""
    return F.coalesce(error.contains("429"), F.lit(False))


def ask_in_rounds(
    requests: DataFrame,
    make_responder: Callable[[], Callable[[pd.DataFrame], list]],
    ledger: str | None = None,
    attempts: int = LABEL_ATTEMPTS,
    wait_seconds: float = RETRY_SECONDS,
) -> DataFrame:
    """(request_hash, reply, error, attempts) for every distinct request of `requests`.

    `requests` holds `request_hash` and the request fields. Round r asks the requests
    whose last ledger entry is missing or a refusal, with `attempt` = r for them (one more
    than their entries); after `attempts` rounds the last outcome stands. `ledger` is a
    folder kept between runs; without one, a fresh folder under the shared folder is used.
    """
    spark = requests.sparkSession
    path = ledger or scratch_path(spark, "ledger")
    distinct = requests.dropDuplicates(["request_hash"])
    for round_no in range(1, attempts + 1):
        last = _last(_entries(spark, path))
        open_ = distinct.join(last.where(~F.col("open")).select("request_hash"), "request_hash", "left_anti")
        open_ = open_.join(last.select("request_hash", "attempt"), "request_hash", "left").withColumn(
            "attempt", (F.coalesce(F.col("attempt"), F.lit(0)) + 1).cast("int")).where(F.col("attempt") <= attempts)
        waiting = open_.count()
        if waiting == 0:
            break
        if round_no > 1 and wait_seconds:
            time.sleep(wait_seconds)
        parts = max(1, -(-waiting // REQUESTS_PER_TASK))
        open_.repartition(parts, "request_hash").mapInPandas(_call_each(make_responder), LEDGER) \
            .write.mode("append").parquet(path)
    last = _last(_entries(spark, path))
    return last.select("request_hash", "reply", "error", F.col("attempt").alias("attempts"))


def _entries(spark, path: str) -> DataFrame:
    try:
        return spark.read.schema(LEDGER).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], LEDGER)


def _last(entries: DataFrame) -> DataFrame:
    """The latest outcome of every request, and whether it is still open (refused)."""
    latest = entries.groupBy("request_hash").agg(F.max_by(F.struct("reply", "error", "attempt"), "attempt").alias("e"))
    return latest.select("request_hash", "e.reply", "e.error", "e.attempt", refused(F.col("e.error")).alias("open"))


def _call_each(make_responder) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def call(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        responder = make_responder()
        for frame in frames:
            replies, errors = [], []
            for k in range(len(frame)):
                one = frame.iloc[[k]]
                try:
                    (reply, error), = list(responder(one))
                except Exception as failure:  # the responder's own failure is this request's outcome
                    reply, error = None, str(failure)
                replies.append(reply)
                errors.append(error)
            yield pd.DataFrame({"request_hash": frame["request_hash"].to_numpy(), "reply": replies, "error": errors,
                                "attempt": frame["attempt"].astype("int32").to_numpy()})
    return call

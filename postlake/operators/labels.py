"""Model-assisted labelling (LB family).

The model call is injected: a `responder` gets a pandas frame of requests and
returns one (reply, error) pair per request. Nothing here opens a connection.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from postlake.functions import quality
from postlake.functions.replies import parse_years_and_price, parse_years_only
from postlake.functions.text import truncate_prompt
from postlake.lists import (
    LABEL_ATTEMPTS,
    LABEL_MAX_TOKENS,
    LABEL_MODELS,
    LABEL_TEMPERATURE,
    PROMPT_YEARS_AND_PRICE,
    PROMPT_YEARS_ONLY,
    PROVIDER_MODELS,
    RETRY_SECONDS,
)
from postlake.operators.ledger import ask_in_rounds, request_hash
from postlake.sources.scratch import cut_lineage

Responder = Callable[[pd.DataFrame], list[tuple[str | None, str | None]]]

YEARS = "expected_experience_years"
SALARY = "expected_salary"
DRAWS = 10_000
RESPONSE_TYPE = "reply string, error string, attempts int"
NO_MODELS = "No model configurations provided"


def model_draw(*key: str, seed: int) -> Column:
    """Uniform draw in 0..DRAWS-1, repeatable when a task is retried."""
    return F.pmod(F.xxhash64(*key, F.lit(seed)), F.lit(DRAWS))


def assign_model(draw: Column, draws: int = DRAWS) -> Column:
    """LB1: struct(provider, model) by weight from a draw in 0..draws-1."""
    bounds = accumulate(weight for _, _, weight in LABEL_MODELS)
    chosen = F
    for (provider, model, _), bound in zip(LABEL_MODELS, bounds):
        pair = F.struct(F.lit(provider).alias("provider"), F.lit(model).alias("model"))
        chosen = chosen.when(draw < round(bound * draws), pair)
    return chosen


def choose_prompt(salary: Column) -> Column:
    """LB2: ask for years alone where the salary is known."""
    return F.when(quality.has_valid_pay(salary), PROMPT_YEARS_ONLY).otherwise(
        PROMPT_YEARS_AND_PRICE
    )


def request_fields(draw: Column, draws: int = DRAWS) -> list[Column]:
    """The columns of one labelling request."""
    chosen = assign_model(draw, draws)
    return [
        chosen["provider"].alias("provider"),
        chosen["model"].alias("model"),
        choose_prompt(F.col(SALARY)).alias("system_message"),
        truncate_prompt(F.col("text")).alias("prompt"),
        F.lit(LABEL_TEMPERATURE).alias("temperature"),
        F.lit(LABEL_MAX_TOKENS).alias("max_tokens"),
    ]


def label_requests(examples: DataFrame, key: str, draw: Column, draws: int = DRAWS) -> DataFrame:
    """LB3: the work list, one request per example with a missing label."""
    work = examples.filter(quality.needs_work(F.col(YEARS), F.col(SALARY)))
    return work.select(key, *request_fields(draw, draws))


def retry_calls(
    responder: Responder,
    requests: pd.DataFrame,
    attempts: int = LABEL_ATTEMPTS,
    wait_seconds: float = RETRY_SECONDS,
) -> pd.DataFrame:
    """LB5: call again, after a wait, only the requests refused with a 429 error.

    The responder sees the number of the try in the column `attempt`.
    """
    outcome = pd.DataFrame(
        {"reply": None, "error": None, "attempts": 0}, index=requests.index, dtype=object
    )
    pending = requests.index
    for attempt in range(1, attempts + 1):
        results = _isolated(responder, requests.loc[pending].assign(attempt=attempt))
        for column, values in zip(("reply", "error"), zip(*results)):
            outcome.loc[pending, column] = pd.Series(values, index=pending, dtype=object)
        outcome.loc[pending, "attempts"] = attempt
        errors = outcome.loc[pending, "error"]
        pending = pending[[isinstance(e, str) and "429" in e for e in errors]]
        if pending.empty or attempt == attempts:
            break
        time.sleep(wait_seconds)
    return outcome


def _isolated(responder: Responder, batch: pd.DataFrame) -> list[tuple[str | None, str | None]]:
    """One result per request. If the call raises, both halves of the batch are called
    apart, down to the request that cannot be answered; only that one fails."""
    try:
        return list(responder(batch))
    except Exception as failure:
        if len(batch) == 1:
            return [(None, str(failure))]
    middle = len(batch) // 2
    return _isolated(responder, batch.iloc[:middle]) + _isolated(responder, batch.iloc[middle:])


def call_responder(
    request: Column,
    make_responder: Callable[[], Responder],
    attempts: int = LABEL_ATTEMPTS,
    wait_seconds: float = RETRY_SECONDS,
) -> Column:
    """LB4: struct(reply, error, attempts) for a request struct with a prompt.

    An Arrow batch at a time; `make_responder` runs once per task. As a column it
    leaves the rest of the row in the JVM and needs no join to bring replies back.
    Parallel calls = tasks, so repartition first where the input has few.
    """

    @F.pandas_udf(RESPONSE_TYPE)
    def called(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        responder = make_responder()
        for batch in batches:
            asked = batch[batch["prompt"].notna()]
            outcome = pd.DataFrame(index=batch.index, columns=["reply", "error", "attempts"])
            if len(asked):
                outcome.loc[asked.index] = retry_calls(responder, asked, attempts, wait_seconds)
            outcome["attempts"] = outcome["attempts"].astype("Int32")
            yield outcome

    return called.asNondeterministic()(request)


def respond_in_rounds(
    work: DataFrame,
    key: str,
    draw: Column,
    make_responder: Callable[[], Responder],
    attempts: int = LABEL_ATTEMPTS,
    wait_seconds: float = RETRY_SECONDS,
    ledger: str | None = None,
    draws: int = DRAWS,
) -> DataFrame:
    """LB4/LB5 by rounds: (key, reply, error, attempts) for every row of `work`.

    Requests go through the ledger of paid replies (operators/ledger.py): each distinct
    request is asked once per round, refusals (429) again in the next round after the
    driver waits, and a run on the same `ledger` asks nothing that was answered. Rows
    without a prompt get NULLs, as do no calls for them.
    """
    request = F.struct(*request_fields(draw, draws))
    rows = work.select(key, request.alias("request")).withColumn("request_hash", request_hash(F.col("request")))
    requests = rows.where(F.col("request.prompt").isNotNull()).select("request_hash", "request.*")
    outcomes = ask_in_rounds(requests, make_responder, ledger, attempts, wait_seconds)
    found = rows.select(key, "request_hash").join(
        outcomes.withColumn("asked", F.lit(True)), "request_hash", "left")
    return found.select(key, "reply", "error", F.col("attempts").cast("int").alias("attempts"))


def valid_model_pairs(spark: SparkSession) -> DataFrame:
    """LB7: which provider serves which model."""
    pairs = [
        F.struct(F.lit(provider).alias("provider"), F.lit(model).alias("model"))
        for provider, models in PROVIDER_MODELS.items() for model in models
    ]
    return spark.range(1).select(F.inline(F.array(*pairs)))


def is_valid_pair(provider: Column, model: Column) -> Column:
    """LB7 as a predicate."""
    known = [f"{p}/{m}" for p, models in PROVIDER_MODELS.items() for m in models]
    return F.coalesce(F.concat_ws("/", provider, model).isin(known), F.lit(False))


def fallback_chain(attempts: Column) -> Column:
    """LB6: struct(reply, model, error) from one request's ordered attempts.

    `attempts` is an array of struct(provider, model, reply, error), one per
    configured model. Pairs no provider serves are skipped silently. The first
    non-empty reply wins; if none does, every failure is reported in order.
    """
    tried = F.filter(attempts, lambda a: is_valid_pair(a["provider"], a["model"]))
    answered = F.get(
        F.filter(tried, lambda a: a["error"].isNull() & (F.coalesce(a["reply"], F.lit("")) != "")),
        F.lit(0),
    )

    def failure(attempt: Column) -> Column:
        reason = F.concat(F.lit(": "), attempt["error"])
        return F.concat(
            F.lit("Model "), attempt["model"], F.lit(" failed"),
            F.coalesce(reason, F.lit("")), F.lit("\n"),
        )

    failures = F.array_join(F.transform(tried, failure), "")
    error = F.when(F.size(attempts) == 0, NO_MODELS).otherwise(
        F.concat(F.lit("All models failed: "), failures)
    )
    return F.struct(
        answered["reply"].alias("reply"),
        answered["model"].alias("model"),
        F.when(answered.isNull(), error).alias("error"),
    )


def with_fallback(
    make_responder: Callable[[], Responder], configs: list[tuple[str, str]]
) -> Callable[[], Responder]:
    """LB6 for live calls: a responder that tries (provider, model) pairs in order.

    Each round calls one pair for the requests still unanswered, within one batch,
    so an earlier answer is never asked for again.
    """
    usable = [(p, m) for p, m in configs if m in PROVIDER_MODELS.get(p, [])]

    def make() -> Responder:
        responder = make_responder()

        def respond(requests: pd.DataFrame) -> list[tuple[str | None, str | None]]:
            if not configs:
                return [(None, NO_MODELS)] * len(requests)
            answers: list[str | None] = [None] * len(requests)
            errors = ["All models failed: "] * len(requests)
            pending = list(range(len(requests)))
            for provider, model in usable:
                if not pending:
                    break
                batch = requests.iloc[pending].assign(provider=provider, model=model)
                for i, (reply, error) in zip(pending, _isolated(responder, batch)):
                    if error is None and reply:
                        answers[i] = reply
                    else:
                        reason = "" if error is None else f": {error}"
                        errors[i] += f"Model {model} failed{reason}\n"
                pending = [i for i in pending if answers[i] is None]
            return [(a, None if a is not None else e) for a, e in zip(answers, errors)]

        return respond

    return make


def parse_reply(years_only: Column, reply: Column) -> Column:
    """struct(years, expected_salary) of a reply to either prompt, NULL if it fails."""
    years = parse_years_only(reply)
    alone = F.when(
        years.isNotNull(),
        F.struct(years.alias("years"), F.lit(None).cast("bigint").alias("expected_salary")),
    )
    return F.when(years_only, alone).otherwise(parse_years_and_price(reply))


def with_status(df: DataFrame, result: Column) -> DataFrame:
    """Add `result` and a `status`: untouched, updated or failed."""
    work = quality.needs_work(F.col(YEARS), F.col(SALARY))
    status = F.when(~work, "untouched").when(F.col("result").isNotNull(), "updated")
    return df.withColumn("result", result).withColumn("status", status.otherwise("failed"))


def apply_labels(df: DataFrame) -> DataFrame:
    """LB11: years are overwritten even where valid, salary only if one came back."""
    updated = F.col("status") == "updated"
    return df.withColumns({
        YEARS: F.when(updated, F.col("result.years").cast("bigint")).otherwise(F.col(YEARS)),
        SALARY: F.when(
            updated, F.coalesce(F.col("result.expected_salary"), F.col(SALARY))
        ).otherwise(F.col(SALARY)),
    })


def drop_failed(df: DataFrame) -> DataFrame:
    """FL13: rows whose labelling failed leave the table."""
    return df.filter(F.col("status") != "failed")


def label_summary(df: DataFrame) -> DataFrame:
    """LB12: one row of counts."""
    status = F.col("status")
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(status != "untouched").alias("found"),
        F.count_if(status == "updated").alias("updated"),
        F.count_if(status == "failed").alias("removed"),
    )


def label_with_replies(examples: DataFrame, reply: Column) -> DataFrame:
    """Recorded replies on the rows themselves: parsed, given a status and applied."""
    years_only = quality.has_valid_pay(F.col(SALARY))
    return apply_labels(with_status(examples, parse_reply(years_only, reply)))


def ask(
    examples: DataFrame,
    key: str,
    draw: Column,
    make_responder: Callable[[], Responder],
    attempts: int = LABEL_ATTEMPTS,
    wait_seconds: float = RETRY_SECONDS,
    path: str | None = None,
    ledger: str | None = None,
) -> DataFrame:
    """(key, reply) of the examples with a missing label, written down before use.

    Calls go through the ledger of paid replies, asked by rounds; `ledger` kept between
    runs means that nothing answered is asked again. The (key, reply) rows go to `path`, or
    to the shared folder. Only keys and replies are stored, so texts are not copied.
    """
    work = examples.filter(quality.needs_work(F.col(YEARS), F.col(SALARY)))
    replies = respond_in_rounds(work, key, draw, make_responder, attempts, wait_seconds, ledger).select(key, "reply")
    if path is None:
        return cut_lineage(replies, "replies")
    replies.write.mode("overwrite").parquet(path)
    return examples.sparkSession.read.schema(replies.schema).parquet(path)


def fill_labels(
    examples: DataFrame,
    key: str,
    make_responder: Callable[[], Responder],
    seed: int = 0,
    attempts: int = LABEL_ATTEMPTS,
    wait_seconds: float = RETRY_SECONDS,
) -> tuple[DataFrame, DataFrame]:
    """LB13: the labelled table without failed rows, and its summary.

    `key` is unique. Rows with both labels pass by; the others meet their stored
    reply by key.
    """
    replies = ask(examples, key, model_draw(key, seed=seed), make_responder, attempts, wait_seconds)
    labelled = with_stored_replies(examples, key, replies)
    return drop_failed(labelled).select(*examples.columns), label_summary(labelled)


def with_stored_replies(examples: DataFrame, key: str, replies: DataFrame) -> DataFrame:
    """Examples with a status, labelled from stored (key, reply) rows."""
    work = quality.needs_work(F.col(YEARS), F.col(SALARY))
    # A row without a stored reply, or with a NULL key, stays and fails; it does not vanish.
    answered = examples.filter(work).join(replies, key, "left")
    untouched = examples.filter(~work).withColumn("reply", F.lit(None).cast("string"))
    rows = untouched.unionByName(answered.select(*examples.columns, "reply"))
    return label_with_replies(rows, F.col("reply"))

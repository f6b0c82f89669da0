"""The ledger of paid replies: every answerable request is asked once, refusals by rounds."""

from __future__ import annotations

import pathlib
import uuid

from pyspark.sql import functions as F

from postlake.operators.ledger import ask_in_rounds, request_hash


def counting(folder):
    """A responder that leaves one file per call; 429 on the first try of 'slow', raises on 'bad'."""
    def make():
        def respond(batch):
            assert len(batch) == 1
            prompt, attempt = batch["prompt"].iloc[0], int(batch["attempt"].iloc[0])
            (pathlib.Path(folder) / f"{prompt}.{attempt}.{uuid.uuid4().hex}").touch()
            if prompt.startswith("bad"):
                raise ValueError("unreadable request")
            if prompt.startswith("slow") and attempt == 1:
                return [(None, "429 Too Many Requests")]
            if prompt.startswith("never"):
                return [(None, "429 Too Many Requests")]
            return [(f"re {prompt}", None)]
        return respond
    return make


def _requests(spark, prompts):
    df = spark.createDataFrame([(p, "sys") for p in prompts], "prompt string, system_message string")
    return df.withColumn("request_hash", request_hash(F.struct("prompt", "system_message")))


def _calls(folder):
    return sorted(p.name.rsplit(".", 1)[0] for p in pathlib.Path(folder).iterdir())


def test_each_request_once_and_refusals_by_rounds(spark, tmp_path):
    calls, ledger = tmp_path / "calls", str(tmp_path / "ledger")
    calls.mkdir()
    prompts = ["a", "b", "a", "slow1", "bad1", "never1"]
    got = {r["request_hash"]: r for r in ask_in_rounds(_requests(spark, prompts), counting(calls), ledger, 3, 0).collect()}
    by_prompt = {r["prompt"]: got[r["request_hash"]] for r in _requests(spark, prompts).collect()}
    assert (by_prompt["a"]["reply"], by_prompt["a"]["attempts"]) == ("re a", 1)
    assert (by_prompt["slow1"]["reply"], by_prompt["slow1"]["attempts"]) == ("re slow1", 2)
    assert (by_prompt["bad1"]["error"], by_prompt["bad1"]["attempts"]) == ("unreadable request", 1)
    assert (by_prompt["never1"]["error"], by_prompt["never1"]["attempts"]) == ("429 Too Many Requests", 3)
    assert _calls(calls) == ["a.1", "b.1", "bad1.1", "never1.1", "never1.2", "never1.3", "slow1.1", "slow1.2"]
    # Run again on the same ledger: nothing is asked.
    again = ask_in_rounds(_requests(spark, prompts), counting(calls), ledger, 3, 0).collect()
    assert len(again) == 5 and len(_calls(calls)) == 8


def test_resume_asks_only_what_is_open(spark, tmp_path):
    calls, ledger = tmp_path / "calls", str(tmp_path / "ledger")
    calls.mkdir()
    first = _requests(spark, ["a", "slow2"])
    ask_in_rounds(first, counting(calls), ledger, attempts=1, wait_seconds=0).collect()
    assert _calls(calls) == ["a.1", "slow2.1"]
    # A later run with more requests and attempts: the refusal goes on at attempt 2.
    out = ask_in_rounds(_requests(spark, ["a", "slow2", "c"]), counting(calls), ledger, attempts=3, wait_seconds=0)
    assert {r["reply"] for r in out.collect()} == {"re a", "re slow2", "re c"}
    assert _calls(calls) == ["a.1", "c.1", "slow2.1", "slow2.2"]

"""Language model, regression, sources and incremental jobs."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from postlake.operators import curate, language, modeling, normalize
from postlake.plans import inputs
from postlake.schemas import EXAMPLE, RAW_POSTING, conform
from postlake.sources import scratch, tables
from postlake.streaming import jobs

TEXTS = [("en", "The cat sat."), ("fr", "Le chat où\nest"), ("en", "ab"), ("de", "Ü" * 5), ("en", None), (None, "x y z")]


def brute_counts():
    counts: dict = {}
    for lang, text in TEXTS:
        if lang is None or text is None:
            continue
        codes = [ord(c) for c in text.replace("\n", " ").lower()]
        for a, b, c in zip(codes, codes[1:], codes[2:]):
            key = (lang, (a * 9973 + b * 613 + c) % language.BUCKETS)
            counts[key] = counts.get(key, 0) + 1
    return counts


def test_trigram_counts(spark):
    df = spark.createDataFrame(TEXTS, "lang string, text string")
    found = language.trigram_counts(df).collect()
    assert {(r["lang"], r["bucket"]): r["n"] for r in found} == brute_counts()


def test_chunks_change_nothing(monkeypatch):
    table = np.arange(language.BUCKETS * 2, dtype=np.int64).reshape(-1, 2)
    text = "The quick brown fox. " * 40
    whole = language._trigram_totals(text, table)
    monkeypatch.setattr(language, "CHUNK", 7)
    chunked = language._trigram_totals(text, table)
    assert whole[1] == chunked[1] == len(text) - 2
    assert (whole[0] == chunked[0]).all()


def test_many_languages_are_flushed(monkeypatch):
    monkeypatch.setattr(language, "MAX_LANGUAGES", 1)
    batch = pd.DataFrame({"lang": ["a", "b", "a"], "text": ["xyz", "xyz", "xyz"]})
    found = pd.concat(language._count_trigrams(iter([batch])))
    assert found.groupby("lang")["n"].sum().to_dict() == {"a": 2, "b": 1}


def test_held_out_accuracy(spark, sf_dir):
    docs = inputs.table(spark, sf_dir, "documents").filter("n_chars > 40")
    model = language.fit_language_id(docs.filter("doc_id % 2 = 0"))
    held_out = docs.filter("doc_id % 2 = 1").withColumn("found", model.score(F.col("text")))
    right = held_out.agg(F.avg((F.col("found.lang") == F.col("lang")).cast("double"))).first()[0]
    assert right > 0.97
    english = docs.select("lang", model.is_english(F.col("text")).alias("is_english"))
    assert english.filter("is_english and lang <> 'en'").count() <= 2


def test_short_text_is_undecided():
    model = language.LanguageModel(["en", "fr"], np.zeros((language.BUCKETS, 2), dtype=np.int64))
    assert list(model.score_texts(pd.Series(["", None, "ab"]))["probability"]) == [0.5] * 3


def test_regressor_learns_and_reloads(spark, sf_dir):
    rows = inputs.view(spark, sf_dir, inputs.TRAINING)
    model = modeling.TextRegressor.fit(rows, features=256, reg_params=(0.5, 5.0))
    predicted = model.predict(rows.filter("split <> 'train'"))
    years = F.col("expected_experience_years")
    mean = rows.filter("split = 'train'").agg(F.avg(years)).first()[0]
    error, plain = predicted.agg(
        F.avg(F.abs(F.col("pred_years") - years)), F.avg(F.abs(F.lit(mean) - years))).first()
    assert error < 0.9 * plain
    path = scratch.scratch_path(spark, "test-model")
    model.save(path)
    again = modeling.TextRegressor.load(spark, path)
    assert again.losses == model.losses
    assert again.predict(rows).exceptAll(model.predict(rows)).count() == 0


def test_external_model_guards(spark):
    stats = spark.createDataFrame(
        [("expected_experience_years", 1.0, 2.0), ("expected_salary", 0.0, 1.0)], "target string, mean double, std double")

    def make():
        def predict(texts):
            assert len(texts) <= 4
            return np.array([[float(t), float(t)] for t in texts], dtype=np.float32)
        return predict
    texts = ["0.75", "-9", "nan", "inf", "1", "2", "3"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    found = modeling.predict_external(df, make, stats, batch_size=4).collect()
    assert [(r["pred_years"], r["pred_salary"]) for r in found] == [
        (2, 1), (0, 0), (0, 0), (0, 0), (3, 2), (5, 6), (7, 19)]


def posting_files(spark, folder, first, last):
    rows = [(n, f"Analyst {n}", "works", 1.5, None, '["US"]', 0, "CA") for n in range(first, last)]
    spark.createDataFrame(rows, RAW_POSTING).coalesce(1).write.mode("append").parquet(folder)


def always_english(text):
    return F.lit(True)


def test_scan_postings(spark, tmp_path):
    folder = str(tmp_path / "raw")
    spark.createDataFrame([("Analyst", 7.0)], "job_title string, min_annual_salary_usd double").write.parquet(folder)
    row = tables.scan_postings(spark, folder).first().asDict()
    assert row.pop("job_title") == "Analyst" and row.pop("min_annual_salary_usd") == 7.0
    assert set(row.values()) == {None}
    assert tables.with_row_key(tables.scan_postings(spark, folder)).select("row_no").first()[0] == 0
    other = spark.createDataFrame([(True, 9)], "remote boolean, min_annual_salary_usd long")
    other.write.parquet(str(tmp_path / "typed"))
    typed = tables.scan_postings(spark, str(tmp_path / "typed")).first()
    assert (typed["remote"], typed["min_annual_salary_usd"]) == (1, 9.0)
    whole = spark.createDataFrame([("a", 7)], "job_title string, min_annual_salary_usd long")
    part = spark.createDataFrame([("b", 7.5, 1)], "job_title string, min_annual_salary_usd double, remote int")
    for df in (whole, part):
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "mixed"))
    mixed = tables.scan_postings(spark, str(tmp_path / "mixed"))
    assert {(r["job_title"], r["min_annual_salary_usd"], r["remote"]) for r in mixed.collect()} == {("a", 7.0, None), ("b", 7.5, 1)}
    (tmp_path / "empty").mkdir()
    with pytest.raises(FileNotFoundError):
        tables.scan_postings(spark, str(tmp_path / "empty"))


def test_footer_table_groups_many_files(spark, tmp_path):
    folder = str(tmp_path / "many")
    kinds = [("long", True), ("double", 1), ("int", None)]
    for n in range(9):
        kind, remote = kinds[n % 3]
        remote_type = "boolean" if remote is True else "int"
        salary = n if kind != "double" else n + 0.5
        spark.createDataFrame([(f"t{n}", salary, remote)], f"job_title string, min_annual_salary_usd {kind}, remote {remote_type}") \
            .coalesce(1).write.mode("append").parquet(folder)
    files = spark.read.parquet(folder).inputFiles()
    footers = tables.footer_table(spark, files).collect()
    assert len(footers) == 9 and len({r["schema"] for r in footers}) == 3
    got = {(r["job_title"], r["min_annual_salary_usd"], r["remote"]) for r in tables.scan_postings(spark, folder).collect()}
    want = {(f"t{n}", float(n if n % 3 != 1 else n + 0.5), (1 if n % 3 in (0, 1) else None)) for n in range(9)}
    assert got == want


def test_append_checks_columns_and_leaves_test_alone(spark, tmp_path):
    for split in tables.SPLITS:
        df = conform(spark.createDataFrame([(split, 1, 2)], "text string, expected_salary int, expected_experience_years int"), EXAMPLE)
        tables.write_examples(df, f"{tmp_path}/{split}.parquet")
    more = conform(spark.createDataFrame([("more", 5, -1)], "text string, expected_salary int, expected_experience_years int"), EXAMPLE)
    tables.append_examples(more, f"{tmp_path}/train.parquet")
    found = {(r["split"], r["text"]) for r in tables.scan_examples(spark, str(tmp_path)).collect()}
    assert found == {("train", "train"), ("train", "more"), ("val", "val"), ("test", "test")}
    with pytest.raises(ValueError, match="expected_salary"):
        tables.append_examples(more.drop("expected_salary"), f"{tmp_path}/val.parquet")


def test_curation_continues_where_it_was(spark, tmp_path):
    folder, out, checkpoint = (str(tmp_path / n) for n in ("raw", "out", "cp"))
    posting_files(spark, folder, 0, 5)
    for upto in (5, 5, 9):
        if upto == 9:
            posting_files(spark, folder, 5, 9)
        jobs.stream_curate(jobs.stream_postings(spark, folder), always_english, out, checkpoint).awaitTermination()
        assert spark.read.parquet(out).count() == upto
    batch = curate.build_examples(tables.scan_postings(spark, folder), always_english)
    assert spark.read.parquet(out).exceptAll(batch).count() == 0


def test_running_funnel(spark, tmp_path):
    folder, out, checkpoint = (str(tmp_path / n) for n in ("raw", "out", "cp"))
    for upto in (4, 7):
        posting_files(spark, folder, 0 if upto == 4 else 4, upto)
        jobs.stream_funnel(jobs.stream_postings(spark, folder), always_english, out, checkpoint).awaitTermination()
        assert dict(jobs.latest_totals(spark, out).collect())["kept"] == upto


def canned():
    def respond(batch):
        return [('{"years": 2, "expected_salary": 3}', None)] * len(batch)
    return respond


def test_labelling_in_chunks(spark, tmp_path):
    folder, out, checkpoint = (str(tmp_path / n) for n in ("raw", "out", "cp"))
    schema = "row_id long, text string, expected_salary long, expected_experience_years long"
    for start in (0, 3):
        rows = [(n, "t", -1, -1) for n in range(start, start + 3)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(schema).parquet(folder)
        jobs.stream_fill_labels(stream, "row_id", canned, out, checkpoint, wait_seconds=0).awaitTermination()
    found = spark.read.parquet(out).collect()
    assert sorted(r["row_id"] for r in found) == list(range(6))
    assert {(r["expected_experience_years"], r["expected_salary"]) for r in found} == {(2, 3)}


def test_mean_of_logs_round_trip(spark):
    df = spark.createDataFrame([("train", 2, 99)], "split string, expected_experience_years long, expected_salary long")
    assert normalize.log_targets(df).first()["expected_salary"] == pytest.approx(math.log1p(99))


def test_model_is_packed_by_language(spark):
    weights = spark.createDataFrame(
        [("en", -1, -7), ("en", 3, 5), ("fr", -1, -9), ("fr", 0, 2), ("fr", 3, 1), ("xx", 7, 4)],
        "lang string, bucket int, weight bigint")
    model = language.LanguageModel.load(weights)
    assert model.languages == ["en", "fr", "xx"]
    expected = np.zeros((language.BUCKETS, 3), dtype=np.int32)
    expected[:, 0], expected[:, 1] = -7, -9
    expected[3, 0], expected[0, 1], expected[3, 1], expected[7, 2] = 5, 2, 1, 4
    assert (model.table == expected).all()
    assert language.LanguageModel.load(weights.limit(0)).languages == []


def test_unfinished_replies_are_asked_again_without_paying_twice(spark, tmp_path):
    import pathlib
    import shutil
    import uuid

    calls = tmp_path / "calls"
    calls.mkdir()

    def counting():
        def respond(batch):
            for row_text in batch["prompt"]:
                (calls / f"{row_text}-{uuid.uuid4().hex}").touch()
            return [('{"years": 2, "expected_salary": 3}', None)] * len(batch)
        return respond

    folder, out = str(tmp_path / "raw"), str(tmp_path / "out")
    schema = "row_id long, text string, expected_salary long, expected_experience_years long"
    spark.createDataFrame([(n, f"t{n}", -1, -1) for n in range(4)], schema).coalesce(1).write.parquet(folder)
    stream = spark.readStream.schema(schema).parquet(folder)
    jobs.stream_fill_labels(stream, "row_id", counting, out, str(tmp_path / "cp"), wait_seconds=0).awaitTermination()
    assert len(list(calls.iterdir())) == 4
    # The batch's marker and output are lost, as if the driver died after the replies: the batch runs again.
    shutil.rmtree(pathlib.Path(out) / "_replies" / "0.done")
    shutil.rmtree(pathlib.Path(out) / "batch=0")
    stream = spark.readStream.schema(schema).parquet(folder)
    jobs.stream_fill_labels(stream, "row_id", counting, out, str(tmp_path / "cp2"), wait_seconds=0).awaitTermination()
    assert sorted(r["row_id"] for r in spark.read.parquet(out).collect()) == [0, 1, 2, 3]
    assert len(list(calls.iterdir())) == 4


def test_fit_cuts_texts_into_words_once(spark, monkeypatch):
    """Document frequencies and features come from the written counts, with the pipeline's own weights."""
    from postlake.operators import modeling

    rows = spark.createDataFrame(
        [(n, f"w{n % 7} w{n % 3} common {'x ' * (n % 5)}", "val" if n % 5 == 4 else "train", n % 9, 50000 + 100 * (n % 11))
         for n in range(60)],
        "row_id long, text string, split string, expected_experience_years long, expected_salary long")
    stored, write = {}, modeling.cut_lineage
    monkeypatch.setattr(modeling, "cut_lineage", lambda df, name: stored.setdefault(name, write(df, name)))
    model = modeling.TextRegressor.fit(rows, features=64, reg_params=(0.5,))
    plain = modeling.featurize_text(64).fit(rows.filter("split = 'train'"))
    assert set(stored) == {"stats", "counts"} and stored["counts"].count() == 60
    assert list(model.features.stages[-1].idf) == list(plain.stages[-1].idf)
    assert model.features.transform(rows).select("features").collect() == plain.transform(rows).select("features").collect()

from __future__ import annotations

from postlake.llm.decontaminate import find_leaks
from postlake.llm.minhash import near_duplicates
from tests.llm import brute


def test_stages_in_order(spark, sf_dir, documents):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "secrets", "packing"]
    docs, before = documents, documents.count()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir).cache()
        if name != "packing":
            assert out.dtypes == documents.dtypes and out.count() <= before
        if name == "near_dedup":
            assert all(r["kept"] for r in near_duplicates(out, 80).collect())
        if name == "decontamination":
            assert find_leaks(out, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).count() == 0
            assert out.count() > 0.6 * documents.count()
        if name == "secrets":
            assert out.count() == before and not any(brute.base_secrets(r["text"]) for r in out.collect())
        docs, before = out, out.count()
    assert docs.select("doc_id").distinct().count() > 0


def test_run(spark, sf_dir):
    import corpus_pipeline

    assert corpus_pipeline.run(spark, sf_dir).columns == [
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

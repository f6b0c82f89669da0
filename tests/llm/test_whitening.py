from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from postlake.llm.plans import embedding_whitening
from postlake.llm.whitening import jacobi_davidson, whiten

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, components=16):
    """vec_id -> list of (component, n, deviation, |whitened|, explained) by dense numpy."""
    valid = [(i, v) for i, v in rows if v is not None and len(v) and all(c is not None and math.isfinite(c) for c in v)]
    if not valid:
        return {}, np.zeros(0)
    dim = max({len(v) for _, v in valid}, key=lambda d: (sum(len(v) == d for _, v in valid), d))
    valid = [(i, [math.floor(64 * float(c)) + 1_000_000 for c in v]) for i, v in valid if len(v) == dim]
    fit = np.array(sorted({tuple(x) for _, x in valid}), dtype=np.int64)
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - sums / n
    cov = centred.T @ centred / n
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values)[:components]
    values, vectors = values[order], vectors[:, order]
    keep = values > 1e-12 * max(values.max(initial=0), 0)
    values, vectors = values[keep], vectors[:, keep]
    out = {}
    for i, x in valid:
        x = np.array(x)
        deviation = int(sum((n * int(a) - int(s)) ** 2 for a, s in zip(x, sums)))
        white = (x - sums / n) @ vectors / np.sqrt(values)
        out.setdefault(i, []).append([(j + 1, n, deviation, abs(white[j]), values[j] / np.trace(cov)) for j in range(len(values))])
    return out, values


def _check(got, rows, components=16):
    want, values = brute(rows, components)
    by_id = {}
    for r in got:
        by_id.setdefault(r["vec_id"], []).append(r)
    assert set(by_id) == set(want)
    for i, found in by_id.items():
        copies = len(want[i])
        expected = sorted(want[i][0] * copies)
        found = sorted((r["component"], r["n"], r["deviation"], abs(r["whitened"]), r["explained"]) for r in found)
        assert len(found) == len(expected)
        for f, e in zip(found, expected):
            assert f[:3] == e[:3]
            assert f[3] == pytest.approx(e[3], rel=1e-6, abs=1e-6)
            assert f[4] == pytest.approx(e[4], rel=1e-4)
    for r in got:
        assert r["identity_error"] <= 1e-4


def test_operator_against_dense_eigen(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.standard_normal(12) * np.linspace(0.05, 0.6, 12)).tolist()) for i in range(300)]
    rows += [(300, rows[0][1]), (300, rows[0][1]), (301, None), (302, [1.0, None] + [0.0] * 10), (303, [float("nan")] * 12),
             (304, [float("inf")] + [0.0] * 11), (305, []), (306, [0.1] * 5), (None, rows[5][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("label", F.lit(None).cast("int"))
    df = df.withColumn("x", F.lit("clash")).withColumn("centred", F.lit(1)).withColumn("c", F.lit(2))
    got = whiten(df, components=16).collect()
    _check(got, rows)
    assert {r["component"] for r in got} == set(range(1, 13))


def test_few_distinct_vectors_and_empty(spark):
    rows = [(i, [0.5, 0.25, -0.5] if i % 2 else [0.0, 0.0, 0.0]) for i in range(10)]
    got = whiten(spark.createDataFrame(rows, SCHEMA.replace("array<float>", "array<double>").replace(", label int", "")))
    got = got.collect()
    assert {r["component"] for r in got} == {1}
    _check(got, rows)
    one = spark.createDataFrame([(1, [0.5, 0.5])], "vec_id long, embedding array<double>")
    assert whiten(one).collect() == []
    assert whiten(spark.createDataFrame([], SCHEMA)).collect() == []


def test_jacobi_davidson_with_clusters():
    rng = np.random.default_rng(5)
    q, _ = np.linalg.qr(rng.standard_normal((40, 40)))
    spectrum = np.concatenate([[9.0] * 5, [8.999999] * 3, np.linspace(0.1, 5, 32)])
    matrix = q @ np.diag(spectrum) @ q.T
    values, vectors = jacobi_davidson(lambda w: matrix @ w, 40, 16)
    assert np.allclose(values, np.sort(spectrum)[::-1][:16], atol=1e-11)
    assert np.abs(matrix @ vectors - vectors * values).max() < 1e-10


def test_query_on_the_table(spark):
    sf_dir = "/root/testdata/sf0.001"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    _check(embedding_whitening(spark, sf_dir).collect(), rows)

from __future__ import annotations

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from postlake.llm import hardnegatives
from postlake.llm.hardnegatives import hard_negatives
from postlake.llm.plans import hard_negative_mining
from postlake.plans.registry import ORACLES

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows):
    """All (anchor, positive, rank, negative, ps, ns) by scoring every anchor against every row."""
    valid = [(i, v, l) for i, v, l in rows if i is not None and l is not None and v is not None and len(v)
             and all(c is not None and math.isfinite(c) for c in v)]
    if not valid:
        return []
    dim = max({len(v) for _, v, _ in valid}, key=lambda d: (sum(len(v) == d for _, v, _ in valid), d))
    table = [(i, [math.floor(256 * c) for c in v], (l + 1) % 10 if i % 7 == 0 else l) for i, v, l in valid if len(v) == dim]
    out = []
    for a, ax, al in table:
        if a % 100:
            continue
        scored = sorted(((sum(p * q for p, q in zip(ax, x)), i, lab) for i, x, lab in table), key=lambda t: (-t[0], t[1]))
        positives = [(s, i) for s, i, lab in scored if lab == al and i != a][:5]
        for ps, pid in positives:
            negatives = [(s, i) for s, i, lab in scored if lab != al and 80 * ps <= 100 * s <= 100 * ps][:5]
            out += [(a, pid, r + 1, nid, ps, ns) for r, (ns, nid) in enumerate(negatives)]
    return sorted(out)


def _rows(df):
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score",
                                              "negative_score").collect())


def _table(seed, size, dim=6, spread=1.0):
    rnd = random.Random(seed)
    rows = []
    for i in range(size):
        center = rnd.choice([[0.3] * dim, [-0.2] * dim, [0.1, -0.1] * (dim // 2)])
        rows.append((i, [c + rnd.gauss(0, 0.2 * spread) for c in center], rnd.randrange(3)))
    return rows


@pytest.mark.parametrize("block_rows, per_task", [(4, 3), (128, 512)])
def test_against_brute_force(spark, monkeypatch, block_rows, per_task):
    monkeypatch.setattr(hardnegatives, "BLOCK_ROWS", block_rows)
    monkeypatch.setattr(hardnegatives, "ANCHORS_PER_TASK", per_task)
    monkeypatch.setattr(hardnegatives, "BLOCKS_PER_TASK", per_task)
    monkeypatch.setattr(hardnegatives.hilbert_blocks, "__defaults__", (hardnegatives.HILBERT_BITS, block_rows))
    rows = _table(1, 700)
    rows += [(700 + k, rows[100][1], rows[100][2]) for k in range(30)]  # ties: one vector many times
    rows += [(800, None, 1), (900, [0.1] * 6, None), (1000, [float("nan")] * 6, 1), (1100, [0.1, None] + [0.0] * 4, 2),
             (1200, [0.2] * 3, 1), (None, [0.3] * 6, 1), (1300, [-0.3] * 6, 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("block", "x", "ax", "score", "anchor_id", "low", "high", "ac", "zc"):
        df = df.withColumn(name, F.lit("clash"))
    got = _rows(hard_negatives(df))
    assert got == brute(rows)
    assert len(got) > 50


def test_empty_and_tiny(spark):
    assert hard_negatives(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(0, [0.5, 0.5], 1), (100, [0.5, 0.4], 1)]
    assert _rows(hard_negatives(spark.createDataFrame(rows, SCHEMA))) == brute(rows) == []


def test_query_against_sql(spark):
    sf_dir = "/root/testdata/sf0.01"
    got = _rows(hard_negative_mining(spark, sf_dir))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    want = sorted(tuple(r) for r in con.execute(ORACLES["op12_hard_negative_mining"]).fetchall())
    assert got == want and len(got) > 0


def by_row(rows):
    """The contract row by row, in Python integers: rows that repeat a vec_id stay apart."""
    table = [(i, [math.floor(256 * c) for c in v], (l + 1) % 10 if i % 7 == 0 else l) for i, v, l in rows]
    out = []
    for k, (a, ax, al) in enumerate(table):
        if a % 100:
            continue
        scored = sorted((-sum(p * q for p, q in zip(ax, x)), i, n, lab) for n, (i, x, lab) in enumerate(table)
                        if len(x) == len(ax))
        positives = [(-s, i) for s, i, n, lab in scored if lab == al and n != k][:5]
        for ps, pid in positives:
            negatives = [(-s, i) for s, i, n, lab in scored if lab != al and 80 * ps <= -100 * s <= 100 * ps][:5]
            out += [(a, pid, r + 1, nid, ps, ns) for r, (ns, nid) in enumerate(negatives)]
    return sorted(out)


@pytest.mark.parametrize("kind", ["repeated ids", "large values", "huge outliers", "lengths"])
def test_odd_rows(spark, kind):
    rows = _table(2, 400)
    if kind == "repeated ids":
        rows += [(i % 150, v, l) for i, v, l in _table(3, 300)] + rows[:101:50]
    elif kind == "large values":  # scores fit a long, a hundred times them does not
        rows = [(i, [4e6 * c for c in v], l) for i, v, l in rows]
    elif kind == "huge outliers":  # beyond every window, but their blocks and longs must hold
        rows += [(401, [-1e30] * 6, 8), (402, [-3e19, 0.0, 0.0, 0.0, 0.0, 0.0], 6), (403, [1e17, 1e17] + [-1e17] * 4, 5)]
    else:
        rows += [(1000 + i, v, l) for i, v, l in _table(4, 300, dim=4)]
        rows += [(2000 + i, v[:1], l) for i, v, l in _table(5, 20)]
    want = by_row(rows)
    assert _rows(hard_negatives(spark.createDataFrame(rows, SCHEMA))) == want and len(want) > 20


def test_tasks_in_many_partitions(spark, monkeypatch):
    """Anchors and rows of a task meet wherever its key is hashed to, not only in one coalesced partition."""
    monkeypatch.setattr(hardnegatives, "ANCHORS_PER_TASK", 3)
    monkeypatch.setattr(hardnegatives, "BLOCKS_PER_TASK", 2)
    rows = _table(6, 900)
    conf = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(conf, "false")
    try:
        got = _rows(hard_negatives(spark.createDataFrame(rows, SCHEMA)))
    finally:
        spark.conf.unset(conf)
    assert got == by_row(rows) and len(got) > 50

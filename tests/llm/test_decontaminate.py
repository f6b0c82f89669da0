from __future__ import annotations

import random

import numpy as np

from postlake.llm.decontaminate import find_leaks, smith_waterman, without_leaks
from postlake.llm.plans import benchmark_decontamination
from tests.llm import brute


def _items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def _words(draw, count):
    return [f"v{draw.randrange(3000)}" for _ in range(count)]


def test_exact_and_edited_copies(spark, make_docs, clashing):
    draw = random.Random(4)
    items = [(n, _words(draw, draw.randrange(15, 60))) for n in range(30)]
    docs, expected = [], set()
    for n in range(120):
        words = _words(draw, 300)
        if n % 2 == 0:
            item, passage = items[n // 2 % 30][0], list(items[n // 2 % 30][1])
            for at in range(n % 5, len(passage), 6 if n % 4 else len(passage) + 9):
                passage[at] = "edited"
            words[100:100] = passage
            expected.add((n, item))
        docs.append((n, " ".join(words).upper() if n % 3 == 0 else ", ".join(words)))
    benchmark = _items(spark, [(i, " ".join(w)) for i, w in items])
    found = find_leaks(clashing(make_docs(docs)), clashing(benchmark)).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == expected
    assert all(r["start"] <= 102 and r["end"] > 100 and r["similarity"] >= 0.5 for r in found)


def test_alignment_against_the_full_table():
    draw = np.random.default_rng(3)
    a = [draw.integers(0, 6, n).astype(np.uint64) + 10 for n in (1, 5, 17, 30)]
    b = [draw.integers(0, 6, n).astype(np.uint64) + 10 for n in (1, 40, 3, 60)]
    low = lambda xs: np.concatenate([[0], np.cumsum([len(x) for x in xs])[:-1]])
    size = lambda xs: np.array([len(x) for x in xs])
    score, start, end = smith_waterman(np.concatenate(a), low(a), size(a), np.concatenate(b), low(b), size(b))
    assert score.tolist() == [brute.smith_waterman(x.tolist(), y.tolist()) for x, y in zip(a, b)]
    for x, y, s, low_at, high in zip(a, b, score, start, end):
        assert s == 0 or brute.smith_waterman(x.tolist(), y[low_at:high].tolist()) == s


def test_edge_cases(spark, make_docs):
    docs = make_docs([(1, None), (2, ""), (3, "one"), (4, "say one two"), (5, "the long answer is here"), (None, "one two"), (4, "say one two"),
                      (7, "x y " * 20000 + "the long answer is here")])
    items = _items(spark, [(1, None), (2, ""), (3, "one two"), (4, "the long answer is here"), (4, "the long answer is here"), (None, "...")])
    found = sorted((r["doc_id"] or 0, r["item_id"]) for r in find_leaks(docs, items).collect())
    assert found == [(0, 3), (3, 3), (4, 3), (4, 3), (5, 4), (5, 4), (7, 4), (7, 4)]
    assert find_leaks(make_docs([]), items).collect() == [] and find_leaks(docs, items.limit(0)).collect() == []
    kept = without_leaks(docs, items)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {1, 2, None}


def test_query_against_whole_passages(spark, sf_dir, documents):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()
    expected = {(d["doc_id"], i["item_id"]) for d in documents.collect() for i in items if i["text"] in d["text"]}
    found = {(r["doc_id"], r["item_id"]) for r in benchmark_decontamination(spark, sf_dir).collect()}
    assert expected and expected <= found


def test_every_pair_against_the_full_table(spark, make_docs):
    draw = random.Random(11)
    items = [(n, _words(draw, draw.choice([3, 9, 15, 15, 25, 40]))) for n in range(12)]
    docs = []
    for n in range(160):
        words, passage = _words(draw, 60), list(items[n % 12][1])
        if n % 4 == 3:  # random edits: tokens replaced, left out and added
            passage = [y for x in passage for y in ([x], [x], ["other"], [], [x, "more"])[draw.choice([0, 0, 0, 0, 1, 2, 2, 3, 4])]]
        elif n % 4 < 2:
            for at in range(n % 3, len(passage), 4 + n % 4):
                passage[at] = f"edit{n}"
        else:
            passage = [y for x in passage for y in (x, "between")]
        words[n % 50:n % 50] = passage
        docs.append((n, words))
    # Whole copies elsewhere make seeds that edits broke occur.
    for whole in ([], [(1000 + i, w) for i, w in items]):
        rows = docs + whole
        expected = {(d, i): s / (2 * len(w)) for d, x in rows for i, w in items for s in [brute.smith_waterman(w, x)] if s >= len(w)}
        found = find_leaks(make_docs([(d, " ".join(x)) for d, x in rows]), _items(spark, [(i, " ".join(w)) for i, w in items])).collect()
        assert {(r["doc_id"], r["item_id"]): r["similarity"] for r in found} == expected
        assert all(len({d for d, _ in expected if d < 1000 and d % 4 == k}) > 10 for k in range(4))

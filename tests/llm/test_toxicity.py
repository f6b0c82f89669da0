from __future__ import annotations

import random

import pytest

from postlake.llm.plans import toxicity
from postlake.llm.toxicity import maximal_segments, score_toxicity, without_toxic
from tests.llm import brute

BAD = ["vexil", "gromp", "skarn"]


def _texts(count: int, seed: int):
    draw, rows, labels = random.Random(seed), [], []
    for n in range(count):
        words = [f"w{draw.randrange(400)}" for _ in range(draw.randrange(5, 120))]
        toxic = n % 4 == 0
        for _ in range(draw.randrange(1, 5) if toxic else 0):
            words[draw.randrange(len(words))] = draw.choice(BAD) + draw.choice(["", "ia", "ung", "os"])
        rows.append((n, " ".join(words)))
        labels.append((n, int(toxic)))
    return rows, labels


def _labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, toxic int")


def test_held_out_accuracy(spark, make_docs, clashing):
    rows, labels = _texts(1200, 7)
    found = score_toxicity(clashing(make_docs(rows)), _labels(spark, labels)).collect()
    truth = dict(labels)
    assert len(found) == len(rows)
    for r in found:
        assert r["held_out"] == brute.held_out(r["doc_id"])
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    unseen = [r for r in found if r["held_out"]]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in unseen) >= 0.97 * len(unseen)


def test_held_out_labels_change_nothing(spark, make_docs):
    rows, labels = _texts(300, 8)
    turned = [(i, 1 - y if brute.held_out(i) else y) for i, y in labels]
    one, other = ({r["doc_id"]: r["score"] for r in score_toxicity(make_docs(rows), _labels(spark, ls)).collect()}
                  for ls in (labels, turned))
    assert one == other


def test_odd_texts_and_labels(spark, make_docs):
    rows, labels = _texts(200, 9)
    odd = [(1001, None), (1002, ""), (1003, "..."), (1004, "gromp " * 20000), (None, "vexil vexil"), (5, rows[5][1])]
    found = score_toxicity(make_docs(rows + odd), _labels(spark, labels + [(3, 1), (3, None), (None, 1), (9999, 1)])).collect()
    assert len(found) == len(rows) + len(odd)
    by = {r["doc_id"]: r for r in found}
    assert by[1001]["score"] == by[1002]["score"] == by[1003]["score"] and by[1001]["predicted"] == 0
    assert by[1004]["predicted"] == 1 and by[None]["predicted"] == 1 and not by[None]["held_out"]
    assert score_toxicity(make_docs([]), _labels(spark, labels)).collect() == []
    none = score_toxicity(make_docs(rows[:20]), _labels(spark, [])).collect()
    assert len({r["score"] for r in none}) == 1
    kept = without_toxic(make_docs(rows + odd), _labels(spark, labels))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in found if not r["predicted"]} | {None}


@pytest.mark.parametrize("seed", range(5))
def test_segments_against_the_definition(seed):
    draw = random.Random(seed)
    scores = [-0.05] * 40
    at = sorted(draw.sample(range(40), 15))
    for n in at:
        scores[n] = draw.uniform(-3, 3)
    found = maximal_segments(at, [scores[n] for n in at])
    assert {(s, e) for s, e, _ in found} == brute.maximal_segments(scores)
    for start, end, score in found:
        assert score == pytest.approx(sum(scores[start:end]))


def test_query(spark, sf_dir, documents):
    assert toxicity(spark, sf_dir).count() == documents.count()

from __future__ import annotations

import random

from postlake.llm import minhash
from postlake.llm.graph import components
from postlake.llm.minhash import near_duplicates, without_near_duplicates
from tests.llm import brute


def _found(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def _check(spark_rows, rows, percent=85):
    assert spark_rows == brute.near_duplicates(rows, percent)


def _near_copies(count: int, edits, seed: int, length: int = 120) -> list[str]:
    draw = random.Random(seed)
    base = [f"w{draw.randrange(5000)}" for _ in range(length)]
    out = []
    for n in range(count):
        words = list(base)
        for _ in range(edits(n)):
            words[draw.randrange(length)] = f"e{draw.randrange(10 ** 6)}"
        out.append(" ".join(words))
    return out


def test_same_as_all_pairs_on_the_table(spark, documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    found = near_duplicates(documents).collect()
    _check({r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found}, rows)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found)


def test_links_among_many_near_copies(make_docs):
    # Copies with up to six edits: most are too far from the least one, some pairs are close.
    texts = _near_copies(150, lambda n: n % 7, seed=3)
    _check(_found(near_duplicates(make_docs(texts))), list(enumerate(texts)))


def test_a_chain_of_links(make_docs):
    texts, words = [], [f"w{n}" for n in range(200)]
    for n in range(12):
        words = list(words)
        words[n * 15:n * 15 + 2] = [f"a{n}", f"b{n}"]
        texts.append(" ".join(words))
    found = _found(near_duplicates(make_docs(texts)))
    _check(found, list(enumerate(texts)))
    assert {c for _, c in found.values()} == {0}


def test_edge_cases(spark, make_docs, clashing):
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one two"), (5, "ONE  two"), (6, "one two three four five"),
            (7, "one two three four five six"), (8, "é É x"), (9, "a " * 30000), (10, "a b " * 20), (None, "one two")]
    df = near_duplicates(clashing(make_docs(rows)))
    found = df.collect()
    assert len(found) == len(rows)
    _check({r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found if r["doc_id"] is not None},
           [r for r in rows if r[0] is not None])
    alone = [r for r in found if r["doc_id"] is None]
    assert [(r["component_id"], r["kept"]) for r in alone] == [(None, True)]
    assert near_duplicates(make_docs([])).collect() == []


def test_repeated_rows(make_docs):
    rows = [(3, "a b c d e f"), (3, "a b c d e f"), (1, "a b c d e f"), (9, "other words stand here now")]
    found = near_duplicates(make_docs(rows)).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in found) == [(1, 1), (3, 1), (3, 1), (9, 9)]
    kept = without_near_duplicates(make_docs(rows + [(9, "other words stand here now"), (None, "a b c d e f")]))
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == [
        (1, "a b c d e f"), (9, "other words stand here now"), (None, "a b c d e f")]
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_components_of_long_chains_and_stars(spark):
    chain = [(n, n + 1) for n in range(100, 140)] + [(7, n) for n in range(8, 40)] + [(3, 3), (50, None)]
    df = spark.createDataFrame(random.Random(1).sample(chain, len(chain)) * 2, "a long, b long")
    found = {r["node"]: r["component"] for r in components(df).collect()}
    assert found == {n: 100 for n in range(100, 141)} | {n: 7 for n in range(7, 40)}
    assert components(df.limit(0)).collect() == []


def test_copies_far_from_the_first_in_the_same_way(make_docs, monkeypatch):
    # All lack the first 30 words of document 0 and have four of forty edits: pairs share most
    # differences from it, too few for a link.
    draw = random.Random(5)
    base = [f"w{n}" for n in range(120)]
    texts = [" ".join([f"x{n}" for n in range(30)] + base[30:])]
    for _ in range(160):
        words = list(base)
        for place in draw.sample(range(34, 118, 4), 4):
            words[place] = f"e{place}v{draw.randrange(2)}"
        texts.append(" ".join(words))
    stored = {}
    write = minhash.cut_lineage
    monkeypatch.setattr(minhash, "cut_lineage", lambda df, name: stored.setdefault(name, []).append(write(df, name)) or stored[name][-1])
    _check(_found(near_duplicates(make_docs(texts))), list(enumerate(texts)))
    assert stored["unresolved"][0].count() > 100
    assert stored["met"][0].count() < 160 * 159 / 2 / 4

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from postlake.llm import plans
from postlake.llm.licences import scan_licences, train
from postlake.llm.plans import URL_RULES
from postlake.llm.sharding import fill_table, place, write_shards
from postlake.llm.urlfilter import Rule, host_ranks, judge_urls


def _pages(spark, rows):
    return spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], "page_id long, url string, html string")


@pytest.mark.parametrize("name", ["license_scans", "url_filters", "sharding"])
def test_no_python_in_the_plan(spark, sf_dir, name):
    plan = getattr(plans, name)(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct|BroadcastNestedLoopJoin", plan)


URLS = [
    (None, "", ""), ("no scheme", "", ""), ("http://A.Example.NET/en/x?y#z", "a.example.net", "/en/x"), ("://net/", "net", "/"),
    ("x://h?q://z/", "h", ""), ("http://org#f", "org", ""), ("https://b.org/fr/1", "b.org", "/fr/1"), ("http://xnet/", "xnet", "/"),
    ("http://c.example.com/de/1", "c.example.com", "/de/1"), ("http://c.example.com/DE/1", "c.example.com", "/DE/1"), ("", "", ""),
    ("http://a.net", "a.net", ""), ("http://É.net/\nx", "É.net", "/\nx"),
]


def test_hosts_paths_and_rules(spark, clashing):
    found = {r["page_id"]: r for r in judge_urls(clashing(_pages(spark, [(u, None) for u, _, _ in URLS])), URL_RULES).collect()}
    for n, (_, host, path) in enumerate(URLS):
        assert (found[n]["host"], found[n]["path"]) == (host, path)
    rules = {n: (r["rule"], r["verdict"]) for n, r in found.items() if r["rule"]}
    assert rules == {2: ("example.net/en/", "allow"), 3: ("net/", "block"), 6: ("org/fr/", "allow"),
                     8: ("example.com/de/", "block"), 12: ("net/", "block")}
    assert found[0]["verdict"] == "allow"
    assert judge_urls(_pages(spark, []), URL_RULES).collect() == []


def _ranks(links, seeds, rounds=60):
    """Personalised PageRank, hosts without links giving back to the seeds."""
    rank = dict(seeds)
    hosts = {h for link in links for h in link} | set(seeds)
    for _ in range(rounds):
        got = dict.fromkeys(hosts, 0.0)
        for a in hosts:
            out = [b for x, b in links if x == a]
            for b in out:
                got[b] += rank.get(a, 0.0) / len(out)
        passed = sum(got.values())
        rank = {h: 0.85 * got[h] + (1 - 0.85 * passed) * seeds.get(h, 0.0) for h in hosts}
    return rank


def test_trust_follows_links_and_distrust_runs_back(spark):
    links = {"good.a": ["near.b", "x.c"], "near.b": ["far.d"], "x.c": ["bad.e"], "farm.f": ["bad.e", "bad.e:80"], "bad.e": ["good.a"],
             "lone.g": []}
    html = {h: "".join(f'<a href="http://U@{t.upper()}/p">x</a><img src=\'//{t}/i\'>' for t in ts) + '<a href="/self">' for h, ts in links.items()}
    pages = _pages(spark, [(f"http://{h}/p{k}", html[h]) for h in links for k in range(3)] + [("http://near.b/", None)])
    rules = [Rule("allow", "good.a", "/"), Rule("block", "bad.e", "/")]
    found = {r["host"]: r for r in judge_urls(pages, rules).collect()}
    edges = {(a, b) for a, bs in links.items() for b in (t.split(":")[0] for t in bs)}
    trust = _ranks(edges, {"good.a": 1.0})
    distrust = _ranks({(b, a) for a, b in edges}, {"bad.e": 1.0})
    for host, row in found.items():
        assert row["trust"] == pytest.approx(trust.get(host, 0.0), abs=2e-3)
        assert row["distrust"] == pytest.approx(distrust.get(host, 0.0), abs=2e-3)
    assert found["farm.f"]["verdict"] == "block" and found["near.b"]["verdict"] == "allow" and found["lone.g"]["verdict"] == "allow"


def test_ranks_reach_as_far_among_many_seeds(spark):
    # Each seed's share of the rank is below 1e-4; far3 lies three links from one of them.
    chain = [("bad", "far1"), ("far1", "far2"), ("far2", "far3")]
    hosts = spark.range(12_000).select(F.concat(F.lit("seed"), "id").alias("host"), F.lit(0.0).alias("allowed"), F.lit(1.0).alias("blocked"))
    few = spark.createDataFrame([("bad", 0.0, 1.0)], hosts.schema)
    links = spark.createDataFrame([(b, a) for a, b in chain], "src string, dst string")
    found = {r["host"]: r["distrust"] for r in host_ranks(hosts.unionByName(few), links).collect()}
    for near, far in (("bad", "far1"), ("far1", "far2"), ("far2", "far3")):
        assert 0 < found[far] == pytest.approx(0.85 * found[near], rel=1e-3)


def test_every_share_of_ruled_pages_seeds(spark):
    hosts = spark.createDataFrame(
        [("a", 0.0, 0.3), ("b", 0.1, 0.1), ("c", 0.0, 0.0), ("d", 0.0, 0.0)], "host string, allowed double, blocked double")
    found = {r["host"]: r for r in host_ranks(hosts, spark.createDataFrame([], "src string, dst string")).collect()}
    assert {h: (r["trust"], r["distrust"]) for h, r in found.items()} == {
        "a": (0.0, pytest.approx(0.75)), "b": (1.0, pytest.approx(0.25)), "c": (0.0, 0.0), "d": (0.0, 0.0)}
    assert {h for h, r in found.items() if r["bad"]} == {"a"}


def test_shard_table():
    shards = [f"s{n}" for n in range(7)]
    table = fill_table(shards, 997)
    sizes = [table.count(n) for n in range(7)]
    assert sum(sizes) == 997 and max(sizes) - min(sizes) <= 1
    fewer = fill_table(shards[:-1], 997)
    moved = sum(a != b for a, b in zip(table, fewer) if a != 6)
    assert moved < 0.3 * 997
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            fill_table(bad)
    with pytest.raises(ValueError):
        fill_table(["a"], 10)


def test_placement(spark, make_docs, clashing, tmp_path):
    docs = clashing(make_docs([(1, "a"), (1, "a"), (None, "b"), (3, None)]))
    rows = place(docs, F.col("doc_id"), ["x", "y"], 11, prefix="new_").collect()
    assert len(rows) == 4 and len({(r["new_slot"], r["new_shard"]) for r in rows if r["doc_id"] == 1}) == 1
    assert all(r["new_shard"] == fill_table(["x", "y"], 11)[r["new_slot"]] for r in rows)
    write_shards(make_docs([str(n) for n in range(50)]), F.col("doc_id"), ["x", "y"], str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).groupBy("shard").count().count() == 2


def test_licences(spark, documents, make_docs, clashing):
    model = train(documents)
    texts = [
        "Intro\nLicensed under the Apache License, Version 2.0.\nmore", "Released under the MIT License.",
        "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.",
        "Copyright 2021 the authors. Licensed under the Mozilla Public License, version 2.0.", None, "", "Er kommt mit dem Zug.",
        "words " * 20000 + "\nThis software is released under the BSD 3-Clause License.", "nothing to see",
    ]
    rows = scan_licences(clashing(make_docs(texts)), model).collect()
    found = {r["doc_id"]: r["family"] for r in rows if r["confirmed"]}
    assert found == {0: "apache", 1: "mit", 2: "gpl", 3: "cc-by-nc", 4: "mpl", 8: "bsd"}
    assert {r["line"] for r in rows if r["doc_id"] == 0} == {1}
    assert not any(r["doc_id"] in (5, 6, 7, 9) for r in rows)
    assert scan_licences(make_docs([]), model).collect() == []
    lines = {(r["doc_id"], n) for r in documents.collect() for n, x in enumerate(r["text"].split("\n")) if x.startswith(("Licensed under", "Released under the MIT"))}
    assert lines <= {(r["doc_id"], r["line"]) for r in scan_licences(documents, model).collect() if r["confirmed"]}

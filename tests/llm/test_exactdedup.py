from __future__ import annotations

import hashlib
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from postlake.llm.exactdedup import exact_duplicates
from postlake.llm.plans import exact_dedup
from postlake.plans.registry import ORACLES

SPACE = re.compile(r"[\x20\x09-\x0D]")


def brute(rows):
    """doc_id -> (keep_id, group_size, kept, sha) over all rows by plain Python."""
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(SPACE.sub("", text or ""), []).append((doc_id, len(text or "")))
    out = []
    for norm, members in groups.items():
        keep = sorted(members, key=lambda m: (-m[1], m[0] is None, m[0] if m[0] is not None else 0))[0][0]
        sha = hashlib.sha256(norm.encode()).hexdigest()
        out += [(d, keep, len(members), d == keep, sha) for d, _ in members]
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0, r[1] or 0))


def _rows(df):
    got = [(r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in df.collect()]
    return sorted(got, key=lambda r: (r[0] is None, r[0] or 0, r[1] or 0))


ODD = [None, "", " \n\t", "a b", "ab", "a\tb\r\n", "\U0001d11e x", "\U0001d11ex", "é é", "é é", "w " * 100000,
       "w" * 100000, "tie", "tie", "t i e"]


@pytest.mark.parametrize("hot_rows, member_bits", [(100_000, 24), (1, 24), (2, 6)])
def test_odd_texts_against_brute(make_docs, clashing, hot_rows, member_bits):
    rows = list(enumerate(ODD)) + [(3, "a b")]  # a repeated row
    df = clashing(make_docs(rows)).withColumn("fp", F.lit("x")).withColumn("norm", F.lit(1)).withColumn("word", F.lit(2))
    assert _rows(exact_duplicates(df, hot_rows=hot_rows, member_bits=member_bits)) == brute(rows)


def test_random_copies_and_edits(make_docs):
    rnd = random.Random(7)
    base = [" ".join(rnd.choice(["ab", "cd", "ef", "gh"]) for _ in range(rnd.randint(0, 12))) for _ in range(40)]
    rows = []
    for n in range(400):
        text = rnd.choice(base)
        if rnd.random() < 0.5:
            text = text.replace(" ", rnd.choice(["  ", "\n", "\t", ""]))
        if rnd.random() < 0.1:
            text = None
        rows.append((n if rnd.random() < 0.97 else None, text))
    assert _rows(exact_duplicates(make_docs(rows), hot_rows=20, member_bits=8)) == brute(rows)


def test_empty_table(make_docs):
    assert exact_duplicates(make_docs([])).collect() == []


def test_query_against_sql(spark):
    sf_dir = "/root/testdata/sf0.01"
    got = _rows(exact_dedup(spark, sf_dir))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf_dir}/documents.parquet/**/*.parquet')"
                if not sf_dir.endswith("0.01") else f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = sorted(con.execute(ORACLES["op11_exact_dedup"]).fetchall(), key=lambda r: (r[0] is None, r[0] or 0, r[1] or 0))
    assert got == want
    assert sum(1 for r in got if not r[3]) > 0

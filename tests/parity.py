"""Run registered queries and their oracle SQL side by side and compare rows."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def oracle(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return value if isinstance(value, str) else repr(value)


def _rows(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def difference(spark_df, con, sql: str) -> str | None:
    """None if both give the same columns, types and rows; else what differs."""
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    kinds = {d[0]: str(d[1]) for d in found.description}
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} != {sorted(names)}"
    expected_kind = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE",
                     "string": "VARCHAR", "boolean": "BOOLEAN"}
    wrong = {n: (t, kinds[n]) for n, t in spark_df.dtypes if expected_kind.get(t) != kinds[n]}
    theirs = _rows(names, found.fetchall())
    ours = _rows(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    if len(ours) != len(theirs):
        return f"{len(ours)} rows != {len(theirs)}"
    for a, b in zip(ours, theirs):
        if a != b:
            bad = [(str(x)[:300], str(y)[:300]) for x, y in zip(a, b) if x != y]
            return f"row {str(a[0])[:40]}: {bad[:2]}"
    return f"types {wrong}" if wrong else None


def main(sf_dir: str, wanted: list[str]) -> None:
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    from __spark_entry__ import oracle_sql, queries
    from tests.session import make_session

    spark, con, sqls = make_session(), oracle(sf_dir), oracle_sql()
    for name, run in queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            df = run(spark, sf_dir)
            found = difference(df, con, sqls[name]) if name in sqls else f"rows only: {df.count()}"
        except Exception as failure:
            found = f"{type(failure).__name__}: {str(failure)[:600]}"
        print(f"{name:34s} {time.time() - start:6.2f}s  {found or 'ok'}", flush=True)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])

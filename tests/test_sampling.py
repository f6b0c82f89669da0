from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from postlake.operators import sampling
from postlake.sources import profile, tables


@pytest.fixture
def keyed(spark):
    """Ties in the first order column, a wide spread in the second."""
    rng = random.Random(7)
    rows = [(rng.choice([5, 5, 5, rng.randrange(2**62)]), n * 1_000_003) for n in range(3000)]
    return spark.createDataFrame(rows, "h long, id long"), sorted(rows)


@pytest.fixture(params=[100_000, 40])
def sort_rows(request, monkeypatch):
    """Both the small-table path and the narrowing rounds."""
    monkeypatch.setattr(sampling, "SORT_ROWS", request.param)
    monkeypatch.setattr(sampling, "HISTOGRAM", 16)
    monkeypatch.setattr(sampling, "POSITION_ROWS", request.param)


@pytest.mark.parametrize("n", [1, 2, 750, 2249, 2250, 2999, 3000])
def test_nth_key(keyed, sort_rows, n):
    df, rows = keyed
    assert sampling.nth_key(df, ["h", "id"], n) == rows[n - 1]


def test_past_the_end(keyed, sort_rows):
    df, _ = keyed
    assert sampling.nth_key(df, ["h", "id"], 3001) is None
    assert sampling.nth_key(df, ["h", "id"], 0) is None
    assert sampling.nth_key(df.limit(0), ["h", "id"], 1) is None
    assert sampling.take_n(df, ["h", "id"], 5000).count() == 3000


def test_take_n_and_split(keyed, sort_rows):
    df, rows = keyed
    taken = {tuple(r) for r in sampling.take_n(df, ["h", "id"], 1234).collect()}
    assert taken == set(rows[:1234])
    split = sampling.positional_split(df, ["h", "id"], 1000, 50)
    found = {(r["h"], r["id"]): r["split"] for r in split.collect()}
    assert found == {r: "train" if n < 1000 else "val" for n, r in enumerate(rows[:1050])}


def test_short_tables_empty_val_first(keyed, sort_rows):
    df, _ = keyed
    counts = sampling.positional_split(df, ["h", "id"], 2990, 50).groupBy("split").count()
    assert dict(counts.collect()) == {"train": 2990, "val": 10}
    counts = sampling.positional_split(df, ["h", "id"], 9000, 50).groupBy("split").count()
    assert dict(counts.collect()) == {"train": 3000}


def test_shuffle_positions(spark, sort_rows):
    df = spark.range(1000).withColumn("h", sampling.order_hash("id", seed=42))
    expected = [r["id"] for r in df.orderBy("h").collect()]
    shuffled = sampling.seeded_shuffle(df, ["h", "id"])
    assert [r["id"] for r in shuffled.orderBy("position").collect()] == expected
    assert sorted(r["position"] for r in shuffled.collect()) == list(range(1000))


def test_repeated_keys_are_refused(spark, monkeypatch):
    monkeypatch.setattr(sampling, "SORT_ROWS", 10)
    with pytest.raises(ValueError, match="not unique"):
        sampling.nth_key(spark.range(50).select(F.lit(3).alias("k")), ["k"], 7)


def test_copies_are_told_apart_by_row_key(spark, tmp_path, monkeypatch):
    """Half of the table is one row repeated; samples stay exact."""
    path = str(tmp_path / "t")
    spark.range(400).select(F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id")).alias("v")) \
        .repartition(3).write.parquet(path)
    monkeypatch.setattr(sampling, "SORT_ROWS", 20)
    df = tables.with_row_key(spark.read.parquet(path))
    df = df.withColumn("h", sampling.order_hash("file_key", "row_no", seed=1))
    taken = sampling.take_n(df, ["h", "file_key", "row_no"], 123)
    assert taken.count() == 123
    assert taken.select("file_key", "row_no").distinct().count() == 123


def test_hash_split_is_stable(spark):
    df = spark.range(5000)
    split = sampling.hash_split(sampling.hash_draw("id", seed=3), 900, 50).alias("s")
    one = {tuple(r) for r in df.repartition(1).select("id", split).collect()}
    many = {tuple(r) for r in df.repartition(13).select("id", split).collect()}
    assert one == many
    share = sum(s == "train" for _, s in one) / 5000
    assert 0.87 < share < 0.93


def test_quartiles_do_not_depend_on_size(spark, monkeypatch):
    values = [float(v) for v in [1, 2, 2, 2, 2, 9, 11, 40, 41, 5000]] + [7.5] * 300
    df = spark.createDataFrame([(v,) for v in values] + [(None,), (math.nan,)], "v double")
    expected = profile.describe(df, ["v"]).collect()
    assert [expected[0][n] for n in ("count", "p25", "p50", "p75")] == [310, 7.5, 7.5, 7.5]
    monkeypatch.setattr(profile, "SORT_VALUES", 1)
    monkeypatch.setattr(profile, "GRID", 4)
    assert profile.describe(df, ["v"]).collect() == expected


def test_infinities_are_values(spark):
    df = spark.createDataFrame([(v,) for v in (-math.inf, 1.0, 2.0, 4.0, math.inf)], "v double")
    row = profile.describe(df, ["v"]).first()
    assert (row["min"], row["p25"], row["p50"], row["p75"], row["max"]) == (-math.inf, 1.0, 2.0, 4.0, math.inf)
    none = profile.describe(df.limit(0), ["v"]).first()
    assert none["count"] == 0 and none["p50"] is None


@pytest.mark.parametrize("seed", range(2))
def test_order_statistics(spark, monkeypatch, seed):
    draw = random.Random(seed)
    values = [float(draw.choice([draw.randrange(50), draw.randrange(10 ** 6)])) for _ in range(4000)]
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(5)
    monkeypatch.setattr(profile, "SORT_VALUES", 50)
    wanted = [1, 2, 999, 1000, 2000, 3999, 4000, 4001]
    found = profile.order_statistics(df, [("v", n) for n in wanted])
    assert found == [sorted(values)[n - 1] if n <= 4000 else None for n in wanted]


@pytest.mark.parametrize("accuracy", [3, 100, 100_000])
def test_quartiles_from_the_sketch_match_a_sort(spark, monkeypatch, accuracy):
    """Brackets narrow or wide (even wrong at a tiny accuracy), ties or not: the same exact quartiles."""
    monkeypatch.setattr(profile, "ACCURACY", accuracy)
    draw = random.Random(accuracy)
    values = [float(draw.choice([draw.randrange(5), draw.randrange(10 ** 5)])) for _ in range(3001)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double").repartition(4)
    row = profile.describe(df, ["v"]).first()
    ordered = sorted(values)
    for name, share in profile.QUARTILES:
        at = (len(values) - 1) * share
        low, high = ordered[int(at)], ordered[min(int(at) + 1, len(values) - 1)]
        assert row[name] == round(low + (high - low) * (at % 1), 3)


@pytest.mark.parametrize("seed", range(2))
def test_several_cuts_in_one_walk(spark, seed):
    draw = random.Random(seed)
    rows = [(float(draw.choice([draw.randrange(30), draw.randrange(10 ** 6)])), n) for n in range(3000)]
    df = spark.createDataFrame(rows, "v double, id long").repartition(3)
    ordered = sorted(rows)
    wanted = [1, 2, 700, 1500, 1501, 2999, 3000, 3001, 0]
    found = sampling.nth_keys(df, ["v", "id"], wanted, sort_rows=20, histogram=16)
    assert found == [ordered[n - 1] if 1 <= n <= 3000 else None for n in wanted]
    assert sampling.nth_keys(df, ["v", "id"], wanted) == found


def test_shuffle_positions_with_a_skewed_key(spark, monkeypatch):
    """A third of the rows share one value of the first column; any order columns work."""
    monkeypatch.setattr(sampling, "POSITION_ROWS", 100)
    rows = [(0 if n % 3 == 0 else n * 7 % 1000, n) for n in range(3000)]
    df = spark.createDataFrame(rows, "v long, id long").repartition(5)
    found = {r["id"]: r["position"] for r in sampling.seeded_shuffle(df, ["v", "id"]).collect()}
    assert found == {n: p for p, (_, n) in enumerate(sorted(rows))}
    sizes = sampling.seeded_shuffle(df, ["v", "id"]).groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in sizes) < 1000


def test_column_profile_and_head(spark):
    df = spark.createDataFrame([(3, "a", None), (1, None, 2.5), (2, "c", 1.0)], "id long, name string, v double")
    found = [tuple(r) for r in profile.column_profile(df).collect()]
    assert found == [(1, "id", "bigint", 3), (2, "name", "string", 2), (3, "v", "double", 2)]
    assert [r["id"] for r in profile.head(df, ["id"], 2).collect()] == [1, 2]

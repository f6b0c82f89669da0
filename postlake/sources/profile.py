"""Row counts and column profiles (SC6, SC7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from postlake.schemas import TARGETS

QUARTILES = [("p25", 0.25), ("p50", 0.50), ("p75", 0.75)]
#: Steps of the grid of one round, and values sorted at most.
GRID, SORT_VALUES = 500, 20_000


def row_counts(df: DataFrame, complete: Column) -> DataFrame:
    """SC6: rows per split, all and with both labels, in one pass."""
    return df.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(complete).alias("n_complete")
    )


def columns_and_types(df: DataFrame) -> list[tuple[str, str]]:
    """SC7: column names with their types, read from the schema alone."""
    return df.dtypes


def column_profile(df: DataFrame) -> DataFrame:
    """SC7: position, name, type and count of non-NULL values of every column, in one pass."""
    counts = df.agg(*[F.count(F.col(f"`{name}`")).alias(f"c{k}") for k, (name, _) in enumerate(df.dtypes)]).first()
    rows = [F.struct(F.lit(k + 1).alias("position"), F.lit(name).alias("name"), F.lit(kind).alias("type"),
                     F.lit(counts[f"c{k}"]).cast("bigint").alias("non_null"))
            for k, (name, kind) in enumerate(columns_and_types(df))]
    return df.sparkSession.range(1).select(F.inline(F.array(*rows))) if rows else df.sparkSession.createDataFrame(
        [], "position int, name string, type string, non_null bigint")


def head(df: DataFrame, order: list[str], n: int = 5) -> DataFrame:
    """SC7: the first n rows by `order`, a top-k that no task sorts the table for."""
    return df.orderBy(*order).limit(n)


def describe(df: DataFrame, columns: list[str] = TARGETS) -> DataFrame:
    """SC7: count, mean, std, min, quartiles and max per column, to 3 places.

    NULL and NaN are left out; infinities are ordinary values, the least and greatest.
    Quartiles interpolate between neighbours, where they fall between two that differ.
    Two passes: one aggregation gives the moments and, from a mergeable quantile sketch,
    values that bracket every wanted order statistic; a second counts the values below
    each bracket and sorts those inside it, see `bracketed_order_statistics`.
    """
    clean = [F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(c) for c in columns]
    values = df.select(clean)
    basics = [
        f(c).alias(f"{c}_{name}") for c in columns for name, f in
        [("count", F.count), ("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max)]
    ]
    wanted_shares = [share for _, share in QUARTILES]
    found = values.agg(*basics, *[sketch(c, wanted_shares).alias(f"{c}_sketch") for c in columns]).first().asDict()
    wanted = []
    for c in columns:
        for _, share in QUARTILES:
            at = (found[f"{c}_count"] - 1) * share
            wanted += [(c, int(at) + 1), (c, min(int(at) + 2, found[f"{c}_count"]))]
    numbers = iter(bracketed_order_statistics(values, wanted, {c: (found[f"{c}_count"], found[f"{c}_sketch"]) for c in columns}))
    for c in columns:
        for name, share in QUARTILES:
            below, above, part = next(numbers), next(numbers), (found[f"{c}_count"] - 1) * share % 1
            found[f"{c}_{name}"] = below if below == above or part == 0 else below + (above - below) * part
    names = ["mean", "std", "min", *[p for p, _ in QUARTILES], "max"]
    rows = [
        F.struct(
            F.lit(c).alias("name"), F.lit(found[f"{c}_count"]).cast("bigint").alias("count"),
            *[F.round(F.lit(found[f"{c}_{n}"]).cast("double"), 3).alias(n) for n in names],
        ) for c in columns
    ]
    return df.sparkSession.range(1).select(F.inline(F.array(*rows)))


#: Accuracy of the quantile sketch: a returned value's rank is within n / ACCURACY of the asked one.
ACCURACY = 100_000


def sketch(column: str, shares: list[float]) -> Column:
    """Values of a mergeable (Greenwald-Khanna) quantile sketch around the given shares.

    For every share q two values: at q - 2/ACCURACY and at q + 2/ACCURACY (clipped to 0
    and 1), which bracket the exact order statistic at q by the sketch's rank guarantee.
    """
    edges = []
    for share in shares:
        edges += [max(0.0, share - 2 / ACCURACY), min(1.0, share + 2 / ACCURACY)]
    return F.percentile_approx(column, F.array(*[F.lit(e) for e in edges]), ACCURACY)


def bracketed_order_statistics(values: DataFrame, wanted: list[tuple[str, int]],
                               sketches: dict[str, tuple[int, list | None]]) -> list[float | None]:
    """The wanted (column, n-th smallest value)s, exact, in one more pass over `values`.

    Each wanted rank takes the sketch's bracket [low, high] of the nearest share; one
    aggregation counts the values below, equal to low and equal to high, and sorts the
    values strictly inside (at most about 4 n / ACCURACY of them, ties or not). A rank the
    bracket does not hold (the sketch's guarantee failed) is found by `order_statistics`.
    """
    answers: list[float | None] = [None] * len(wanted)
    brackets = {}
    for t, (c, rank) in enumerate(wanted):
        n, edges = sketches[c]
        if not n or edges is None or not 1 <= rank <= n:
            continue
        share = (rank - 1) / max(n - 1, 1)
        k = min(range(len(QUARTILES)), key=lambda j: abs(QUARTILES[j][1] - share))
        brackets[t] = (c, float(edges[2 * k]), float(edges[2 * k + 1]), rank)
    rest = [t for t in range(len(wanted)) if t not in brackets and wanted[t][1] >= 1 and sketches[wanted[t][0]][0]]
    if brackets:
        aggs = []
        for t, (c, low, high, _) in brackets.items():
            v = F.col(c)
            aggs += [F.count_if(v < low).alias(f"b{t}"), F.count_if(v == low).alias(f"l{t}"),
                     F.count_if((v == high) & (v > low)).alias(f"h{t}"),
                     F.sort_array(F.collect_list(F.when((v > low) & (v < high), v))).alias(f"v{t}")]
        found = values.agg(*aggs).first().asDict()
        for t, (_, low, high, rank) in brackets.items():
            inside, at = found[f"v{t}"], rank - found[f"b{t}"]
            if 1 <= at <= found[f"l{t}"]:
                answers[t] = low
            elif 1 <= at - found[f"l{t}"] <= len(inside):
                answers[t] = inside[at - found[f"l{t}"] - 1]
            elif 1 <= at - found[f"l{t}"] - len(inside) <= found[f"h{t}"]:
                answers[t] = high
            else:
                rest.append(t)
    if rest:
        for t, value in zip(rest, order_statistics(values, [wanted[t] for t in rest])):
            answers[t] = value
    return answers


def order_statistics(values: DataFrame, wanted: list[tuple[str, int]]) -> list[float | None]:
    """The wanted (column, n-th smallest value)s, exact; None past the end.

    A round takes an approximate grid of every target's candidates, whose error is well
    below the grid's step, and counts what lies below and between the two grid values
    around the target. A round leaves about a two-hundredth of the candidates, whatever
    the size of the table; at most SORT_VALUES are sorted.
    """
    answers: list[float | None] = [None] * len(wanted)
    ranks = {t: n for t, (_, n) in enumerate(wanted)}
    cells = [F.struct(F.lit(t).alias("t"), F.col(c).alias("v")) for t, (c, _) in enumerate(wanted)]
    rows = values.select(F.inline(F.array(*cells))).filter(F.col("v").isNotNull())
    shares = [F.lit(k / GRID) for k in range(GRID + 1)]
    while ranks:
        rows = rows.filter(F.col("t").isin(list(ranks)))
        grids = {r["t"]: r for r in rows.groupBy("t").agg(
            F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"),
            F.percentile_approx("v", F.array(*shares), GRID * 10).alias("grid")).collect()}
        bounds = {}
        for t in list(ranks):
            grid = grids.get(t)
            if grid is None or not 1 <= ranks[t] <= grid["n"]:
                del ranks[t]
                continue
            k = int((ranks[t] - 1) / grid["n"] * GRID)
            low = grid["grid"][k - 2] if k >= 2 else grid["low"]
            high = grid["grid"][k + 3] if k + 3 <= GRID else grid["high"]
            bounds[t] = (low, high)
        if not bounds:
            break
        low, high = (F.element_at(F.create_map(*[
            F.lit(x) for t, pair in bounds.items() for x in (t, float(pair[end]))]), F.col("t")) for end in (0, 1))
        rows = rows.filter(F.col("t").isin(list(bounds)))
        between = (F.col("v") > low) & (F.col("v") < high)
        counts = {r["t"]: r for r in rows.groupBy("t").agg(
            F.count_if(F.col("v") < low).alias("below"), F.count_if(F.col("v") == low).alias("least"),
            F.count_if(between).alias("inside")).collect()}
        # Values equal to a grid value are settled here, so ties cannot keep a round from shrinking.
        for t, (least, most) in bounds.items():
            ranks[t] -= counts[t]["below"] + counts[t]["least"]
            if ranks[t] <= 0 or ranks[t] > counts[t]["inside"]:
                answers[t] = least if ranks[t] <= 0 else most
                del ranks[t]
        rows = rows.filter(between)
        small = {t: n for t, n in ranks.items() if counts[t]["inside"] <= SORT_VALUES}
        if small:
            at = F.element_at(F.create_map(*[F.lit(x) for pair in small.items() for x in pair]), F.col("t"))
            listed = rows.filter(F.col("t").isin(list(small))).groupBy("t").agg(F.sort_array(F.collect_list("v")).alias("v"))
            for r in listed.select("t", F.get("v", (at - 1).cast("int")).alias("v")).collect():
                answers[r["t"]] = r["v"]
                del ranks[r["t"]]
    return answers

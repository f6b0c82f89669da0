"""Connected components of an edge table, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from postlake.llm.ids import within
from postlake.sources.scratch import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b); component is the least node.

    Each round hooks a node to its least neighbour and contracts the edges, until none
    is left. Rounds order nodes by id and by a seeded hash in turn: the first resolves
    stars around a small id at once, the second halves long chains. Every round's
    tables are written to the shared folder, so no lineage grows and a lost executor
    costs a re-read. Self loops, repeated edges and NULL ends are ignored; no edges
    give no rows.
    """
    left = _contracted(edges, F.col("a"), F.col("b"))
    layers: list[DataFrame] = []
    while not left.isEmpty():
        seed = F.lit(len(layers) // 2)
        rank = (lambda c: c) if len(layers) % 2 == 0 else (lambda c: F.xxhash64(c, seed))
        both = left.select(F.col("a").alias("node"), F.col("b").alias("near")).unionAll(
            left.select(F.col("b").alias("node"), F.col("a").alias("near")))
        least = both.groupBy("node").agg(F.min(F.struct(rank(F.col("near")).alias("r"), "near")).alias("m"))
        own = F.struct(rank(F.col("node")).alias("r"), F.col("node").alias("near"))
        hooks = within(cut_lineage(least.select("node", F.least("m", own)["near"].alias("parent")), "hooks"))
        layers.append(hooks)
        mapped = left.join(hooks.select(F.col("node").alias("a"), F.col("parent").alias("pa")), "a").join(
            hooks.select(F.col("node").alias("b"), F.col("parent").alias("pb")), "b")
        left = _contracted(mapped, F.col("pa"), F.col("pb"))
    if not layers:
        return edges.select(F.col("a").alias("node"), F.col("a").alias("component")).limit(0)
    found = layers[-1].select("node", F.col("parent").alias("root"))
    for layer in reversed(layers[:-1]):
        above = within(found).select(F.col("node").alias("parent"), "root")
        found = cut_lineage(layer.join(above, "parent", "left").select(
            "node", F.coalesce("root", "parent").alias("root")), "roots")
    least = cut_lineage(found.groupBy("root").agg(F.min("node").alias("component")), "least")
    return cut_lineage(found.join(within(least), "root").select("node", "component"), "components")


def _contracted(edges: DataFrame, a, b) -> DataFrame:
    pairs = edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), (a != b).alias("apart"))
    return cut_lineage(pairs.where("apart").select("a", "b").distinct(), "edges")

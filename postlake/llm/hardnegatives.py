"""Hard-negative mining over Hilbert-ordered blocks with per-dimension zone maps.

Rows are quantised to HILBERT_BITS bits per dimension, ordered along a Hilbert curve in all
dimensions, and cut into blocks of BLOCK_ROWS consecutive rows, written as Parquet. Every
block keeps a zone map: the least and greatest value of every dimension, and its labels
with their counts. For an anchor a, interval arithmetic bounds the score of every row of a
block: a_d * x_d lies between a_d * lo_d and a_d * hi_d, so the sum lies in [LB, UB].

- Positives: in a task, an anchor's blocks taken in falling LB until they hold 5 rows of
  its label (the anchor left out) give a floor that its top five scores reach; blocks
  whose UB is below the floor are not read.
- Negatives: with the positives known, only blocks with another label whose [LB, UB] meets
  the anchor's score windows [0.8 p, p] are read.

Anchors meet blocks in tasks of at most ANCHORS_PER_TASK anchors and the rows of about
BLOCKS_PER_TASK blocks (a stated query set against all rows, in blocks). A task scores
the rows it must read with one matrix product, exactly, and returns only its best five
per anchor (and positive); the best five of those over all tasks are the result.

On 64-dimensional embeddings such zone maps are wide: in the check tables nearly every
block's UB reaches the floor (measured 99 percent), so the work stays anchors x rows;
see the README.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from postlake.llm.words import map_texts
from postlake.sources.scratch import cut_lineage

#: Each component x becomes floor(SCALE * x).
SCALE = 256
#: Anchors, positives and negatives per pair, as the contract fixes them.
ANCHOR_EVERY, RELABEL_EVERY, LABELS, TOP = 100, 7, 10, 5
#: The window of negative scores: LOW_PERCENT * p <= 100 * n <= 100 * p.
LOW_PERCENT = 80
#: Bits per dimension of the Hilbert key, rows per block, and the sizes of a bounding task.
HILBERT_BITS, BLOCK_ROWS = 2, 128
ANCHORS_PER_TASK, BLOCKS_PER_TASK = 512, 64

OUT = ("anchor_id long, positive_id long, rank int, negative_id long, positive_score long, "
       "negative_score long")


def prepared(embeddings: DataFrame) -> DataFrame:
    """vec_id, label (relabelled every RELABEL_EVERY-th id) and x (whole-valued array<double>) of rows that take part.

    Rows without id, with a NULL label, a NULL or empty vector, or a NULL, NaN or infinite
    entry take no part. Doubles hold every floor(SCALE * c) exactly, also beyond a long.
    """
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) != float("inf"))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"),
                             F.col("embedding").alias("v")).where(
        F.col("label").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & F.col("vec_id").isNotNull()).where(
        F.forall("v", finite))
    label = F.when(F.col("vec_id") % RELABEL_EVERY == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    scaled = F.transform("v", lambda c: c.cast("double") * SCALE)
    # Doubles of 2^52 and more are whole already; floor() would cut them at the ends of a long.
    x = F.transform(scaled, lambda c: F.when(F.abs(c) < 2.0 ** 52, F.floor(c).cast("double")).otherwise(c))
    return rows.select("vec_id", label.alias("label"), x.alias("x"))


def hard_negatives(embeddings: DataFrame) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Higher scores come first, ties by smaller vec_id. An anchor with no other row of its
    label, or a positive with no different-label row in its window, gives no rows; a
    positive with a negative score has an empty window. An empty table gives no rows.
    Rows that repeat a vec_id are rows of their own, as anchors, positives and negatives; only
    the anchor's own row is no positive of it. Rows meet rows of their own vector length.
    """
    rows = prepared(embeddings)
    blocks = hilbert_blocks(rows)
    anchors = cut_lineage(blocks.where(F.col("vec_id") % ANCHOR_EVERY == 0).select(
        F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"), F.col("label").alias("alabel"),
        F.col("x").alias("ax")), "hard-anchors")

    # Positives: every task keeps its best TOP rows of the anchor's label; the best TOP of those stay.
    found = searched(anchors.withColumn("windows", F.lit(None).cast(WINDOWS)), blocks, _best_positives, POSITIVE)
    order = Window.partitionBy("anchor").orderBy(F.desc("score"), "vec_id", "row")
    positives = cut_lineage(found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= TOP).select(
        "anchor", F.col("row").alias("positive"), F.col("vec_id").alias("positive_id"),
        F.col("score").alias("positive_score")), "hard-positives")

    # Negatives: every task keeps, per positive, its best TOP different-label rows in the window.
    windows = positives.groupBy("anchor").agg(F.sort_array(F.collect_list(
        F.struct("positive", "positive_id", "positive_score"))).alias("windows"))
    found = searched(anchors.join(windows, "anchor"), blocks, _best_negatives, NEGATIVE)
    order = Window.partitionBy("anchor", "positive").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"))


def hilbert_blocks(rows: DataFrame, bits: int = HILBERT_BITS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """`rows` with `row` (a number of its own) and `block`: consecutive runs of block_rows rows along
    the Hilbert curve, vectors of one length after those of another, written as Parquet.

    Dimensions are quantised between their least and greatest value over all rows.
    """
    dim = rows.agg(F.max(F.size("x"))).first()[0] or 0
    if dim == 0:
        return rows.withColumns({"row": F.lit(0).cast("long"), "block": F.lit(0).cast("long")}).limit(0)
    spans = rows.agg(*[F.min(F.get("x", F.lit(k))).alias(f"lo{k}") for k in range(dim)],
                     *[F.max(F.get("x", F.lit(k))).alias(f"hi{k}") for k in range(dim)]).first()
    lows = np.array([spans[f"lo{k}"] for k in range(dim)], dtype=np.float64)
    widths = np.array([spans[f"hi{k}"] for k in range(dim)], dtype=np.float64) - lows + 1

    def keys(batches: Iterator) -> Iterator:
        import pyarrow as pa
        for batch in batches:
            x = batch.column("x")
            flat, lengths = x.flatten().to_numpy(zero_copy_only=False), np.diff(x.offsets.to_numpy())
            starts = np.cumsum(lengths) - lengths
            hi, lo = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
            for d in np.unique(lengths):
                of = np.flatnonzero(lengths == d)
                points = flat[starts[of][:, None] + np.arange(d)]
                cells = np.floor((points - lows[:d]) * (1 << bits) / widths[:d]).astype(np.uint64)
                hi[of], lo[of] = hilbert_key(np.minimum(cells, (1 << bits) - 1), bits)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), x, pa.array(lengths), pa.array(hi), pa.array(lo)],
                names=["vec_id", "label", "x", "d", "h1", "h2"])

    keyed = map_texts(rows, keys, "vec_id long, label int, x array<double>, d int, h1 long, h2 long")
    ordered = keyed.repartitionByRange("d", "h1", "h2", "vec_id").sortWithinPartitions("d", "h1", "h2", "vec_id")

    def numbered(batches: Iterator) -> Iterator:
        # Range partitions hold consecutive keys; a block is a run of rows inside one of them.
        import pyarrow as pa
        from pyspark import TaskContext

        base, seen = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            place = np.arange(seen, seen + batch.num_rows, dtype=np.int64)
            seen += batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), batch.column("x"), pa.array(base + place),
                 pa.array(base + place // block_rows)], names=["vec_id", "label", "x", "row", "block"])

    blocks = map_texts(ordered, numbered, "vec_id long, label int, x array<double>, row long, block long")
    return cut_lineage(blocks.select("vec_id", "label", "x", "row", "block"), "hard-blocks")


def hilbert_key(cells: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hilbert index of every row of `cells` (rows x n, values below 2^bits), as two order-preserving longs.

    The axes are turned into the transposed index by Skilling's method, then bits are
    interleaved from the highest; the first 64 bits and the next 64 are returned with the
    top bit flipped, so signed order is the curve's order.
    """
    x = cells.astype(np.uint64).copy()
    rows, n = x.shape
    top = np.uint64(1 << (bits - 1))
    q = top
    while q > 1:
        p = q - np.uint64(1)
        for i in range(n):
            on = (x[:, i] & q) != 0
            x[on, 0] ^= p
            t = (x[~on, 0] ^ x[~on, i]) & p
            x[~on, 0] ^= t
            x[~on, i] ^= t
        q >>= np.uint64(1)
    for i in range(1, n):
        x[:, i] ^= x[:, i - 1]
    t = np.zeros(rows, dtype=np.uint64)
    q = top
    while q > 1:
        t[(x[:, n - 1] & q) != 0] ^= q - np.uint64(1)
        q >>= np.uint64(1)
    x ^= t[:, None]
    words = [np.zeros(rows, dtype=np.uint64), np.zeros(rows, dtype=np.uint64)]
    place = 0
    for level in range(bits - 1, -1, -1):
        for i in range(n):
            if place < 128:
                word = place // 64
                words[word] = (words[word] << np.uint64(1)) | ((x[:, i] >> np.uint64(level)) & np.uint64(1))
            place += 1
    # Keys shorter than 128 bits are moved to the top of their words.
    used = min(place, 128)
    if used < 64:
        words[0] <<= np.uint64(64 - used)
    elif used < 128:
        words[1] <<= np.uint64(128 - used)
    flip = np.uint64(1 << 63)
    return (words[0] ^ flip).view(np.int64), (words[1] ^ flip).view(np.int64)


WINDOWS = "array<struct<positive: long, positive_id: long, positive_score: long>>"
POSITIVE = "anchor long, vec_id long, row long, score long"
NEGATIVE = ("anchor long, anchor_id long, positive long, positive_id long, positive_score long, vec_id long, "
            "row long, score long")


def searched(anchors: DataFrame, blocks: DataFrame, search, schema: str) -> DataFrame:
    """Tasks of at most ANCHORS_PER_TASK anchors and the rows of about BLOCKS_PER_TASK blocks.

    Anchors are dealt to a_tasks groups and blocks to z_tasks groups; every pair of groups is
    one task (a stated query set against all rows, in blocks), for each length of vectors. A task builds the zone maps
    of its blocks, bounds every anchor's scores on them, reads only the blocks the bounds
    leave, and returns a bounded number of rows per anchor. The group keys have one type on
    both sides: an int and a long of one value are hashed to different partitions.
    """
    n_anchors = anchors.count()
    n_blocks = blocks.select("block").distinct().count()
    a_tasks = max(1, math.ceil(n_anchors / ANCHORS_PER_TASK))
    z_tasks = max(1, math.ceil(n_blocks / BLOCKS_PER_TASK))
    left = anchors.select("anchor", "anchor_id", "alabel", "ax", "windows", F.size("ax").alias("d")).withColumn(
        "ac", F.pmod(F.xxhash64("anchor"), F.lit(a_tasks)).cast("int")).withColumn(
        "zc", F.explode(F.sequence(F.lit(0), F.lit(z_tasks - 1))))
    right = blocks.select("vec_id", "label", "x", "row", "block", F.size("x").alias("d")).withColumn(
        "zc", F.pmod(F.xxhash64("block"), F.lit(z_tasks)).cast("int")).withColumn(
        "ac", F.explode(F.sequence(F.lit(0), F.lit(a_tasks - 1))))
    task = ["d", "ac", "zc"]
    return left.groupBy(*task).cogroup(right.groupBy(*task)).applyInPandas(search, schema)


def _block_view(rows: pd.DataFrame):
    """Rows of a task as arrays sorted by block, with each block's zone map and row range."""
    rows = rows.sort_values(["block", "vec_id"], kind="stable")
    x = np.stack(rows["x"].to_numpy())
    block = rows["block"].to_numpy()
    starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
    ends = np.r_[starts[1:], len(block)]
    lo = np.minimum.reduceat(x, starts, axis=0)
    hi = np.maximum.reduceat(x, starts, axis=0)
    return x, rows["vec_id"].to_numpy(), rows["row"].to_numpy(), rows["label"].to_numpy(), starts, ends, lo, hi


MOST = np.iinfo(np.int64).max


def _scores(ax: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products of whole-valued doubles, set to -MOST or MOST beyond a long.

    In doubles where every partial sum stays below 2^53, in longs where it stays below 2^63,
    else in Python integers. Vectors are told apart by their greatest entry, so a few with
    huge entries do not slow the others.
    """
    dim = max(1, ax.shape[-1])
    if np.abs(ax).max(initial=0) * np.abs(x).max(initial=0) * dim < 2.0 ** 53:
        return np.rint(ax @ x.T).astype(np.int64)
    steps = np.sqrt(np.array([2.0 ** 53, 2.0 ** 63]) / dim)
    left, right = (np.searchsorted(steps, np.abs(v).max(axis=1, initial=0), side="right") for v in (ax, x))
    out = np.empty((len(ax), len(x)), np.int64)
    for i in np.unique(left):
        for j in np.unique(right):
            p, q = np.flatnonzero(left == i), np.flatnonzero(right == j)
            a, b = ax[p], x[q]
            bound = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * dim
            if bound < 2.0 ** 53:
                got = np.rint(a @ b.T)
            elif bound < 2.0 ** 62:
                got = a.astype(np.int64) @ b.T.astype(np.int64)
            else:
                whole = np.vectorize(int, otypes=[object])
                got = np.clip(whole(a) @ whole(b).T, -MOST, MOST)
            out[np.ix_(p, q)] = got.astype(np.int64)
    return out


def _bounds(ax: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """[LB, UB] in doubles, widened by their rounding error where sums may pass 2^53."""
    pos, neg = np.maximum(ax, 0), np.minimum(ax, 0)
    low, high = pos @ lo.T + neg @ hi.T, pos @ hi.T + neg @ lo.T
    reach = np.abs(ax) @ np.maximum(np.abs(lo), np.abs(hi)).T
    slack = np.where(reach < 2.0 ** 52, 0.0, reach * (ax.shape[-1] + 8) * 2.0 ** -52)
    return low - slack, high + slack


def _least(p):
    """The least score of a positive's window: LOW_PERCENT percent of p, rounded up, within a long."""
    return LOW_PERCENT * (p // 100) - (-LOW_PERCENT * (p % 100) // 100)


NONE = np.iinfo(np.int64).min


def _top(scores: np.ndarray, ids: np.ndarray, keep: np.ndarray, top: int):
    """Per row of `scores` (anchors x rows): the positions of its best `top` kept entries,
    higher score first, then smaller id; as (anchor index, row position) arrays."""
    masked = np.where(keep, scores, NONE)
    if masked.shape[1] > top:
        floor = np.partition(masked, masked.shape[1] - top, axis=1)[:, masked.shape[1] - top]
    else:
        floor = np.full(masked.shape[0], NONE)
    who, where = np.nonzero(keep & (masked >= floor[:, None]))
    order = np.lexsort((ids[where], -masked[who, where], who))
    who, where = who[order], where[order]
    first = np.r_[0, np.flatnonzero(np.diff(who)) + 1] if len(who) else np.zeros(0, np.int64)
    rank = np.arange(len(who)) - np.repeat(first, np.diff(np.r_[first, len(who)]))
    return who[rank < top], where[rank < top]


def _anchor_arrays(a: pd.DataFrame):
    return np.stack(a["ax"].to_numpy()), a["alabel"].to_numpy(), a["anchor"].to_numpy()


def _best_positives(a: pd.DataFrame, z: pd.DataFrame) -> pd.DataFrame:
    """Per anchor, the task's best TOP other rows of its label, reading only blocks the bounds leave.

    The floor of an anchor is the least bound LB of the blocks, taken in falling LB, that
    first hold TOP rows of its label; blocks whose UB is below it cannot hold a top row.
    """
    if a.empty or z.empty:
        return pd.DataFrame({"anchor": [], "vec_id": [], "row": [], "score": []})
    x, ids, number, labels, starts, ends, lo, hi = _block_view(z)
    ax, alabel, own = _anchor_arrays(a)
    low, high = _bounds(ax, lo, hi)
    of_row = np.repeat(np.arange(len(starts)), ends - starts)
    same = np.stack([np.bincount(of_row, weights=(labels == lab) & (number != i), minlength=len(starts))
                     for lab, i in zip(alabel, own)]).astype(np.int64)
    order = np.argsort(-low, axis=1, kind="stable")
    held = np.cumsum(np.take_along_axis(same, order, axis=1), axis=1)
    enough = held[:, -1] >= TOP
    at = np.argmax(held >= TOP, axis=1)
    floor = np.where(enough, np.take_along_axis(low, order, axis=1)[np.arange(len(own)), at], -np.inf)
    need = (high >= floor[:, None]) & (same > 0)
    read = need.any(axis=0)[of_row]
    rows = np.flatnonzero(read)
    scores = _scores(ax, x[rows])
    keep = need[:, of_row[rows]] & (labels[rows][None, :] == alabel[:, None]) & (number[rows][None, :] != own[:, None])
    who, where = _top(scores, ids[rows], keep, TOP)
    if (scores[who, where] == MOST).any():
        raise OverflowError("the score of a positive does not fit a long")
    return pd.DataFrame({"anchor": own[who], "vec_id": ids[rows][where], "row": number[rows][where],
                         "score": scores[who, where]})


def _best_negatives(a: pd.DataFrame, z: pd.DataFrame) -> pd.DataFrame:
    """Per anchor and positive, the task's best TOP rows of another label in the positive's window,
    reading only blocks whose [LB, UB] meets one of the anchor's windows."""
    columns = ["anchor", "anchor_id", "positive", "positive_id", "positive_score", "vec_id", "row", "score"]
    a = a[[any(w["positive_score"] >= 0 for w in ws) for ws in a["windows"]]] if not a.empty else a
    if a.empty or z.empty:
        return pd.DataFrame({c: [] for c in columns})
    x, ids, number, labels, starts, ends, lo, hi = _block_view(z)
    ax, alabel, own = _anchor_arrays(a)
    aid = a["anchor_id"].to_numpy()
    windows = [[(w["positive"], w["positive_id"], w["positive_score"]) for w in ws if w["positive_score"] >= 0]
               for ws in a["windows"]]
    least = np.array([min(_least(p) for *_, p in ws) for ws in windows], dtype=np.int64)
    most = np.array([max(p for *_, p in ws) for ws in windows], dtype=np.int64)
    low, high = _bounds(ax, lo, hi)
    of_row = np.repeat(np.arange(len(starts)), ends - starts)
    other = np.stack([np.bincount(of_row, weights=labels != lab, minlength=len(starts)) for lab in alabel]) > 0
    need = (high >= least[:, None]) & (low <= most[:, None]) & other
    rows = np.flatnonzero(need.any(axis=0)[of_row])
    scores = _scores(ax, x[rows])
    base = need[:, of_row[rows]] & (labels[rows][None, :] != alabel[:, None])
    out = []
    for j in range(TOP):
        has = np.array([len(ws) > j for ws in windows])
        prow, pid, p = (np.array([ws[j][k] if len(ws) > j else 0 for ws in windows], dtype=np.int64) for k in range(3))
        keep = base & has[:, None] & (_least(p)[:, None] <= scores) & (scores <= p[:, None])
        who, where = _top(scores, ids[rows], keep, TOP)
        out.append(pd.DataFrame({"anchor": own[who], "anchor_id": aid[who], "positive": prow[who],
                                 "positive_id": pid[who], "positive_score": p[who], "vec_id": ids[rows][where],
                                 "row": number[rows][where], "score": scores[who, where]}))
    return pd.concat(out, ignore_index=True)

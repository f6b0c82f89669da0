"""Benchmark items inside training texts: rare tokens that a copy must hold, then local alignment."""

from __future__ import annotations

from collections.abc import Iterator
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from postlake.llm.ids import within
from postlake.llm.words import Lookup, hash_ranges, lower_ascii, map_texts, mix, slices, split_tokens, text_bytes
from postlake.sources.scratch import cut_lineage

#: Seeds of an item that a stretch of text must hold to be aligned; fewer where an item is short.
HITS = 4
MATCH, MISMATCH, GAP = 2, -1, 1
#: A passage counts from this share of the item's perfect score.
LEAST_SIMILARITY = 0.5
#: Benchmark bytes that are held at once; more are searched for block by block.
BLOCK_BYTES = 16 << 20
#: Alignments computed side by side, and cells of a row of them at most (or one alignment).
LANES, CELLS = 256, 1 << 20

FOUND = "doc_id long, item_id long, similarity double, start long, end long"


def find_leaks(docs: DataFrame, benchmark: DataFrame, least: float = LEAST_SIMILARITY) -> DataFrame:
    """(doc_id, item_id, similarity, start, end): training texts that hold a test item.

    Takes doc_id and text, item_id and text; other columns are ignored. Texts become tokens:
    lower-cased runs of letters, digits and bytes beyond ASCII. Benchmark items are the
    query set, held in blocks of BLOCK_BYTES; every block reads all texts twice:

    1. Every token of the items is counted in the corpus. A passage that reaches `least` matches at
       least M = least * n of an item's n tokens, so of any n - M + k of them it matches k. An
       item's seeds are its rarest tokens, as many as that leaves after those found nowhere.
    2. Stretches of text with k seeds no farther apart than such a passage can be long are
       aligned with the item (Smith-Waterman; match 2, mismatch -1, gap -1), unless even all
       their tokens that the item holds could not make the score. A pair is returned if its
       best score reaches `least` of twice the item's tokens. start and end are the
       passage's tokens in the text.

    No pair that reaches `least` is passed over, whatever its edits. NULL or empty texts and items match
    nothing, no rows give none. Repeated rows are reported once each. Rows with a NULL id
    are reported with it.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = None
    for items in _blocks(benchmark):
        part = _search(docs, items, least)
        found = part if found is None else found.unionAll(part)
    if found is None:
        return docs.sparkSession.createDataFrame([], FOUND)
    return found


def without_leaks(docs: DataFrame, benchmark: DataFrame, least: float = LEAST_SIMILARITY) -> DataFrame:
    """`docs` less the rows whose doc_id holds a test item. Rows without doc_id stay."""
    leaks = cut_lineage(find_leaks(docs, benchmark, least).select("doc_id").distinct(), "leaks")
    return docs.join(within(leaks), "doc_id", "left_anti").select(*docs.columns)


class _Items:
    """One block of items: tokens end to end, and which of them are seeds."""

    def __init__(self, ids: list, column: pa.Array):
        self.ids = ids
        self.tokens, self.first = tokens_of(column)
        self.item = np.repeat(np.arange(len(ids)), np.diff(self.first))
        self.words = np.unique(self.tokens)

    def choose_seeds(self, counts: np.ndarray, least: float) -> None:
        """Keep each item's rarest tokens that occur, so many that a passage holds `hits` of them."""
        sizes = np.diff(self.first)
        place = np.searchsorted(self.words, self.tokens)
        need = np.maximum(np.ceil(least * sizes - 1e-9), 1).astype(np.int64)
        self.hits = np.minimum(need, HITS)
        #: Tokens of text in a passage at most: n matches, and the edits that its score allows.
        self.reach = np.floor(3 * sizes - 2 * least * sizes + 1e-9).astype(np.int64)
        order = np.lexsort((counts[place], self.item))
        order = order[counts[place[order]] > 0]
        item = self.item[order]
        alive = np.bincount(item, minlength=len(sizes))
        rank = np.arange(len(order)) - np.repeat(np.cumsum(alive) - alive, alive)
        kept = (rank < (alive - need + self.hits)[item]) & (alive >= need)[item]
        seeds = np.unique(np.stack([place[order[kept]], item[kept]]), axis=1)
        self.seed_item = seeds[1]
        self.low = np.searchsorted(seeds[0], np.arange(len(self.words) + 1))
        self.held = np.unique(_held_keys(self.tokens, self.item))


def _held_keys(tokens: np.ndarray, item: np.ndarray) -> np.ndarray:
    return mix(tokens + (item.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))


def tokens_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(token hashes end to end, row offsets into them)."""
    data, offsets = text_bytes(column)
    data = lower_ascii(data)
    starts, ends, first = split_tokens(data, offsets)
    return hash_ranges(data, starts, ends), first


def _blocks(benchmark: DataFrame) -> Iterator[_Items]:
    """The items, in blocks of at most BLOCK_BYTES or one item."""
    ids, texts, held = [], [], 0
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    for row in rows.where("text IS NOT NULL").toLocalIterator():
        size = len(row["text"].encode())
        if ids and held + size > BLOCK_BYTES:
            yield _Items(ids, pa.array(texts, pa.large_string()))
            ids, texts, held = [], [], 0
        ids.append(row["item_id"])
        texts.append(row["text"])
        held += size
    if ids:
        yield _Items(ids, pa.array(texts, pa.large_string()))


def _search(docs: DataFrame, items: _Items, least: float) -> DataFrame:
    context = docs.sparkSession.sparkContext
    held_words = context.broadcast(items.words)

    def count(batches):
        lookup = Lookup(held_words.value)
        total = np.zeros(len(lookup.table), np.int64)
        for batch in slices(batches, "text"):
            slots = lookup.places(tokens_of(batch.column("text"))[0])
            total += np.bincount(slots[slots >= 0], minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["slot", "n"])

    # At most one row per token of the block.
    counted = map_texts(docs, count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(len(items.words), np.int64)
    counts[counted.column("slot").to_numpy()] = counted.column("n").to_numpy()
    items.choose_seeds(counts, least)
    held = context.broadcast(vars(items))  # plain arrays: executors need no package to read them

    def align(batches):
        block = SimpleNamespace(**held.value)
        lookup = Lookup(block.words)
        for batch in slices(batches, "text"):
            tokens, first = tokens_of(batch.column("text"))
            row, item, low, high = _stretches(block, first, lookup.places(tokens))
            if len(row):
                found = _aligned(block, tokens, first, row, item, low, high, least)
                row = pa.array(found["row"])
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").take(row), pa.array([block.ids[i] for i in found["item"]], pa.int64()),
                    pa.array(found["similarity"]), pa.array(found["start"]), pa.array(found["end"])],
                    names=["doc_id", "item_id", "similarity", "start", "end"])

    return map_texts(docs, align, FOUND)


def _stretches(block: SimpleNamespace, first, slots):
    """(row, item, low, high): token ranges in which every passage that could do lies whole."""
    at = np.flatnonzero(slots >= 0)
    slots = slots[at]
    many = block.low[slots + 1] - block.low[slots]
    before = np.cumsum(many) - many
    entry = np.arange(int(many.sum())) + np.repeat(block.low[slots] - before, many)
    at, item = np.repeat(at, many), block.seed_item[entry]
    order = np.argsort(item, kind="stable")
    at, item = at[order], item[order]
    row = np.searchsorted(first, at, side="right") - 1
    reach = block.reach[item]
    # The hit that completes this one's number of hits, if near enough.
    last = np.arange(len(at)) + block.hits[item] - 1
    inside = np.minimum(last, max(len(at) - 1, 0))
    good = np.flatnonzero((last < len(at)) & (item[inside] == item) & (row[inside] == row) & (at[inside] - at < reach))
    row, item, reach = row[good], item[good], reach[good]
    low = np.maximum(at[inside[good]] - reach + 1, first[row])
    high = np.minimum(at[good] + reach, first[row + 1])
    # Overlapping ranges are joined, then cut into ranges of two reaches that overlap by one.
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (low[1:] >= high[:-1])
    begins = np.flatnonzero(new)
    low, high = low[begins], high[np.append(begins[1:], len(row)) - 1] if len(row) else high
    row, item, reach = row[begins], item[begins], reach[begins]
    parts = np.maximum(-(-(high - low) // reach) - 1, 1)
    part = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
    row, item, reach, low, high = (np.repeat(x, parts) for x in (row, item, reach, low, high))
    low = low + part * reach
    return row, item, low, np.minimum(low + 2 * reach, high)


def _aligned(block: SimpleNamespace, tokens, first, row, item, low, high, least: float) -> dict[str, np.ndarray]:
    """The best passage of every (row, item) that reaches the least similarity."""
    length = np.diff(block.first)[item]
    score, start, end = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
    by = np.lexsort((high - low, length))
    done = 0
    while done < len(by):
        some = by[done:done + LANES]
        some = some[:max(1, CELLS // int((high - low)[some].max()))]
        done += len(some)
        some = some[_most_score(block, tokens, item[some], low[some], (high - low)[some]) / (MATCH * length[some]) >= least]
        if len(some):
            score[some], start[some], end[some] = smith_waterman(
                block.tokens, block.first[item[some]], length[some], tokens, low[some], (high - low)[some])
    similarity = score / (MATCH * length)
    start, end = low - first[row] + start, low - first[row] + end
    order = np.lexsort((start, -similarity, item, row))
    order = order[(similarity[order] >= least) & (score[order] > 0)]
    r, i = row[order], item[order]
    best = order[np.concatenate([[True], (r[1:] != r[:-1]) | (i[1:] != i[:-1])])] if len(order) else order
    return {"row": row[best], "item": item[best], "similarity": similarity[best], "start": start[best], "end": end[best]}


def _most_score(block: SimpleNamespace, tokens, item, low, size) -> np.ndarray:
    """A bound on each range's score: its best run where all tokens that the item holds match."""
    columns = np.arange(int(size.max()))
    text = tokens[np.minimum(low[:, None] + columns, len(tokens) - 1)]
    key = _held_keys(text, np.broadcast_to(item[:, None], text.shape))
    held = block.held[np.minimum(np.searchsorted(block.held, key), len(block.held) - 1)] == key
    total = np.cumsum(np.where(held & (columns < size[:, None]), MATCH, MISMATCH), axis=1)
    before = np.minimum.accumulate(np.concatenate([np.zeros((len(low), 1), np.int64), total[:, :-1]], axis=1), axis=1)
    return (total - before).max(axis=1)


def smith_waterman(a, a_low, a_size, b, b_low, b_size) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best local alignment of a[a_low:][:a_size] with b[b_low:][:b_size], many at a time.

    Returns (score, start in b, end in b). A cell holds score and start in one number, the
    score above; of equal scores the earliest start wins. A row's gaps are a running
    maximum, so only the rows are looped over.
    """
    bits = max(1, int(b_size.max() + 1).bit_length())
    unit, full = 1 << bits, (1 << bits) - 1
    width, lanes = int(b_size.max()), len(a_low)
    columns = np.arange(width)
    inside = columns[None, :] < b_size[:, None]
    text = np.where(inside, b[np.minimum(b_low[:, None] + columns, len(b) - 1)], 0)
    fresh = full - columns  # an alignment that starts in this column
    slope = (columns + 1) * (GAP * unit)
    above = np.zeros((lanes, width + 1), np.int64)
    best, best_end = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
    for i in range(int(a_size.max())):
        live = i < a_size
        word = a[np.minimum(a_low + i, len(a) - 1)]
        same = (text == word[:, None]) & inside & live[:, None]
        corner = np.where(above[:, :-1] >= unit, above[:, :-1], fresh)
        cell = np.maximum(corner + np.where(same, MATCH * unit, MISMATCH * unit), above[:, 1:] - GAP * unit)
        cell[cell < unit] = 0
        cell = np.maximum.accumulate(cell + slope, axis=1) - slope
        cell[cell < unit] = 0
        above = np.concatenate([np.zeros((lanes, 1), np.int64), np.where(live[:, None], cell, 0)], axis=1)
        top = above[:, 1:].max(axis=1)
        better = top >> bits > best >> bits
        best = np.where(better, top, best)
        best_end = np.where(better, above[:, 1:].argmax(axis=1) + 1, best_end)
    start = np.where(best > 0, full - (best & full), 0)
    return best >> bits, start, best_end

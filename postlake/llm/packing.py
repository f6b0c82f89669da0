"""Packing of tokenized texts into windows by multiway differencing."""

from __future__ import annotations

import heapq
import json
import zlib

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, functions as F

from postlake.llm.transducer import (
    DIGIT, LETTER, OTHER, SPACE, SPACES, byte_names, classes_of, code_points, contractions, point_offsets, utf8_of)
from postlake.llm.words import hash_ranges, map_texts, runs, slices, text_bytes, worker_cache
from postlake.sources.scratch import cut_lineage

#: The id that ends a document.
END_ID = 1
#: Known pretokens in one worker before they are dropped.
MOST_KNOWN = 200_000
#: Fixed value: the pretoken pattern of byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WHITE = frozenset(map(chr, SPACES))
#: Pieces that one task differences at a time, on average.
GROUP = 2_000

PIECES = "doc_id long, doc_no long, start long, length long, ids_crc32 long, doc_tokens long"


def pack(docs: DataFrame, vocabulary: str, window: int = 2048, group: int = GROUP) -> DataFrame:
    """Cut every text's ids into pieces and place them in windows of at most `window` ids.

    Takes doc_id (whole number) and text; `vocabulary` is the path of a byte-level tokenizers
    JSON file that every executor has. A document is its ids and then END_ID, also when
    its text is NULL or empty. Full windows are cut from its start; the rest is cut at the
    largest multiple of a quarter window, which leaves light pieces to even out with.

    Returns one row per piece: doc_id, start, length, ids_crc32 (of the ids as unsigned
    little-endian 32-bit words), doc_tokens, sequence_id, offset. Rests are dealt by a hash into
    groups of about `group` pieces. In a group, Karmarkar-Karp differencing keeps a heap of
    partial partitions, takes the two with the largest imbalance and merges heavy windows
    of one with light windows of the other; if a window of the result exceeds the
    capacity, the group is partitioned again with more windows. Repeated rows are packed
    once each; a NULL doc_id is packed too; other columns are ignored; no rows give none.
    """
    pieces = cut_lineage(token_pieces(docs, vocabulary, window), "pieces")
    full = F.col("length") == window
    rests = pieces.where(~full)
    groups = max(1, round(rests.count() / group))
    key = F.pmod(F.xxhash64("doc_id", "doc_no", "start"), F.lit(groups))
    placed = rests.withColumn("group", key).groupBy("group").applyInArrow(
        _placer(window), "group long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
                         "window_no long, offset long")
    placed = cut_lineage(placed, "placed")
    # Groups number their windows apart: each has room for as many as the largest one uses.
    most = (placed.agg(F.max("window_no")).first()[0] or 0) + 1
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    rest_rows = placed.select(*columns, (F.col("group") * most + F.col("window_no")).alias("sequence_id"), "offset")
    full_rows = pieces.where(full).select(
        *columns, (F.lit(most * groups) + F.monotonically_increasing_id()).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"))
    return rest_rows.unionByName(full_rows)


def token_pieces(docs: DataFrame, vocabulary: str, window: int = 2048) -> DataFrame:
    """(doc_id, doc_no, start, length, ids_crc32, doc_tokens) for every piece; doc_no tells
    rows with equal doc_id apart."""
    docs = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
        F.monotonically_increasing_id().alias("doc_no"))

    def cut(batches):
        encoder = encoder_of(vocabulary)
        for batch in slices(batches, "text", 2 << 20):
            ids, offsets = encoder.encode(*text_bytes(batch.column("text")))
            rows, starts, lengths, sums = [], [], [], []
            sizes = np.diff(offsets) + 1
            for row in range(batch.num_rows):
                own = np.append(ids[offsets[row]:offsets[row + 1]], np.uint32(END_ID)).astype("<u4")
                for start, length in _cuts(len(own), window):
                    rows.append(row)
                    starts.append(start)
                    lengths.append(length)
                    sums.append(zlib.crc32(own[start:start + length].tobytes()))
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").take(at), batch.column("doc_no").take(at), pa.array(starts, pa.int64()),
                pa.array(lengths, pa.int64()), pa.array(sums, pa.int64()), pa.array(sizes[rows].astype(np.int64))],
                names=["doc_id", "doc_no", "start", "length", "ids_crc32", "doc_tokens"])

    return map_texts(docs, cut, PIECES)


def _cuts(size: int, window: int) -> list[tuple[int, int]]:
    """Ranges of a document: full windows, quarter windows together, and what is left."""
    done = size // window * window
    cuts = [(start, window) for start in range(0, done, window)]
    quarter = max(1, window // 4)
    for length in ((size - done) // quarter * quarter, (size - done) % quarter):
        if length:
            cuts.append((done, length))
            done += length
    return cuts


def _placer(window: int):
    def place(table: pa.Table) -> pa.Table:
        # The order of rows in a group follows the shuffle; ours must not.
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"),
                               ("doc_no", "ascending")])
        lengths = table.column("length").to_numpy().astype(np.int64)
        number, offset = differencing(lengths, window)
        return pa.table({
            **{c: table.column(c) for c in ("group", "doc_id", "start", "length", "ids_crc32", "doc_tokens")},
            "window_no": pa.array(number), "offset": pa.array(offset)})
    return place


def differencing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(window number, offset) of every piece; no window holds more than `capacity`.

    Starts from the least count of windows that could hold all pieces. Every time the
    near-equal partition exceeds the capacity, the count rises by half a percent, one at least.
    """
    if len(lengths) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if lengths.max() > capacity:
        raise ValueError("a piece is longer than the window")
    count = int(-(-lengths.sum() // capacity))
    while True:
        number = partition(lengths, count)
        loads = np.bincount(number, lengths, minlength=count)
        if loads.max() <= capacity:
            break
        count = min(len(lengths), count + max(1, count // 200))
    _, number = np.unique(number, return_inverse=True)
    order = np.argsort(number, kind="stable")
    held, sizes = number[order], lengths[order]
    before = np.cumsum(sizes) - sizes
    first = np.concatenate([[True], held[1:] != held[:-1]])
    offset = np.empty(len(lengths), np.int64)
    offset[order] = before - np.maximum.accumulate(np.where(first, before, 0))
    return number.astype(np.int64), offset


def partition(lengths: np.ndarray, count: int) -> np.ndarray:
    """Window of every piece when `count` windows are balanced by differencing.

    A partial partition has `count` loads in descending order, less the smallest; entry k
    of one merges with entry k from the end of the other. Only the entries that are not
    zero are kept. Pieces are linked into trees, read out once at the end.
    """
    if count <= 1:
        return np.zeros(len(lengths), np.int64)
    # A part: (loads in descending order, trees of the same windows), at most `count` long.
    heap = [(-int(n), k, np.array([n], np.int64), np.array([k], np.int64)) for k, n in enumerate(lengths)]
    heapq.heapify(heap)
    link_left, link_right = [], []
    fresh = len(lengths)
    while len(heap) > 1:
        _, _, loads, trees = heapq.heappop(heap)
        _, tie, others, other_trees = heapq.heappop(heap)
        spare = count - len(loads) - len(others)
        if spare >= 0:  # all go to windows of their own
            loads, trees = np.concatenate([loads, others]), np.concatenate([trees, other_trees])
        else:
            both = -spare  # the lightest of one share windows with the lightest of the other, turned round
            keep, keep_other = len(loads) - both, len(others) - both
            summed = loads[keep:] + others[keep_other:][::-1]
            names = np.arange(fresh, fresh + both)
            fresh += both
            link_left.append(trees[keep:])
            link_right.append(other_trees[keep_other:][::-1])
            loads = np.concatenate([loads[:keep], others[:keep_other], summed])
            trees = np.concatenate([trees[:keep], other_trees[:keep_other], names])
        order = np.argsort(-loads, kind="stable")
        loads, trees = loads[order], trees[order]
        if len(loads) == count:
            loads = loads - loads[-1]
        heapq.heappush(heap, (-int(loads[0] - (loads[-1] if len(loads) == count else 0)), tie, loads, trees))
    window = np.full(fresh, -1, np.int64)
    trees = heap[0][3]
    window[trees] = np.arange(len(trees))
    left = np.concatenate(link_left) if link_left else np.zeros(0, np.int64)
    right = np.concatenate(link_right) if link_right else np.zeros(0, np.int64)
    for k in range(fresh - len(lengths) - 1, -1, -1):
        window[left[k]] = window[right[k]] = window[len(lengths) + k]
    return window[:len(lengths)]


#: Pretokens longer than this many bytes are encoded by the tokenizers library.
LONG_PRETOKEN = 100_000


class Encoder:
    """Ids of a byte-level vocabulary for many texts at once: equal pretokens are encoded once."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        bytes_of = {c: b for b, c in byte_names().items()}
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(bytes_of[c] for c in token): n for token, n in spec["model"]["vocab"].items() if token not in added}
        self.encoding = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=added)
        self.path, self.library = path, None
        self.specials = [s.encode() for s in added]
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, n in ranks.items():
            self.sizes[n] = len(token)
        self._drop()

    def _drop(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.at = np.zeros(1, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids end to end, row offsets into them)."""
        rows = len(offsets) - 1
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(rows + 1, np.int64)
        raw = data.tobytes()
        if any(raw.find(s) >= 0 for s in self.specials):
            return self._one_by_one(raw, offsets)
        points, at = code_points(data), point_offsets(data, offsets)
        starts = pretoken_starts(points, at)
        _, byte_at = utf8_of(points)
        begins = byte_at[starts]
        ends = np.concatenate([begins[1:], [len(data)]])
        hashes = hash_ranges(data, begins, ends)
        distinct, one, back = np.unique(hashes, return_index=True, return_inverse=True)
        slot = self._slots(distinct, raw, begins[one], ends[one])
        low, size = self.at[slot], self.at[slot + 1] - self.at[slot]
        low, size = low[back], size[back]
        before = np.concatenate([[0], np.cumsum(size)])
        ids = self.pool[np.arange(before[-1]) + np.repeat(low - before[:-1], size)]
        return ids, before[np.searchsorted(begins, offsets)]

    def _slots(self, distinct, raw: bytes, begins, ends) -> np.ndarray:
        """Places of the pretokens in the pool, after encoding the new ones."""
        if len(self.known) > MOST_KNOWN:
            self._drop()
        place = np.searchsorted(self.known, distinct)
        new = np.ones(len(distinct), bool)
        if len(self.known):
            new = self.known[np.minimum(place, len(self.known) - 1)] != distinct
        if new.any():
            found, size = self._fresh([raw[a:b] for a, b in zip(begins[new].tolist(), ends[new].tolist())])
            sizes = np.concatenate([np.diff(self.at), size])
            low = np.concatenate([[0], np.cumsum(sizes)])
            pool = np.concatenate([self.pool, found])
            # Keep the pool in the order of the hashes.
            names = np.concatenate([self.known, distinct[new]])
            order = np.argsort(names)
            size = sizes[order]
            self.at = np.concatenate([[0], np.cumsum(size)])
            self.pool = pool[np.arange(self.at[-1]) + np.repeat(low[order] - self.at[:-1], size)]
            self.known = names[order]
            place = np.searchsorted(self.known, distinct)
        return place

    def _fresh(self, pretokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pretokens end to end, and how many each has."""
        found: list[list[int] | None] = [None] * len(pretokens)
        sizes = np.zeros(len(pretokens), np.int64)
        # Those that open with their space fall apart again when joined: one call for all.
        joined = [n for n, p in enumerate(pretokens) if len(p) > 1 and p[0] == 0x20 and p[1] != 0x20 and p[1:].decode()[0] not in WHITE]
        ids = np.array(self.encoding.encode_ordinary(b"".join(pretokens[n] for n in joined).decode()), np.uint32)
        ends = np.cumsum([len(pretokens[n]) for n in joined]) if joined else np.zeros(0, np.int64)
        cuts = np.searchsorted(np.cumsum(self.sizes[ids]), ends, side="left") + 1
        held = set(joined)
        rest = [n for n in range(len(pretokens)) if n not in held]
        for n in rest:
            found[n] = self._long(pretokens[n]) if len(pretokens[n]) > LONG_PRETOKEN else \
                self.encoding.encode_ordinary(pretokens[n].decode())
            sizes[n] = len(found[n])
        sizes[joined] = np.diff(np.concatenate([[0], cuts]))
        low = np.concatenate([[0], np.cumsum(sizes)])
        out = np.empty(low[-1], np.uint32)
        counts = sizes[joined]
        before = np.concatenate([[0], np.cumsum(counts)])
        out[np.arange(before[-1]) + np.repeat(low[:-1][joined] - before[:-1], counts)] = ids
        for n in rest:
            out[low[n]:low[n + 1]] = found[n]
        return out, sizes

    def _long(self, pretoken: bytes) -> list[int]:
        """A very long pretoken (a run of white space) by the tokenizers library itself.

        tiktoken's merge loop overflows its stack on runs of about a million characters.
        """
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        return self.library.encode(pretoken.decode(), add_special_tokens=False).ids

    def _one_by_one(self, raw: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows that spell out special tokens: those strings are their ids."""
        found = [np.array(self.encoding.encode(raw[a:b].decode(), allowed_special="all"), np.uint32)
                 for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        return np.concatenate(found), np.concatenate([[0], np.cumsum([len(f) for f in found])])


def encoder_of(path: str) -> Encoder:
    cache = worker_cache()
    if ("encoder", path) not in cache:
        cache["encoder", path] = Encoder(path)
    return cache["encoder", path]


def pretoken_starts(points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where pretokens begin: runs of letters, digits or the rest, each with one space before
    it; contractions; and white space, whose last character stands alone before a word
    unless it is that space."""
    kinds = classes_of(points)
    size = len(points)
    begins = np.zeros(size + 1, bool)
    marks, takes = None, None
    for kind in (LETTER, DIGIT, OTHER, SPACE):
        starts, ends = runs(kinds == kind, offsets)
        if kind == SPACE:
            begins[starts] = True
            row_end = np.isin(ends, offsets)
            last = ends - 1
            begins[last[~row_end]] = True
            continue
        spaced = np.zeros(len(starts), bool)
        inner = np.flatnonzero(~np.isin(starts, offsets))
        spaced[inner] = points[starts[inner] - 1] == 0x20
        begins[starts[~spaced]] = True
        if kind == OTHER:
            alone = ~spaced & (ends - starts == 1)
            alone[alone] = points[starts[alone]] == 0x27
            row_ends = offsets[np.searchsorted(offsets, starts[alone], side="right")]
            marks, takes = contractions(points, kinds, starts[alone], row_ends)
    # A contraction takes its letters; what is left of the letter run starts a pretoken.
    if marks is not None and len(marks):
        begins[marks + 1] = False
        after = marks + 1 + takes
        inside = after < offsets[np.searchsorted(offsets, marks, side="right")]
        begins[after[inside]] |= kinds[after[inside]] == LETTER
    return np.flatnonzero(begins[:size])

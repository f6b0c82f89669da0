"""Quality rules on repetition, from a suffix array over the words of each text."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from postlake.llm.words import hash_ranges, map_texts, mix, slices, split_words, text_bytes

SYMBOLS = b"#*$%&|<>"
#: Shortest repeat that counts, in words. A power of two: it is one level of the doubling.
LEAST_REPEAT = 8
#: Largest share of words inside repeats, and longest repeat as a share of the words and in words, of a
#: kept text. A repeat of two copies covers twice its length, so its own limit is below half of the first.
MOST_COVERED, LONGEST_SHARE, LONGEST = 0.3, 0.1, 400
MIN_WORDS, MOST_REPEATED = 50, 50

MEASURES = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
            "longest_repeat long, covered_words long, n_maximal_repeats long, "
            "repeat_spans array<struct<start:bigint,end:bigint>>")
_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def measure_repetition(docs: DataFrame, least_repeat: int = LEAST_REPEAT) -> DataFrame:
    """One row per row of `docs` (doc_id, text): counts and repeats of the whole text.

    Words are runs of bytes other than space and tab to carriage return, as they stand.
    word_chars counts code points in words, n_symbols the characters of SYMBOLS,
    n_dup_lines the lines with a word that equal an earlier line, n_repeat_words the
    words in 3-word windows found at least twice. repeat_spans are the joined word ranges
    of all occurrences of maximal repeats of `least_repeat` words or more; covered_words
    is their total, longest_repeat the longest common prefix of two suffixes (0 if below
    `least_repeat`), n_maximal_repeats the starts that no longer repeat reaches over.
    NULL and empty texts count as no words; other columns are ignored.
    """
    if least_repeat < 4 or least_repeat & (least_repeat - 1):
        raise ValueError("least_repeat must be a power of two, 4 or more")

    def measure(batches):
        for batch in slices(batches, "text", 2 << 20):
            counts, spans = _measure(*text_bytes(batch.column("text")), least_repeat)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c.astype(np.int64)) for c in counts.values()), spans],
                names=["doc_id", *counts, "repeat_spans"])

    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return map_texts(docs, measure, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {MEASURES}")


def with_verdict(measured: DataFrame, most_covered: float = MOST_COVERED, longest: int = LONGEST,
                 longest_share: float = LONGEST_SHARE) -> DataFrame:
    """Add base_failed and kept: too short or repetitive by windows, else by the repeats."""
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    repeats = (F.col("covered_words") > most_covered * F.col("n_words")) | (
        F.col("longest_repeat") > F.least(F.lit(float(longest)), longest_share * F.col("n_words")))
    return measured.withColumn("base_failed", base).withColumn("kept", ~base & ~repeats)


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of flags in each row's range."""
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _measure(data: np.ndarray, offsets: np.ndarray, least: int):
    rows = len(offsets) - 1
    starts, ends, first = split_words(data, offsets)
    n_words = np.diff(first)
    row_of_word = np.repeat(np.arange(rows), n_words)
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int64)])
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    chars = np.bincount(row_of_word, lead[ends] - lead[starts], minlength=rows) if len(starts) else np.zeros(rows)
    # Words of different rows are different letters of the alphabet, so no repeat crosses rows.
    letters = mix(hash_ranges(data, starts, ends) + row_of_word.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    windows, repeat = _repeats(letters, least)
    # A repeat that starts one word earlier and reaches as far holds this one.
    covers = np.zeros(len(letters), bool)
    at = np.flatnonzero(repeat)
    if len(at):
        before = np.where((at > 0) & (row_of_word[at - 1] == row_of_word[at]), repeat[at - 1], 0)
        at = at[before <= repeat[at]]
        edges = np.zeros(len(letters) + 1, np.int64)
        np.add.at(edges, at, 1)
        np.add.at(edges, at + repeat[at], -1)
        covers = np.cumsum(edges[:-1]) > 0
    longest = np.zeros(rows, np.int64)
    np.maximum.at(longest, row_of_word[at], repeat[at])
    counts = {
        "n_words": n_words, "word_chars": chars, "n_symbols": _per_row(symbol[data], offsets),
        "n_dup_lines": _repeated_lines(data, offsets, starts), "n_repeat_words": _per_row(windows, first),
        "longest_repeat": longest, "covered_words": _per_row(covers, first),
        "n_maximal_repeats": np.bincount(row_of_word[at], minlength=rows),
    }
    return counts, _spans(covers, row_of_word, first)


def _spans(covers: np.ndarray, row_of_word: np.ndarray, first: np.ndarray) -> pa.Array:
    rows = len(first) - 1
    begin, end = covers.copy(), covers.copy()
    if len(covers):
        new_row = np.concatenate([[True], row_of_word[1:] != row_of_word[:-1]])
        begin[1:] &= ~covers[:-1] | new_row[1:]
        end[:-1] &= ~covers[1:] | new_row[1:]
    begins, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    row = row_of_word[begins]
    sizes = np.bincount(row, minlength=rows)
    struct = pa.StructArray.from_arrays(
        [pa.array(begins - first[row]), pa.array(ends - first[row])], fields=list(_SPAN.value_type))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), struct)


def _repeated_lines(data: np.ndarray, offsets: np.ndarray, word_starts: np.ndarray) -> np.ndarray:
    rows = len(offsets) - 1
    breaks = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    row = np.concatenate([np.arange(rows), np.searchsorted(offsets, breaks, side="right") - 1])
    order = np.argsort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    row = row[order]
    # A break ends its row's last line when it is the row's last byte: that line is empty.
    ends = np.concatenate([starts[1:], [len(data)]])
    has_break = (ends > starts) & (data[np.maximum(ends - 1, 0)] == 10) if len(data) else np.zeros(len(ends), bool)
    ends = ends - has_break
    full = np.searchsorted(word_starts, ends) > np.searchsorted(word_starts, starts)
    starts, ends, row = starts[full], ends[full], row[full]
    if not len(starts):
        return np.zeros(rows, np.int64)
    key = mix(hash_ranges(data, starts, ends) + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    again = key[order][1:] == key[order][:-1]
    return np.bincount(row[order][1:][again], minlength=rows)


def _repeats(letters: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(in a repeated 3-letter window, longest repeat that starts here or 0 below `least`).

    The suffix array comes from prefix doubling: at level k a suffix's rank tells its first
    2^k letters apart, and only suffixes that still share a rank are sorted again. The
    ranks of all levels then give the common prefix of neighbours in the array.
    """
    size = len(letters)
    windows, repeat = np.zeros(size, bool), np.zeros(size, np.int32)
    if size < 2:
        return windows, repeat
    order = np.argsort(letters).astype(np.int32)
    rank = np.empty(size, np.int32)
    slots = np.arange(size, dtype=np.int32)
    rank[order] = _heads(letters[order], slots)
    levels = [rank]
    step = 1
    while True:
        shared = _shared(levels[-1][order], slots)
        slots, order = slots[shared], order[shared]
        if not len(order):
            break
        if step == 2:
            _mark_windows(windows, levels, order)
        last = levels[-1]
        beyond = order + step
        following = np.where(beyond < size, last[np.minimum(beyond, size - 1)], -1)
        key = (last[order].astype(np.int64) << 32) | (following + 1)
        by = np.argsort(key)
        order = order[by]
        rank = last.copy()
        rank[order] = _heads(key[by], slots)
        levels.append(rank)
        step *= 2
    k = least.bit_length() - 1
    if len(levels) > k:
        _longest(repeat, levels, k)
    return windows, repeat


def _heads(keys: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """For sorted keys, the slot of the first member of each key's group."""
    new = np.concatenate([[True], keys[1:] != keys[:-1]])
    return np.maximum.accumulate(np.where(new, slots, 0)).astype(np.int32)


def _shared(ranks: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Whether a member's group has another member; ranks are sorted."""
    same = ranks[1:] == ranks[:-1]
    return np.concatenate([[False], same]) | np.concatenate([same, [False]])


def _mark_windows(windows: np.ndarray, levels: list[np.ndarray], order: np.ndarray) -> None:
    """Mark the words of 3-letter windows found twice; `order` shares its first two letters."""
    order = order[order + 2 < len(windows)]
    if not len(order):
        return
    key = (levels[1][order].astype(np.int64) << 32) | levels[0][order + 2]
    by = np.argsort(key)
    order = order[by][_shared(key[by], order)]
    for k in range(3):
        windows[order + k] = True


def _longest(repeat: np.ndarray, levels: list[np.ndarray], k: int) -> None:
    """Longest common prefix with a neighbour in the suffix array, where 2^k or more."""
    size = len(repeat)
    at = np.argsort(levels[-1]).astype(np.int64)  # the suffix array
    same = levels[k][at[1:]] == levels[k][at[:-1]]
    a, b = at[:-1][same], at[1:][same]
    length = np.zeros(len(a), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        i, j = a + length, b + length
        inside = (i < size) & (j < size)
        equal = inside & (levels[level][np.minimum(i, size - 1)] == levels[level][np.minimum(j, size - 1)])
        length += np.where(equal, 1 << level, 0)
    np.maximum.at(repeat, a, length.astype(np.int32))
    np.maximum.at(repeat, b, length.astype(np.int32))

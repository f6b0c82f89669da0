"""Words of whole texts as flat arrays, one Arrow batch at a time.

A word is a longest run of bytes other than space and tab to carriage return. Those are
single bytes in UTF-8, so words are found on the bytes without decoding. All arrays of
a chunk are flat: `first[d]:first[d+1]` are the words of its document d.
"""

from __future__ import annotations

import ctypes
import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

CHUNK_BYTES = 1 << 20
BATCH_CONF, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 2 << 20
BASE = 0x9E3779B97F4A7C15 | 1
STEP = 0xD6E8FEB86659FD93


def worker_cache() -> dict:
    """A dict that lives as long as the Python worker, for tables that are slow to build.

    Functions travel to executors by value, so their own module globals last one task.
    """
    holder = sys.modules.get("_postlake_worker_cache")
    if holder is None:
        holder = sys.modules["_postlake_worker_cache"] = types.ModuleType("_postlake_worker_cache")
        holder.entries = {}
    return holder.entries


def map_texts(df: DataFrame, fn: Callable, schema) -> DataFrame:
    """`df.mapInArrow` with batches of at most BATCH_BYTES, unless the session sets its own bound.

    By default a batch may hold 64 MB, in the JVM and in Python at a time for every task.
    """
    conf = df.sparkSession.conf
    if conf.get(BATCH_CONF, "67108864b") == "67108864b":
        conf.set(BATCH_CONF, str(BATCH_BYTES))

    def mapped(batches):
        yield from fn(batches)
        _release()

    return df.mapInArrow(mapped, schema)


def _release() -> None:
    """Give freed memory back after a task: workers live on between stages."""
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library than glibc


def slices(batches, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that `column` holds at most `limit` bytes, or one row."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, offsets = text_bytes(batch.column(column))
        begin = 0
        while begin < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[begin] + limit, side="right")) - 1
            end = max(end, begin + 1)
            yield batch.slice(begin, end - begin)
            begin = end


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows end to end, and row offsets into them. NULL is empty."""
    if column.null_count:
        column = column.fill_null("")
    if not (pa.types.is_string(column.type) or pa.types.is_large_string(column.type)):
        column = column.cast(pa.large_string())
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, kind)[column.offset:column.offset + len(column) + 1]
    offsets = offsets.astype(np.int64)
    low, high = (int(offsets[0]), int(offsets[-1])) if len(offsets) else (0, 0)
    data = np.frombuffer(data, np.uint8)[low:high] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - low


def _space_table() -> np.ndarray:
    table = np.zeros(256, bool)
    table[[0x20, *range(0x09, 0x0E)]] = True
    return table


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the longest runs of True, cut at row offsets."""
    size = len(inside)
    if size == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    cuts = offsets[(offsets > 0) & (offsets < size)]
    begins[cuts] = inside[cuts]
    ends[cuts - 1] = inside[cuts - 1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def split_words(data: np.ndarray, offsets: np.ndarray):
    """(starts, ends, first): byte ranges of words, and each row's range of words."""
    starts, ends = runs(~_space_table()[data], offsets)
    return starts, ends, np.searchsorted(starts, offsets)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table[data]


def split_tokens(data: np.ndarray, offsets: np.ndarray):
    """As `split_words` for tokens: runs of lower-case letters, digits and bytes beyond ASCII."""
    inside = (data >= 0x80) | ((data >= 97) & (data <= 122)) | ((data >= 48) & (data <= 57))
    starts, ends = runs(inside, offsets)
    return starts, ends, np.searchsorted(starts, offsets)


class Lookup:
    """Places of hashes in a sorted table; a bitmap turns most of the others away."""

    def __init__(self, table: np.ndarray):
        self.table = table
        self.bits = np.zeros(1 << 20, bool)
        self.bits[table >> np.uint64(44)] = True

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """Place in the table, or -1."""
        found = np.full(hashes.shape, -1, np.int64)
        at = np.nonzero(self.bits[hashes >> np.uint64(44)])
        if len(at[0]) and len(self.table):
            some = hashes[at]
            place = np.minimum(np.searchsorted(self.table, some), len(self.table) - 1)
            found[at] = np.where(self.table[place] == some, place, -1)
        return found


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2^64."""
    cache = worker_cache()
    held = cache.get("powers")
    if held is None or len(held[0]) < size:
        size = max(size, CHUNK_BYTES + 1)
        with np.errstate(over="ignore"):
            out = []
            for base in (BASE, pow(BASE, -1, 1 << 64)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                out.append(np.cumprod(steps, dtype=np.uint64))
        cache["powers"] = held = (out[0], out[1])
        if size > 4 * CHUNK_BYTES:  # one giant text: not worth keeping
            del cache["powers"]
    return held


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def hash_ranges(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every byte range, from one running polynomial sum."""
    power, inverse = _powers(len(data) + 1)
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.multiply(data.astype(np.uint64) + np.uint64(1), power[:len(data)], out=total[1:])
    np.cumsum(total, out=total)
    return mix((total[ends] - total[starts]) * inverse[starts])


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True):
    """(hash of every word, first): see `split_words`."""
    starts, ends, first = split_words(data, offsets)
    return hash_ranges(lower_ascii(data) if lower else data, starts, ends), first


def ngrams(words: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start word, row offsets) of every run of n words inside a row."""
    counts = np.maximum(np.diff(first) - (n - 1), 0)
    offsets = np.concatenate([[0], np.cumsum(counts)])
    if offsets[-1] == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), offsets
    at = np.arange(offsets[-1]) + np.repeat(first[:-1] - offsets[:-1], counts)
    width = len(words) - n + 1
    total = words[:width].copy()
    for k in range(1, n):
        total *= np.uint64(STEP)
        total += words[k:k + width]
    return mix(total[at]), at, offsets


def distinct_sets(words: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's sorted distinct n-word shingles, end to end, and row offsets.

    A row of fewer than n words has its whole sequence as the only shingle; a row
    without words has none.
    """
    grams, _, offsets = ngrams(words, first, n)
    sets, sizes = [], np.zeros(len(first) - 1, np.int64)
    for row in range(len(first) - 1):
        begin, end = first[row], first[row + 1]
        if end - begin >= n:
            own = np.sort(grams[offsets[row]:offsets[row + 1]])
            own = own[np.concatenate([[True], own[1:] != own[:-1]])]
        elif end > begin:
            total = np.array([end - begin], np.uint64)
            for at in range(begin, end):
                total = total * np.uint64(STEP) + words[at]
            own = mix(total ^ np.uint64(BASE))
        else:
            continue
        sets.append(own)
        sizes[row] = len(own)
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    return flat, np.concatenate([[0], np.cumsum(sizes)])

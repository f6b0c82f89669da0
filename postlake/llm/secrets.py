"""Secrets in whole texts: fixed patterns, and windows of high character entropy."""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from postlake.llm.words import lower_ascii, map_texts, runs, slices, text_bytes

#: The base kinds in their order, their patterns and least lengths.
KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 8, 16, 32
HEX = b"0123456789abcdef"
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
CANDIDATE = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=.-"

#: Characters that end sentences and join groups: none at the ends of a run, and of no character class.
JOINERS = b".-"
#: Window length, and the least entropy in bits of a window by its widest character class.
WINDOW = 20
LEAST_BITS = {"hex": 3.0, "alnum": 3.6, "base64": 3.7}
#: Words (letters and digits in a row) that hold one of these, in either case, are known to be harmless.
ALLOW = ("example", "sample", "placeholder", "0123456789", "abcdefghij", "xxxxxxxx")

SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"
_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
_ASSIGN = re.compile(ASSIGN)
_WORD = re.compile("[a-z0-9]+")


def scan_secrets(docs: DataFrame, allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """(doc_id, spans) for every row: kind, start and end in code points, end exclusive.

    `assign`, `access` and `hex` spans are the fixed patterns. `entropy` spans are added:
    in every longest run of key characters (with - and . inside), a window of WINDOW characters slides along with
    incremental counts; windows whose Shannon entropy reaches the least of their class
    and that mix digits with letters are joined. Windows that touch a word with an
    allow-list entry do not count, and base spans are taken out of the joined stretches:
    what is left of at least a window's length is reported. Spans are in order of start,
    then kind. NULL and empty texts give an empty list; repeated rows give
    repeated results; every other column is ignored.
    """
    def scan(batches):
        for batch in slices(batches, "text"):
            found = [sorted(s, key=_order) for s in _spans(batch.column("text"), allow)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _span_array(found)], names=["doc_id", "spans"])

    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return map_texts(docs, scan, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, spans {SPANS}")


def redact_secrets(docs: DataFrame, mark: str = "[SECRET]", allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """The same rows with every secret span of `text` replaced by `mark`.

    Overlapping spans become one mark. `n_chars`, where present, follows the new text.
    All other columns, rows without secrets and NULL texts stay as they are.
    """
    names = docs.columns
    at = names.index("text")
    length_at = names.index("n_chars") if "n_chars" in names else None

    def redact(batches):
        for batch in slices(batches, "text"):
            found = _spans(batch.column("text"), allow)
            rows = [row for row, spans in enumerate(found) if spans]
            if not rows:
                yield batch
                continue
            texts = batch.column(at).to_pylist()
            for row in rows:
                texts[row] = _replaced(texts[row], found[row], mark)
            columns = list(batch.columns)
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            if length_at is not None:
                lengths = columns[length_at].to_pylist()
                for row in rows:
                    lengths[row] = len(texts[row])
                columns[length_at] = pa.array(lengths, batch.schema.field(length_at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return map_texts(docs, redact, docs.schema)


def span_text(spans: Column) -> Column:
    """The spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _order(span: tuple[str, int, int]):
    return span[1], KINDS.index(span[0])


def _replaced(text: str, spans: list[tuple[str, int, int]], mark: str) -> str:
    parts, done, open_mark = [], 0, False
    for _, start, end in sorted(spans, key=lambda s: (s[1], s[2])):
        if end <= done:
            continue
        if start >= done or not open_mark:
            parts += [text[done:start], mark]
        done, open_mark = end, True
    return "".join(parts) + text[done:]


def _span_array(found: list[list[tuple[str, int, int]]]) -> pa.Array:
    return pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in spans] for spans in found], _SPAN)


def _member(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


def _occurrences(haystack: bytes, needle: bytes) -> list[int]:
    found, at = [], haystack.find(needle)
    while at >= 0:
        found.append(at)
        at = haystack.find(needle, at + 1)
    return found


def _spans(column: pa.Array, allow) -> list[list[tuple[str, int, int]]]:
    """Unsorted spans of every row."""
    data, offsets = text_bytes(column)
    rows = len(offsets) - 1
    found: list[list[tuple[str, int, int]]] = [[] for _ in range(rows)]
    if not len(data):
        return found

    def row_of(at) -> np.ndarray:
        return np.searchsorted(offsets, at, side="right") - 1

    def place(kind: str, starts, ends) -> None:
        for row, start, end in zip(row_of(starts).tolist(), starts.tolist(), ends.tolist()):
            begin = int(offsets[row])
            lead = (data[begin:end] & 0xC0) != 0x80
            stop = int(np.count_nonzero(lead))
            found[row].append((kind, stop - int(np.count_nonzero(lead[start - begin:])), stop))

    lowered = lower_ascii(data).tobytes()
    named = {at for word in ASSIGN_WORDS for at in _occurrences(lowered, word)}
    for row in sorted(set(row_of(np.array(sorted(named), np.int64)).tolist())):
        text = data[offsets[row]:offsets[row + 1]].tobytes().decode("utf-8", "surrogatepass")
        for match in _ASSIGN.finditer(text):
            if match.end(2) - match.start(2) >= ASSIGN_LEAST:
                found[row].append(("assign", match.start(), match.end()))

    starts, ends = _access(data, offsets)
    place("access", starts, ends)
    starts, ends = runs(_member(HEX)[data], offsets)
    long = ends - starts >= HEX_LEAST
    place("hex", starts[long], ends[long])

    starts, ends = _trimmed(data, *runs(_member(CANDIDATE)[data], offsets))
    long = ends - starts >= WINDOW
    for row, start, end in zip(row_of(starts[long]).tolist(), starts[long].tolist(), ends[long].tolist()):
        windows = _high_entropy(data[start:end].tobytes().decode("ascii"), allow)
        if not windows:
            continue
        base = int(np.count_nonzero((data[offsets[row]:start] & 0xC0) != 0x80))
        known = sorted((s, e) for kind, s, e in found[row] if kind != "entropy")
        for a, b in windows:
            found[row] += [("entropy", s, e) for s, e in _left(base + a, base + b, known)]
    return found


def _trimmed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs without joiners at their ends."""
    solid = np.flatnonzero(~_member(JOINERS)[data])
    if not len(solid):
        return starts[:0], ends[:0]
    first, last = np.searchsorted(solid, starts), np.searchsorted(solid, ends) - 1
    some = first <= last
    return solid[first[some]], solid[last[some]] + 1


def _left(start: int, end: int, known: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What the known spans leave of a stretch, in pieces of at least a window."""
    out = []
    for s, e in [*known, (end, end)]:
        if min(s, end) - start >= WINDOW:
            out.append((start, min(s, end)))
        start = max(start, e)
    return out


def _access(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """AKIA and all capitals and digits that follow, leftmost first, inside one row."""
    starts, ends = [], []
    inside, done = _member(UPPER), 0
    for at in _occurrences(data.tobytes(), b"AKIA"):
        stop = int(offsets[np.searchsorted(offsets, at, side="right")])
        if at < done or at + 4 > stop:
            continue
        piece = inside[data[at:min(stop, at + 64)]]
        if piece.all() and at + 64 < stop:
            piece = inside[data[at:stop]]
        done = at + (len(piece) if piece.all() else int(np.argmin(piece)))
        if done - at > 4 and done - at >= ACCESS_LEAST:
            starts.append(at)
            ends.append(done)
    return np.array(starts, np.int64), np.array(ends, np.int64)


def _class_of(char: str) -> int:
    """0 hexadecimal and joiners, 1 other letters and digits, 2 the rest."""
    return 0 if char in "0123456789abcdefABCDEF.-" else 1 if char.isalnum() else 2


def _high_entropy(run: str, allow) -> list[tuple[int, int]]:
    """Joined windows of the run that look random."""
    lowered = run.lower()
    if not any(c.isdigit() for c in run):
        return []
    harmless = [word.span() for word in _WORD.finditer(lowered) if any(entry in word[0] for entry in allow)]
    if any(entry in lowered for entry in allow):
        # Entries with other characters than letters and digits cover themselves.
        harmless = sorted(harmless + [(k, k + len(entry)) for entry in allow if entry and not entry.isalnum()
                                      for k in range(len(lowered)) if lowered.startswith(entry, k)])
    passed = 0
    term = [0.0] + [k * math.log2(k) for k in range(1, WINDOW + 1)]
    counts: dict[str, int] = {}
    classes, digits, letters, total = [0, 0, 0], 0, 0, 0.0
    out: list[tuple[int, int]] = []
    for at, char in enumerate(run):
        # The leaving character goes out before the new one comes in, so no count passes WINDOW.
        for other, step in ((run[at - WINDOW] if at >= WINDOW else None, -1), (char, 1)):
            if other is None:
                continue
            held = counts.get(other, 0)
            counts[other] = held + step
            total += term[held + step] - term[held]
            classes[_class_of(other)] += step
            digits += step * other.isdigit()
            letters += step * other.isalpha()
        if at + 1 < WINDOW:
            continue
        least = LEAST_BITS["base64" if classes[2] else "alnum" if classes[1] else "hex"]
        if digits >= 2 and letters >= 2 and math.log2(WINDOW) - total / WINDOW >= least:
            start = at + 1 - WINDOW
            while passed < len(harmless) and harmless[passed][1] <= start:
                passed += 1
            if passed < len(harmless) and harmless[passed][0] <= at:
                continue
            if out and start <= out[-1][1]:
                out[-1] = (out[-1][0], at + 1)
            else:
                out.append((start, at + 1))
    return out

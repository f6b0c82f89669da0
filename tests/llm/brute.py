"""Plain Python versions of the operators, for small inputs."""

from __future__ import annotations

import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SECRETS = {
    "assign": (re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
               lambda m: len(m[2]) >= 8),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16),
    "hex": (re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 32),
}


def shingles(text: str | None, size: int = 5) -> frozenset:
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[k:k + size]) for k in range(max(1, len(words) - size + 1)))


def near_duplicates(rows: list[tuple[int, str | None]], percent: int = 85) -> dict[int, tuple[int, int]]:
    """doc_id -> (n_shingles, component), over all pairs."""
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {i: (len(sets[i]), find(i)) for i in ids}


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    words = WORD.findall(text)
    seen, again = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    windows: dict[tuple, list[int]] = {}
    for k in range(len(words) - 2):
        windows.setdefault(tuple(words[k:k + 3]), []).append(k)
    marked = {p + d for places in windows.values() if len(places) > 1 for p in places for d in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(marked)


def repeats(text: str | None, least: int) -> tuple[int, int]:
    """(longest repeat, words covered by repeats of at least `least` words)."""
    words = WORD.findall(text or "")
    longest, covered = 0, set()
    for a in range(len(words)):
        for b in range(a):
            n = 0
            while a + n < len(words) and words[a + n] == words[b + n]:
                n += 1
            if n >= least:
                longest = max(longest, n)
                covered |= set(range(a, a + n)) | set(range(b, b + n))
    return longest, len(covered)


def base_secrets(text: str | None) -> list[tuple[str, int, int]]:
    found = [(kind, m.start(), m.end()) for kind, (pattern, good) in SECRETS.items()
             for m in pattern.finditer(text or "") if good(m)]
    order = list(SECRETS)
    return sorted(found, key=lambda s: (s[1], order.index(s[0])))


def smith_waterman(a: list, b: list) -> int:
    best, above = 0, [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(max(0, above[j] + (2 if x == y else -1), above[j + 1] - 1, row[j] - 1))
        best, above = max(best, *row), row
    return best


def held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def maximal_segments(scores: list[float]) -> set[tuple[int, int]]:
    """All maximal-scoring segments by their definition: the best segment, then the best
    on either side of it, and so on."""
    out: set[tuple[int, int]] = set()

    def split(low: int, high: int) -> None:
        best, at = 0.0, None
        for a in range(low, high):
            total = 0.0
            for b in range(a, high):
                total += scores[b]
                # Longer segments of an equal score would hold a part that scores nothing.
                if total > best + 1e-12:
                    best, at = total, (a, b + 1)
        if at:
            out.add(at)
            split(low, at[0])
            split(at[1], high)

    split(0, len(scores))
    return out

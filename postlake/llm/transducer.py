"""Token counts by a byte-pair vocabulary compiled to a deterministic transducer.

For text read from the left, the last token of the encoding of every prefix is unique: it
is the token that ends there, fits behind the last token of the prefix before it, and is
not merged away. So an encoder needs to remember only the places where a token may still
be under way: the trie node reached from each, the last token there and how many tokens
lie between. That is the state. Reading one byte leads to one next state, and the transition
carries the change in the number of tokens. States and transitions are found as texts ask
for them, and are kept while the Python worker lives.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from postlake.llm.words import hash_ranges, map_texts, runs, slices, text_bytes, worker_cache

CHUNK = 64
LAST = 256
#: Transitions kept in one worker before its table starts afresh.
MOST_TRANSITIONS = 300_000
#: Characters that the tokenizer's patterns take for white space, a fixed list.
SPACES = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
LETTER, DIGIT, SPACE, OTHER = 0, 1, 2, 3
#: Texts without characters from here on are in composed form already.
COMBINING = 0x300


class Transducer:
    """The automaton of one vocabulary with word ends (`</w>`)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("end_of_word_suffix") != "</w>":
            raise ValueError("expected byte pairs with </w> word ends")
        self.specials = [t["content"] for t in spec["added_tokens"]]
        names = {c: b for b, c in byte_names().items()}

        def symbols(token: str) -> tuple[int, ...]:
            ended = token.endswith("</w>")
            out = [names[c] for c in (token[:-4] if ended else token)]
            return (*out[:-1], out[-1] + LAST) if ended else tuple(out)

        self.parts: list[tuple[int, int] | None] = [None] * 512
        ids = {(b,): b for b in range(512)}
        self.merged: dict[tuple[int, int], int] = {}
        self.children: list[dict[int, int]] = [{}]
        self.token: list[int] = [-1]
        for b in range(512):
            self._insert((b,), b)
        for pair in model["merges"]:
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b = symbols(left), symbols(right)
            new = len(self.parts)
            self.parts.append((ids[a], ids[b]))
            self.merged[ids[a], ids[b]] = new
            ids.setdefault(a + b, new)
            self._insert(a + b, ids[a + b])
        self.fits: dict[int, bool] = {}
        self.forget()

    def forget(self) -> None:
        self.numbers: dict[tuple, int] = {((0, -1, 0),): 0}
        self.states: list[tuple] = [((0, -1, 0),)]
        self.moves: dict[int, int] = {}

    def _insert(self, symbols, token: int) -> None:
        node = 0
        for s in symbols:
            following = self.children[node].get(s)
            if following is None:
                following = len(self.children)
                self.children[node][s] = following
                self.children.append({})
                self.token.append(-1)
            node = following
        self.token[node] = token

    def adjacent(self, a: int, b: int) -> bool:
        """Whether token b can follow token a: no merge across their border comes first."""
        key = a << 20 | b
        known = self.fits.get(key)
        if known is None:
            known = self.fits[key] = self._adjacent(a, b)
        return known

    def _adjacent(self, a: int, b: int, limit: int = 1 << 30) -> bool:
        # Undo the merges of both tokens from the latest back; a pair on the border that
        # merges before the step just undone would have been taken.
        parts, merged = self.parts, self.merged
        while True:
            across = merged.get((a, b))
            if across is not None and across < limit:
                return False
            undo_left = a > b
            if parts[a if undo_left else b] is None:
                undo_left = not undo_left
                if parts[a if undo_left else b] is None:
                    return True
            if undo_left:
                limit, a = a, parts[a][1]
            else:
                limit, b = b + 1, parts[b][0]

    def whole(self, token: int) -> bool:
        """Whether the token's own letters encode to it alone."""
        pair = self.parts[token]
        if pair is None:
            return True
        key = token << 40
        known = self.fits.get(key)
        if known is None:
            known = self.whole(pair[0]) and self.whole(pair[1]) and self._adjacent(*pair, limit=token)
            self.fits[key] = known
        return known

    def step(self, state: int, symbol: int) -> int:
        """Compile one transition: next state * 256 + change in tokens + 128."""
        active, found = [], None
        for node, last, behind in self.states[state]:
            following = self.children[node].get(symbol)
            if following is None:
                continue
            token = self.token[following]
            if token >= 0 and self.whole(token) and (last < 0 or self.adjacent(last, token)):
                found = (token, 1 - behind)
            if self.children[following]:
                active.append((following, last, behind))
        if found is None:
            raise ValueError("no token ends here; the vocabulary is not closed under its merges")
        token, change = found
        state_key = (*((n, last, behind + change) for n, last, behind in active), (0, token, 0))
        number = self.numbers.get(state_key)
        if number is None:
            number = self.numbers[state_key] = len(self.states)
            self.states.append(state_key)
        return number << 8 | (change + 128)

    def advance(self, states: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Read one symbol in every lane: next states and changes in tokens."""
        keys, back = np.unique(states.astype(np.int64) << 9 | symbols, return_inverse=True)
        moves = self.moves
        packed = np.empty(len(keys), np.int64)
        for n, key in enumerate(keys.tolist()):
            move = moves.get(key)
            if move is None:
                move = moves[key] = self.step(key >> 9, key & 511)
            packed[n] = move
        packed = packed[back]
        return packed >> 8, (packed & 255) - 128

    def run(self, data, starts, ends, last, entry) -> tuple[np.ndarray, np.ndarray]:
        """Exit state and token change of every byte range from its entry state, in lockstep.

        `last` marks ranges that end a word: their final byte is read as a word end.
        """
        lengths = ends - starts
        order = np.argsort(-lengths, kind="stable")
        starts, lengths, last = starts[order], lengths[order], last[order]
        states, counts = entry[order].copy(), np.zeros(len(order), np.int64)
        live = len(order)
        for k in range(int(lengths[0]) if len(order) else 0):
            live = int(np.searchsorted(-lengths[:live], -k, side="left"))
            symbols = data[starts[:live] + k].astype(np.int64)
            symbols += LAST * (last[:live] & (lengths[:live] == k + 1))
            states[:live], change = self.advance(states[:live], symbols)
            counts[:live] += change
        out_states, out_counts = np.empty_like(states), np.empty_like(counts)
        out_states[order], out_counts[order] = states, counts
        return out_states, out_counts

    def count(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Tokens of every word data[starts:ends].

        Words are cut into chunks of CHUNK bytes, all read at once. A chunk's state map
        takes its entry state to its exit state and token change. Entry states are first
        guessed from the chunk before read on its own; the scan then composes the maps
        along each word and reads again the chunks whose guess was wrong, until all fit.
        """
        if len(self.moves) > MOST_TRANSITIONS:
            self.forget()
        pieces = np.maximum(-(-(ends - starts) // CHUNK), 1)
        word = np.repeat(np.arange(len(starts)), pieces)
        opens = np.concatenate([[0], np.cumsum(pieces)])[:-1]
        nth = np.arange(len(word)) - opens[word]
        begin = starts[word] + nth * CHUNK
        end = np.minimum(begin + CHUNK, ends[word])
        last = end == ends[word]
        entry = np.zeros(len(word), np.int64)
        later = np.flatnonzero(nth > 0)
        if len(later):
            entry[later] = self.run(data, begin[later - 1], end[later - 1], np.zeros(len(later), bool), entry[later - 1])[0]
        leave, change = self.run(data, begin, end, last, entry)
        while len(later):
            later = later[entry[later] != leave[later - 1]]
            entry[later] = leave[later - 1]
            if len(later):
                leave[later], change[later] = self.run(data, begin[later], end[later], last[later], entry[later])
                later = np.flatnonzero(nth > 0)
        return np.add.reduceat(change, opens) if len(word) else np.zeros(0, np.int64)


def byte_names() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(rest)}


def compiled(path: str) -> Transducer:
    """The transducer of a vocabulary file, built once in a worker."""
    cache = worker_cache()
    if ("transducer", path) not in cache:
        cache["transducer", path] = Transducer(path)
    return cache["transducer", path]


def character_classes() -> tuple[np.ndarray, np.ndarray]:
    """Class and lower-case form of every code point of the basic plane."""
    cache = worker_cache()
    if "classes" not in cache:
        kinds, lower = np.full(1 << 16, OTHER, np.uint8), np.arange(1 << 16, dtype=np.uint32)
        for c in range(1 << 16):
            kinds[c] = _class(chr(c))
            small = chr(c).lower()
            if len(small) == 1:
                lower[c] = ord(small)
        cache["classes"] = (kinds, lower)
    return cache["classes"]


def _class(char: str) -> int:
    if ord(char) in SPACES:
        return SPACE
    kind = unicodedata.category(char)[0]
    return LETTER if kind == "L" else DIGIT if kind == "N" else OTHER


def classes_of(points: np.ndarray) -> np.ndarray:
    kinds, _ = character_classes()
    found = kinds[np.minimum(points, 0xFFFF)]
    for c in np.unique(points[points > 0xFFFF]).tolist():
        found[points == c] = _class(chr(c))
    return found


def _normal(text: str) -> str:
    # Lower case letter by letter: a final sigma is not special.
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


def code_points(data: np.ndarray) -> np.ndarray:
    return np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)


def point_offsets(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte offsets as code point offsets."""
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int64)])
    return lead[offsets]


def utf8_of(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes, and the byte offset of every code point and of the end."""
    data = np.frombuffer(points.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass"), np.uint8)
    sizes = 1 + (points >= 0x80).astype(np.int8) + (points >= 0x800) + (points >= 0x10000)
    return data, np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])


def contractions(points: np.ndarray, kinds: np.ndarray, marks: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the apostrophes at `marks` (row ends given), those that open 's 't 'm 'd 're 've
    or 'll, and how many letters they take."""
    size = len(points)
    one = np.where(marks + 1 < ends, points[np.minimum(marks + 1, size - 1)], 0)
    two = np.where(marks + 2 < ends, points[np.minimum(marks + 2, size - 1)], 0)
    takes = np.zeros(len(marks), np.int64)
    takes[np.isin(one, [ord(c) for c in "stmd"])] = 1
    for pair in ("re", "ve", "ll"):
        takes[(one == ord(pair[0])) & (two == ord(pair[1]))] = 2
    return marks[takes > 0], takes[takes > 0]


def split_lower(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word ranges of lower-case text: letter runs, single digits, runs of the rest, and
    contractions."""
    kinds = classes_of(points)
    letter_starts, letter_ends = runs(kinds == LETTER, offsets)
    other_starts, other_ends = runs(kinds == OTHER, offsets)
    digits = np.flatnonzero(kinds == DIGIT)
    alone = (other_ends - other_starts == 1) & (points[other_starts] == 0x27) if len(other_starts) else np.zeros(0, bool)
    row_ends = offsets[np.searchsorted(offsets, other_starts[alone], side="right")]
    marks, takes = contractions(points, kinds, other_starts[alone], row_ends)
    if len(marks):
        other_ends = other_ends.copy()
        other_ends[np.searchsorted(other_starts, marks)] = marks + 1 + takes
        letter_starts = letter_starts.copy()
        letter_starts[np.searchsorted(letter_starts, marks + 1)] += takes
        some = letter_starts < letter_ends
        letter_starts, letter_ends = letter_starts[some], letter_ends[some]
    starts = np.concatenate([letter_starts, other_starts, digits])
    ends = np.concatenate([letter_ends, other_ends, digits + 1])
    return starts, ends


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 2048) -> DataFrame:
    """Token counts of whole texts by a lower-casing byte-pair vocabulary with word ends.

    `vocabulary` is the path of a tokenizers JSON file that every executor has. Returns,
    per row of `docs` (doc_id, text): doc_id, n_bytes, n_tokens, over_limit (more than
    `limit`). Begin and end tokens are not counted; the file's special tokens count one
    where a text spells them out. NULL and empty texts have no tokens; repeated rows give
    repeated results; other columns are ignored.
    """
    def count(batches):
        machine = compiled(vocabulary)
        for batch in slices(batches, "text", 2 << 20):
            data, offsets = text_bytes(batch.column("text"))
            tokens = _count(machine, data, offsets)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(tokens), pa.array(tokens > limit)],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_texts(docs, count, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")


def _count(machine: Transducer, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    rows = len(offsets) - 1
    total = np.zeros(rows, np.int64)
    if not len(data):
        return total
    if any(data.tobytes().find(s.encode()) >= 0 for s in machine.specials):
        return _count_around_specials(machine, data, offsets)
    points, at = _lowered(data, offsets)
    starts, ends = split_lower(points, at)
    data, byte_at = utf8_of(points)
    row = np.searchsorted(at, starts, side="right") - 1
    starts, ends = byte_at[starts], byte_at[ends]
    # Equal words are read once.
    _, one, back = np.unique(hash_ranges(data, starts, ends), return_index=True, return_inverse=True)
    counts = machine.count(data, starts[one], ends[one])[back]
    return np.bincount(row, counts, minlength=rows).astype(np.int64)


def _lowered(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    points, at = code_points(data), point_offsets(data, offsets)
    odd = (points >= COMBINING) | (points == 0x130)
    if odd.any():
        rows = np.unique(np.searchsorted(at, np.flatnonzero(odd), side="right") - 1)
        parts, sizes, done = [], np.diff(at), 0
        for row in rows.tolist():
            text = _normal(points[at[row]:at[row + 1]].tobytes().decode("utf-32-le", "surrogatepass"))
            parts += [points[done:at[row]], np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
            sizes[row], done = len(text), at[row + 1]
        points = np.concatenate([*parts, points[done:]])
        at = np.concatenate([[0], np.cumsum(sizes)])
    _, lower = character_classes()
    return np.where(points < COMBINING, lower[np.minimum(points, 0xFFFF)], points), at


def _count_around_specials(machine: Transducer, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Cut rows at spelled-out special tokens, which count one each."""
    import regex

    rows = len(offsets) - 1
    cut = regex.compile(b"|".join(regex.escape(s.encode()) for s in sorted(machine.specials, key=len, reverse=True)))
    texts, owners, total = [], [], np.zeros(rows, np.int64)
    for row in range(rows):
        own = data[offsets[row]:offsets[row + 1]].tobytes()
        parts = cut.split(own)
        total[row] = len(parts) - 1
        texts += parts
        owners += [row] * len(parts)
    whole = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    points, at = _lowered(whole, ends)
    starts, stops = split_lower(points, at)
    raw, byte_at = utf8_of(points)
    row = np.array(owners)[np.searchsorted(at, starts, side="right") - 1] if len(starts) else np.zeros(0, np.int64)
    counts = machine.count(raw, byte_at[starts], byte_at[stops])
    return total + np.bincount(row, counts, minlength=rows).astype(np.int64)

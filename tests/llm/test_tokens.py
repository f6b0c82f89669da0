from __future__ import annotations

import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from postlake.llm.packing import differencing, pack, partition
from postlake.llm.plans import packing, token_counts, vocabulary
from postlake.llm.transducer import CHUNK, Transducer, count_tokens
from tests.llm import brute  # noqa: F401

TEXTS = [
    None, "", "don't we'll I'VE it's 's 'S '' ''t a'b 90's !'s", "ÀÉ İstanbul ΣΑΣ ﬁ é ½ ²3 ١٢ 日本語 😀😀 a\u200db", "x" * 5000,
    "<|endoftext|> hi <|startoftext|>", "  lead\n\n tail  \n", "tab\t\tx   y\u3000z", "a\x85b \x1c c", "\x00\x01", "thethethe" * 40,
    " 're 'llama", "ab" * 300 + " " + "zq" * 200, "' '  '' \n's", "I'm\n'd  'd", "e\u0301 cafe\u0301",
]


def test_counts_as_the_library(spark, make_docs, clashing, documents, sf_dir):
    path = vocabulary("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    for df in (clashing(make_docs(TEXTS)), documents):
        texts = {r["doc_id"]: r["text"] or "" for r in df.collect()}
        rows = count_tokens(df, path).collect()
        assert len(rows) == len(texts)
        for row in rows:
            text = texts[row["doc_id"]]
            assert row["n_tokens"] == len(library.encode(text, add_special_tokens=False).ids), text[:60]
            assert row["n_bytes"] == len(text.encode()) and row["over_limit"] == (row["n_tokens"] > 2048)
    assert token_counts(spark, sf_dir).count() == documents.count()
    assert count_tokens(make_docs([]), path).collect() == []


def test_chunk_maps_compose():
    machine = Transducer(vocabulary("word_bpe_49k.json"))
    library = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    draw = np.random.default_rng(1)
    words = ["".join(draw.choice(list("thanerio"), n)) for n in (1, CHUNK - 1, CHUNK, CHUNK + 1, 3 * CHUNK, 1000)]
    data = np.frombuffer("".join(words).encode(), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    found = machine.count(data, np.concatenate([[0], ends[:-1]]), ends)
    assert found.tolist() == [len(library.encode(w, add_special_tokens=False).ids) for w in words]


def _check_packing(rows, texts, window):
    library = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    ids = {i: [*library.encode(t or "", add_special_tokens=False).ids, 1] for i, t in texts.items()}
    held, pieces = {}, {}
    for row in rows:
        own = ids[row["doc_id"]]
        part = own[row["start"]:row["start"] + row["length"]]
        assert len(part) == row["length"] and row["doc_tokens"] == len(own)
        assert row["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
        held.setdefault(row["sequence_id"], []).append((row["offset"], row["length"]))
        pieces.setdefault(row["doc_id"], []).append((row["start"], row["length"]))
    for spans, size in [(v, None) for v in held.values()] + [(v, len(ids[i])) for i, v in pieces.items()]:
        at = 0
        for start, length in sorted(spans):
            assert start == at and length > 0
            at += length
        assert at <= window if size is None else at == size
    assert set(pieces) == set(ids)
    return sum(map(len, ids.values())) / (window * len(held))


def test_packing_is_whole_and_tight(spark, documents, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    assert _check_packing(packing(spark, sf_dir).collect(), texts, 2048) > 0.95


@pytest.mark.parametrize("window, group", [(64, 3), (2048, 2000), (5, 4)])
def test_packing_of_odd_texts(make_docs, clashing, window, group):
    rows = pack(clashing(make_docs(TEXTS)), vocabulary("byte_bpe_50k.json"), window, group).collect()
    _check_packing(rows, dict(enumerate(TEXTS)), window)
    assert pack(make_docs([]), vocabulary("byte_bpe_50k.json")).collect() == []


def test_repeated_and_unnamed_rows_are_packed(make_docs):
    rows = pack(make_docs([(1, "a b"), (1, "a b"), (None, "c")]), vocabulary("byte_bpe_50k.json")).collect()
    assert sorted((r["doc_id"] or 0, r["length"]) for r in rows) == [(0, 2), (1, 3), (1, 3)]
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == 3


def test_differencing():
    assert sorted(np.bincount(partition(np.array([8, 7, 6, 5, 4]), 2), [8, 7, 6, 5, 4])) == [14, 16]
    draw = np.random.default_rng(2)
    lengths = np.sort(draw.integers(1, 500, 800))[::-1]
    number, offset = differencing(lengths, 2048)
    loads = np.bincount(number, lengths)
    assert loads.max() <= 2048 and loads.mean() > 0.98 * 2048
    # Pieces just over half a window each need one of their own.
    number, _ = differencing(np.full(10, 1025), 2048)
    assert sorted(number.tolist()) == list(range(10))
    with pytest.raises(ValueError):
        differencing(np.array([2049]), 2048)


def test_very_long_white_space_is_encoded_as_the_library_does():
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    from postlake.llm.packing import Encoder

    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    encoder, library = Encoder(path), Tokenizer.from_file(path)
    for text in [" " * 1_000_000, "\n" * 1_000_000, "a" + " " * 300_000 + "b", "x " + "\t\n " * 200_000 + "end"]:
        data = np.frombuffer(text.encode(), np.uint8)
        ids, offsets = encoder.encode(data, np.array([0, len(data)]))
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids

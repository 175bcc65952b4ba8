"""What tasks do to many words, shingles or places at once, against the same one by one."""

import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from faultgrain.llm import decontaminate, packing, simhash, toxicity
from faultgrain.llm.xxh64 import xxh64

TEXTS = [
    "", None, "a", " \t\n\x0b\x0c\r ", "one two three", "One TWO three four", "a  b\tc \n d e f g", "é É\xa0x y z\x85 w   v t", "w " * 256, "q " * 257,
    "x" * 5000, "x" * 100 + " " + "y" * 900 + " z q", " ".join(map(str, range(3000))), "", "end",
]


def spans(parts):
    size = np.array([len(p) for p in parts], np.int64)
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum(size) - size, size


@pytest.mark.parametrize("seed", [0, 42, (1 << 64) - 1])
def test_xxh64(seed):
    pick = random.Random(1)
    parts = [pick.randbytes(n) for n in [*range(140), *range(140), 1000, 4097]]
    assert xxh64(*spans(parts), seed).tolist() == [xxhash.xxh64_intdigest(p, seed) for p in parts]
    assert xxh64(*spans([]), seed).tolist() == []


@pytest.mark.parametrize("shingle", [1, 3, 5])
def test_fingerprints(shingle):
    for texts in (TEXTS, TEXTS[::-1], [None], []):
        want = [simhash.simhash((t or "").encode(), shingle) for t in texts]
        column = pa.array(texts, pa.string())
        assert simhash.simhashes(column, shingle).tolist() == want
        assert simhash.simhashes(column.slice(1), shingle).tolist() == want[1:]


def test_latin_words_are_not_encoded_one_by_one(monkeypatch):
    encoder = packing.WordIds(packing.tokenizer_path())
    pick = random.Random(2)
    words = ["".join(pick.choices("aeinorstlcdéèÉßÿçAEIN", k=pick.randint(1, 40))) for _ in range(3000)]
    words += [c * n for c in "aeé" for n in (1, 2, 31, 32, 62, 63, 64, 70)]
    want = encoder.tokenizer.encode(" ".join(words), add_special_tokens=False).ids
    one, calls = encoder._ids, []
    monkeypatch.setattr(encoder, "_ids", lambda word: calls.append(word) or one(word))
    (got,) = encoder.encode_all(pa.array([" ".join(words)]))
    assert got.tolist() == [*want, 0]
    assert all(len(word.encode()) > 63 for word in calls)


def test_ids_of_odd_texts():
    encoder = packing.WordIds(packing.tokenizer_path())
    odd = ["<|endoftext|> Hello World", "É×é÷ç ẞ Ÿ ŒUVRE İstanbul ſ K", "it's 12 o'clock  Á \x1c z", "ªº µg", "a1b2.c,d!e\x00f", "\xa0a\xa0", "a<b|c"]
    texts = [*TEXTS, *odd]
    want = [[*encoder.tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for t in texts]
    assert [ids.tolist() for ids in encoder.encode_all(pa.array(texts, pa.string()))] == want


def test_beginnings_are_hashed_once_a_distinct_word(monkeypatch):
    hashed, one = [], toxicity.hashes
    monkeypatch.setattr(toxicity, "hashes", lambda data, starts, *a, **b: hashed.append(len(starts)) or one(data, starts, *a, **b))
    batch = pa.RecordBatch.from_pydict({"text": ["insulting words " * 500, None, "words"], "toxic": pa.array([1, 0, 0], pa.int32())})
    counts = pa.Table.from_batches(toxicity._class_counts(iter([batch])))
    assert hashed == [1001, 2, 1, 1]
    # insu, words; insult; insultin; both words
    assert sorted(zip(counts["toxic"].to_pylist(), counts["ordinary"].to_pylist())) == [(1, 0)] * 4 + [(1, 1)] * 2


def test_pieces_are_found_where_they_are():
    pick = random.Random(3)
    units = [u for n, size in enumerate([1, 2, 4, 5, 13, 14, 30, 60]) for u in decontaminate.units(n, " ".join("".join(pick.choices("abé", k=pick.randint(1, 9))) for _ in range(size)))]
    found = decontaminate.Pieces(units)
    lines = ["", "a", *(u.text for u in units), *("".join(pick.choices("ab é", k=200)) for _ in range(50))]
    lines += [f"ab {u.text[3:-3]} {u.text}" for u in units]
    wanted = {piece.encode() for u in units if not u.alone for _, piece in decontaminate.pieces(u)}
    for line, hits in zip(lines, found.hits([line.encode() for line in lines])):
        coded = line.encode()
        want = [(k + len(p), -len(p), p) for p in wanted for k in range(len(coded)) if coded.startswith(p, k)]
        assert hits == sorted(want)
    assert sorted(found.alone) == sorted({u.text for u in units if u.alone})

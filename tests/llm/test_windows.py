"""Window packing: ids against the tokenizer, the plan against plain best-fit decreasing, and an exact round trip."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given as cases
from hypothesis import settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, models

from faultgrain.llm import windows

PATH = windows.tokenizer_path()


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


@settings(max_examples=300, deadline=None)
@cases(st.lists(st.text("aZé'ß \n\t  \x1c\x85,.-7½中<|endoftext|>st", max_size=25) | st.text(max_size=10), max_size=6))
def test_ids_are_the_tokenizers(texts):
    own = Tokenizer.from_file(PATH)
    texts = [t for t in texts if not any(0xD800 <= ord(c) < 0xE000 for c in t)] + [None, "a<|endoftext|> b", "it's 'tis can't\n\n  x"]
    got = [ids.tolist() for ids in windows.chunk_ids(PATH).encode_all(pa.array(texts, pa.string()))]
    assert got == [ids_of(own, t) for t in texts]


def test_ids_of_the_given_documents(tokenizer, given):
    encoder = windows.ChunkIds(PATH)
    texts = [t for _, t in given]
    assert [i.tolist() for i in encoder.encode_all(pa.array(texts))] == [ids_of(tokenizer, t) for t in texts]


def test_a_tokenizer_that_reads_across_blanks_is_refused(tmp_path):
    whole = Tokenizer(models.WordLevel({"[UNK]": 0}, unk_token="[UNK]"))
    whole.save(str(tmp_path / "whole.json"))
    with pytest.raises(ValueError):
        windows.ChunkIds(str(tmp_path / "whole.json"))


def plain_best_fit(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(rooms) if r >= n]
        if fits:
            rooms[min(fits, key=lambda i: rooms[i])] -= n
        else:
            rooms.append(capacity - n)
    return Counter(rooms)


@settings(max_examples=200, deadline=None)
@cases(st.lists(st.integers(1, 31), max_size=120))
def test_runs_equal_plain_best_fit(lengths):
    got = Counter()
    for run in windows.best_fit(Counter(lengths), 32):
        got[run.room] += run.count
    assert got == plain_best_fit(lengths, 32)


@settings(max_examples=300, deadline=None)
@cases(st.lists(st.integers(1, 31), max_size=80) | st.lists(st.sampled_from([3, 7, 20, 31]), max_size=300))
def test_plan_places_every_token_once_and_pads_nothing(lengths):
    counts = Counter(lengths)
    covered = defaultdict(list)
    windows_used = 0
    for length, low, high, start, size, first, offset in windows._places(windows.plan(dict(counts), 32)):
        assert size > 0
        for rank in range(low, high + 1):
            covered[length, rank].append((start, size, first + rank - low, offset))
    assert set(covered) == {(n, r) for n, c in counts.items() for r in range(c)}
    held = defaultdict(list)
    for (length, _), parts in covered.items():
        at = 0
        for start, size, sequence, offset in sorted(parts):
            assert start == at
            at += size
            held[sequence].append((offset, size))
        assert at == length
    for parts in held.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at == 32 or at & (at - 1) == 0
        windows_used += 1
    assert windows_used <= -(-sum(lengths) // 32) + 5


def test_the_tightest_room():
    tree = windows.RoomTree(10)
    for room in (0, 3, 7, 10):
        tree.add(room, 2)
    tree.add(7, -2)
    assert [tree.tightest(n) for n in range(11)] == [0, 3, 3, 3, 10, 10, 10, 10, 10, 10, 10]
    tree.add(10, -2)
    assert tree.tightest(4) is None


@pytest.mark.parametrize("which", [0, 1])
@pytest.mark.parametrize("capacity", [64, 1024])
def test_round_trip(odd, tables, both, tokenizer, which, capacity):
    docs = [odd, tables("documents")][which]
    rows = windows.pack_documents(docs, PATH, capacity, with_ids=True).collect()
    want = Counter((doc, tuple(ids_of(tokenizer, text))) for doc, text in both[which])
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length and zlib.crc32(r.ids) == r.ids_crc32
        by_doc[r.doc_id].append((r.start, tuple(ids.tolist()), r.doc_tokens))
        by_sequence[r.sequence_id].append((r.offset, r.length))
    n_of = Counter(doc for doc, _ in want.elements())
    for doc, own in by_doc.items():
        if n_of[doc] == 1:
            ids = tuple(i for _, part, _ in sorted(own) for i in part)
            assert want[doc, ids] == 1 and {n for *_, n in own} == {len(ids)}
            at = 0
            for start, part, _ in sorted(own):
                assert start == at
                at += len(part)
    tokens = Counter(i for (_, ids), n in want.items() for i in ids * n)
    assert Counter(i for own in by_doc.values() for _, part, _ in own for i in part) == tokens
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == capacity or at & (at - 1) == 0
    narrow = windows.pack_documents(docs, PATH, capacity).collect()
    assert Counter((r.doc_id, r.doc_tokens) for r in narrow if r.start == 0) == Counter((d, len(ids)) for d, ids in want.elements())


def test_sequences_are_whole_windows(tables):
    packed = windows.pack_documents(tables("documents"), PATH, 256, with_ids=True)
    sizes = Counter(len(r.ids) // 4 for r in windows.sequences(packed).collect())
    assert sum(n for size, n in sizes.items() if size != 256) <= 8


def test_ranks_are_spread_and_gapless(spark, monkeypatch):
    monkeypatch.setattr(windows, "RANK_ROWS", 7)
    tails = spark.range(300).selectExpr("id * 3 AS key", "CASE WHEN id < 200 THEN 5L ELSE id % 4 END AS length")
    counts = {r.length: r["count"] for r in tails.groupBy("length").count().collect()}
    got = defaultdict(list)
    for r in windows._ranked(tails, counts).collect():
        got[r.length].append(r["rank"])
    assert {n: sorted(r) for n, r in got.items()} == {n: list(range(c)) for n, c in counts.items()}


def test_empty(empty):
    assert windows.pack_documents(empty, PATH).count() == 0

"""Spelling variants against plain versions of their rules."""

import re
import zlib
from collections import Counter

import pytest
from hypothesis import given as cases
from hypothesis import settings
from hypothesis import strategies as st

from faultgrain.llm import spellings

LETTERS = re.compile("[A-Za-zÀ-ÿ]+")


def plain_counts(rows, every=None, least=7, twice=2):
    seen = Counter()
    for doc, text in rows:
        for run in LETTERS.findall(text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if every and h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            seen[run] += 1
    return {w: n for w, n in seen.items() if len(w) >= least and n >= twice}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(counted, ratio=10):
    by_size = {}
    for w in counted:
        by_size.setdefault(len(w), []).append(w)
    near = {w: [v for k in (-1, 0, 1) for v in by_size.get(len(w) + k, []) if one_edit(w, v)] for w in counted}
    form = {}
    for w, n in counted.items():
        best = min(near[w], key=lambda v: (-counted[v], v), default=None)
        form[w] = best if best is not None and counted[best] >= ratio * n else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), n, len(near[w]), counted.get(form[w])) for w, n in counted.items()}


def as_rows(df):
    return [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()]


@pytest.mark.parametrize("which", [0, 1])
@pytest.mark.parametrize("every", [None, 31, 2])
def test_counts(odd, tables, both, which, every):
    docs = [odd, tables("documents")][which]
    got = {r.word: r.n for r in spellings.word_counts(docs, delete_every=every).collect()}
    assert got == plain_counts(both[which], every)


def test_variants_of_the_given_documents(tables, given):
    got = as_rows(spellings.spelling_variants(tables("documents"), delete_every=31))
    assert len(got) == len(set(got)) and set(got) == plain_variants(plain_counts(given, 31))


def test_crowded_tiles_are_dealt_again(spark):
    """Nearly all words share a half, some many; tiles hold few rows, so they are dealt several times."""
    stems = ["abcdefg", "abcdefgh", "aaaaaaaa", "aaaaaaaaa", "àéabcdef"]
    letters = "abcdefghéÿ"
    counted = {s[:i] + c + s[i + k :]: 2 + (7 * i + ord(c) * len(s)) % 400 for s in stems for i in range(len(s)) for c in letters for k in (0, 1)}
    counted |= {"abc" + x + y + z + "q": 3 + ord(x) for x in letters for y in letters for z in letters}
    table = spark.createDataFrame(list(counted.items()), "word string, n long").repartition(5)
    for rows in (2, 16, 100_000):
        got = as_rows(spellings.variants(table, tile_rows=rows))
        assert len(got) == len(counted) and set(got) == plain_variants(counted)


def test_long_words_and_chains(spark):
    long = "x" * 30_000
    counted = {long: 5, long + "y": 60, long[:-1]: 700, "abcdefgh": 2, "abcdefg": 20, "bcdefg" + "g": 200, "unlike" * 3: 9}
    table = spark.createDataFrame(list(counted.items()), "word string, n long")
    got = as_rows(spellings.variants(table))
    assert set(got) == plain_variants(counted)
    assert {r[0]: r[2] for r in got}["abcdefgh"] in ("abcdefg", "bcdefgg")


def test_empty_and_odd_input(spark, empty):
    assert as_rows(spellings.spelling_variants(empty)) == []
    counted = spark.createDataFrame([("seventh", 3, "a", "b")], "word string, n long, size string, tile string")
    assert as_rows(spellings.variants(counted)) == [("seventh", None, "seventh", 3, 0, None)]
    with pytest.raises(ValueError):
        spellings.variants(counted, ratio=1)


@settings(max_examples=200, deadline=None)
@cases(st.lists(st.text("abé", min_size=3, max_size=5), min_size=2, max_size=30, unique=True))
def test_one_stack_finds_single_edits(own):
    import numpy as np

    size = max(map(len, own))
    own = [w for w in own if len(w) >= size - 1]
    stack = spellings._Stack(own, np.array([0, len(own)]), np.array([[size, 0, 0, size + 1, 0]]))
    stack.block = 4
    count, best = stack.compare()
    for i, w in enumerate(own):
        near = [v for v in own if one_edit(w, v) and max(len(w), len(v)) == size]
        assert count[i] == len(near)
        assert not near or own[best[i]] == near[0]

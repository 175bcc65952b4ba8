"""Byte-pair merges of many words at once.

A word's symbols lie in a column of their own. Each round finds every word's pair of lowest rank, the first of them where
it is there twice, joins that pair and looks up the two pairs it now stands in: the order in which a
tokenizer's queue takes them, word by word.
"""

from __future__ import annotations

import json

import numpy as np

BLOCK_WORDS, FEW_WORDS = 16_384, 256
_NONE = np.int32((1 << 31) - 1)
_ODD = np.uint64(0x9E3779B97F4A7C15)


class PairMerges:
    """The ids of words given as UTF-8, by the merges of a tokenizer's file whose alphabet is ``byte_names``.

    ``ready`` is False for a file with other rules than merges by rank.
    """

    longest = 63  # bytes: a place in a word has six bits of a pair's key

    def __init__(self, path: str, byte_names: dict[int, str]):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        vocabulary = model.get("vocab", {})
        suffix = model.get("end_of_word_suffix") or ""
        self.ready = (
            model.get("type") == "BPE"
            and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
            and all(name + end in vocabulary for name in byte_names.values() for end in ("", suffix))
            and len(model["merges"]) < _NONE >> 6
        )
        if not self.ready:
            return
        # Each byte's symbol inside a word and at its end.
        self.inside, self.last = (np.array([vocabulary[byte_names[b] + end] for b in range(256)], np.int64) for end in ("", suffix))
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left, right, self.joined = (np.array([vocabulary[x] for x in names], np.int64) for names in (*zip(*pairs), map("".join, pairs)))
        self._keep(left << 32 | right)

    def _keep(self, pairs: np.ndarray) -> None:
        """A table of open addresses with the pairs' ranks; the first rank of a repeated pair counts."""
        pairs, rank = np.unique(pairs, return_index=True)
        bits = max(4, int(len(pairs) * 2).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.pairs = np.full(1 << bits, -1, np.int64)
        self.ranks = np.full(1 << bits, _NONE, np.int32)
        at = self._slots(pairs)
        while len(at):
            free = np.flatnonzero(self.pairs[at] < 0)
            put = free[np.unique(at[free], return_index=True)[1]]
            self.pairs[at[put]], self.ranks[at[put]] = pairs[put], rank[put]
            rest = np.ones(len(at), bool)
            rest[put] = False
            at, pairs, rank = at[rest] + 1 & self.mask, pairs[rest], rank[rest]

    def _slots(self, pairs: np.ndarray) -> np.ndarray:
        return ((pairs.view(np.uint64) * _ODD) >> self.shift).view(np.int64)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Each pair's rank, _NONE where there is no such merge."""
        pairs = left << 32 | right
        at = self._slots(pairs)
        held = self.pairs[at]
        rank = self.ranks[at]
        rank[held != pairs] = _NONE
        open_ = np.flatnonzero((held != pairs) & (held >= 0))
        at = at[open_]
        while len(open_):
            at = at + 1 & self.mask
            held, wanted = self.pairs[at], pairs[open_]
            rank[open_] = np.where(held == wanted, self.ranks[at], _NONE)
            more = (held != wanted) & (held >= 0)
            at, open_ = at[more], open_[more]
        return rank

    def ids(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words ``data[starts : starts + sizes]``, of 1 to ``longest`` bytes, one word after the other, and how many each has."""
        counts = np.zeros(len(starts), np.int64)
        order, found = np.argsort(sizes, kind="stable"), []
        for begin in range(0, len(order), BLOCK_WORDS):
            block = order[begin : begin + BLOCK_WORDS]
            symbols, there = self._block(data, starts[block], sizes[block])
            counts[block] = there.sum(axis=0)
            found.append(symbols.T[there.T])
        # From the blocks' order back to the words'.
        out = np.empty(int(counts.sum()), np.uint32)
        begins = (np.cumsum(counts) - counts)[order]
        if len(order):
            sized = counts[order]
            out[np.arange(len(out)) + np.repeat(begins - (np.cumsum(sized) - sized), sized)] = np.concatenate(found)
        return out, counts

    def _block(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols by place and word, and which of them are left."""
        n, most = len(starts), int(sizes.max())
        place = np.arange(most)[:, None]
        there = place < sizes
        symbols = self.inside[data[np.minimum(starts + place, len(data) - 1)]]
        word = np.arange(n)
        symbols[sizes - 1, word] = self.last[data[starts + sizes - 1]]
        keys = np.full((most, n), _NONE, np.int32)
        if most > 1:
            rank = self._rank(symbols[:-1].ravel(), symbols[1:].ravel()).reshape(most - 1, n)
            rank[~there[1:]] = _NONE
            keys[:-1] = np.where(rank < _NONE, rank << 6 | place[:-1], _NONE)
        # Places of the symbols before and after each; -1 before the first, ``most`` after the last.
        after = np.where(place + 1 < sizes, place + 1, most)
        before = np.broadcast_to(place - 1, (most, n)).copy()
        self._rounds(symbols, there, keys, after, before)
        return symbols, there

    def _rounds(self, symbols, there, keys, after, before) -> None:
        """Join pairs until no word has one; when most words are done the others go on by themselves."""
        while True:
            least = keys.min(axis=0)
            word = np.flatnonzero(least < _NONE)
            if not len(word):
                return
            if len(word) < len(least) // 2 and len(least) > FEW_WORDS:
                own = [np.ascontiguousarray(x[:, word]) for x in (symbols, there, keys, after, before)]
                self._rounds(*own)
                symbols[:, word], there[:, word] = own[:2]
                return
            self._join(symbols, there, keys, after, before, word, least[word])

    def _join(self, symbols, there, keys, after, before, word, least) -> None:
        """Join the pair of each ``word`` that ``least`` names."""
        most = len(symbols)
        at, new = least & 63, self.joined[least >> 6]
        gone = after[at, word]
        then, earlier = after[gone, word], before[at, word]
        symbols[at, word], there[gone, word] = new, False
        keys[gone, word], keys[at, word] = _NONE, _NONE
        after[at, word] = then
        has = np.flatnonzero(then < most)
        w, a, t = word[has], at[has], then[has]
        before[t, w] = a
        rank = self._rank(new[has], symbols[t, w])
        keys[a, w] = np.where(rank < _NONE, rank << 6 | a, _NONE)
        has = np.flatnonzero(earlier >= 0)
        w, a = word[has], earlier[has]
        rank = self._rank(symbols[a, w], new[has])
        keys[a, w] = np.where(rank < _NONE, rank << 6 | a, _NONE)

"""Substring dedup: words inside a 13-word window that an earlier document already has.

Difference-cover anchors. Of each document only the 7-word windows at places that are 0, 1 or
3 modulo 7 are hashed: every number modulo 7 is a difference of two of these, so two equal
13-word windows anywhere hold, at the same offset of 0 to 6, an anchor in both. Anchors that
one document alone has end the search there. Around anchors that two documents share the
match is extended: the 13-word windows holding one are hashed and the smallest document of
each is found.

Both rounds send, from each slice of text, a hash once (twice if the slice itself shows that
documents share it), however often it occurs; a slice tells its other holders itself. So a
passage in a third of all documents is no larger in any group than one row a slice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultgrain.llm.common import flat, hashes, keyed, owners, parts, slices, text_bytes, unkeyed, windows, words

WIDTH = 13
PERIOD, COVER = 7, (0, 1, 3)
ANCHOR = WIDTH - PERIOD + 1
GROUP_BYTES, ASKING_BYTES = 32 << 20, 8 << 20

_COVERED = np.isin(np.arange(PERIOD), COVER)
_SENT = "bucket int, docs binary, sent binary"
_TOLD = "doc_id long, told binary"


class _Slice:
    """The words of a slice of documents."""

    def __init__(self, batch: pa.RecordBatch):
        self.docs = batch["doc_id"].to_numpy(zero_copy_only=False)
        data, at = flat(batch["text"])
        starts, ends, self.first = words(data, at)
        self.h = hashes(data, starts, ends)
        self.owner = owners(self.first)
        self.left = self.first[self.owner + 1] - np.arange(len(self.h))

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Places (word numbers) and hashes of the anchors."""
        place = np.flatnonzero(_COVERED[(np.arange(len(self.h)) - self.first[self.owner]) % PERIOD] & (self.left >= ANCHOR))
        return place, windows(self.h, ANCHOR)[place]

    def full(self) -> np.ndarray:
        """Whether a 13-word window starts at each word."""
        return self.left >= WIDTH

    def told(self, column: pa.Array) -> np.ndarray:
        """(text number, hash) pairs of a column that lists hashes for each text, as one number."""
        parts_ = [np.frombuffer(b"".join(row), np.uint64) if row else np.empty(0, np.uint64) for row in column.to_pylist()]
        sizes = [len(p) for p in parts_]
        return self.pairs(np.repeat(np.arange(len(parts_)), sizes), np.concatenate([np.empty(0, np.uint64), *parts_]))

    @staticmethod
    def pairs(texts: np.ndarray, h: np.ndarray) -> np.ndarray:
        return h ^ ((texts.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))


def _groups(h: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, document) pairs sorted by hash; each group's number, smallest and largest document."""
    order = np.lexsort((docs, h))
    h, docs = h[order], docs[order]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(h)) - 1
    return h, docs, np.cumsum(new) - 1, docs[at], docs[last[: len(at)]]


def _tell(docs: np.ndarray, h: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Per document the distinct hashes told to it."""
    order = np.lexsort((h, docs))
    docs, h = docs[order], h[order]
    new = np.ones(len(docs), bool)
    new[1:] = (docs[1:] != docs[:-1]) | (h[1:] != h[:-1])
    docs, h = docs[new], h[new]
    cuts = np.flatnonzero(np.diff(docs)) + 1
    for start, end in zip([0, *cuts], [*cuts, len(docs)]):
        if end > start:
            yield int(docs[start]), h[start:end].tobytes()


def _send(h: np.ndarray, docs: np.ndarray, known: np.ndarray, known_docs: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Rows for the exchange: hashes to be asked about, by bucket, and what is known, by document."""
    bucket = ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    bucket, h, docs = bucket[order], h[order], docs[order]
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    spans = [(s, e) for s, e in zip([0, *cuts], [*cuts, len(h)]) if e > s]
    rows = [(int(bucket[s]), docs[s:e].tobytes(), h[s:e].tobytes()) for s, e in spans]
    rows += [(-1 - doc % buckets, np.int64(doc).tobytes(), told) for doc, told in _tell(known_docs, known)]
    return _batch(rows, [pa.int32(), pa.binary(), pa.binary()], ["bucket", "docs", "sent"])


def _batch(rows: list[tuple], types: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def _ask_anchors(buckets: int, most: int) -> Callable:
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=most):
            s = _Slice(batch)
            place, h = s.anchors()
            h, docs, group, low, high = _groups(h, s.docs[s.owner[place]])
            shared = (low < high)[group]
            at = np.flatnonzero(np.diff(group, prepend=-1))
            both = low < high
            asked = np.concatenate([h[at], h[at][both]])
            yield _send(asked, np.concatenate([low, high[both]]), h[shared], docs[shared], buckets)

    return ask


def _ask_windows(buckets: int, most: int) -> Callable:
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=most):
            s = _Slice(batch)
            place, h = s.anchors()
            place = place[np.isin(s.pairs(s.owner[place], h), s.told(batch["told"]))]
            near = np.zeros(len(s.h) + WIDTH, bool)
            for offset in range(PERIOD):  # the windows that hold the anchor at this offset
                back = place[place >= offset] - offset
                near[back[s.owner[back] == s.owner[back + offset]]] = True
            start = np.flatnonzero(near[: len(s.h)] & s.full())
            h, docs, group, low, _ = _groups(windows(s.h, WIDTH)[start], s.docs[s.owner[start]])
            at = np.flatnonzero(np.diff(group, prepend=-1))
            later = docs > low[group]
            yield _send(h[at], low, h[later], docs[later], buckets)

    return ask


def _answer(rule: Callable) -> Callable:
    """One bucket: all hashes asked about meet here; ``rule`` picks the pairs to be told."""

    def answer(table: pa.Table) -> pa.Table:
        names, types = ["doc_id", "told"], [pa.int64(), pa.binary()]
        if table["bucket"][0].as_py() < 0:
            docs = np.frombuffer(b"".join(table["docs"].to_pylist()), np.int64)
            return pa.table([pa.array(docs), table["sent"].combine_chunks()], names=names)
        h = np.frombuffer(b"".join(table["sent"].to_pylist()), np.uint64)
        docs = np.frombuffer(b"".join(table["docs"].to_pylist()), np.int64)
        h, docs, group, low, high = _groups(h, docs)
        pick = rule(docs, low[group], high[group])
        return pa.Table.from_batches([_batch(list(_tell(docs[pick], h[pick])), types, names)])

    return answer


def _round(asked: DataFrame, rule: Callable) -> DataFrame:
    told = asked.groupBy("bucket").applyInArrow(_answer(rule), _TOLD)
    return told.groupBy("doc_id").agg(F.collect_list("told").alias("told"))


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        s = _Slice(batch)
        told, gone = s.told(batch["told"]), np.zeros(len(s.h), bool)
        if len(told):
            start = np.flatnonzero(s.full())
            start = start[np.isin(s.pairs(s.owner[start], windows(s.h, WIDTH)[start]), told)]
            edges = np.zeros(len(s.h) + 1, np.int64)
            edges[start] += 1
            np.subtract.at(edges, start + WIDTH, 1)
            gone = np.cumsum(edges[:-1]) > 0
        kept = []
        for k, text in enumerate(batch["text"].cast(pa.large_binary()).to_pylist()):
            own = (text or b"").split()
            lost = gone[s.first[k] : s.first[k + 1]]
            kept.append(b" ".join([w for w, g in zip(own, lost) if not g] if lost.any() else own))
        sums = np.concatenate([[0], np.cumsum(gone)])
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], pa.array(np.diff(s.first)), pa.array(sums[s.first[1:]] - sums[s.first[:-1]]),
             pa.array(kept, pa.binary()).cast(pa.string())],
            names=["doc_id", "n_words", "n_removed", "kept"],
        )


def remove_repeats(docs: DataFrame, slice_bytes: int = ASKING_BYTES) -> DataFrame:
    """Every document without the words of windows that a smaller doc_id has: ``doc_id, n_words, n_removed, kept``.

    A hash is sent once for every ``slice_bytes`` of text. Windows are judged on the input. ``kept`` joins the words left by one space. Texts of
    under 13 words, empty and null ones lose nothing. Rows of one doc_id count as one document
    for the comparison and are answered row by row; rows without doc_id count as one
    document after all others. An empty table gives no rows.
    """
    docs = keyed(docs, "text")
    buckets = parts(text_bytes(docs), GROUP_BYTES)
    shared = _round(docs.mapInArrow(_ask_anchors(buckets, slice_bytes), _SENT), lambda docs, low, high: low < high)
    near = docs.join(shared, "doc_id")
    later = _round(near.mapInArrow(_ask_windows(buckets, slice_bytes), _SENT), lambda docs, low, high: docs > low)
    told = docs.join(later, "doc_id", "left")
    return told.mapInArrow(_remove, "doc_id long, n_words long, n_removed long, kept string").withColumn("doc_id", unkeyed())

"""Secret scans: fixed patterns, and a pair of character Markov models for what they miss.

Two first-order models over the characters of tokens, one of random strings and one of
ordinary identifiers, are trained from labelled samples: the values that the fixed patterns
find in the whole corpus, and all its other tokens. Values of hexadecimal digits alone are left
out, as a pattern finds all of them; a prior of evenly drawn letters and digits stands for
random strings where values are few. A token is a secret if its log-likelihood
ratio is high enough in total and per character.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultgrain.llm.common import flat, keyed, slices, unkeyed, words

KINDS = ("assign", "access", "hex", "markov")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST, TOKEN_LEAST = 12, 18, 16, 20
RATIO_LEAST, RATIO_PER_CHARACTER = 12.0, 0.4
_SAMPLE_LEAST = 6

# The patterns of the base kinds.
_ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
_NAMES = (b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_ALPHABET = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"

_TOKEN, _HEX = np.zeros(256, bool), np.zeros(256, bool)
_TOKEN[list(_ALPHABET)] = True
_HEX[list(b"0123456789abcdef")] = True
_NUMBER = np.zeros(256, np.int64)
_NUMBER[list(_ALPHABET)] = np.arange(len(_ALPHABET))
_N = len(_ALPHABET)
_ALNUM = np.array([chr(c).isalnum() for c in _ALPHABET])
_PRIOR = np.where(_ALNUM[:, None] & _ALNUM[None, :], 20.0, 2.0).reshape(-1)


def _runs(data: np.ndarray, at: np.ndarray, kind: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of ``kind`` of at least ``least`` bytes: starts, ends, text numbers."""
    starts, ends, _ = words(data, at, kind)
    long = ends - starts >= least
    starts, ends = starts[long], ends[long]
    return starts, ends, np.searchsorted(at, starts, "right") - 1


def base_spans(data: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(text number, kind, start, end, value start, value end) in bytes of the whole slice."""
    for start, end, text in zip(*(x.tolist() for x in _runs(data, at, _HEX, HEX_LEAST))):
        yield text, 2, start, end, start, end
    for text, (low, high) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
        own = data[low:high].tobytes()
        if b"AKIA" in own:
            for m in _ACCESS.finditer(own):
                if m.end() - m.start() >= ACCESS_LEAST:
                    yield text, 1, low + m.start(), low + m.end(), low + m.start(), low + m.end()
        small = own.lower()
        if any(name in small for name in _NAMES):
            for m in _ASSIGN.finditer(own):
                if m.end(2) - m.start(2) >= ASSIGN_LEAST:
                    yield text, 0, low + m.start(), low + m.end(), low + m.start(2), low + m.end(2)


def _transitions(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How often each character follows each other one inside the spans."""
    inside = np.zeros(len(data) + 1, np.int32)
    np.add.at(inside, starts, 1)
    np.add.at(inside, np.maximum(ends - 1, starts), -1)
    here = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
    code = _NUMBER[data[here]] * _N + _NUMBER[data[here + 1]]
    return np.bincount(code, minlength=_N * _N)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((2, _N * _N), np.int64)
    for batch in slices(batches):
        data, at = flat(batch["text"])
        found = list(base_spans(data, at))
        secret = np.zeros(len(data) + 1, np.int32)
        low, high = (np.array([x[k] for x in found], np.int64) for k in (4, 5))
        np.add.at(secret, low, 1)
        np.add.at(secret, high, -1)
        mixed = np.array([not _HEX[data[s:e]].all() for s, e in zip(low, high)], bool)
        low, high = low[mixed], high[mixed]
        secret = np.cumsum(secret) > 0
        starts, ends, _ = _runs(data, at, _TOKEN, _SAMPLE_LEAST)
        plain = ~secret[starts]
        counts[0] += _transitions(data, low, high)
        counts[1] += _transitions(data, starts[plain], ends[plain])
    label, code = np.nonzero(counts)
    yield pa.RecordBatch.from_arrays(
        [pa.array(label, pa.int64()), pa.array(code, pa.int64()), pa.array(counts[label, code])], names=["label", "code", "n"]
    )


def train(docs: DataFrame) -> np.ndarray:
    """The log ratio of every character pair, random over ordinary, from all documents' tokens.

    Its size is the alphabet's square whatever the data.
    """
    rows = keyed(docs, "text").mapInArrow(_count, "label long, code long, n long")
    total = rows.groupBy("label", "code").agg(F.sum("n").alias("n"))
    counts = np.stack([_PRIOR, np.full(_N * _N, 0.2)])
    for label, code, n in total.collect():
        counts[label, code] += n
    by_first = counts.reshape(2, _N, _N)
    chance = by_first / by_first.sum(axis=2, keepdims=True)
    return np.log(chance[0] / chance[1]).reshape(-1)


def _scan(model) -> object:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = model.value
        for batch in slices(batches):
            data, at = flat(batch["text"])
            found = [[] for _ in range(batch.num_rows)]
            taken = np.zeros(len(data) + 1, np.int32)
            for text, kind, start, end, _, _ in base_spans(data, at):
                found[text].append((start, kind, end))
                taken[start] += 1
                taken[end] -= 1
            taken = np.concatenate([[0], np.cumsum(np.cumsum(taken) > 0)])
            for start, end, text in zip(*(x.tolist() for x in _runs(data, at, _TOKEN, TOKEN_LEAST))):
                if taken[end] > taken[start]:
                    continue
                own = _NUMBER[data[start:end]]
                total = float(ratio[own[:-1] * _N + own[1:]].sum())
                if total >= max(RATIO_LEAST, RATIO_PER_CHARACTER * (end - start - 1)):
                    found[text].append((start, 3, end))
            spans = []
            for text, own in enumerate(found):
                if own:
                    low = at[text]
                    points = np.concatenate([[0], np.cumsum((data[low : at[text + 1]] & 0xC0) != 0x80)])
                    own = [{"kind": KINDS[k], "start": int(points[s - low]), "end": int(points[e - low])} for s, k, e in sorted(own)]
                spans.append(own)
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(spans, kind)], names=["doc_id", "spans"])

    return scan


def scan(docs: DataFrame) -> DataFrame:
    """Every document's spans by start and kind: ``doc_id, spans array<struct<kind, start, end>>`` in code points.

    Spans of the kinds assign, access and hex are those of the fixed patterns; markov spans are further
    tokens, none of which touches one of them. Null and empty texts have no spans. Rows
    of one doc_id stay apart; rows without doc_id keep it null. An empty table gives no rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs))
    layout = "doc_id long, spans array<struct<kind: string, start: long, end: long>>"
    return keyed(docs, "text").mapInArrow(_scan(model), layout).withColumn("doc_id", unkeyed())

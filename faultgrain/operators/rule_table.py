"""Ordered substring rules from a table: the first of any number of markers that a text contains.

A text is looked through once for every length that markers have, by rolling hashes and a bit table of bounded
size that all machines hold; what passes is joined by its bytes with the markers. So the work grows with the
texts and with the markers they contain, not with texts times markers; the rules are neither collected nor
held by a worker, and texts are never joined with all of them.

Markers beyond EXACT bytes are first told by as many of their bytes as the largest power of two within them:
their own lengths are tried only where these were found, so many lengths cost no pass each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultgrain.plans.skew import lookup
from faultgrain.session import materialize

EXACT = 16
BITS_A_MARKER = 32
MOST_WORDS = 1 << 21  # 16 MiB, whatever the table
BLOCK_BYTES, LEAST_BLOCK = 1 << 20, 1 << 18

_FACTOR = 0x9E3779B97F4A7C15
_INVERSE = pow(_FACTOR, -1, 1 << 64)
_C1, _C2, _C3 = (np.uint64(c) for c in (0x94D049BB133111EB, 0xBF58476D1CE4E5B9, 0xD6E8FEB86659FD93))
_BYTES = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64)  # drawn once: the same on every machine


def _told_by(length: int) -> int:
    """How many of a marker's bytes are looked for everywhere."""
    return length if length <= EXACT else 1 << (length.bit_length() - 1)


class _Rolling:
    """Hashes of any stretches of some bytes."""

    def __init__(self, data: np.ndarray):
        powers = np.full(len(data), _FACTOR, np.uint64)
        powers[:1] = 1
        sums = np.cumsum(_BYTES[data] * np.cumprod(powers, dtype=np.uint64), dtype=np.uint64)
        self._sums = np.concatenate([np.zeros(1, np.uint64), sums])
        powers[1:] = _INVERSE
        self._back = np.cumprod(powers, dtype=np.uint64)

    def at(self, starts: np.ndarray | slice, length: int) -> np.ndarray:
        """The hash of the ``length`` bytes from each start; a slice names the starts from its own to its end."""
        if isinstance(starts, slice):
            ends = slice(starts.start + length, starts.stop + length)
        else:
            ends = starts + length
        h = (self._sums[ends] - self._sums[starts]) * self._back[starts]
        h ^= h >> np.uint64(29)
        h *= _C2
        h += np.uint64(length) * _C1
        h ^= h >> np.uint64(32)
        h *= _C3
        return h ^ (h >> np.uint64(31))


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values one after the other and their n + 1 offsets; null is empty."""
    values = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = values.buffers()
    at = np.frombuffer(offsets, np.int64)[values.offset : values.offset + len(values) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def _marker_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each marker's length and two hashes: of the bytes that tell it and of all."""
    for batch in batches:
        data, at = _flat(batch["marker"])
        size = np.diff(at)
        told, whole = np.zeros(len(size), np.uint64), np.zeros(len(size), np.uint64)
        rolling = _Rolling(data)
        for length in np.unique(size).tolist():
            rows = np.flatnonzero(size == length)
            told[rows], whole[rows] = rolling.at(at[rows], _told_by(length)), rolling.at(at[rows], length)
        columns = [pa.array(size), pa.array(told.view(np.int64)), pa.array(whole.view(np.int64))]
        yield pa.RecordBatch.from_arrays(columns, names=["size", "told", "whole"])


def _has(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which hashes the bit table holds: a word by the upper bits, two bits in it by the lower ones."""
    word = bits[(h >> np.uint64(64 - int(math.log2(len(bits))))).astype(np.int64)]
    return ((word >> (h & np.uint64(63))) & (word >> ((h >> np.uint64(6)) & np.uint64(63))) & np.uint64(1)).astype(bool)


def _bit_table(hashes: DataFrame, markers: int) -> np.ndarray:
    """The bits of ``hashes(h)`` in a power of two of words; the driver sees one number a word."""
    size = min(MOST_WORDS, 1 << max(6, math.ceil(math.log2(max(1, markers * BITS_A_MARKER / 64)))))
    one = F.lit(1).cast("long")
    bit = lambda by: F.call_function("shiftleft", one, F.shiftright("h", by).bitwiseAND(F.lit(63)).cast("int"))
    word = F.shiftrightunsigned("h", 64 - int(math.log2(size))).alias("word")
    words = hashes.select(word, bit(0).bitwiseOR(bit(6)).alias("bits")).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    found, bits = words.toArrow(), np.zeros(size, np.int64)
    bits[found["word"].to_numpy()] = found["bits"].to_numpy()
    return bits.view(np.uint64)


def _candidates(column: str, lengths: list[int], held: Broadcast, block_bytes: int):
    """Each text's stretches that may be markers, once a text and stretch."""
    classes: dict[int, list[int]] = {}
    for length in lengths:
        classes.setdefault(_told_by(length), []).append(length)
    longest = max(lengths, default=0)

    def stretches(data: np.ndarray, at: np.ndarray, low: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
        """Starts in the block from ``low`` on, by length: their texts, hashes and the length."""
        high = min(low + block_bytes, len(data))
        part = data[low : high + longest - 1]
        rolling = _Rolling(part)
        for told, own in classes.items():
            last = min(high - low, len(part) - told + 1)
            if last <= 0:
                continue
            first = rolling.at(slice(0, last), told)
            starts = np.flatnonzero(_has(held.value, first))
            for length in own:
                here = starts[starts + length <= len(part)]
                h = first[here] if length == told else rolling.at(here, length)
                if length != told:
                    passed = _has(held.value, h)
                    here, h = here[passed], h[passed]
                here = here + low
                owner = np.searchsorted(at, here, side="right") - 1
                inside = here + length <= at[owner + 1]
                yield owner[inside], here[inside], h[inside], length

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = _flat(batch[column])
            for low in range(0, len(data), block_bytes):
                owners, markers = [], []
                for owner, starts, h, length in stretches(data, at, low):
                    order = np.lexsort((h, owner))
                    owner, starts, h = owner[order], starts[order], h[order]
                    new = np.ones(len(order), bool)
                    new[1:] = (owner[1:] != owner[:-1]) | (h[1:] != h[:-1])
                    owners.append(owner[new])
                    markers += [data[s : s + length].tobytes() for s in starts[new].tolist()]
                if markers:
                    rows = pa.array(np.concatenate(owners))
                    digests = [batch[name].take(rows) for name in ("digest", "digest2")]
                    yield pa.RecordBatch.from_arrays([*digests, pa.array(markers, pa.binary())], names=["digest", "digest2", "marker"])

    return candidates


def first_rule_of_table(texts: DataFrame, rules: DataFrame, text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``texts`` with ``value``: that of the first rule by ``ord`` whose ``marker`` the text contains, else null.

    ``rules`` has ord, marker and value; of equal ords the smaller marker comes first, rules without marker match
    nothing. A missing text contains nothing, not even an empty marker. ``texts`` may have any columns but ``value``.
    A worker hashes some ``block_bytes`` of text at a time, LEAST_BLOCK and the longest marker's bytes at least.
    Equal texts are told by 128 bits of hash.
    """
    spark = texts.sparkSession
    best = F.min(F.struct("ord", "marker", "value")).alias("rule")
    usable = rules.filter("marker IS NOT NULL").select("ord", "marker", "value").groupBy("marker").agg(best)
    usable = materialize(usable.withColumn("marker", F.encode("marker", "UTF-8")), "rules", spark)
    filled = usable.filter("octet_length(marker) > 0")
    hashes = materialize(filled.select("marker").mapInArrow(_marker_hashes, "size long, told long, whole long"), "rule-hashes", spark)
    lengths = sorted(r["size"] for r in hashes.select("size").distinct().collect())
    both = hashes.select(F.explode(F.array("told", "whole")).alias("h"))
    held = spark.sparkContext.broadcast(_bit_table(both, hashes.count()))

    # Equal texts have one answer; missing and empty ones contain no filled marker.
    digests = [F.when(F.col(text) != "", digest) for digest in (F.xxhash64(text), F.xxhash64(F.lit(1), text))]
    read = texts.select(text, digests[0].alias("digest"), digests[1].alias("digest2")).filter("digest IS NOT NULL")
    block = max(block_bytes, LEAST_BLOCK, lengths[-1] if lengths else 0)
    hits = read.mapInArrow(_candidates(text, lengths, held, block), "digest long, digest2 long, marker binary")
    hits = materialize(hits, "rule-hits", spark)
    met = lookup(hits, filled, ["marker"], ["digest"], how="inner")
    found = met.groupBy("digest", "digest2").agg(F.min("rule").alias("_rule"))
    columns = texts.columns
    one, two = (_fresh(columns, name) for name in ("_digest", "_digest2"))
    rule = _fresh(columns, "_rule")
    answers = materialize(found.select(F.col("digest").alias(one), F.col("digest2").alias(two), F.col("_rule").alias(rule)), "rules-found", spark)
    hashable = [name for name, kind in texts.dtypes if "map<" not in kind and "variant" not in kind]
    joined = lookup(texts.withColumns({one: digests[0], two: digests[1]}), answers, [one, two], hashable)
    # A rule with an empty marker, of which one is the first, is contained in every text there is.
    empty = usable.filter("octet_length(marker) = 0").select("rule").scalar()
    first = F.when(F.col(text).isNotNull(), F.least(F.col(rule), empty))
    return joined.withColumn("value", first["value"]).select(*columns, "value")


def _fresh(taken: list[str], name: str) -> str:
    while name in taken:
        name = f"_{name}"
    return name

"""Best-fit decreasing packing of documents into token windows, with a segment tree over the room left.

An overlong document is first cut into full windows; what is left of it, and every shorter document,
is a tail. Tails of one length are alike, so their histogram, with fewer rows than a window has tokens,
holds all the packing needs: from long to short each goes where the least sufficient room is, which a
segment tree indexed by remaining capacity finds, and runs of equal windows are filled at once. The
windows that are still open then are topped up: the fullest keep what they have, and the emptiest are
cut to fill the gaps exactly. What remains, less than one window, is cut at powers of two, which need no
padding either. A tail finds its places by its rank among the tails of its length.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from faultgrain.llm.common import flat, keyed, slices, unkeyed
from faultgrain.session import materialize

CAPACITY = 1024
RANK_ROWS = 20_000
CACHED_CHUNKS = 400_000

_SPACE, _OTHER, _ALPHA, _DIGIT, _MARK = range(5)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[[0x20, *range(0x09, 0x0E)]] = _SPACE
_KIND[0x21:0x7F] = _MARK
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = _ALPHA
_KIND[0x30:0x3A] = _DIGIT
# Texts that this module's cuts must not change: tried with every tokenizer before it is used.
_PROBES = ("It's 3.5km, isn't it? \n\n  x\t\ty 'tis été,  naïve  a \r\n'' 're-doß9 中文 12:30", "a'sb c''d 've ' s")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class ChunkIds:
    """The ids of whole texts by a byte-level tokenizer, each distinct chunk encoded once while it is cached.

    The tokenizer's pattern never joins characters across the start of white space, nor an ASCII letter, digit
    or other sign with one of another of these kinds unless an apostrophe comes first. So texts are cut there
    and the chunks, which have no gaps, are told apart in Arrow. A text that holds a special token's string is
    encoded whole. A chunk of Latin letters alone, after a blank or none, is one word of the pattern and goes to the
    model at once. The constructor refuses a tokenizer that gives other ids than these.
    """

    def __init__(self, path: str, end: int = 0):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on every core already
        self.tokenizer, self.end = Tokenizer.from_file(path), end
        self.model = self.tokenizer.model
        # The characters that name bytes in the vocabulary: printable ones themselves, the others from 256 on.
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [b for b in range(256) if b not in shown]
        self.byte_names = {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(hidden)}
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._clear()
        for text, ids in zip(_PROBES, self.encode_all(pa.array(_PROBES))):
            if ids[:-1].tolist() != self._ids(text):
                raise ValueError(f"{path}: not a byte-level tokenizer whose words end where white space begins")

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _chunk_ids(self, chunk: bytes) -> list[int]:
        text = chunk.decode()
        word = text[1:] if text[:1] == " " else text
        if word.isalpha() and max(word) < "\u0250":
            return [token.id for token in self.model.tokenize(chunk.decode("latin-1").translate(self.byte_names))]
        return self._ids(text)

    def _clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.flat, self.begin, self.size = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)

    def _learn(self, chunks: list[bytes]) -> np.ndarray:
        """The numbers of distinct ``chunks``."""
        new = [c for c in chunks if c not in self.number]
        if len(self.number) + len(new) > CACHED_CHUNKS and self.number:
            self._clear()
            new = chunks
        self.number.update(zip(new, range(len(self.size), len(self.size) + len(new))))
        fresh = [self._chunk_ids(chunk) for chunk in new]
        size = np.fromiter(map(len, fresh), np.int64, len(fresh))
        self.flat = np.concatenate([self.flat, np.array([i for ids in fresh for i in ids], np.uint32)])
        self.size = np.concatenate([self.size, size])
        self.begin = np.cumsum(self.size) - self.size
        return np.array([self.number[c] for c in chunks], np.int64)

    @staticmethod
    def _cuts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where chunks start, text starts among them, and the end."""
        kind = _KIND[data]
        before, here = kind[:-1], kind[1:]
        sure = before >= _ALPHA  # certainly no white space
        sure[1:] |= data[:-2] == 0xC3  # U+00C0 to U+00FF
        apart = (before >= _ALPHA) & (here >= _ALPHA) & (before != here) & (data[:-1] != ord("'"))
        cut = np.zeros(len(data) + 1, bool)
        cut[1:-1] = (sure & (here == _SPACE)) | apart
        cut[at] = True
        return np.flatnonzero(cut)

    def _whole(self, texts: pa.Array) -> dict[int, list[int]]:
        """The ids of those texts that hold a special token's string."""
        found: dict[int, list[int]] = {}
        for mark in self.special:
            for i in np.flatnonzero(pc.match_substring(texts, mark).to_numpy(zero_copy_only=False)).tolist():
                found[i] = self._ids(texts[i].as_py())
        return found

    def encode_all(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Each text's ids and the end id; null is empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        data, at = flat(texts)
        whole = self._whole(texts)
        if not len(data):
            yield from (np.array([self.end], np.uint32) for _ in texts)
            return
        cuts = self._cuts(data, at)
        chunks = pa.Array.from_buffers(
            pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())]
        ).dictionary_encode()
        numbers = self._learn(chunks.dictionary.to_pylist())[chunks.indices.to_numpy()]
        first = np.searchsorted(cuts, at)
        for text, (lo, hi) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
            if text in whole:
                yield np.array([*whole[text], self.end], np.uint32)
                continue
            own = numbers[lo:hi]
            size = self.size[own]
            total = int(size.sum())
            out = np.empty(total + 1, np.uint32)
            out[:total] = self.flat[np.arange(total) + np.repeat(self.begin[own] - (np.cumsum(size) - size), size)]
            out[total] = self.end
            yield out


@cache
def chunk_ids(path: str) -> ChunkIds:
    """One encoder a Python worker, for all its tasks."""
    return ChunkIds(path)


_CUT = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())]


def _cut(docs: DataFrame, path: str, capacity: int, with_ids: bool) -> DataFrame:
    """Full windows and tails: ``doc_id, start, length, doc_tokens, ids_crc32, ids``; full windows have ids only if wanted."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = chunk_ids(path)
        for batch in slices(batches):
            rows = []
            for doc, ids in zip(batch["doc_id"].to_pylist(), encoder.encode_all(batch["text"])):
                for start in range(0, len(ids), capacity):
                    own = ids[start : start + capacity].astype("<u4").tobytes()
                    kept = own if with_ids or len(own) < 4 * capacity else None
                    rows.append((doc, start, len(own) // 4, len(ids), zlib.crc32(own), kept))
            arrays = [pa.array(c, t) for c, (_, t) in zip(zip(*rows), _CUT)]
            yield pa.RecordBatch.from_arrays(arrays, names=[name for name, _ in _CUT])

    return docs.mapInArrow(cut, "doc_id long, start long, length long, doc_tokens long, ids_crc32 long, ids binary")


class RoomTree:
    """Counts by remaining capacity with a segment tree above: ``tightest`` finds the least sufficient room."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.held = [0] * (2 * self.leaves)

    def add(self, room: int, count: int) -> None:
        node = room + self.leaves
        while node:
            self.held[node] += count
            node //= 2

    def tightest(self, least: int) -> int | None:
        """The smallest room of at least ``least`` that is held."""
        node = least + self.leaves
        if self.held[node]:
            return least
        # Up to the first ancestor with something held on its right, then down to that part's first leaf.
        while node > 1 and not (node % 2 == 0 and self.held[node + 1]):
            node //= 2
        if node <= 1:
            return None
        node += 1
        while node < self.leaves:
            node = 2 * node if self.held[2 * node] else 2 * node + 1
        return node - self.leaves


class Part:
    """The same cut of ``count`` tails of one length, by their ranks from ``rank`` on: ``size`` tokens from ``start``."""

    __slots__ = ("length", "rank", "count", "start", "size")

    def __init__(self, length: int, rank: int, count: int, start: int, size: int):
        self.length, self.rank, self.count, self.start, self.size = length, rank, count, start, size

    def first(self, count: int) -> Part:
        """The first ``count`` on their own; this part keeps the others."""
        own = Part(self.length, self.rank, count, self.start, self.size)
        self.rank, self.count = self.rank + count, self.count - count
        return own

    def head(self, size: int) -> Part:
        """The first ``size`` tokens of each; this part keeps the rest."""
        own = Part(self.length, self.rank, self.count, self.start, size)
        self.start, self.size = self.start + size, self.size - size
        return own


class Run:
    """``count`` windows of the same content, with ``room`` tokens to spare."""

    __slots__ = ("count", "room", "parts")

    def __init__(self, count: int, room: int, parts: list[Part] | None = None):
        self.count, self.room, self.parts = count, room, parts or []

    def put(self, part: Part) -> None:
        self.parts.append(part)
        self.room -= part.size

    def first(self, count: int) -> Run:
        """The first ``count`` windows on their own; this run keeps the others."""
        own = Run(count, self.room, [part.first(count) for part in self.parts])
        self.count -= count
        return own


def best_fit(histogram: dict[int, int], capacity: int) -> list[Run]:
    """Best-fit decreasing of all tails (length -> number) into runs of equal windows."""
    tree = RoomTree(capacity)
    open_runs: dict[int, list[Run]] = {}

    def keep(run: Run) -> None:
        open_runs.setdefault(run.room, []).append(run)
        tree.add(run.room, 1)

    for length, left in sorted(histogram.items(), reverse=True):
        rank = 0
        while left:
            room = tree.tightest(length)
            if room is None:
                run = Run(max(1, left // (capacity // length)), capacity)
            else:
                run = open_runs[room].pop()
                tree.add(room, -1)
            # A window takes all it has room for before the next one is looked at.
            copies = min(run.room // length, left)
            if run.count * copies > left:
                keep_rest, run = run, run.first(max(1, left // copies))
                keep(keep_rest)
            for _ in range(copies):
                run.put(Part(length, rank, run.count, 0, length))
                rank += run.count
            left -= run.count * copies
            keep(run)
    return [run for runs in open_runs.values() for run in runs]


def _fill(runs: list[Run], parts: list[Part]) -> list[Run]:
    """``runs`` filled in turn with ``parts``, which are cut where a window ends."""
    done, left, queue = [], list(reversed(runs)), list(reversed(parts))
    while queue:
        part, run = queue.pop(), left.pop()
        if run.count > part.count:
            left.append(run)
            run = run.first(part.count)
        elif part.count > run.count:
            queue.append(part)
            part = part.first(run.count)
        run.put(part.head(min(run.room, part.size)))
        if part.size:
            queue.append(part)
        (left if run.room else done).append(run)
    return done + left


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Run]:
    """Runs of windows that hold every token of ``histogram``, all of them full but those of a power of two."""
    packed = best_fit(histogram, capacity)
    full, open_runs = [r for r in packed if not r.room], sorted((r for r in packed if r.room), key=lambda r: r.room)
    tokens = sum(r.count * (capacity - r.room) for r in open_runs)
    keep, rest = divmod(tokens, capacity)
    fullest: list[Run] = []
    for run in open_runs:
        if keep <= 0:
            break
        fullest.append(run.first(min(keep, run.count)))
        keep -= fullest[-1].count
    parts = [part for run in open_runs if run.count for part in run.parts]
    odd = [Run(1, 1 << bit) for bit in reversed(range(capacity.bit_length())) if rest >> bit & 1]
    return full + _fill(fullest + odd, parts)


def _places(runs: list[Run]) -> list[tuple[int, int, int, int, int, int, int]]:
    """(length, first rank, last rank, start, size, first sequence, offset) of all parts."""
    out = []
    for run, first in zip(runs, accumulate((r.count for r in runs), initial=0)):
        offset = 0
        for part in run.parts:
            out.append((part.length, part.rank, part.rank + run.count - 1, part.start, part.size, first, offset))
            offset += part.size
    return out


def _ranked(tails: DataFrame, counts: dict[int, int]) -> DataFrame:
    """``key, length`` with each row's rank from 0 among those of its length.

    A length's rows are dealt into shares of some RANK_ROWS by a hash of their key and ranked share by share, so
    that a frequent length is spread over as many tasks as it needs.
    """
    # At most one row for each length below the capacity.
    spread = tails.sparkSession.createDataFrame([(n, -(-c // RANK_ROWS)) for n, c in counts.items()], "length long, _shares long")
    dealt = tails.join(F.broadcast(spread), "length").withColumn("_share", F.pmod(F.xxhash64("key"), F.col("_shares")))
    sizes = dealt.groupBy("length", "_share").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("length").orderBy("_share").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("length", "_share", F.coalesce(before, F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("length", "_share").orderBy("key")) - 1
    ranked = dealt.withColumn("_within", within).join(sizes, ["length", "_share"])
    return ranked.select("key", "length", (F.col("_before") + F.col("_within")).alias("rank"))


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """All documents in windows of at most ``capacity`` tokens:
    ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` and, if wanted, ``ids`` (binary, unsigned
    little-endian 32-bit numbers). Every window is full or, a handful of them, as long as a power of two.

    A document's ids end in id 0, so null and empty texts are one piece of length 1. Rows of one doc_id are
    documents of their own; a missing doc_id stays null. An empty table gives no rows. Columns beside doc_id
    and text are left behind. A token lies in exactly one piece; few documents are cut at all beside overlong ones.
    """
    spark = docs.sparkSession
    cut = _cut(keyed(docs, "text"), path, capacity, with_ids).withColumn("key", F.monotonically_increasing_id())
    cut = materialize(cut, "windows")
    tails = cut.filter(F.col("length") < capacity)
    counts = {r["length"]: r["count"] for r in tails.groupBy("length").count().collect()}  # fewer rows than a window has tokens
    places = spark.createDataFrame(
        _places(plan(counts, capacity)), "length long, _from long, _to long, _start long, size long, _first long, offset long"
    ).withColumnRenamed("length", "_length")  # some runs for each length, whatever the data
    ranked = _ranked(tails.select("key", "length"), counts)
    here = (F.col("length") == F.col("_length")) & F.col("rank").between(F.col("_from"), F.col("_to"))
    sequence = (F.col("_first") + F.col("rank") - F.col("_from")).alias("sequence_id")
    placed = materialize(ranked.join(F.broadcast(places), here).select("key", "_start", "size", sequence, "offset"), "places")

    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids]
    # A full window is a sequence of its own.
    full = cut.filter(F.col("length") == capacity).withColumns({"sequence_id": -1 - F.col("key"), "offset": F.lit(0).cast("long")})
    joined = (tails if with_ids else tails.drop("ids")).join(placed, "key")
    whole = joined.filter(F.col("size") == F.col("length"))
    # Only what the topping up has cut needs its ids again; stored, it is broadcast if it is small.
    parts = materialize(joined.filter(F.col("size") < F.col("length")).drop("ids"), "parts").join(tails.select("key", "ids"), "key")
    parts = parts.withColumn("ids", F.expr("substring(ids, cast(4 * _start + 1 AS INT), cast(4 * size AS INT))"))
    parts = parts.withColumns({"start": F.col("start") + F.col("_start"), "length": F.col("size"), "ids_crc32": F.crc32("ids")})
    out = full.select(*columns).unionAll(whole.select(*columns)).unionAll(parts.select(*columns))
    return out.withColumn("doc_id", unkeyed())


def sequences(packed: DataFrame) -> DataFrame:
    """Pieces with ids -> ``sequence_id, ids``: each window's ids in order, binary."""
    inside = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(inside, F.lit(b""), lambda all_ids, piece: F.concat(all_ids, piece["ids"]))
    return packed.groupBy("sequence_id").agg(joined.alias("ids"))

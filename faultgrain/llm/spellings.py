"""Spelling variants: words one edit apart, found by dense prefix-suffix tiling.

Two words are one inserted, deleted or replaced code point apart just when their common prefix and
common suffix together reach the longer length minus one. So of the code points that are not yet known
to be common, half are shared at one end or the other: words go into tiles by the longer length ``L``
of the pairs sought and by such a half, taken from the front or the back. A tile holds the words of
``L`` and of ``L - 1`` code points as padded code-point matrices, whose blocks are compared pair by
pair. A tile with too many words is dealt again by half of what is left open, so no word meets all
words and no tile grows with the data: with one code point left open there are fewer than an alphabet.
A pair that shares both halves is judged at the front only, so it is found once.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultgrain.llm.common import flat, owners, slices, words
from faultgrain.session import materialize

LEAST_LENGTH, LEAST_COUNT = 7, 2
RATIO = 10
TILE_ROWS = 384
BLOCK_CELLS = 1 << 20
TASK_ROWS = 100_000

_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_INSIDE = np.array([False, True])

_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, (_CRC >> 1) ^ np.uint32(0xEDB88320), _CRC >> 1)

_TILE = ("longer", "front", "back", "below", "tile")


def _checksums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray, most: int = 64) -> np.ndarray:
    """The crc32 of each span, continued from its number in ``before``."""
    size, crc = ends - starts, before.astype(np.uint32) ^ np.uint32(0xFFFFFFFF)
    left = np.flatnonzero((size > 0) & (size <= most))
    for step in range(most):
        if not len(left):
            break
        crc[left] = _CRC[(crc[left] ^ data[starts[left] + step]) & 0xFF] ^ (crc[left] >> 8)
        left = left[size[left] > step + 1]
    crc ^= np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(size > most).tolist():
        crc[i] = zlib.crc32(data[starts[i] : ends[i]], int(before[i]))
    return crc


def _strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The spans of ``data`` as strings."""
    size = ends - starts
    at = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    own = data[np.arange(at[-1]) + np.repeat(starts - at[:-1], size)]
    return pa.Array.from_buffers(pa.large_utf8(), len(size), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(own.tobytes())])


def _without_letter(word: str, place: int) -> str:
    return word[:place] + word[place + 1 :]


def _words_of(batch: pa.RecordBatch, least: int, delete_every: int | None) -> pa.Array:
    data, at = flat(batch["text"])
    if not len(data):
        return pa.array([], pa.string())
    latin = data == 0xC3  # the first byte of U+00C0 to U+00FF
    letter = _ASCII_LETTER[data] | latin
    letter[1:] |= latin[:-1]
    starts, ends, first = words(letter.view(np.uint8), at, _INSIDE)
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    length = points[ends] - points[starts]
    long = length >= least
    starts, ends, length, text = starts[long], ends[long], length[long], owners(first)[long]
    data = _LOWER[data]
    if not delete_every:
        return _strings(data, starts, ends)
    prefix = np.array([zlib.crc32(f"{doc}:".encode()) for doc in batch["doc_id"].to_pylist()], np.uint32)
    crc = _checksums(data, starts, ends, prefix[text])
    hit = crc % delete_every == 0
    whole = _strings(data, starts[~hit], ends[~hit]).cast(pa.string())
    places = (crc[hit] % length[hit]).tolist()
    shorter = map(_without_letter, _strings(data, starts[hit], ends[hit]).to_pylist(), places)
    return pa.concat_arrays([whole, pa.array([w for w in shorter if len(w) >= least], pa.string())])


def word_counts(
    docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, delete_every: int | None = None
) -> DataFrame:
    """``word, n`` for the runs of ``[A-Za-z\\u00C0-\\u00FF]`` in all texts, A-Z lower-cased.

    Kept are words of at least ``least_length`` code points and ``least_count`` occurrences. With
    ``delete_every`` misspellings are planted first: where that divides the crc32 ``h`` of
    ``<doc_id>:<word>``, the word loses the code point ``h`` modulo its length. Null and empty texts have
    no words; a missing doc_id reads as the empty text; rows of one doc_id all count.
    """

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = pc.value_counts(_words_of(batch, least_length, delete_every).cast(pa.string()))
            yield pa.RecordBatch.from_arrays([found.field(0), found.field(1).cast(pa.int64())], ["word", "n"])

    texts = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), "text")
    found = texts.mapInArrow(counts, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return found.filter(F.col("n") >= least_count)


def _dealt(rows: DataFrame) -> DataFrame:
    """Each row once by the next half from its front and once by that from its back."""
    half = F.floor((F.col("longer") - F.col("front") - F.col("back")) / 2).cast("int")
    ahead = F.struct((F.col("front") + half).alias("front"), "back", "below")
    # What shares the front half too is judged there.
    behind = F.struct("front", (F.col("back") + half).alias("back"), F.least("below", F.col("front") + half).alias("below"))
    both = rows.select("word", "n", "longer", F.explode(F.array(ahead, behind)).alias("end"))
    rows = both.select("word", "n", "longer", "end.*")
    return rows.withColumn("tile", F.xxhash64(F.expr("left(word, front)"), F.expr("right(word, back)")))


def _first_tiles(counted: DataFrame) -> DataFrame:
    longer = F.explode(F.array(F.length("word"), F.length("word") + 1))
    rows = counted.select("word", "n", longer.alias("longer"), F.lit(0).alias("front"), F.lit(0).alias("back"))
    return _dealt(rows.withColumn("below", F.col("longer") + 1))


class _Stack:
    """Tiles of one longer length, padded to the same number of rows and of code points.

    ``first`` has the tiles' first words and the end; ``kind`` their longer, front, back and below.
    """

    def __init__(self, own: list[str], first: np.ndarray, kind: np.ndarray):
        self.own, self.first = own, first
        self.longer = int(kind[0, 0])
        self.front, self.back, self.below = (kind[:, k, None, None] for k in (1, 2, 3))
        size = np.diff(first)
        self.tiles, self.width = len(size), int(size.max())
        self.tile = np.repeat(np.arange(len(size)), size)
        self.place = np.arange(len(own)) - np.repeat(first[:-1], size)
        self.length = np.fromiter(map(len, own), np.int64, len(own))
        self.block = max(1, min(self.width, math.isqrt(BLOCK_CELLS // self.tiles), BLOCK_CELLS // (self.tiles * self.longer)))

    def _matrices(self, start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A block of every tile: code points from the left, from the right, and lengths, padded with zeros."""
        here = np.flatnonzero((self.place >= start) & (self.place < start + self.block))
        tile, place, size = self.tile[here], self.place[here] - start, self.length[here]
        codes = np.frombuffer("".join(self.own[i] for i in here.tolist()).encode("utf-32-le"), np.uint32)
        word = np.repeat(np.arange(len(here)), size)
        at = np.arange(len(codes)) - np.repeat(np.cumsum(size) - size, size)
        left, right = (np.zeros((self.tiles, self.block, self.longer), np.uint32) for _ in "lr")
        left[tile[word], place[word], at] = codes
        right[tile[word], place[word], size[word] - 1 - at] = codes
        length = np.zeros((self.tiles, self.block), np.int64)
        length[tile, place] = size
        return left, right, length

    def compare(self) -> tuple[np.ndarray, np.ndarray]:
        """Each word's number of near words in its tile, and the first of them (any number where there is none)."""
        count = np.zeros((self.tiles, self.width), np.int64)
        best = np.full((self.tiles, self.width), -1, np.int64)
        for a in range(0, self.width, self.block):
            left, right, length = self._matrices(a)
            rows = slice(a, min(a + self.block, self.width))
            for b in range(0, self.width, self.block):
                other_left, other_right, other_length = (left, right, length) if a == b else self._matrices(b)
                ahead, behind = _common(left, other_left), _common(right, other_right)
                one, other = length[:, :, None], other_length[:, None, :]
                near = (ahead + behind >= self.longer - 1) & (ahead >= self.front) & (behind >= self.back) & (ahead < self.below)
                # One of a pair has the longer length, none is padding, and no word is compared with itself.
                near &= (one + other >= 2 * self.longer - 1) & (one > 0) & (other > 0) & ((ahead < self.longer) | (one != other))
                near = near[:, : rows.stop - a]
                count[:, rows] += near.sum(axis=2)
                found = np.where(near.any(axis=2), near.argmax(axis=2) + b, -1)
                best[:, rows] = np.where(best[:, rows] >= 0, best[:, rows], found)
        return count[self.tile, self.place], best[self.tile, self.place] + self.first[self.tile]


def _common(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For tiles of rows ``x`` and ``y`` (tile, row, place): how many places from the first on agree, for each pair."""
    alive = np.ones((x.shape[0], x.shape[1], y.shape[1]), bool)
    total = np.zeros(alive.shape, np.int32)
    for place in range(x.shape[2]):
        alive &= x[:, :, None, place] == y[:, None, :, place]
        if not alive.any():
            break
        total += alive
    return total


def _stacks(sizes: list[int], longer: list[int]) -> Iterator[tuple[int, int]]:
    """Consecutive tiles (first, end) of one length and like size that together fill a block of matrices at most."""
    first = 0
    while first < len(sizes):
        end, wide = first + 1, sizes[first]
        while end < len(sizes) and longer[end] == longer[first] and max(wide, sizes[end]) <= 2 * min(sizes[first], sizes[end]):
            wide = max(wide, sizes[end])
            if (end + 1 - first) * wide * max(wide, longer[first]) > BLOCK_CELLS:
                break
            end += 1
        yield first, end
        first = end


def _judged(rows: pa.Table) -> pa.RecordBatch:
    """Whole tiles, each with its most frequent word first (ties in code-point order), so the first near word is the best."""
    own, n = rows["word"].to_pylist(), rows["n"].to_numpy()
    kinds = np.stack([rows[c].to_numpy().astype(np.int64) for c in _TILE], axis=1)
    starts = np.concatenate([[0], np.flatnonzero((kinds[1:] != kinds[:-1]).any(axis=1)) + 1, [len(own)]])
    found: list[tuple[str, int, int, str]] = []
    for tile, end in _stacks(np.diff(starts).tolist(), kinds[starts[:-1], 0].tolist()):
        lo, hi = int(starts[tile]), int(starts[end])
        count, best = _Stack(own[lo:hi], starts[tile : end + 1] - lo, kinds[starts[tile:end]]).compare()
        for i in np.flatnonzero(count).tolist():
            found.append((own[lo + i], int(count[i]), int(n[lo + best[i]]), own[lo + best[i]]))
    columns = list(zip(*found)) or [()] * 4
    types = (pa.string(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["word", "n_near", "near_n", "near_word"])


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of their tiles -> ``word, n_near, near_n, near_word`` for each tile and word with a near word."""
    held: list[pa.RecordBatch] = []  # the last tile, which may go on in the next batch
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([*held, batch])
        same = np.ones(rows.num_rows, bool)
        for name in _TILE:
            column = rows[name].to_numpy()
            same &= column == column[-1]
        cut = 0 if same.all() else int(np.flatnonzero(~same)[-1]) + 1
        if cut:
            yield _judged(rows.slice(0, cut))
        held = rows.slice(cut).to_batches()
    if held:
        yield _judged(pa.Table.from_batches(held))


def near_words(counted: DataFrame, tile_rows: int = TILE_ROWS) -> DataFrame:
    """For distinct ``word, n``: ``word, n_near, near_word, near_n`` of each word that has near words.

    ``near_word`` has the largest n of them, ties the smallest word in code-point order. A tile of more than
    ``tile_rows`` words is dealt again. ``counted`` must read alike each time.
    """
    rows, tiles = _first_tiles(counted), []
    while True:
        sizes = rows.groupBy(*_TILE).agg(F.count("*").alias("size")).filter("size > 1")
        rows = materialize(rows.join(sizes, list(_TILE)), "tiles")
        # With one code point left open there is nothing to deal by: such a tile is compared whatever its alphabet.
        crowding = (F.col("size") > tile_rows) & (F.col("longer") - F.col("front") - F.col("back") > 1)
        tiles.append(rows.filter(~crowding))
        crowded = rows.filter(crowding)
        if crowded.isEmpty():
            break
        rows = _dealt(crowded.drop("size", "tile"))
    found = None
    for level in tiles:
        parts = max(12, level.count() // TASK_ROWS)
        order = ["longer", "size", "front", "back", "below", "tile", F.desc("n"), "word"]
        sorted_rows = level.repartition(parts, *_TILE).sortWithinPartitions(*order).select("word", "n", *_TILE)
        near = sorted_rows.mapInArrow(_near, "word string, n_near long, near_n long, near_word string")
        found = near if found is None else found.unionAll(near)
    first = F.min(F.struct((-F.col("near_n")).alias("less"), "near_word"))
    one = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), first.alias("best"))
    return one.select("word", "n_near", F.col("best.near_word").alias("near_word"), (-F.col("best.less")).alias("near_n"))


def _roots(forms: DataFrame, steps: int) -> DataFrame:
    """``word, form`` -> ``word, root``: the last word on the way from form to form, of at most ``steps`` steps."""
    links = materialize(forms.select("word", F.col("form").alias("root")), "forms")
    for _ in range(max(0, math.ceil(math.log2(max(1, steps))))):
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = materialize(links.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
    return links


def variants(counted: DataFrame, ratio: int = RATIO, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Distinct ``word, n`` -> ``word, form, root, n, n_near, form_n``, every word once.

    ``form`` is the near word of largest n (ties: smallest in code-point order) if that n is at least
    ``ratio`` times the word's; else null, as is ``form_n``. ``root`` is the last word reached by
    following forms, the word itself without one. Each step multiplies n, so the way is short. An empty
    table gives no rows; columns beside word and n are left behind.
    """
    if ratio < 2:
        raise ValueError("a form must be more frequent than its variants: ratio must be 2 or more")
    counted = materialize(counted.select("word", "n"), "words")
    most = counted.agg(F.max("n")).first()[0] or 1
    near = counted.join(near_words(counted, tile_rows), "word", "left")

    def given(column: str) -> Column:
        return F.when(F.col("near_n") >= ratio * F.col("n"), F.col(column))

    judged = near.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), given("near_word").alias("form"), given("near_n").alias("form_n")
    )
    judged = materialize(judged, "judged")
    roots = _roots(judged.filter("form IS NOT NULL"), int(math.log(most, ratio)) + 1)
    joined = judged.join(roots, "word", "left")
    return joined.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, delete_every: int | None = None, ratio: int = RATIO) -> DataFrame:
    """The words of all texts of ``docs`` with their forms; see ``word_counts`` and ``variants``."""
    return variants(word_counts(docs, delete_every=delete_every), ratio)

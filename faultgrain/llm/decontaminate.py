"""Benchmark decontamination by pigeonhole edit matching.

Texts and test items are compared as words in lower case joined by one blank, and a match begins and ends
where words do. A test unit is an item (a long one: each of its stretches of some STRETCH characters),
and each UNIT_WORDS words of it that follow one another. A unit of m characters may be
misquoted by e = m // EDIT_EVERY edits; cut into e + 1 pieces, at least one of which is
then quoted exactly. A unit of UNIT_WORDS words may instead have one word replaced, lost or added, of any length;
if that could touch all pieces its two halves are pieces too. One pass over many texts at a time finds all
pieces by hashes of their first bytes, and around each hit Myers' bit-parallel distance, in characters and then in words, decides
whether the whole unit is there. So any UNIT_WORDS consecutive words of an item with up to e edits or one other word are found.
An item of fewer than SHORT_WORDS words, which ordinary prose holds by chance, is only found in a text that is nothing else.

The benchmark is taken in blocks of bounded size, each sent to all machines; each block scans
all documents, so no document is compared with an item it shares no piece with.
"""

from __future__ import annotations

import uuid
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultgrain.llm.common import kept, keyed, slices, unkeyed

EDIT_EVERY = 18
UNIT_WORDS = 13
SHORT_WORDS = 4
STRETCH = 1024
BLOCK_BYTES = 512 << 10
_FIRST = (12, 8, 4, 1)
_BLOCK_PLACES = 1 << 16
_ODD, _OTHER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_BLANKS = bytes.maketrans(
    bytes(range(128)), bytes(c + 32 if 0x41 <= c < 0x5B else c if chr(c).isalnum() else 0x20 for c in range(128))
)


def plain(text: str | None) -> str:
    """Words of ASCII letters, digits and non-ASCII characters in lower case, joined by one blank."""
    return b" ".join((text or "").encode().translate(_BLANKS).split()).decode().lower()


class Unit(NamedTuple):
    item_id: int
    text: str
    edits: int
    words: int  # that may be other ones, lost or added
    alone: bool = False  # only found in a text that is nothing else


def _stretches(own: list[str]) -> list[str]:
    """Words in stretches of at least STRETCH characters, one for a text below two of them.

    They leave no word out, so if the whole is quoted with an edit for every EDIT_EVERY characters, one of them is too.
    """
    out, size = [[]], 0
    for word in own:
        if size >= STRETCH:
            out.append([])
            size = 0
        out[-1].append(word)
        size += len(word) + 1
    if len(out) > 1 and size < STRETCH:
        rest = out.pop()
        out[-1] += rest
    return [" ".join(words) for words in out]


def units(item_id: int, text: str | None) -> list[Unit]:
    """An item by its stretches, and each UNIT_WORDS of its words that follow one another; none if it is empty."""
    own = plain(text).split(" ")
    if own == [""]:
        return []
    if len(own) < SHORT_WORDS:
        return [Unit(item_id, " ".join(own), 0, 0, True)]
    windows = dict.fromkeys(" ".join(own[k : k + UNIT_WORDS]) for k in range(len(own) - UNIT_WORDS + 1))
    stretches = dict.fromkeys(_stretches(own))
    found = [Unit(item_id, line, len(line) // EDIT_EVERY, int(len(own) == UNIT_WORDS)) for line in stretches]
    return found + [Unit(item_id, line, len(line) // EDIT_EVERY, 1) for line in windows if line not in stretches]


def pieces(unit: Unit) -> Iterator[tuple[int, str]]:
    """The unit's e + 1 pieces with their place in it, and its halves if a word could touch all of those."""
    n, size = unit.edits + 1, len(unit.text)
    for k in range(n):
        start = size * k // n
        yield start, unit.text[start : size * (k + 1) // n]
    if unit.words:
        own = unit.text.split(" ")
        # With its blanks a word lies in so many pieces at most.
        if -(-(max(map(len, own)) + 1) // (size // n)) + 1 >= n:
            half = len(" ".join(own[: len(own) // 2]))
            yield 0, unit.text[:half]
            yield half + 1, unit.text[half + 1 :]


def closest(pattern: Sequence[str], text: Sequence[str], most: int) -> tuple[int, int] | None:
    """The least edit distance of ``pattern`` to any part of ``text`` and that part's first end; None above ``most``.

    Both are strings, or lists of words.

    Myers' algorithm: one machine word of any width holds a column's vertical steps.
    """
    m = len(pattern)
    places: dict[str, int] = {}
    for i, c in enumerate(pattern):
        places[c] = places.get(c, 0) | 1 << i
    full, last = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best = full, 0, m, None
    for end, c in enumerate(text, 1):
        match = places.get(c, 0)
        across = match | minus
        diagonal = (((match & plus) + plus) ^ plus) | match
        up = minus | (full & ~(diagonal | plus))
        down = plus & diagonal
        score += bool(up & last) - bool(down & last)
        up, down = (up << 1) & full, (down << 1) & full
        plus, minus = down | (full & ~(across | up)), up & across
        if score <= most and (best is None or score < best[0]):
            best = score, end
    return best


def distances(pattern: str, text: str, most: int) -> list[tuple[int, int]]:
    """(distance, end) for the parts of ``text`` that begin at its start and end beside a blank or at its end, at most ``most`` away.

    The same columns as in ``closest``, but each further character of ``text`` costs an edit.
    """
    m = len(pattern)
    places: dict[str, int] = {}
    for i, c in enumerate(pattern):
        places[c] = places.get(c, 0) | 1 << i
    full, last = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, out = full, 0, m, []
    for end, c in enumerate(text[: m + most], 1):
        match = places.get(c, 0)
        across = match | minus
        diagonal = (((match & plus) + plus) ^ plus) | match
        up = minus | (full & ~(diagonal | plus))
        down = plus & diagonal
        score += bool(up & last) - bool(down & last)
        up, down = ((up << 1) | 1) & full, (down << 1) & full
        plus, minus = down | (full & ~(across | up)), up & across
        if score <= most and (end == len(text) or " " in text[end - 1 : end + 1]):
            out.append((score, end))
    return out


def _begin(pattern: Sequence[str], text: Sequence[str], end: int, distance: int) -> int:
    """Where the part of ``text`` that ends at ``end`` with this distance begins: the same search backwards."""
    back = text[max(0, end - len(pattern) - distance) : end][::-1]
    found = closest(pattern[::-1], back, distance)
    return end - (found[1] if found else len(pattern))


def quoted(pattern: str, line: str, at: int, most: int) -> tuple[int, int, int] | None:
    """(distance, first, last) of the part of ``line`` closest to ``pattern`` that begins within ``most`` places of ``at``.

    It begins and ends beside blanks or the line's ends, so never inside a word. The first of the closest counts;
    None above ``most`` edits.
    """
    end = at + len(pattern)
    if at >= 0 and line.startswith(pattern, at) and (not at or line[at - 1] == " ") and (end == len(line) or line[end] == " "):
        return 0, at, end
    low, high = max(0, at - most), min(len(line), end + most)
    if closest(pattern, line[low:high], most) is None:  # anywhere, also inside words
        return None
    best = None
    for start in range(low, min(at + most + 1, high)):
        if not start or " " in line[start - 1 : start + 1]:
            for distance, size in distances(pattern, line[start : high + 1], most):
                if start + size <= high and (best is None or distance < best[0]):
                    best = distance, start, start + size
    return best


class _Words:
    """A line's words and where they begin."""

    def __init__(self, line: str):
        self.words = line.split(" ")
        self.starts = list(accumulate(map((1).__add__, map(len, self.words[:-1])), initial=0))

    def closest(self, unit: Unit, start: int, at: int) -> tuple[int, int] | None:
        """First and last place of the unit with at most ``unit.words`` words changed, if its place ``start`` is at ``at``."""
        own = unit.text.split(" ")
        # A piece may begin with a blank, or inside a word.
        before = bisect_right(self.starts, at) - 1 - unit.text.count(" ", 0, start)
        low = max(0, before - unit.words - 1)
        part = self.words[low : before + len(own) + unit.words + 1]
        hit = closest(own, part, unit.words)
        if not hit:
            return None
        first, last = low + _begin(own, part, hit[1], hit[0]), low + hit[1] - 1
        return self.starts[first], self.starts[last] + len(self.words[last])


class Pieces:
    """Finds all pieces of a block's units in lines.

    A table by a hash of a piece's first bytes passes few places of a line, the hashes themselves hardly any
    other; there the bytes are looked up. ``alone`` holds the units that are only found in a text that is nothing else.
    """

    def __init__(self, own: list[Unit]):
        self.own = own
        self.alone: dict[str, list[int]] = {}
        self.where: dict[bytes, list[tuple[int, int]]] = {}
        for number, unit in enumerate(own):
            if unit.alone:
                self.alone.setdefault(unit.text, []).append(number)
                continue
            for start, piece in pieces(unit):
                self.where.setdefault(piece.encode(), []).append((number, start))
        # By the number of first bytes: the table, the distinct hashes and the pieces' sizes for each.
        self.tables: list[tuple[int, np.uint64, np.ndarray, np.ndarray, list[list[int]]]] = []
        for most, first in zip((1 << 62, *_FIRST), _FIRST):
            some = [piece for piece in self.where if first <= len(piece) < most]
            if not some:
                continue
            bits = max(16, (len(some) * 32).bit_length())
            shift = np.uint64(64 - bits)
            heads = [piece[:first].ljust(first + 8, b"\0") for piece in some]
            hashed = self._hashes(np.frombuffer(b"".join(heads), np.uint8), first)[:: first + 8]
            known, number = np.unique(hashed, return_inverse=True)
            sizes: list[set[int]] = [set() for _ in known]
            for n, piece in zip(number.tolist(), some):
                sizes[n].add(len(piece))
            table = np.zeros(1 << bits, bool)
            table[known >> shift] = True
            self.tables.append((first, shift, table, known, [sorted(s) for s in sizes]))

    @staticmethod
    def _hashes(data: np.ndarray, first: int) -> np.ndarray:
        """A hash of the ``first`` bytes from each place on that has eight more after them."""
        eight = np.ndarray(shape=(max(len(data) - 7, 0),), dtype="<u8", buffer=data, strides=(1,)).copy()
        if first < 8:
            eight &= np.uint64((1 << 8 * first) - 1)
            return eight * _ODD
        return eight[: len(eight) - first + 8] * _ODD + eight[first - 8 :] * _OTHER

    def hits(self, lines: list[bytes]) -> list[list[tuple[int, int, bytes]]]:
        """For each line (end, -size, piece) of all pieces in it, in the order of their ends, long ones first."""
        out: list[list[tuple[int, int, bytes]]] = [[] for _ in lines]
        whole = b"\n".join(lines)  # no piece holds one
        at = np.cumsum([0, *(len(line) + 1 for line in lines)])
        padded = np.frombuffer(whole + bytes(16), np.uint8)
        for first, shift, table, known, sizes in self.tables:
            for begin in range(0, len(whole), _BLOCK_PLACES):
                hashed = self._hashes(padded[begin : begin + _BLOCK_PLACES + first + 7], first)[:_BLOCK_PLACES]
                place = np.flatnonzero(table[hashed >> shift])
                hashed = hashed[place]
                number = np.minimum(np.searchsorted(known, hashed), len(known) - 1)
                sure = known[number] == hashed
                place, number = place[sure] + begin, number[sure]
                text = np.searchsorted(at, place, "right") - 1
                for k, start, line, n in zip(place.tolist(), (place - at[text]).tolist(), text.tolist(), number.tolist()):
                    for size in sizes[n]:
                        if (piece := whole[k : k + size]) in self.where:
                            out[line].append((start + size, -size, piece))
        for found in out:
            found.sort()
        return out


def _pieces_of(name: str, block: Broadcast) -> Pieces:
    """A block's pieces, for all tasks of a worker until another operator's or block's come."""
    return kept(name, lambda: Pieces(block.value))


def _search(block: Broadcast):
    name = uuid.uuid4().hex

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _pieces_of(name, block)
        own = known.own
        for batch in slices(batches, keeps=name):
            rows = []
            lines = [plain(text) for text in batch["text"].to_pylist()]
            coded_lines = [line.encode() for line in lines]
            for doc, line, coded, hits in zip(batch["doc_id"].to_pylist(), lines, coded_lines, known.hits(coded_lines)):
                ascii_ = len(coded) == len(line)
                found = {number: (0, 0, len(line)) for number in known.alone.get(line, ())}
                tried, split = set(), None
                for end, size, piece in hits:
                    at = end + size  # the size is negative
                    if not ascii_:  # bytes to characters
                        at = len(coded[:at].decode(errors="ignore"))
                    for number, start in known.where[piece]:
                        unit = own[number]
                        if number in found and (found[number][0] == 0 or (number, at - start) in tried):
                            continue
                        place = None
                        if (number, at - start) not in tried:
                            tried.add((number, at - start))
                            place = quoted(unit.text, line, at - start, unit.edits)
                        if not place and unit.words:
                            split = split or _Words(line)
                            reach = split.closest(unit, start, at)
                            if not reach:
                                continue
                            place = closest(unit.text, line[reach[0] : reach[1]], len(unit.text))[0], *reach
                        if place and (number not in found or place[0] < found[number][0]):
                            found[number] = place
                rows += [(doc, own[k].item_id, d, s, e, len(own[k].text)) for k, (d, s, e) in found.items()]
            names = ["doc_id", "item_id", "distance", "first", "last", "unit_chars"]
            columns = zip(*rows) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    return search


def _blocks(benchmark: DataFrame) -> Iterator[list[Unit]]:
    """The benchmark's units, item by item, in blocks of about BLOCK_BYTES of text."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("item_id IS NOT NULL")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = -(-size // BLOCK_BYTES)
    share = F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, n)))
    for k in range(n):
        yield [u for row in items.filter(share == k).distinct().collect() for u in units(*row)]


def contaminations(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Where documents hold test units: ``doc_id, item_id, distance, first, last, unit_chars``, a row a unit found.

    ``first`` and ``last`` (end exclusive) are places in the document's plain text of the closest
    match. A unit shorter than EDIT_EVERY characters is only found as it is, an item of fewer than SHORT_WORDS
    words only where the whole text is that. Null and empty texts hold
    nothing, and null and empty items are in nothing; items without item_id are left out, repeated
    ones count once. Rows of one doc_id give their own rows. Empty tables give no rows.
    """
    spark = docs.sparkSession
    layout = "doc_id long, item_id long, distance long, first long, last long, unit_chars long"
    rows = keyed(docs, "text")
    found = [rows.mapInArrow(_search(spark.sparkContext.broadcast(block)), layout) for block in _blocks(benchmark) if block]
    if not found:
        return spark.createDataFrame([], layout)
    return reduce(DataFrame.union, found).withColumn("doc_id", unkeyed())


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row a document and item: ``doc_id, item_id, distance, first, last, n_units``, for its closest unit.

    The longest of the closest units counts, then the first in the text.
    """
    place = F.struct("distance", (-F.col("unit_chars")).alias("size"), "first", "last")
    best = contaminations(docs, benchmark).groupBy("doc_id", "item_id").agg(F.min(place).alias("best"), F.count("*").alias("n_units"))
    return best.select("doc_id", "item_id", "best.distance", "best.first", "best.last", "n_units")

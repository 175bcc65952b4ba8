"""Best-fit packing of documents into sequences, large items first.

Lengths are whole numbers up to the capacity, so a histogram of them, of at most ``capacity``
rows whatever the data, holds all the packing needs. Pieces above a third of the capacity are
matched greedily, at most two a sequence: the largest with the largest that fits beside it.
Smaller ones, from large to small, go where the least room is left. The plan packs runs of
equal sequences at once; a piece finds its place in it by its rank among the pieces of its
length.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from faultgrain.llm.common import SMALL_SLICE_BYTES, flat, kept, keyed, slices, unkeyed
from faultgrain.llm.merges import PairMerges
from faultgrain.session import materialize

CAPACITY = 2048
RANK_ROWS, RANK_SHARES = 5_000, 4096
WORD_CACHE = 300_000

_LETTER, _PLAIN = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_PLAIN[0x21:0x7F] = True
_PLAIN[ord("'")] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
# Words that the merges must give the tokenizer's ids for before they are used.
_PROBES = ("a", "the", "naïve", "ça", "mississippi", "straße", "ÿé", "aaaaaaaaaaa", "internationalization")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordIds:
    """The ids of whole texts, tokenized word by word.

    The tokenizer's own rules never join characters across a blank or a line feed, nor an ASCII
    letter with ASCII punctuation other than an apostrophe or with a digit, and fold A-Z. So
    texts are folded and cut there, and the words of many texts are told apart in Arrow. Distinct words of Latin letters
    alone, each a single piece, go through the tokenizer's merges together; any other is encoded once while it
    stays in a cache of bounded size. Texts that might hold a special token, which is found before all that, are only
    cut at blanks and line feeds.
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
        merges = PairMerges(path, self.byte_names)
        self.merges = merges if merges.ready and self._agree(merges) else None
        self._clear()

    def _agree(self, merges: PairMerges) -> bool:
        coded = [word.encode() for word in _PROBES]
        size = np.array([len(c) for c in coded])
        ids, count = merges.ids(np.frombuffer(b"".join(coded), np.uint8), np.cumsum(size) - size, size)
        want = [self._ids(word) for word in _PROBES]
        return ids.tolist() == [i for one in want for i in one] and count.tolist() == [len(one) for one in want]

    def _clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.flat = np.empty(0, np.uint32)
        self.begin = np.empty(0, np.int64)
        self.size = np.empty(0, np.int64)

    def _learn(self, words: list[bytes]) -> np.ndarray:
        """The numbers of distinct ``words``, each with the blank after it."""
        new = [w for w in words if w not in self.number]
        if len(self.number) + len(new) > WORD_CACHE:
            self._clear()
            new = words
        self.number.update(zip(new, range(len(self.size), len(self.size) + len(new))))
        ids, sizes = [self.flat], [self.size]
        for start in range(0, len(new), 2000):
            fresh = [self._ids(word[:-1].decode()) for word in new[start : start + 2000]]
            ids.append(np.array([i for one in fresh for i in one], np.uint32))
            sizes.append(np.array([len(one) for one in fresh], np.int64))
        self.flat, self.size = np.concatenate(ids), np.concatenate(sizes)
        self.begin = np.cumsum(self.size) - self.size
        return np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))

    def _ids(self, word: str) -> list[int]:
        """A word's ids; one of Latin letters alone is a single piece and goes to the model at once."""
        small = word.lower()
        if small.isalpha() and max(small) < "\u0250":
            coded = small if small.isascii() else "".join(map(self.byte_names.__getitem__, small.encode()))
            return [token.id for token in self.model.tokenize(coded)]
        return self.tokenizer.encode(word, add_special_tokens=False).ids

    @staticmethod
    def _split(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
        """The words of all texts, told apart in Arrow, each with the blank after it; each text's first one (n + 1 numbers)."""
        data, at = flat(texts)
        special = np.flatnonzero((data[:-1] == ord("<")) & (data[1:] == ord("|")))
        letter, plain = _LETTER[data], _PLAIN[data]
        cut = (letter[1:] != letter[:-1]) & plain[1:] & plain[:-1]
        folded = _LOWER[data]
        for text in np.unique(np.searchsorted(at, special, "right") - 1).tolist():
            here = slice(at[text], at[text + 1])
            cut[here], folded[here] = False, data[here]
        # A blank between any two words, and one after each text.
        places = np.flatnonzero(cut) + 1
        folded = np.insert(folded, np.concatenate([places, at[1:]]), 0x20)
        at = at + np.searchsorted(places, at, "right") + np.arange(len(at))
        folded[folded == 0x0A] = 0x20
        ends = np.flatnonzero(folded == 0x20) + 1
        cuts = np.concatenate([[0], ends]).astype(np.int64)
        words = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(cuts), pa.py_buffer(folded)])
        return words.dictionary_encode(), np.searchsorted(cuts, at)

    @staticmethod
    def _latin(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words in lower case, and which are letters of ASCII and U+00C0 to U+00FF alone, but for the last byte."""
        after = np.flatnonzero(data[:-1] == 0xC3) + 1
        letter, small = _LETTER[data], _LOWER[data]
        sign = (data[after] == 0x97) | (data[after] == 0xB7)
        letter[after - 1] = letter[after] = ~sign
        capital = after[(data[after] <= 0x9E) & ~sign]
        small[capital] += 32
        others = np.concatenate([[0], np.cumsum(~letter)])
        return small, others[at[1:] - 1] == others[at[:-1]]

    def _encoded(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and where those of each distinct word begin and how many it has."""
        data, at = flat(words)
        size = np.diff(at) - 1
        small, once = self._latin(data, at)
        once &= (size > 0) & (size <= PairMerges.longest) & (self.merges is not None)
        ids, count = self.merges.ids(small, at[:-1][once], size[once]) if once.any() else (np.empty(0, np.uint32), np.empty(0, np.int64))
        number = self._learn(words.filter(pa.array(~once)).to_pylist())
        begins, sizes = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        begins[once], sizes[once] = np.cumsum(count) - count, count
        begins[~once], sizes[~once] = self.begin[number] + len(ids), self.size[number]
        return np.concatenate([ids, self.flat]), begins, sizes

    def encode_all(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Each text's ids and the end id; the texts' words are learnt together."""
        words, first = self._split(texts)
        ids, begins, sizes = self._encoded(words.dictionary)
        number = words.indices.to_numpy()
        for start, end in zip(first[:-1].tolist(), first[1:].tolist()):
            at = number[start:end]
            size = sizes[at]
            total = int(size.sum())
            before = np.cumsum(size) - size
            out = np.empty(total + 1, np.uint32)
            out[:total] = ids[np.arange(total) + np.repeat(begins[at] - before, size)]
            out[total] = self.end
            yield out


def word_ids(path: str) -> WordIds:
    """One encoder a Python worker, for all its tasks until another operator's come."""
    return kept(path, lambda: WordIds(path))


def _pieces(path: str, capacity: int, with_ids: bool):
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_ids(path)
        for batch in slices(batches, most=SMALL_SLICE_BYTES, keeps=path):
            rows = []
            for doc, ids in zip(batch["doc_id"].to_pylist(), encoder.encode_all(batch["text"])):
                for piece, start in enumerate(range(0, len(ids), capacity)):
                    own = ids[start : start + capacity]
                    rows.append((doc, piece, start, len(own), zlib.crc32(own.tobytes()), own.tolist() if with_ids else None))
            columns = list(zip(*rows))
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)][: 5 + with_ids], names=names[: 5 + with_ids])

    return pieces


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Documents as pieces of at most ``capacity`` tokens: ``doc_id, piece, start, length, ids_crc32`` and the ids if wanted."""
    layout = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.mapInArrow(_pieces(path, capacity, with_ids), layout)


class _Run:
    """``count`` sequences with the same content: lengths, each with the rank its first piece has."""

    def __init__(self, count: int, room: int):
        self.count, self.room, self.held = count, room, []

    def put(self, length: int, rank: int, copies: int = 1) -> None:
        """``copies`` pieces of a length in every sequence, ranked copy after copy."""
        for _ in range(copies):
            self.held.append((length, rank))
            rank += self.count
        self.room -= length * copies

    def split(self, count: int) -> _Run:
        """The first ``count`` sequences on their own; this run keeps the others."""
        first = _Run(count, self.room)
        first.held = list(self.held)
        self.held = [(length, rank + count) for length, rank in self.held]
        self.count -= count
        return first


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[_Run]:
    """Runs of equal sequences that hold all pieces of ``histogram`` (length -> pieces)."""
    left, used = dict(sorted(histogram.items(), reverse=True)), dict.fromkeys(histogram, 0)
    runs: list[_Run] = []

    def take(run: _Run, length: int, copies: int = 1) -> None:
        run.put(length, used[length], copies)
        used[length] += run.count * copies
        left[length] -= run.count * copies

    large = [n for n in left if 3 * n > capacity]
    for length in large:
        while left[length]:
            mate = next((n for n in large if left[n] and n <= capacity - length and (n != length or left[n] > 1)), None)
            if mate is None:
                runs.append(run := _Run(left[length], capacity))
                take(run, length)
            elif mate == length:
                runs.append(run := _Run(left[length] // 2, capacity))
                take(run, length, 2)
            else:
                runs.append(run := _Run(min(left[length], left[mate]), capacity))
                take(run, length)
                take(run, mate)
    by_room: dict[int, list[_Run]] = {}
    rooms: list[int] = []

    def keep(run: _Run) -> None:
        if run.room not in by_room:
            by_room[run.room] = []
            insort(rooms, run.room)
        by_room[run.room].append(run)

    for run in runs:
        keep(run)
    for length in (n for n in left if 3 * n <= capacity):
        while left[length]:
            k = bisect_left(rooms, length)
            if k == len(rooms):
                copies = capacity // length
                run = _Run(left[length] // copies or 1, capacity)
                take(run, length, min(copies, left[length]))
                runs.append(run)
            else:
                run = by_room[rooms[k]].pop()
                if not by_room[rooms[k]]:
                    del by_room[rooms.pop(k)]
                if run.count > left[length]:
                    first = run.split(left[length])
                    runs.append(first)
                    keep(run)
                    run = first
                take(run, length)
            keep(run)
    return runs


def _places(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, last rank, first sequence, offset) for all pieces, by runs."""
    runs = plan(histogram, capacity)
    firsts = accumulate((r.count for r in runs), initial=0)
    out = []
    for run, first in zip(runs, firsts):
        offset = 0
        for length, rank in run.held:
            out.append((length, rank, rank + run.count - 1, first, offset))
            offset += length
    return out


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces with ``doc_id, piece, length`` (and any other columns) -> the same with ``sequence_id, offset``.

    Offsets are gapless from 0 in each sequence. The plan is made from the number of pieces of
    each length alone. Pieces of one length are ranked in two steps, so that one frequent length
    is spread over many tasks. ``cut`` must read the same rows each time, so give a stored table.
    """
    spark = cut.sparkSession
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # at most ``capacity`` rows
    spread = max(1, min(sum(counts.values()) // RANK_ROWS, RANK_SHARES))
    share = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(spread)).cast("int")
    dealt = cut.withColumn("_share", share)
    before = Window.partitionBy("length").orderBy("_share").rowsBetween(Window.unboundedPreceding, -1)
    shares = dealt.groupBy("length", "_share").agg(F.count("*").alias("_n"))
    shares = shares.select("length", "_share", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("length", "_share").orderBy("doc_id", "piece", F.xxhash64(*cut.columns))) - 1
    ranked = dealt.withColumn("_within", within).join(shares, ["length", "_share"])
    ranked = ranked.withColumn("_rank", F.col("_before") + F.col("_within")).drop("_share", "_within", "_before")
    places = spark.createDataFrame(
        _places(counts, capacity), "_length long, _from long, _to long, _first long, offset long"
    )  # as many rows as the capacity allows runs, whatever the data
    # Runs start at few ranks of a length, so the run is found by an equality on length and a range.
    found = ranked.join(
        F.broadcast(places), (F.col("length") == F.col("_length")) & F.col("_rank").between(F.col("_from"), F.col("_to"))
    )
    found = found.withColumn("sequence_id", F.col("_first") + F.col("_rank") - F.col("_from"))
    return found.select(*cut.columns, "sequence_id", "offset")


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """All documents as pieces with a place: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` (and ids).

    A document's ids end in id 0, so null and empty texts are one piece of length 1. Rows of one doc_id are
    documents of their own. Rows without doc_id keep it null. An empty table gives no rows.
    """
    cut = materialize(pieces(keyed(docs, "text"), path, capacity, with_ids), "pieces")
    return pack(cut, capacity).withColumn("doc_id", unkeyed())


def sequences(packed: DataFrame) -> DataFrame:
    """Pieces with ids and places -> ``sequence_id, ids``, each at most the capacity long."""
    inside = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(inside, lambda p: p["ids"])).alias("ids"))

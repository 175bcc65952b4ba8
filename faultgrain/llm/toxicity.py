"""Toxicity by two class-conditional Kneser-Ney models over words and word beginnings.

A word is reached through its first 4, 6 and 8 bytes, so rare words are judged by their
beginnings. Each class gives the next node an absolutely discounted chance, and what the
discount frees goes to the shared backoff: how many documents of the whole corpus, labelled or
not, have the node. A text's score compares its length-normalised log-likelihoods under both
models, and is calibrated on labelled rows that the models have not seen.

Class counts come from a bounded sample of labelled rows (MODEL_ROWS of each class,
MODEL_BYTES of text in all), so the model fits each machine; the backoff counts cover every
document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultgrain.llm.common import SMALL_SLICE_BYTES, flat, hashes, keyed, owners, slices, unkeyed, words
from faultgrain.session import materialize

MODEL_ROWS, CALIBRATION_ROWS = 4000, 6000
MODEL_BYTES = 24 << 20
DISCOUNT = 2.0
EXPRESSIVE = 2.0
THRESHOLD = 0.7
HELD_OUT_FOLD = 1
CALIBRATE_EVERY = 4
_BEGINNINGS = (4, 6, 8)
_FLUSH = 300_000

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def _lowered(data: np.ndarray) -> np.ndarray:
    """A-Z and the two-byte capitals of Latin-1 in lower case."""
    data = _LOWER[data]
    after = np.flatnonzero(data[:-1] == 0xC3) + 1
    capital = after[(data[after] >= 0x80) & (data[after] <= 0x9E) & (data[after] != 0x97)]
    data[capital] += 32
    return data


def _numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, and each key's number among them."""
    coded = pa.array(keys).dictionary_encode()
    return coded.dictionary.to_numpy(), coded.indices.to_numpy()


def _any_of(number: np.ndarray, n: int, values: np.ndarray) -> np.ndarray:
    """For each of ``n`` numbers a value that goes with it."""
    out = np.zeros(n, values.dtype)
    out[number] = values
    return out


def _levels(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Each word's text number and its number among the distinct words; for those, from the shortest beginning to the word: (word numbers, node hashes)."""
    data, at = flat(batch["text"])
    starts, ends, first = words(data, at, _LETTER)
    data = _lowered(data)
    whole, word = _numbered(hashes(data, starts, ends, seed=99))
    starts, ends = _any_of(word, len(whole), starts), _any_of(word, len(whole), ends)
    levels = []
    for size in _BEGINNINGS:
        longer = np.flatnonzero(ends - starts > size)
        levels.append((longer, hashes(data, starts[longer], starts[longer] + size, seed=size)))
    levels.append((np.arange(len(whole)), whole))
    return owners(first), word, levels


def _parents(n: int, levels: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per level: word numbers, nodes, and the nodes above them (0: the root)."""
    above = np.zeros(n, np.uint64)
    for at, nodes in levels:
        yield at, nodes, above[at]
        above[at] = nodes


def _sums(keys: list[np.ndarray], values: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    order = np.argsort(keys[0], kind="stable")
    keys, values = [k[order] for k in keys], [v[order] for v in values]
    new = np.flatnonzero(np.diff(keys[0].view(np.int64), prepend=~keys[0].view(np.int64)[:1]) != 0)
    return [k[new] for k in keys], [np.add.reduceat(v, new) if len(v) else v for v in values]


def _pairs(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs of numbers, those of ``b`` below ``n``."""
    n = max(n, 1)
    pairs = a * np.int64(n) + b
    pairs = np.sort(pairs.astype(np.int32) if pairs.max(initial=0) < 1 << 31 else pairs)
    pairs = pairs[np.diff(pairs, prepend=-1) != 0]
    return pairs // n, pairs % n


def _held_by(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per level: the distinct nodes, the nodes above them, and the texts that hold them as (text, number of a node), each once."""
    owner, word, levels = _levels(batch)
    distinct = len(levels[-1][1])
    text, word = _pairs(owner, word, distinct)
    for at, nodes, above in _parents(distinct, levels):
        node, number = _numbered(nodes)
        number_of = np.full(distinct, -1)
        number_of[at] = number
        held = number_of[word]
        who, which = _pairs(text[held >= 0], held[held >= 0], len(node))
        yield node, _any_of(number, len(node), above), who, which


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes, the nodes above them, and in how many documents they are; what is held is summed up before it is sent."""
    held, size = [], 0

    def summed() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        nodes, above, n = (np.concatenate(x) for x in zip(*held))
        (nodes, above), (n,) = _sums([nodes, above], [n])
        return nodes, above, n

    def send(nodes: np.ndarray, above: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(nodes.view(np.int64)), pa.array(above.view(np.int64)), pa.array(n)], names=["node", "above", "n"])

    for batch in slices(batches, most=SMALL_SLICE_BYTES // 2):
        for nodes, above, _, which in _held_by(batch):
            held.append((nodes, above, np.bincount(which, minlength=len(nodes))))
            size += len(nodes)
        if size > _FLUSH:
            held = [summed()]
            size = len(held[0][0])
            if size > _FLUSH // 2:
                full, held, size = send(*held[0]), [], 0
                yield full
                del full
    if held:
        yield send(*summed())


def _class_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes, the nodes above them, and in how many documents of each class they are."""
    for batch in slices(batches):
        label = batch["toxic"].to_numpy(zero_copy_only=False).astype(np.int64)
        for nodes, above, who, which in _held_by(batch):
            counts = [np.bincount(which, own[who], len(nodes)).astype(np.int64) for own in (label, 1 - label)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (nodes.view(np.int64), above.view(np.int64), *counts)], names=["node", "above", "toxic", "ordinary"]
            )


class Model:
    """Log ratios of toxic over ordinary, summed from the root to each node, and of leaving it."""

    def __init__(self, node, above, toxic, ordinary, shared, below):
        """Rows of one node each; ``shared`` its share among the corpus' nodes with the same one above."""
        node, above = node.view(np.uint64), above.view(np.uint64)
        order = np.argsort(node)
        self.nodes = node[order]
        bits = max(1, len(self.nodes).bit_length())
        self.shift = np.uint64(64 - bits)
        self.begins = np.searchsorted(self.nodes >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)
        above, share = above[order], (shared / np.maximum(below, 1))[order]
        every, group = np.unique(above, return_inverse=True)
        chances, leave = [], np.zeros(len(every))
        for sign, counts in ((1, toxic[order]), (-1, ordinary[order])):
            total = np.bincount(group, counts, len(every))
            cut = np.bincount(group, np.minimum(counts, DISCOUNT), len(every))
            freed = np.where(total > 0, cut / np.maximum(total, 1), 1.0)
            kept = np.maximum(counts - DISCOUNT, 0) / np.maximum(total[group], 1)
            chances.append(np.log(np.maximum(kept + freed[group] * share, 1e-300)))
            leave += sign * np.log(freed)
        step = chances[0] - chances[1]
        self.ratio = step.copy()
        up, here = above, np.arange(len(step))
        for _ in _BEGINNINGS:  # a word has at most that many beginnings above it
            at = np.searchsorted(self.nodes, up)
            known = (up != 0) & (at < len(self.nodes))
            here, at = here[known], at[known]
            self.ratio[here] += step[at]
            up = above[at]
        self.leave = np.zeros(len(step))
        at = np.searchsorted(self.nodes, every[every != 0])
        self.leave[at] = leave[every != 0]
        self.leave_root = float(leave[every == 0][0]) if (every == 0).any() else 0.0

    def _places(self, nodes: np.ndarray) -> np.ndarray:
        """Where ``nodes`` are among the model's, which lie by their leading bits; -1 if they are not there."""
        place, (at, end) = np.full(len(nodes), -1), (self.begins[(nodes >> self.shift).view(np.int64) + k] for k in (0, 1))
        left = np.flatnonzero(at < end)
        at, end = at[left], end[left]
        while len(left):
            same = self.nodes[at] == nodes[left]
            place[left[same]] = at[same]
            more = ~same & (at + 1 < end)
            left, at, end = left[more], at[more] + 1, end[more]
        return place

    def words(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """Each word's text number and log ratio."""
        owner, word, levels = _levels(batch)
        distinct = len(levels[-1][1])
        ratio, open_ = np.full(distinct, self.leave_root), np.ones(distinct, bool)
        for at, nodes in levels:
            at, nodes = at[open_[at]], nodes[open_[at]]
            place = self._places(nodes)
            known = place >= 0
            ratio[at[known]] = self.ratio[place[known]] + self.leave[place[known]]
            open_[at[~known]] = False
        return owner, ratio[word]


def _features(model: Broadcast):
    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=SMALL_SLICE_BYTES // 2):
            owner, ratio = model.value.words(batch)
            n = np.bincount(owner, minlength=batch.num_rows)
            size = np.maximum(n, 1)
            total = np.bincount(owner, ratio, batch.num_rows)
            strong = np.bincount(owner, np.maximum(ratio - EXPRESSIVE, 0), batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(total / size), pa.array(strong / size), pa.array(n)],
                names=["doc_id", "mean_ratio", "expressive", "n"],
            )

    return features


def _design(mean, expressive, n, least, log1p) -> list:
    """Mean ratio, and how far words go beyond EXPRESSIVE: a word on average, and (damped) in all."""
    return [mean, expressive * 10, log1p(expressive * n), log1p(least(n, 1000)) / 10]


def calibrate(mean: np.ndarray, expressive: np.ndarray, n: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps; its inputs are a bounded sample."""
    weights = np.zeros(5)
    if not len(label):
        return weights
    x = np.stack([np.ones(len(mean)), *_design(mean, expressive, n, np.minimum, np.log1p)], axis=1)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        gradient = x.T @ (p - label) + 1e-1 * weights
        hessian = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-1 * np.eye(5)
        weights = weights - np.linalg.solve(hessian, gradient)
    return weights


def fold() -> F.Column:
    """crc32 of the doc_id's text modulo 3; a missing doc_id is an empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3


def _sample(labels: DataFrame, docs: DataFrame) -> DataFrame:
    """Bounded labelled rows with their text: ``doc_id, text, toxic, calibrates``; rows are picked by a hash of doc_id."""
    once = (
        labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max("toxic").cast("int").alias("toxic"))
        .filter(fold() != HELD_OUT_FOLD)
        .withColumn("calibrates", F.pmod(F.xxhash64("doc_id"), F.lit(CALIBRATE_EVERY)) == 0)
    )

    def pick(rows: DataFrame, most: int) -> DataFrame:
        return rows.orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(most)

    model = once.filter("NOT calibrates")
    picked = pick(model.filter("toxic = 1"), MODEL_ROWS).union(pick(model.filter("toxic = 0"), MODEL_ROWS))
    picked = picked.union(pick(once.filter("calibrates"), CALIBRATION_ROWS))
    sized = keyed(docs, F.octet_length("text").alias("size"), F.xxhash64("doc_id", F.lit(1)).alias("turn")).join(F.broadcast(picked), "doc_id").collect()
    used, left = [], {(c, t): MODEL_BYTES // 2 for c in (True, False) for t in (0, 1)}
    seen = set()
    for row in sorted(sized, key=lambda r: (r["turn"], r["doc_id"], r["size"] or 0)):
        key = row["calibrates"], row["toxic"]
        if row["doc_id"] not in seen and left[key] >= (row["size"] or 0):
            left[key] -= row["size"] or 0
            seen.add(row["doc_id"])
            used.append((row["doc_id"], row["toxic"], row["calibrates"]))
    bounded = docs.sparkSession.createDataFrame(used, "doc_id long, toxic int, calibrates boolean")
    text = keyed(docs, "text").join(F.broadcast(bounded), "doc_id")
    return materialize(text.select("doc_id", "text", "toxic", "calibrates"), "labelled", docs.sparkSession)


def train(docs: DataFrame, labels: DataFrame) -> tuple[Broadcast, np.ndarray]:
    """The broadcast model and the calibration weights."""
    spark = docs.sparkSession
    sample = _sample(labels, docs)
    counted = sample.filter("NOT calibrates").select("text", "toxic")
    counts = counted.mapInArrow(_class_counts, "node long, above long, toxic long, ordinary long")
    counts = counts.groupBy("node", "above").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))
    corpus = docs.select("text").mapInArrow(_spread, "node long, above long, n long")
    corpus = corpus.groupBy("node", "above").agg(F.sum("n").alias("shared"))
    corpus = materialize(corpus, "backoff-counts", spark)
    below = corpus.groupBy("above").agg(F.sum("shared").alias("below"))
    # Bounded: the nodes of at most MODEL_BYTES of sampled text.
    rows = counts.join(corpus, ["node", "above"]).join(below, "above").toArrow()
    columns = [rows[c].to_numpy() for c in ("node", "above", "toxic", "ordinary", "shared", "below")]
    model = spark.sparkContext.broadcast(Model(*columns))
    held = sample.filter("calibrates")
    seen = held.select("doc_id", "text").mapInArrow(_features(model), "doc_id long, mean_ratio double, expressive double, n long")
    seen = seen.join(held.select("doc_id", "toxic"), "doc_id").toArrow()
    weights = calibrate(*(seen[c].to_numpy() for c in ("mean_ratio", "expressive", "n", "toxic")))
    return model, weights


def scored(texts: DataFrame, model: Broadcast, weights: np.ndarray) -> DataFrame:
    """``texts(doc_id, text)``, doc_id being any long -> ``doc_id, score, mean_ratio, n_words, predicted``, a row each."""
    layout = "doc_id long, mean_ratio double, expressive double, n long"
    read = texts.mapInArrow(_features(model), layout)
    one, *others = (F.lit(float(w)) for w in weights)
    n = F.col("n").cast("double")
    design = _design(F.col("mean_ratio"), F.col("expressive"), n, lambda a, b: F.least(a, F.lit(float(b))), F.log1p)
    score = 1 / (1 + F.exp(-sum((w * x for w, x in zip(others, design)), one)))
    read = read.select("doc_id", score.alias("score"), "mean_ratio", F.col("n").alias("n_words"))
    return read.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Each document's ``doc_id, held_out, score, predicted, mean_ratio, n_words``.

    Labels of held-out rows (fold 1) are never read. Null and empty texts and texts without a
    letter have a mean ratio of 0 and get the score of that. Rows of one doc_id stay apart; rows without
    doc_id keep it null. If a document has several labels the toxic one counts; labels that are
    neither 0 nor 1 are left out. Without labels every score is 0.5. An empty table gives no rows.
    """
    judged = scored(keyed(docs, "text"), *train(docs, labels)).withColumn("doc_id", unkeyed())
    return judged.select("doc_id", (fold() == HELD_OUT_FOLD).alias("held_out"), "score", "mean_ratio", "n_words", "predicted")

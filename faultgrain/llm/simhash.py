"""SimHash near-duplicates through vantage-point trees over Hamming space.

Fingerprints within ``radius`` bits differ in at most ``radius // blocks`` bits of one of
``blocks`` parts of the 64 bits. So a forest of one tree a block finds all pairs: a tree's
upper levels, spread over the cluster, send a fingerprint to the shard named by its
distances, within the block, to a few vantage points (triangle bound: two fingerprints at
block distance t have distances to any point that differ by at most t, so a fingerprint also
asks the shards up to t away; with radius + 1 blocks t is 0 and nothing overlaps). Inside a
shard a vantage-point tree over the whole 64 bits splits at the median distance, and what lies
within ``radius`` of the boundary asks both sides.

A shard answers with a spanning forest of its links, not with all pairs, and shards beyond
SHARD_MOST fingerprints are cut into pieces of which every two meet in a task of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultgrain.llm.common import NOT_SPACE, SMALL_SLICE_BYTES, flat, hashes, keyed, mixed, owners, parts, slices, unkeyed, windows, words
from faultgrain.llm.components import components
from faultgrain.llm.xxh64 import xxh64
from faultgrain.session import materialize

RADIUS, SHINGLE = 3, 3
SIMILARITY, WIDE_SHINGLE = 0.8, 5
BANDS, BAND_ROWS, PIECE_GRAMS = 32, 6, 400_000
SHARD_AIM, SHARD_MOST, BUCKET_ROWS = 256, 20_000, 20_000
_LEAF = 48
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
# Drawn once: vantage points need only be the same on every machine.
_VANTAGE = np.random.default_rng(64).integers(0, 1 << 63, 64, dtype=np.int64)
# Odd factors and masks that order the shingles anew for each MinHash value.
_ORDERS = np.random.default_rng(65).integers(0, 1 << 32, (BANDS * BAND_ROWS, 2), dtype=np.uint32) | np.array([1, 0], np.uint32)
_SECOND = 0xD6E8FEB86659FD93


def simhash(text: bytes, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint of a text's word shingles, A-Z lower-cased; 0 without words."""
    own = text.lower().split()
    if not own:
        return 0
    if len(own) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(own), 42)
    line, ends, at = b" ".join(own), [], -1
    for word in own:
        at += len(word) + 1
        ends.append(at)
    view, hashed = memoryview(line), xxhash.xxh64_intdigest
    starts = [0, *(e + 1 for e in ends[:-shingle])]
    h = np.array([hashed(view[s:e], 42) for s, e in zip(starts, ends[shingle - 1 :])], dtype="<u8")
    counts = np.array([np.bincount(column, minlength=256) for column in h.view(np.uint8).reshape(-1, 8).T])
    return int(np.packbits((counts @ _BITS * 2 > len(h)).reshape(64), bitorder="little").view("<u8")[0])


def _word_spans(data: np.ndarray, at: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts as words with a blank after each; starts and sizes of their shingles, and each text's first one (n + 1 numbers).

    A text of fewer words is one shingle.
    """
    starts, ends, first = words(data, at)
    size = ends - starts
    after = np.cumsum(size + 1)
    line = np.full(int(after[-1]) if len(after) else 0, 0x20, np.uint8)
    inside = np.ones(len(line), bool)
    inside[after - 1] = False
    line[inside] = data[NOT_SPACE[data]]
    count = np.diff(first)
    spans = np.where(count > shingle, count - shingle + 1, np.minimum(count, 1))
    firsts = np.concatenate([[0], np.cumsum(spans)])
    begin = np.arange(firsts[-1]) + np.repeat(first[:-1] - firsts[:-1], spans)
    last = np.minimum(begin + shingle, np.repeat(first[1:], spans)) - 1
    begins = (after - size - 1)[begin]
    return line, begins, after[last] - 1 - begins, firsts


def simhashes(column: pa.Array, shingle: int = SHINGLE) -> np.ndarray:
    """``simhash`` of each text of a column; null is empty."""
    data, at = flat(column)
    line, begins, sizes, first = _word_spans(_LOWER[data], at, shingle)
    h = xxh64(line, begins, sizes, 42)
    count = np.diff(first)
    # Eight counters side by side in a number hold up to 255 shingles.
    filled = np.flatnonzero(count)
    runs = -(-count[filled] // 255)
    firsts = np.cumsum(runs) - runs
    starts = np.repeat(first[filled] - 255 * firsts, runs) + 255 * np.arange(int(runs.sum()))
    votes = np.zeros((len(count), 8, 8), np.int64)
    for bit in range(8 if len(filled) else 0):
        held = np.add.reduceat(h >> np.uint64(bit) & np.uint64(0x0101010101010101), starts).view(np.uint8).reshape(-1, 8)
        votes[filled, :, bit] = np.add.reduceat(held, firsts, axis=0, dtype=np.int64)
    more = votes.reshape(-1, 64) * 2 > count[:, None]
    marks = np.packbits(more, axis=1, bitorder="little").view("<u8").ravel()
    alone = filled[count[filled] == 1]  # a lone shingle's hash is the fingerprint
    marks[alone] = h[first[alone]]
    return marks


def _fingerprints(shingle: int):
    def fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=SMALL_SLICE_BYTES):
            marks = simhashes(batch["text"], shingle).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(marks)], names=["doc_id", "mark"])

    return fingerprints


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, mark`` (the fingerprint's bits as a long) for each row; null text counts as empty."""
    return docs.mapInArrow(_fingerprints(shingle), "doc_id long, mark long")


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


class Forest:
    """Links that join two trees each; the others are left out."""

    def __init__(self, size: int):
        self.parent, self.links = list(range(size)), []

    def _root(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        for i, j in zip(a.tolist(), b.tolist()):
            x, y = self._root(i), self._root(j)
            if x != y:
                self.parent[max(x, y)] = min(x, y)
                self.links.append((i, j))

    def pairs(self) -> np.ndarray:
        return np.array(self.links, np.int64).reshape(-1, 2)


def tree_links(marks: np.ndarray, radius: int) -> np.ndarray:
    """Row pairs of a spanning forest of all links among ``marks`` (a row of words each), by a vantage-point tree."""
    label, out = np.arange(len(marks)), []
    stack = [(label.copy(), label.copy())]
    while stack:
        home, asking = stack.pop()
        if not len(home) or not len(asking):
            continue
        if len(home) > _LEAF:
            point = marks[home[len(home) // 2]]
            near, far = _distance(marks[home], point), _distance(marks[asking], point)
            middle = int(np.partition(near, len(near) // 2)[len(near) // 2])
            edge = middle - 1 if (near < middle).any() else middle
            inside = near <= edge
            if not inside.all():
                stack.append((home[inside], asking[far <= edge + radius]))
                stack.append((home[~inside], asking[far > edge - radius]))
                continue
        for one in home.tolist():
            # What is in one component already needs no comparison.
            other = asking[label[asking] != label[one]]
            other = other[_distance(marks[other], marks[one]) <= radius]
            if len(other):
                apart, first = np.unique(label[other], return_index=True)
                out += [(one, k) for k in other[first].tolist()]
                label[np.isin(label, apart)] = label[one]
    return np.array(out, np.int64).reshape(-1, 2)


def _bucket_links(radius: int):
    """Links inside every shard (or pair of a shard's pieces) of a bucket."""

    def bucket_links(table: pa.Table) -> pa.Table:
        shard = table["part"].to_numpy()
        order = np.argsort(shard, kind="stable")
        shard = shard[order]
        marks = np.frombuffer(b"".join(table["mark"].to_pylist()), "<u8").reshape(len(shard), -1)[order]
        docs = table["doc"].to_numpy()
        # A document may be in several shards of the bucket; the forest is over documents.
        names, row_doc = np.unique(docs[order], return_inverse=True)
        forest = Forest(len(names))
        cuts = np.flatnonzero(np.diff(shard, prepend=~shard[:1], append=~shard[-1:]))
        size = np.repeat(np.diff(cuts), np.diff(cuts))
        for apart in range(1, _LEAF):  # small shards all at once, row against the row ``apart`` rows on
            here = np.flatnonzero((shard[apart:] == shard[:-apart]) & (size[apart:] <= _LEAF))
            if not len(here):
                break
            here = here[_distance(marks[here], marks[here + apart]) <= radius]
            forest.add(row_doc[here], row_doc[here + apart])
        for start, end in zip(cuts[:-1], cuts[1:]):
            if end - start > _LEAF:
                pairs = tree_links(marks[start:end], radius) + start
                forest.add(row_doc[pairs[:, 0]], row_doc[pairs[:, 1]])
        pairs = names[forest.pairs()] if len(names) else np.empty((0, 2), np.int64)
        return pa.table({"a": pa.array(pairs[:, 0], pa.int64()), "b": pa.array(pairs[:, 1], pa.int64())})

    return bucket_links


def shard_links(dealt: DataFrame, sizes: DataFrame, radius: int) -> DataFrame:
    """``dealt(doc, mark, shard)``, marks as words -> ``a, b``: forests of the links inside each shard.

    ``sizes(shard, n)`` counts the shards' rows, in any number of parts. Shards beyond SHARD_MOST are cut
    into pieces and every two pieces meet; each is one unit of work, and a task takes many. The
    large shards are stored first, so that Spark knows how few they are and the rows are shuffled once.
    """
    sizes = sizes.groupBy("shard").agg(F.sum("n").alias("n"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    large = sizes.filter(F.col("n") > SHARD_MOST).select("shard", F.ceil(F.col("n") / SHARD_MOST).cast("int").alias("cut"))
    dealt = dealt.join(materialize(large, "large-shards"), "shard", "left").withColumn("pieces", F.coalesce("cut", F.lit(1)))
    own = F.pmod(F.xxhash64("mark"), F.col("pieces")).cast("int")
    met = F.transform(F.sequence(F.lit(0), F.col("pieces") - 1), lambda j: F.struct(F.least(own, j).alias("x"), F.greatest(own, j).alias("y")))
    part = F.xxhash64("shard", "x", "y").alias("part")
    units = dealt.select("doc", "mark", "shard", F.inline(met)).select("doc", "mark", part)
    bucket = F.pmod("part", F.lit(parts(total, BUCKET_ROWS))).alias("bucket")
    return units.select("doc", "mark", "part", bucket).groupBy("bucket").applyInArrow(_bucket_links(radius), "a long, b long")


def _bytes_of(mark: str) -> Column:
    """A long as eight bytes, which keep all distances."""
    return F.unhex(F.lpad(F.hex(mark), 16, "0"))


def _and_rings(names: Column, rings: Column) -> Column:
    """Every name followed by every ring."""
    return F.flatten(F.transform(names, lambda name: F.transform(rings, lambda ring: F.concat_ws(".", name, ring))))


def _shards(block: int, blocks: int, levels: int, slack: int) -> Column:
    """The names of the shards a fingerprint lies in or asks, in one tree."""
    low, high = 64 * block // blocks, 64 * (block + 1) // blocks
    mask = ((1 << (high - low)) - 1) << low
    mask -= (mask >> 63) << 64
    part = F.col("mark").bitwiseAND(F.lit(mask))
    distances = [
        F.bit_count(part.bitwiseXOR(F.lit(int(_VANTAGE[level])).bitwiseAND(F.lit(mask)))) for level in range(levels)
    ]
    if not slack:  # one name, by plain expressions
        return F.array(F.concat_ws(".", F.lit(f"{block}"), *distances))
    names = F.array(F.lit(f"{block}"))
    for distance in distances:
        names = _and_rings(names, F.sequence(distance - slack, distance + slack))
    return names


def near_links(marks: DataFrame, radius: int = RADIUS, blocks: int | None = None) -> DataFrame:
    """``marks(doc, mark)``, distinct in ``mark`` -> ``a, b``: a spanning forest in every shard.

    The links of all shards have the same components as all pairs within ``radius`` bits.
    """
    blocks = blocks or radius + 1
    total = marks.count()
    levels = max(1, min(24, int(np.ceil(np.log(max(total / SHARD_AIM, 1)) / np.log(5)))))
    named = F.concat(*(_shards(block, blocks, levels, radius // blocks) for block in range(blocks)))
    dealt = marks.select("doc", "mark", F.explode(named).alias("shard"))
    sizes = dealt.groupBy("shard").agg(F.count("*").alias("n"))
    return shard_links(dealt.withColumn("mark", _bytes_of("mark")), sizes, radius)


def _edges_of(marked: DataFrame, marks: DataFrame) -> DataFrame:
    """Edges from documents to the first ones with their mark, where a doc_id has several rows and marks."""
    same = marked.groupBy("doc_id").agg(F.min("mark").alias("low"), F.max("mark").alias("high")).filter("low != high")
    several = marked.join(same.select("doc_id"), "doc_id", "left_semi").join(marks, "mark")
    return several.select(F.col("doc_id").alias("a"), F.col("doc").alias("b"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """Each document's fingerprint and group: ``doc_id, fingerprint, component_id``.

    The group is the smallest doc_id reachable over fingerprints at most ``radius`` bits apart.
    Documents without words, null texts among them, have fingerprint 0. Rows of one doc_id
    stay apart and all get an answer; as one document their links count together. Rows without doc_id count
    as one document, with a null component_id if it is alone. An empty table gives no rows.
    """
    spark = docs.sparkSession
    marked = materialize(fingerprints(keyed(docs, "text"), shingle), "fingerprints", spark)
    marks = marked.groupBy("mark").agg(F.min("doc_id").alias("doc"))
    marks = materialize(marks, "distinct-fingerprints", spark)
    found = components(near_links(marks, radius).union(_edges_of(marked, marks)))
    group = marks.join(found, marks.doc == found.node, "left").select("mark", F.coalesce("component", "doc").alias("component_id"))
    return marked.join(group, "mark").select(
        unkeyed(), F.lpad(F.lower(F.hex("mark")), 16, "0").alias("fingerprint"), unkeyed("component_id")
    )


def _shingles(batch: pa.RecordBatch, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word shingle of each text, A-Z lower-cased, and each text's first one (n + 1 numbers)."""
    data, at = flat(batch["text"])
    data = _LOWER[data]
    starts, ends, first = words(data, at)
    h = hashes(data, starts, ends)
    size = np.diff(first)
    whole = size < shingle  # a shorter text is one shingle
    owner = owners(first)
    place = np.flatnonzero((first[owner + 1] - np.arange(len(h)) >= shingle) & ~whole[owner])
    grams, who = windows(h, shingle)[place], owner[place]
    short = np.flatnonzero(whole & (size > 0))
    one = np.array([windows(h[first[k] : first[k + 1]], int(size[k]))[0] for k in short], np.uint64)
    grams, who = np.concatenate([grams, one]), np.concatenate([who, short])
    order = np.argsort(who, kind="stable")
    return grams[order], np.searchsorted(who[order], np.arange(batch.num_rows + 1))


def minhash_bands(grams: np.ndarray, first: np.ndarray) -> np.ndarray:
    """BANDS keys for each text with shingles: every one a hash of BAND_ROWS smallest values under drawn orders."""
    keys = np.zeros((BANDS, len(first) - 1), np.uint64)
    filled = np.flatnonzero(np.diff(first))
    if not len(filled):
        return keys.T
    low = (grams >> np.uint64(32)).astype(np.uint32)
    for band in range(BANDS):
        key = np.full(len(filled), band + 1, np.uint64)
        for row in range(BAND_ROWS):
            factor, mask = _ORDERS[band * BAND_ROWS + row]
            ordered = (low ^ mask) * factor
            key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(ordered ^ (ordered >> np.uint32(15)), first[filled]))
        keys[band, filled] = key
    return keys.T


def _all_marks(shingle: int, marked: bool = True):
    def all_marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=SMALL_SLICE_BYTES):
            marks = simhashes(batch["text"]).view(np.int64) if marked else np.zeros(batch.num_rows, np.int64)
            grams, first = _shingles(batch, shingle)
            n = np.diff(first)
            # Sums of two hashes of all shingles: texts that share both have the same shingles.
            sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(g, dtype=np.uint64)]) for g in (grams, mixed(grams ^ np.uint64(_SECOND)))]
            same = np.stack([s[first[1:]] - s[first[:-1]] for s in sums] + [n.astype(np.uint64)], axis=1)
            keys = minhash_bands(grams, first).view(np.int64)
            filled = np.where(n > 0, BANDS, 0)
            bands = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum(filled)]), pa.int32()), pa.array(keys[n > 0].reshape(-1))
            )
            columns = [batch["doc_id"], pa.array(marks), pa.array([row.tobytes() for row in same], pa.binary()), pa.array(n, pa.int64()), bands]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "mark", "same", "n", "bands"])

    return all_marks


def _distinct_shingles(shingle: int):
    def distinct_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            grams, first = _shingles(batch, shingle)
            sets = [np.unique(grams[s:e]).astype("<u8").tobytes() for s, e in zip(first[:-1], first[1:])]
            columns = [batch[name] for name in ("doc_id", "component", "piece", "cut")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sets, pa.large_binary())], names=["doc", "component", "piece", "cut", "grams"])

    return distinct_shingles


def alike(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """Row pairs of a spanning forest of all links among ``sets`` of distinct numbers: those of at least this Jaccard similarity."""
    size = np.array([len(s) for s in sets], np.int64)
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1] if len(sets) else np.empty(0, np.int64)
    at = np.concatenate([[0], np.cumsum(size)])
    held = np.zeros(int(ids.max(initial=-1)) + 1, bool)
    label, out = np.arange(len(sets)), []
    for one in range(len(sets) - 1):
        # What is in one component already, or differs too much in size, needs no comparison.
        later, own = size[one + 1 :], size[one]
        fits = (np.minimum(later, own) >= similarity * np.maximum(later, own) * (1 - 1e-9)) & (later > 0) & (label[one + 1 :] != label[one])
        other = np.flatnonzero(fits) + one + 1
        if not len(other):
            continue
        held[ids[at[one] : at[one + 1]]] = True
        hits = held[np.concatenate([ids[at[k] : at[k + 1]] for k in other.tolist()])]
        shared = np.add.reduceat(hits, np.concatenate([[0], np.cumsum(size[other])[:-1]]), dtype=np.int64)
        held[ids[at[one] : at[one + 1]]] = False
        other = other[shared / (own + size[other] - shared) >= similarity]
        if len(other):
            apart, nearest = np.unique(label[other], return_index=True)
            out += [(one, k) for k in other[nearest].tolist()]
            label[np.isin(label, apart)] = label[one]
    return np.array(out, np.int64).reshape(-1, 2)


def _alike_in(similarity: float):
    """Verified links inside every unit of a bucket."""

    def alike_in(table: pa.Table) -> pa.Table:
        unit = table["unit"].to_numpy()
        order = np.argsort(unit, kind="stable")
        docs, sets = table["doc"].to_numpy(), table["grams"].to_pylist()
        cuts = np.flatnonzero(np.diff(unit[order], prepend=np.int64(0), append=np.int64(0)) != 0)
        cuts = np.unique(np.concatenate([[0], cuts, [len(order)]]))
        pairs = [np.empty((0, 2), np.int64)]
        for start, end in zip(cuts[:-1], cuts[1:]):
            rows = order[start:end]
            pairs.append(docs[rows[alike([np.frombuffer(sets[k], "<u8") for k in rows], similarity)]].reshape(-1, 2))
        pairs = np.concatenate(pairs)
        return pa.table({"a": pa.array(pairs[:, 0], pa.int64()), "b": pa.array(pairs[:, 1], pa.int64())})

    return alike_in


def similar_links(docs: DataFrame, sizes: DataFrame, candidates: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """``docs(doc_id, text)``, ``sizes(doc_id, n)``, ``candidates(node, component)`` -> ``a, b``.

    The links have the same components as all pairs of one candidate component whose distinct shingles have at
    least this Jaccard similarity. A component of more than PIECE_GRAMS shingles is cut into pieces of
    which every two meet in a unit of their own; each unit compares what no link joins yet.
    """
    candidates = candidates.withColumnRenamed("node", "doc_id")
    total = sizes.join(candidates, "doc_id").groupBy("component").agg(F.sum("n").alias("n"))
    total = materialize(total.select("component", "n", F.ceil(F.col("n") / PIECE_GRAMS).cast("int").alias("cut")), "candidate-sizes")
    work = total.agg(F.sum(F.col("n") * F.col("cut"))).first()[0] or 0
    large = total.filter("cut > 1").select("component", "cut")
    texts = docs.join(candidates, "doc_id").join(large, "component", "left").withColumn("cut", F.coalesce("cut", F.lit(1)))
    texts = texts.select("doc_id", "component", F.pmod(F.xxhash64("doc_id", "text"), F.col("cut")).cast("int").alias("piece"), "cut", "text")
    sets = texts.mapInArrow(_distinct_shingles(shingle), "doc long, component long, piece int, cut int, grams binary")
    own = F.col("piece")
    met = F.transform(F.sequence(F.lit(0), F.col("cut") - 1), lambda j: F.struct(F.least(own, j).alias("x"), F.greatest(own, j).alias("y")))
    units = sets.select("doc", "component", "grams", F.inline(met)).select("doc", "grams", F.xxhash64("component", "x", "y").alias("unit"))
    bucket = F.pmod("unit", F.lit(parts(work, PIECE_GRAMS))).alias("bucket")
    return units.select("doc", "grams", "unit", bucket).groupBy("bucket").applyInArrow(_alike_in(similarity), "a long, b long")


def near_copies(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = WIDE_SHINGLE, linked: DataFrame | None = None) -> DataFrame:
    """Each document's group of near copies: ``doc_id, component_id``, the smallest doc_id in reach.

    Two documents are linked if their distinct shingles of ``shingle`` words (a shorter text is one) have a Jaccard
    similarity of at least ``similarity``, computed exactly. Fingerprints only find the candidates: what
    ``near_duplicates`` links, and texts that share one of BANDS MinHash bands of BAND_ROWS values, which two
    texts of similarity s do with a chance of 1 - (1 - s ** BAND_ROWS) ** BANDS whatever their length, 0.9999 at 0.8.
    All pairs of a component of candidates are judged. Odd rows are treated as in ``near_duplicates``.
    What that links may be given as ``linked(a, b)``, and is then not found anew; the answer is the same.
    """
    spark = docs.sparkSession
    layout = "doc_id long, mark long, same binary, n long, bands array<long>"
    texts = keyed(docs, "text")
    marked = materialize(texts.mapInArrow(_all_marks(shingle, linked is None), layout), "fingerprints", spark)
    nodes = materialize(marked.groupBy("same").agg(F.min("doc_id").alias("doc")), "distinct-fingerprints", spark)
    first = marked.join(nodes.withColumnRenamed("doc", "doc_id"), ["same", "doc_id"]).select(F.col("doc_id").alias("doc"), "mark", "bands")
    first = materialize(first, "first-fingerprints", spark)
    if linked is None:
        marks = materialize(first.groupBy("mark").agg(F.min("doc").alias("doc")), "distinct-fingerprints", spark)
        close = first.join(marks.withColumnRenamed("doc", "least"), "mark").select(F.col("doc").alias("a"), F.col("least").alias("b"))
        links = near_links(marks).union(close)
    else:
        named = marked.select("doc_id", "same").join(nodes, "same").select("doc_id", "doc")
        links = linked.join(named.toDF("a", "one"), "a").join(named.toDF("b", "two"), "b").select(F.col("one").alias("a"), F.col("two").alias("b"))
    keys = first.select("doc", F.explode("bands").alias("key"))
    heads = keys.groupBy("key").agg(F.min("doc").alias("least"), F.max("doc").alias("last")).filter("least != last")
    shared = keys.join(heads, "key").select(F.col("doc").alias("a"), F.col("least").alias("b"))
    candidates = components(links.union(shared).filter("a != b"))
    several = marked.select("doc_id", "same").join(nodes, "same").filter("doc_id != doc")
    twice = marked.groupBy("doc_id").agg(F.count("*").alias("rows")).filter("rows > 1")
    several = several.join(twice, "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("doc").alias("b"))
    found = components(similar_links(texts, marked.select("doc_id", "n"), candidates, similarity, shingle).union(several))
    group = nodes.join(found, nodes.doc == found.node, "left").select("same", F.coalesce("component", "doc").alias("component_id"))
    return marked.select("doc_id", "same").join(group, "same").select(unkeyed(), unkeyed("component_id"))

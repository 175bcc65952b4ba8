"""Document fingerprints by content-defined chunking.

A gear hash runs over a text's bytes; a chunk ends where the hash's low bits are zero. The cut
is normalised: before the usual size more bits have to be zero, beyond it fewer, and no chunk
leaves [MIN_CHUNK, MAX_CHUNK]. An insertion moves only the chunks it touches, so the set of
chunk digests, each weighted by its chunk's bytes, tells how much of one text another holds.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultgrain.llm.common import keyed, parts, slices, text_bytes, unkeyed
from faultgrain.session import materialize

MIN_CHUNK, USUAL_CHUNK, MAX_CHUNK = 16, 48, 192
_STRICT, _LOOSE = np.uint32((1 << 7) - 1), np.uint32((1 << 4) - 1)
_GEAR = np.random.default_rng(20).integers(0, 1 << 32, 256, dtype=np.uint32)
RANGE_BYTES = 16 << 20


def gear(data: np.ndarray) -> np.ndarray:
    """At each byte the rolling hash of it and the 15 bytes before, newest byte unshifted.

    ``h[i] = sum(G[b[i - j]] << j)``, by doubling the width in four steps.
    """
    h = _GEAR[data]
    for width in (1, 2, 4, 8):
        wider = h.copy()
        wider[width:] += h[:-width] << np.uint32(width)
        h = wider
    return h >> np.uint32(15)


def boundaries(data: bytes) -> list[int]:
    """The ends of the chunks of ``data``, ascending; none for an empty text."""
    n = len(data)
    if n <= MIN_CHUNK:
        return [n] if n else []
    h = gear(np.frombuffer(data, np.uint8))
    loose = np.flatnonzero((h & _LOOSE) == 0)
    strict = (loose[(h[loose] & _STRICT) == 0] + 1).tolist()
    loose = (loose + 1).tolist()
    ends, start = [], 0
    while n - start > MIN_CHUNK:
        usual, most = start + USUAL_CHUNK, start + MAX_CHUNK
        k = bisect_left(strict, start + MIN_CHUNK)
        if k < len(strict) and strict[k] <= usual:
            start = strict[k]
        else:
            k = bisect_left(loose, usual)
            start = loose[k] if k < len(loose) and loose[k] <= most else min(most, n)
        ends.append(start)
    if start < n:
        ends.append(n)
    return ends


def chunk_weights(data: bytes) -> dict[int, int]:
    """Chunk digest -> bytes, the same digest counted once."""
    weights, start = {}, 0
    for end in boundaries(data):
        weights[xxhash.xxh3_64_intdigest(data[start:end])] = end - start
        start = end
    return weights


def digest(weights: dict[int, int]) -> str:
    """One hex string for a whole digest set."""
    return xxhash.xxh3_128_hexdigest(np.array(sorted(weights), dtype="<u8").tobytes())


def containment(a: dict[int, int], b: dict[int, int]) -> float:
    """The bytes of shared chunks over those of the smaller set; two empty sets are alike."""
    if not a or not b:
        return float(not a and not b)
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    shared = sum(size for key, size in small.items() if key in large)
    return min(1.0, shared / min(sum(a.values()), sum(b.values())))


def edited_text(text: str, following: str) -> str:
    """``text`` with its last quarter replaced by as many first characters of ``following``."""
    quarter = len(text) // 4
    return text[: len(text) - quarter] + following[:quarter]


def _chunk_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        sets = [chunk_weights((text or "").encode()) for text in batch["text"].to_pylist()]
        chunks = [[{"digest": key - (1 << 64) * (key >> 63), "bytes": size} for key, size in one.items()] for one in sets]
        kind = pa.list_(pa.struct([("digest", pa.int64()), ("bytes", pa.int32())]))
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], pa.array(map(digest, sets), pa.string()), pa.array(chunks, kind)],
            names=["doc_id", "fingerprint", "chunks"],
        )


def chunk_sets(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint and its set of chunks: ``doc_id, fingerprint, chunks``.

    Null and empty texts have no chunks. Rows of one doc_id stay apart.
    """
    layout = "doc_id long, fingerprint string, chunks array<struct<digest: long, bytes: int>>"
    return keyed(docs, "text").mapInArrow(_chunk_rows, layout).withColumn("doc_id", unkeyed())


_LIKENESS = pa.schema(
    [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
     ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
     ("n_chunks", pa.int32())]
)
_RANGED = pa.schema([*_LIKENESS, ("edge", pa.string()), ("range", pa.int32()), ("text", pa.string())])
_COLUMNS = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string,"
    " near_edited double, near_next double, n_chunks int"
)


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _likeness(doc: int, text: str, own: dict[int, int], following: str, next_set: dict[int, int]) -> tuple:
    edited = edited_text(text, following).encode()
    other = chunk_weights(edited)
    sha = hashlib.sha256(edited).hexdigest()
    near = containment(own, other), containment(own, next_set)
    return doc, len(text), sha, digest(own), digest(other), *near, len(own)


def _along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One sorted range: each row judged against the row after it, and the two rows at its ends."""
    held, where = None, TaskContext.get().partitionId()
    edge = (None,) * len(_LIKENESS)
    for batch in slices(batches):
        rows = []
        for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
            now = doc, text, chunk_weights(text.encode())
            if held is None:
                rows.append((doc, *edge[1:], "first", where, text))
            else:
                rows.append((*_likeness(*held, *now[1:]), None, where, None))
            held = now
        yield _table(rows, _RANGED)
    if held is not None:
        yield _table([(held[0], *edge[1:], "last", where, held[1])], _RANGED)


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        rows = zip(*(batch[c].to_pylist() for c in ("doc_id", "text", "following")))
        done = [_likeness(d, t, chunk_weights(t.encode()), f, chunk_weights(f.encode())) for d, t, f in rows]
        yield _table(done, _LIKENESS)


def edit_likeness(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint against its edited text's and against the next document's.

    Next is the next by ascending doc_id, the last document's is the first. The table is
    sorted in ranges of doc_id; a task streams through its range holding one row. What meets
    at the ends of ranges, one row each, is joined afterwards.

    Null text counts as empty. Rows of one doc_id follow each other in order of their text;
    rows without doc_id come last. Two empty texts have likeness 1, an empty and a filled
    one 0. A lone document is its own next one. An empty table gives no rows.
    """
    spark = docs.sparkSession
    docs = keyed(docs, F.coalesce("text", F.lit("")).alias("text"))
    ranges = parts(text_bytes(docs), RANGE_BYTES)
    ranged = docs.repartitionByRange(ranges, "doc_id").sortWithinPartitions("doc_id", "text")
    judged = materialize(
        ranged.mapInArrow(_along, f"{_COLUMNS}, edge string, range int, text string"), "likeness", spark
    )
    inside = judged.filter("edge IS NULL").select(*_LIKENESS.names)
    present = sorted(r[0] for r in judged.filter("edge = 'first'").select("range").collect())  # one number a task
    if not present:
        return inside
    after = spark.createDataFrame(list(zip(present, present[1:] + present[:1])), "range int, next int")
    lasts = judged.filter("edge = 'last'").select("doc_id", "text", "range").join(after, "range")
    firsts = judged.filter("edge = 'first'").select(F.col("range").alias("next"), F.col("text").alias("following"))
    across = lasts.join(firsts, "next").mapInArrow(_across, _COLUMNS)
    return inside.union(across).withColumn("doc_id", unkeyed())

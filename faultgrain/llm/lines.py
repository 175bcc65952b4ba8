"""Line dedup over levelled sorted runs of line keys.

A run is a table sorted by key: how many documents hold the line and the last of them. Each
batch of documents is merged against the runs before it (the anti-join gives the lines never
seen) and adds a run of its own; when a level has FAN_IN runs they are merged into one of the
next level, so a key lies in few runs and an old run is rewritten only log times.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultgrain.llm.common import NULL_ID, fresh, keyed, slices, unkeyed
from faultgrain.session import materialize

MIN_CHARS, MIN_DOCS = 40, 5
FAN_IN, BATCHES = 4, 4
_BLANK = b" \t\n\x0b\x0c\r"


def line_key(line: bytes, least: int) -> bytes | None:
    """The 128-bit key of a line: blanks off both ends, A-Z lower-cased; None if it is short."""
    line = line.strip(_BLANK)
    if len(line) < least or len(line.decode()) < least:
        return None
    return xxhash.xxh3_128_digest(line.lower())


def _keys(least: int):
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            docs, found = [], []
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].cast(pa.large_binary()).to_pylist()):
                own = {line_key(line, least) for line in (text or b"").split(b"\n")} - {None}
                docs += [doc] * len(own)
                found += own
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(found, pa.binary())], names=["doc_id", "key"])

    return keys


def line_keys(docs: DataFrame, least: int = MIN_CHARS) -> DataFrame:
    """``doc_id, key`` of every line of at least ``least`` characters, once a row of ``docs``."""
    return docs.mapInArrow(_keys(least), "doc_id long, key binary")


class LineRuns:
    """The runs of all batches so far, by level."""

    def __init__(self) -> None:
        self.levels: list[list[DataFrame]] = []

    def table(self) -> DataFrame | None:
        """All runs merged: ``key, n_docs, last_doc``, each key once."""
        runs = [run for level in self.levels for run in level]
        return _merged(runs) if runs else None

    def unseen(self, lines: DataFrame) -> DataFrame:
        """The rows of ``lines`` whose key no run has."""
        for level in self.levels:
            for run in level:
                lines = lines.join(run, "key", "left_anti")
        return lines

    def add(self, lines: DataFrame) -> None:
        """Add a batch's (doc_id, key) rows as a run; its documents are in no earlier batch."""
        once = lines.groupBy("key", "doc_id").agg(F.lit(1).alias("one"))
        run = once.groupBy("key").agg(F.count("one").alias("n_docs"), F.max("doc_id").alias("last_doc"))
        self._put(0, _sorted(run))

    def _put(self, level: int, run: DataFrame) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) == FAN_IN:
            full, self.levels[level] = self.levels[level], []
            self._put(level + 1, _sorted(_merged(full)))


def _merged(runs: list[DataFrame]) -> DataFrame:
    if len(runs) == 1:
        return runs[0]
    every = reduce(DataFrame.union, runs)
    return every.groupBy("key").agg(F.sum("n_docs").alias("n_docs"), F.max("last_doc").alias("last_doc"))


def _sorted(run: DataFrame) -> DataFrame:
    return materialize(run.sortWithinPartitions("key"), "line-run")


def _left(text: bytes | None, gone: list[bytes] | None, least: int) -> tuple[list[bytes], list[bytes]]:
    """A text's lines and those that stay."""
    own, gone = (text or b"").split(b"\n"), set(gone or ())
    return own, [x for x in own if line_key(x, least) not in gone] if gone else own


def _drop(least: int):
    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n_lines, n_dropped, kept = [], [], []
            texts = batch["text"].cast(pa.large_binary()).to_pylist()
            for text, gone in zip(texts, batch["gone"].to_pylist()):
                own, left = _left(text, gone, least)
                n_lines.append(len(own))
                n_dropped.append(len(own) - len(left))
                kept.append(b"\n".join(left))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()),
                 pa.array(kept, pa.binary()).cast(pa.string())],
                names=["doc_id", "n_lines", "n_dropped", "kept"],
            )

    return drop


def _gone(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES) -> DataFrame:
    """The keys each document has to drop: ``doc_id, gone``, for documents that drop any."""
    batch = F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int").alias("batch")
    lines = materialize(line_keys(docs, min_chars).select("doc_id", "key", batch), "lines")
    runs = LineRuns()
    for k in range(batches):
        runs.add(lines.filter(F.col("batch") == k).select("doc_id", "key"))
    common = runs.table().filter(F.col("n_docs") >= min_docs)
    found = lines.join(common, "key").filter(F.col("doc_id") != F.col("last_doc"))
    return found.groupBy("doc_id").agg(F.collect_set("key").alias("gone"))


def drop_repeated_lines(
    docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES
) -> DataFrame:
    """Every document without its lines that ``min_docs`` documents hold, but for the last holder's.

    Gives ``doc_id, n_lines, n_dropped, kept``. Null and empty texts are one empty line.
    Rows of one doc_id count as one document and are answered row by row; rows without doc_id count as
    one document after all others. An empty table gives no rows.
    """
    docs = keyed(docs, "text")
    judged = docs.join(_gone(docs, min_chars, min_docs, batches), "doc_id", "left")
    layout = "doc_id long, n_lines long, n_dropped long, kept string"
    return judged.mapInArrow(_drop(min_chars), layout).withColumn("doc_id", unkeyed())


def repeated(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES) -> DataFrame:
    """``doc_id, gone``: the keys of the lines that each document drops, for those of ``docs(doc_id, text)`` that drop any."""
    return _gone(docs, min_chars, min_docs, batches)


def without(docs: DataFrame, key: str, gone: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with all its columns, its texts without the lines named by ``gone(key, gone)``.

    Only texts that lose a line change; their ``n_chars``, where there is such a column, is counted anew.
    """
    lost = fresh(docs, "line_keys_gone")
    names = docs.columns
    # The keys grow with the documents, so they are merged at every size.
    joined = docs.join(gone.toDF(key, lost).hint("merge"), key, "left").select(*names, lost)

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts, keys = batch["text"].cast(pa.large_binary()).to_pylist(), batch[lost].to_pylist()
            kept = [b"\n".join(_left(t, g, min_chars)[1]) if g else t for t, g in zip(texts, keys)]
            kept = pa.array(kept, pa.binary()).cast(pa.string())
            columns = {name: batch[name] for name in names} | {"text": kept}
            if "n_chars" in columns:
                size = pc.utf8_length(kept).cast(batch["n_chars"].type)
                columns["n_chars"] = pc.if_else(pa.array([bool(g) for g in keys], pa.bool_()), size, batch["n_chars"])
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return joined.mapInArrow(replace, docs.schema)


def with_lines_dropped(
    docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES
) -> DataFrame:
    """``docs`` with all its columns, its texts without the lines ``drop_repeated_lines`` drops; see ``without``."""
    key = fresh(docs, "line_doc_id")
    rows = docs.withColumn(key, F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)))
    found = repeated(keyed(docs, "text"), min_chars, min_docs, batches)
    return without(rows, key, found, min_chars).drop(key)


def first_seen_lines(lines: DataFrame, runs: LineRuns) -> DataFrame:
    """Of a new batch's (doc_id, key) rows the ones never seen, each key once with its first document.

    The batch is added to ``runs``.
    """
    lines = materialize(lines, "line-batch")
    new = runs.unseen(lines).groupBy("key").agg(F.min("doc_id").alias("doc_id"))
    new = materialize(new.select("doc_id", "key"), "line-batch")
    runs.add(lines)
    return new

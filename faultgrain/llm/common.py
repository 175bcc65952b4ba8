"""What the operators share: whole texts as numpy arrays inside Arrow tasks, sizes, null keys.

Each task sees its rows as Arrow batches. ``slices`` cuts a batch so that one pass of numpy
work holds a bounded number of bytes (a single longer text is a slice of its own).
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Hashable, Iterator
from types import ModuleType

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLICE_BYTES = 4 << 20
SMALL_SLICE_BYTES = 2 << 20  # where larger ones make the work hardly faster

# A null doc_id stands for one document that comes after all others.
NULL_ID = (1 << 63) - 1

_GOLDEN = 0x9E3779B97F4A7C15
_C1, _C2, _C3 = (np.uint64(c) for c in (_GOLDEN, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_MASKS = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=np.uint64)

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
NOT_SPACE = ~SPACE
# ASCII letters and digits and every byte of a non-ASCII character.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def keyed(docs: DataFrame, *columns: str) -> DataFrame:
    """``columns`` of ``docs`` after a never-null ``doc_id``; all others are left behind."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), *columns)


def unkeyed(column: str = "doc_id") -> Column:
    """The reverse of ``keyed`` for one column."""
    return F.when(F.col(column) != NULL_ID, F.col(column)).alias(column)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def text_bytes(docs: DataFrame) -> int:
    """Bytes of text in the whole table: what partition counts are derived from."""
    return docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]


def parts(total: int, each: int, least: int = 12) -> int:
    """How many groups of about ``each`` bytes hold ``total`` bytes."""
    return max(least, -(-total // each))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts one after the other and their n + 1 offsets; null is empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def _held() -> dict[Hashable, object]:
    """What this worker keeps for its next tasks, one thing at a time.

    The package goes to the workers by value, where a global of its own lasts for one task.
    """
    return vars(sys.modules.setdefault("faultgrain_held", ModuleType("faultgrain_held"))).setdefault("held", {})


def kept(key: Hashable, make: Callable[[], object]) -> object:
    """What ``make`` returns, once a worker for all tasks in a row that ask for ``key``; see ``slices``."""
    held = _held()
    if key not in held:
        held.clear()
        held[key] = make()
    return held[key]


def give_back() -> None:
    """Return what freed arrays and buffers leave in this worker's allocators: Spark goes on with the same process."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc's
        trim(0)


def slices(
    batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES, keeps: Hashable = None
) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in pieces of about ``most`` bytes of ``column``.

    A task that goes through here drops what a worker still keeps of other operators, all but ``keeps``.
    """
    held = _held()
    for key in [k for k in held if k != keeps]:
        del held[key]
    give_back()
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(sizes, dtype=np.int64) // most
        cuts = np.flatnonzero(np.diff(group)) + 1
        for start, end in zip([0, *cuts], [*cuts, batch.num_rows]):
            yield batch.slice(start, end - start)
    give_back()


def words(data: np.ndarray, at: np.ndarray, kind: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of bytes of ``kind``: starts, ends, and each text's first run (n + 1 numbers)."""
    inside = kind[data]
    before, after = np.zeros_like(inside), np.zeros_like(inside)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    filled = at[1:] > at[:-1]
    before[at[:-1][filled]] = False
    after[at[1:][filled] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    return starts, np.flatnonzero(inside & ~after) + 1, np.searchsorted(starts, at)


def mixed(h: np.ndarray) -> np.ndarray:
    """Every bit of each number depends on all of its bits."""
    h = (h ^ (h >> np.uint64(30))) * _C2
    h = (h ^ (h >> np.uint64(27))) * _C3
    return h ^ (h >> np.uint64(31))


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each span of ``data``, eight bytes a step; long spans outlast short ones."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(shape=(len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    size = (ends - starts).astype(np.int64)
    h = mixed(size.astype(np.uint64) + np.uint64((seed + 1) * _GOLDEN % (1 << 64)))
    left, step = np.flatnonzero(size > 0), 0
    while len(left):
        rest = size[left] - step
        chunk = eight[starts[left] + step] & _MASKS[np.minimum(rest, 8)]
        h[left] = mixed(h[left] * _C1 + chunk)
        step += 8
        left = left[rest > 8]
    return h


def windows(h: np.ndarray, width: int) -> np.ndarray:
    """The hash of each ``width`` consecutive numbers of ``h``."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(width):
        out = out * _C2 + h[j : n + j]
    return mixed(out)


def owners(first: np.ndarray) -> np.ndarray:
    """For each run its text's number, from ``words``' third result."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))

"""XXH64 of many spans of bytes at once: the same numbers as ``xxhash.xxh64_intdigest`` gives one by one."""

from __future__ import annotations

import numpy as np

BLOCK_SPANS = 32_768
_P1, _P2, _P3, _P4, _P5 = (
    np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)
)


def _turned(h: np.ndarray, bits: int) -> np.ndarray:
    return h << np.uint64(bits) | h >> np.uint64(64 - bits)


def _round(lane: np.ndarray, chunk: np.ndarray) -> np.ndarray:
    return _turned(lane + chunk * _P2, 31) * _P1


def _block(data: np.ndarray, eight: np.ndarray, starts: np.ndarray, sizes: np.ndarray, seed: int) -> np.ndarray:
    first = [(seed + int(_P1) + int(_P2)) % (1 << 64), (seed + int(_P2)) % (1 << 64), seed, (seed - int(_P1)) % (1 << 64)]
    h = np.full(len(starts), (seed + int(_P5)) % (1 << 64), np.uint64)
    stripes = sizes >> 5
    at = starts + (stripes << 5)
    own = np.flatnonzero(stripes)
    if len(own):
        lanes = [np.full(len(own), f, np.uint64) for f in first]
        left, step = np.arange(len(own)), 0
        while len(left):
            here = starts[own[left]] + 32 * step
            for k, lane in enumerate(lanes):
                lane[left] = _round(lane[left], eight[here + 8 * k])
            step += 1
            left = left[stripes[own[left]] > step]
        mixed = _turned(lanes[0], 1) + _turned(lanes[1], 7) + _turned(lanes[2], 12) + _turned(lanes[3], 18)
        for lane in lanes:
            mixed = (mixed ^ _round(np.zeros(1, np.uint64), lane)) * _P1 + _P4
        h[own] = mixed
    h += sizes.astype(np.uint64)
    rest = sizes & 31
    for step in range(3):
        own = np.flatnonzero(rest >= 8 * (step + 1))
        chunk = _round(np.zeros(1, np.uint64), eight[at[own] + 8 * step])
        h[own] = _turned(h[own] ^ chunk, 27) * _P1 + _P4
    at, rest = at + (rest & 24), rest & 7
    own = np.flatnonzero(rest >= 4)
    chunk = (eight[at[own]] & np.uint64(0xFFFFFFFF)) * _P1
    h[own] = _turned(h[own] ^ chunk, 23) * _P2 + _P3
    at, rest = at + (rest & 4), rest & 3
    for step in range(3):
        own = np.flatnonzero(rest > step)
        h[own] = _turned(h[own] ^ data[at[own] + step].astype(np.uint64) * _P5, 11) * _P1
    h = (h ^ h >> np.uint64(33)) * _P2
    h = (h ^ h >> np.uint64(29)) * _P3
    return h ^ h >> np.uint64(32)


def xxh64(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, seed: int = 0) -> np.ndarray:
    """The hash of each span ``data[starts : starts + sizes]``."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(shape=(len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    out = np.empty(len(starts), np.uint64)
    for k in range(0, len(starts), BLOCK_SPANS):
        here = slice(k, k + BLOCK_SPANS)
        out[here] = _block(padded, eight, starts[here], sizes[here], seed)
    return out

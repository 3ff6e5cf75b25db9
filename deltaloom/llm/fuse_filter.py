"""Static three-wise binary-fuse filters with one byte a slot (Graf and Lemire, 2022), built by peeling whole rounds of keys as arrays."""

from __future__ import annotations

import struct

import numpy as np

_HEAD = struct.Struct("<QIII")
_MOST_SEEDS = 200


def _mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    x = keys + np.uint64(seed)
    for by in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(by)
    return x ^ (x >> np.uint64(33))


def _slots(mixed: np.ndarray, segment: int, segments: int) -> np.ndarray:
    """Three slots of each key, in three consecutive segments."""
    span = np.uint64(segments * segment)
    low, high = mixed & np.uint64(0xFFFFFFFF), mixed >> np.uint64(32)
    first = (high * span + (low * span >> np.uint64(32))) >> np.uint64(32)
    mask = np.uint64(segment - 1)
    return np.stack([first, (first + np.uint64(segment)) ^ (mixed >> np.uint64(18) & mask), (first + np.uint64(2 * segment)) ^ (mixed & mask)]).astype(np.int64)


def _marks(mixed: np.ndarray) -> np.ndarray:
    return (mixed ^ (mixed >> np.uint64(32))).astype(np.uint8)


def build(keys: np.ndarray) -> bytes:
    """The filter of a set of 64-bit keys (repeats are dropped); no keys give an empty filter."""
    keys = np.unique(keys)
    n = len(keys)
    if not n:
        return b""
    segment = 4 if n == 1 else min(1 << 18, 1 << int(np.log(n) / np.log(3.33) + 2.25))
    spread = 0.0 if n == 1 else max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(n))
    segments = max(1, -(-int(round(n * spread)) // segment) - 2)
    size = (segments + 2) * segment
    for seed in range(1, _MOST_SEEDS):
        mixed = _mixed(keys, seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        slots = _slots(mixed, segment, segments)
        count = np.bincount(slots.ravel(), minlength=size)
        held = np.bincount(slots.ravel(), weights=np.tile(np.arange(n, dtype=np.float64), 3), minlength=size).astype(np.int64)
        rounds, left = [], n
        lone = np.flatnonzero(count == 1)
        while lone.size:
            which, at = np.unique(held[lone], return_index=True)
            rounds.append((which, lone[at]))
            left -= which.size
            gone = slots[:, which].ravel()
            np.subtract.at(count, gone, 1)
            np.subtract.at(held, gone, np.tile(which, 3))
            gone = np.unique(gone)
            lone = gone[count[gone] == 1]
        if left:
            continue
        table = np.zeros(size, np.uint8)
        marks = _marks(mixed)
        for which, slot in reversed(rounds):
            a, b, c = slots[:, which]
            table[slot] = marks[which] ^ table[a] ^ table[b] ^ table[c]
        return _HEAD.pack(seed, segment, segments, size) + table.tobytes()
    raise RuntimeError("no seed gives a peelable filter")


def contains(data: bytes, keys: np.ndarray) -> np.ndarray:
    """True for every key of the set, and for about one in 256 of the others."""
    if not data:
        return np.zeros(len(keys), dtype=bool)
    seed, segment, segments, size = _HEAD.unpack_from(data)
    table = np.frombuffer(data, np.uint8, size, _HEAD.size)
    mixed = _mixed(keys, seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    a, b, c = _slots(mixed, segment, segments)
    return table[a] ^ table[b] ^ table[c] == _marks(mixed)

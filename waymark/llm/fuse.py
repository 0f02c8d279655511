"""Static binary fuse filters with three probes and 8-bit fingerprints (Graf and Lemire 2022), in NumPy."""

from __future__ import annotations

import math

import numpy as np

TRIES = 64


def _hash(keys: np.ndarray, seed: int) -> np.ndarray:
    """Finaliser of MurmurHash3 over key plus seed."""
    with np.errstate(over="ignore"):
        x = keys + np.uint64(seed)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _shape(keys: int) -> tuple[int, int]:
    """Cells of a segment (a power of two) and number of segments that a probe can start in."""
    if keys < 2:
        return 4, 1
    segment = min(1 << int(math.log(keys) / math.log(3.33) + 2.25), 1 << 18)
    factor = max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(keys))
    return segment, max(1, math.ceil(keys * factor / segment) - 2)


def _probes(hashes: np.ndarray, segment: int, count: int) -> np.ndarray:
    """The three cells of each key, in three neighbouring segments."""
    first = ((hashes >> np.uint64(32)) * np.uint64(segment * count)) >> np.uint64(32)
    mask = np.uint64(segment - 1)
    second = (first + np.uint64(segment)) ^ ((hashes >> np.uint64(18)) & mask)
    third = (first + np.uint64(2 * segment)) ^ (hashes & mask)
    return np.stack([first, second, third], axis=1).astype(np.int64)


def _marks(hashes: np.ndarray) -> np.ndarray:
    return (hashes ^ (hashes >> np.uint64(32))).astype(np.uint8)


def _peel(probes: np.ndarray, cells: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
    """Rounds of (keys, a cell that only this key has among those left); None if some keys cannot be freed."""
    count = np.bincount(probes.ravel(), minlength=cells)
    mixed = np.zeros(cells, np.int64)
    for column in probes.T:
        np.bitwise_xor.at(mixed, column, np.arange(len(probes)))
    rounds, left, frontier = [], len(probes), np.flatnonzero(count == 1)
    while len(frontier):
        keys, first = np.unique(mixed[frontier], return_index=True)
        rounds.append((keys, frontier[first]))
        left -= len(keys)
        for column in probes[keys].T:
            np.subtract.at(count, column, 1)
            np.bitwise_xor.at(mixed, column, keys)
        touched = np.unique(probes[keys])
        frontier = touched[count[touched] == 1]
    return None if left else rounds


def build(keys: np.ndarray) -> tuple[int, int, int, bytes]:
    """(seed, cells of a segment, segments, fingerprints) of a filter that holds these 64-bit keys."""
    keys = np.unique(np.asarray(keys, np.uint64))
    segment, count = _shape(len(keys))
    cells = segment * (count + 2)
    for seed in range(1, TRIES):
        hashes = _hash(keys, seed)
        probes = _probes(hashes, segment, count)
        rounds = _peel(probes, cells)
        if rounds is None:
            continue
        stored, marks = np.zeros(cells, np.uint8), _marks(hashes)
        for own, cell in reversed(rounds):
            a, b, c = (stored[probes[own, i]] for i in range(3))
            stored[cell] = marks[own] ^ a ^ b ^ c ^ stored[cell]
        return seed, segment, count, stored.tobytes()
    raise RuntimeError("no seed gives a filter")


def contains(keys: np.ndarray, seed: int, segment: int, count: int, stored: bytes) -> np.ndarray:
    """True for every key of the filter, and for about one in 256 others."""
    hashes = _hash(np.asarray(keys, np.uint64), seed)
    probes, stored = _probes(hashes, segment, count), np.frombuffer(stored, np.uint8)
    return (stored[probes[:, 0]] ^ stored[probes[:, 1]] ^ stored[probes[:, 2]]) == _marks(hashes)

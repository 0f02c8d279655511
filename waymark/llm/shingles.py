"""Shingles of whole texts as 64-bit values, many texts at a time, in NumPy.

Words are what white space (ASCII) separates in the lower-cased text. A shingle is five neighbouring words; a text of one
to four words has one shingle, all its words; a text without words has none.
"""

from __future__ import annotations

import numpy as np

WORDS = 5
#: Bytes that are hashed at a time; a longer "word" counts as several.
PIECE = 1 << 21
_ODD = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _powers(base: int, count: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(count - 1, np.uint64(base))]))


_UP = _powers(_ODD, PIECE + 1)
_DOWN = _powers(pow(_ODD, -1, 1 << 64), PIECE + 1)


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Finaliser of splitmix64 over 64-bit values."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((_ODD * (seed + 1)) % (1 << 64))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first byte) of each word of at most PIECE bytes."""
    raw = np.frombuffer(data, np.uint8)
    letter = ~_SPACE[raw]
    edge = np.diff(np.concatenate([[0], letter.view(np.int8), [0]]))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    with np.errstate(over="ignore"):
        sums = np.concatenate([[np.uint64(0)], np.cumsum((raw + np.uint64(1)) * _UP[: len(raw)])])
        return mixed((sums[last] - sums[first]) * _DOWN[first] + (last - first).astype(np.uint64)), first


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, index of its text)."""
    hashes, owners, batch, ends, size = [], [], [], [], 0

    def flush() -> None:
        nonlocal batch, ends, size
        if batch:
            found, first = _word_hashes(b" ".join(data for _, data in batch))
            hashes.append(found)
            owners.append(np.array([i for i, _ in batch])[np.searchsorted(ends, first, side="right")])
        batch, ends, size = [], [], 0

    for owner, text in enumerate(texts):
        data = text.lower().encode("utf-8", "replace")
        while data:
            piece, data = data, b""
            if len(piece) >= PIECE:
                cut = max(piece.rfind(space, 1, PIECE - 1) for space in (b" ", b"\n", b"\t"))
                cut = cut if cut > 0 else PIECE - 1
                piece, data = piece[:cut], piece[cut:]
            if size + len(piece) + 1 > PIECE:
                flush()
            batch.append((owner, piece))
            size += len(piece) + 1
            ends.append(size)
    flush()
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(owners)


def counted_shingles(texts: list[str], size: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingle, index of its text, how often it stands there): distinct for each text, in order of text and value."""
    hashes, owner = words(texts)
    if not len(hashes):
        return hashes, owner, np.zeros(0, np.int64)
    counts = np.bincount(owner, minlength=len(texts))
    room = np.repeat(np.cumsum(counts), counts) - np.arange(len(hashes))  # words from here to the end of the text
    starts = np.flatnonzero((room >= size) | ((room == counts[owner]) & (room < size)))
    value = np.zeros(len(starts), np.uint64)
    with np.errstate(over="ignore"):
        for step in range(size):
            inside = room[starts] > step
            at = np.minimum(starts + step, len(hashes) - 1)
            value = value * np.uint64(_ODD) + np.where(inside, hashes[at], np.uint64(step))
    value, owner = mixed(value, 1), owner[starts]
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    fresh = np.ones(len(value), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(fresh)
    return value[first], owner[first], np.diff(np.append(first, len(value)))


def shingles(texts: list[str], size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text and the index of their text."""
    return counted_shingles(texts, size)[:2]

"""Hierarchical packing of documents into windows of several lengths.

A document's full windows of the longest length stand alone. Its rest goes to the shortest tier that holds it.
Every tier packs its own windows, longest rests first; a gap takes the longest rest of the same or a shorter tier
that fits, and where none fits, a piece cut from the shortest rest that is left. So windows are full; only the last
one of a task can be short. Windows are then dealt to step groups of about equal tokens, the longest first to the
lightest group, so that every step sees the same mix of tiers.

Everything happens in the task that reads the documents, in blocks of bounded size: nothing is shuffled, a retried
task gives the same windows, and a short window of a block moves into the next one. Sequence ids are unique, not
dense: the task's number in the upper half, a counter in the lower.

Cases: null text counts as empty, and an empty text is its end id alone. Repeated rows and repeated or null ids are
packed like any others. Long texts are encoded whole and fill many windows. No rows give no windows. Other columns are
not read.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import whole_text
from waymark.llm.tokens import WORDS, encoder

TIERS = (256, 512, 1024, 2048)
#: Tokens of a block, and windows of the longest tier in a step group.
BLOCK, STEP = 1 << 21, 16
SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "window long, step_group long"
)


class Rests:
    """Unplaced pieces by length, with a bit set of the lengths there are."""

    def __init__(self) -> None:
        self.by: dict[int, list[tuple[int, int]]] = {}
        self.have = 0

    def add(self, length: int, piece: tuple[int, int]) -> None:
        self.by.setdefault(length, []).append(piece)
        self.have |= 1 << length

    def take(self, length: int) -> tuple[int, int]:
        pieces = self.by[length]
        piece = pieces.pop()
        if not pieces:
            del self.by[length]
            self.have &= ~(1 << length)
        return piece

    def longest(self, most: int) -> int:
        """The greatest length up to `most`, or 0."""
        return max((self.have & ((1 << (most + 1)) - 1)).bit_length() - 1, 0)

    def shortest(self) -> int:
        return (self.have & -self.have).bit_length() - 1


def windows(rests: Rests, tiers: tuple[int, ...]) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
    """(window length, its pieces as (document, start, length)); all are full, but perhaps the last."""
    for tier, below in zip(tiers[::-1], (*tiers[::-1][1:], 0), strict=True):
        while (length := rests.longest(tier)) > below:
            pieces, gap = [(*rests.take(length), length)], tier - length
            while gap and rests.have:
                if fits := rests.longest(gap):
                    pieces.append((*rests.take(fits), fits))
                    gap -= fits
                else:
                    length = rests.shortest()
                    document, start = rests.take(length)
                    pieces.append((document, start, gap))
                    rests.add(length - gap, (document, start + gap))
                    gap = 0
            yield tier, pieces


def pack_block(
    lengths: list[int], tiers: tuple[int, ...], carried: list[tuple[int, int, int]], last: bool
) -> tuple[list[tuple[int, list[tuple[int, int, int]]]], list[tuple[int, int, int]]]:
    """Windows of the documents with these lengths, and the pieces of a short one, which the next block takes over.

    `carried`: such pieces of the block before, under their numbers in this one.
    """
    rests, longest, packed = Rests(), tiers[-1], []
    for document, start, length in carried:
        rests.add(length, (document, start))
    taken_over = {document for document, _, _ in carried}
    for document, length in enumerate(lengths):
        if document in taken_over:
            continue
        whole = length - length % longest
        packed += [(longest, [(document, start, longest)]) for start in range(0, whole, longest)]
        if length > whole:
            rests.add(length - whole, (document, whole))
    for tier, pieces in windows(rests, tiers):
        if not last and sum(piece[2] for piece in pieces) < tier:
            return packed, pieces
        packed.append((tier, pieces))
    return packed, []


def step_groups(sizes: list[int], budget: int) -> list[int]:
    """A group for each window: the longest windows first, each to the group with the fewest tokens."""
    groups = [(0, group) for group in range(max(1, round(sum(sizes) / budget)))]
    dealt = [0] * len(sizes)
    for window in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        load, group = heapq.heappop(groups)
        dealt[window] = group
        heapq.heappush(groups, (load + sizes[window], group))
    return dealt


def _blocks(batches: Iterable[pd.DataFrame], encode, end: bytes, most: int):
    """Encoded documents in blocks of about `most` tokens; the flag says which block is the last."""
    block, tokens = [], 0
    for batch in batches:
        for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
            ids = encode(text) + end
            block.append((None if pd.isna(doc_id) else int(doc_id), ids))
            tokens += len(ids) // 4
            if tokens >= most:
                yield block, False
                block, tokens = [], 0
    yield block, True


def pack(
    docs: DataFrame, tokenizer: str, cut: str = WORDS, end_id: int = 1, tiers: tuple[int, ...] = TIERS,
    block: int = BLOCK, step: int = STEP, payload: bool = False,
) -> DataFrame:
    """One row per piece of a document, with its window and place; with `payload`, also its ids as bytes.

    A window holds a document's piece at `offset`; window `sequence_id` has `window` tokens when full.
    """
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get().partitionId() << 32
        encode, sequence, group, carried = encoder(tokenizer, cut).encode, task, task, []
        for fresh, last in _blocks(batches, encode, end, block):
            documents = [(doc_id, ids) for doc_id, ids, _, _ in carried] + fresh
            before = [(i, start, length) for i, (_, _, start, length) in enumerate(carried)]
            packed, short = pack_block([len(ids) // 4 for _, ids in documents], tiers, before, last)
            carried = [(*documents[document], start, length) for document, start, length in short]
            if not packed:
                continue
            sizes = [sum(piece[2] for piece in pieces) for _, pieces in packed]
            groups, rows = step_groups(sizes, step * tiers[-1]), []
            for (tier, pieces), dealt in zip(packed, groups, strict=True):
                offset = 0
                for document, start, length in pieces:
                    doc_id, ids = documents[document]
                    own = ids[4 * start : 4 * (start + length)]
                    row = (doc_id, start, length, zlib.crc32(own), len(ids) // 4, sequence, offset, tier, group + dealt)
                    rows.append((*row, own) if payload else row)
                    offset += length
                sequence += 1
            group += max(groups) + 1
            names = [part.split()[0] for part in schema.split(", ")]
            yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})

    schema = SCHEMA + (", ids binary" if payload else "")
    return docs.select(F.col("doc_id").cast("long"), whole_text().alias("text")).mapInPandas(run, schema)

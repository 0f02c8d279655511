"""Hard-negative mining with exact inner products by the method of the Four Russians.

The components of an anchor are cut into groups of eight, and each group gets a table of its 256 subset sums. Candidates
are integers in two's complement: bit b of the eight components of a group makes one byte, an index into the table. So a
score is a sum of lookups, shifted and added from the highest bit plane (whose weight is negative) to the lowest. No
candidate is left out and no score is estimated.

Two passes run over the same blocks of candidates. The first scores the rows of an anchor's own label and keeps its best
`positives`; the second scores all rows and keeps, per anchor and positive, the best `k` rows of other labels between
`low` and `high` hundredths of the positive's score. A task holds one block of candidates and one of anchors, both of
bounded size, and works on tiles of them; what leaves a block is at most k rows per anchor and positive. Blocks are dealt
by a hash of the id, so neither a frequent label nor a frequent vector makes a block large.

All pairs of anchors and rows are the task; the copies are not: a candidate travels once per block of anchors, an anchor
once per block of candidates, and both blocks are large.

Cases: rows with a null id or label, a null vector or a null or non-finite component take no part. Of several rows under
one anchor id the smallest (label, vector) asks; rows with the anchor's id are never its positives or negatives. Repeated
candidate rows count each; equal scores rank by the smaller id, among equal ids in any order (they look alike). Shorter
vectors count as filled up with zeros; empty ones score 0. Components of any finite size are exact: beyond 64 bits Python's
integers take over; a score outside the range of a long counts as its nearest end. A positive with a negative score has
no negatives, as its band is empty. No rows give no rows. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from waymark.llm.topk import usable
from waymark.session import tabled

#: Rows of a block of candidates and of anchors that one task holds, and of the tiles it works on.
CANDIDATES, ANCHORS, TILE, TILE_ANCHORS = 32_768, 8_192, 2_048, 256
LONGS = np.iinfo(np.int64)


def floors(vectors: pa.ChunkedArray, scale: float) -> np.ndarray:
    """Rows of integers floor(scale * x), filled up with zeros to a common width that is a multiple of eight."""
    lists = vectors.combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.chunk(0) if lists.num_chunks else pa.array([], lists.type)
    lengths = np.diff(lists.offsets.to_numpy())
    flat = np.floor(scale * lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    if np.abs(flat).max(initial=0) < 2.0**62:
        values = flat.astype(np.int64)
    else:
        values = np.array([int(x) for x in flat], dtype=object)
    width = -(-max(int(lengths.max(initial=0)), 1) // 8) * 8
    out = np.zeros((len(lengths), width), dtype=values.dtype)
    out[np.arange(width) < lengths[:, None]] = values
    return out


def bit_planes(vectors: np.ndarray) -> np.ndarray:
    """[plane, group of eight components, row] bytes; plane b holds bit b, the last plane the sign."""
    widest = max([int(vectors.max(initial=0)), -1 - int(vectors.min(initial=0)), 0])
    planes = [
        np.packbits(((vectors >> bit) & 1).astype(np.uint8), axis=1).T for bit in range(widest.bit_length() + 1)
    ]
    return np.ascontiguousarray(planes)


def subset_sums(anchors: np.ndarray, dtype) -> np.ndarray:
    """[group, byte, anchor]: the sum of the components of the group whose bits are set in the byte."""
    tables = []
    for first in range(0, anchors.shape[1], 8):
        table = np.zeros((1, len(anchors)), dtype=dtype)
        for column in range(first + 7, first - 1, -1):
            table = np.concatenate([table, table + anchors[:, column].astype(dtype)])
        tables.append(table)
    return np.array(tables, dtype=dtype)


def sum_type(vectors: np.ndarray, anchors: np.ndarray):
    """The narrowest integers that hold every score and the key made of a score and a place in a tile."""
    planes = max([int(vectors.max(initial=0)), -1 - int(vectors.min(initial=0)), 0]).bit_length() + 1
    largest = max(int(anchors.max(initial=0)), -int(anchors.min(initial=0)), 1)
    bound = (largest * anchors.shape[1]) << planes
    return np.int32 if bound < 2**31 else np.int64 if bound * 2 * TILE < 2**63 else object


def scores(planes: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """[row, anchor] inner products: lookups by the bytes of each plane, shifted and added."""
    shape = planes.shape[2], tables.shape[2]
    total, found = np.zeros(shape, dtype=tables.dtype), np.empty(shape, dtype=tables.dtype)
    for plane in range(len(planes) - 1, -1, -1):
        total += total
        for group, table in enumerate(tables):
            np.take(table, planes[plane, group], axis=0, out=found, mode="clip")
            if plane == len(planes) - 1:
                total -= found
            else:
                total += found
    return total


def _align(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    width = max(left.shape[1], right.shape[1])
    return tuple(np.pad(m, ((0, 0), (0, width - m.shape[1]))) if m.shape[1] < width else m for m in (left, right))


def _best(values: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, row) of the k best allowed rows per anchor of [row, anchor] scores; rows are in order of ids."""
    wide = values.astype(object if values.dtype == object else np.int64)
    count = len(wide)
    keys = np.ascontiguousarray((wide * count + np.arange(count - 1, -1, -1)[:, None]).T)
    lowest = keys.min(initial=0) - 1
    keys[~allowed.T] = lowest
    if count > k:
        rows = np.argpartition(keys, count - k, axis=1)[:, count - k :]
    else:
        rows = np.broadcast_to(np.arange(count), (keys.shape[0], count))
    anchors = np.repeat(np.arange(keys.shape[0]), rows.shape[1])
    rows = rows.ravel()
    fits = keys[anchors, rows] > lowest
    return anchors[fits], rows[fits]


def _tiles(candidates: np.ndarray, anchors: np.ndarray):
    """Scores of all candidates with all anchors, tile by tile: (first row, first anchor, scores)."""
    candidates, anchors = _align(candidates, anchors)
    dtype = sum_type(candidates, anchors)
    for first_anchor in range(0, len(anchors), TILE_ANCHORS):
        tables = subset_sums(anchors[first_anchor : first_anchor + TILE_ANCHORS], dtype)
        for first in range(0, len(candidates), TILE):
            values = scores(bit_planes(candidates[first : first + TILE]), tables)
            yield first, first_anchor, np.clip(values, LONGS.min, LONGS.max) if dtype is object else values


def _keep(found: list[tuple], names: list[str], group: list[str], k: int) -> pa.Table:
    """The k best of what the tiles found, per group."""
    columns = [np.concatenate([part[i] for part in found]) if found else np.array([], dtype=np.int64) for i in range(len(names))]
    data = dict(zip(names, columns, strict=True))
    order = np.lexsort([data["vec_id"], -data["score"], *(data[name] for name in group)])
    data = {name: column[order] for name, column in data.items()}
    changed = np.ones(len(order), dtype=bool)
    if len(order):
        changed[1:] = np.any([data[name][1:] != data[name][:-1] for name in group], axis=0)
    starts = np.flatnonzero(changed)
    place = np.arange(len(order)) - np.repeat(starts, np.diff([*starts, len(order)]))
    kept = {name: column[place < k] for name, column in data.items()}
    return pa.table({name: pa.array(column.astype(np.int64)) for name, column in kept.items()})


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    return table[name].to_numpy().astype(np.int64)


def own_label_block(block: pa.Table, anchors: pa.Table, scale: float, k: int) -> pa.Table:
    """anchor_id, vec_id, score of the k best rows of the anchor's label in this block."""
    block = block.sort_by("vec_id")
    ids, labels, vectors = _numbers(block, "vec_id"), _numbers(block, "label"), floors(block["vector"], scale)
    asking, wanted, queries = _numbers(anchors, "anchor_id"), _numbers(anchors, "label"), floors(anchors["vector"], scale)
    found = []
    for label in np.intersect1d(labels, wanted):
        rows, askers = np.flatnonzero(labels == label), np.flatnonzero(wanted == label)
        for first, first_asker, values in _tiles(vectors[rows], queries[askers]):
            in_tile, of_tile = rows[first : first + len(values)], askers[first_asker : first_asker + values.shape[1]]
            who, what = _best(values, ids[in_tile][:, None] != asking[of_tile][None, :], k)
            found.append((asking[of_tile[who]], ids[in_tile[what]], values[what, who]))
    return _keep(found, ["anchor_id", "vec_id", "score"], ["anchor_id"], k)


def band_block(block: pa.Table, anchors: pa.Table, scale: float, k: int) -> pa.Table:
    """anchor_id, place, vec_id, score of the k best rows of other labels in the band of each positive."""
    block = block.sort_by("vec_id")
    ids, labels, vectors = _numbers(block, "vec_id"), _numbers(block, "label"), floors(block["vector"], scale)
    asking, wanted, queries = _numbers(anchors, "anchor_id"), _numbers(anchors, "label"), floors(anchors["vector"], scale)
    bands = anchors["bands"].to_pylist()
    most = max(map(len, bands), default=0)
    found = []
    for first, first_asker, values in _tiles(vectors, queries):
        of_tile = slice(first_asker, first_asker + values.shape[1])
        in_tile = slice(first, first + len(values))
        other = (labels[in_tile][:, None] != wanted[of_tile][None, :]) & (ids[in_tile][:, None] != asking[of_tile][None, :])
        for number in range(most):
            empty = {"place": 0, "least": 1, "greatest": 0}
            mine = [band[number] if number < len(band) else empty for band in bands[of_tile]]
            least, greatest = (np.array([band[end] for band in mine], dtype=np.int64) for end in ("least", "greatest"))
            if (least > greatest).all():
                continue
            who, what = _best(values, other & (values >= least) & (values <= greatest), k)
            places = np.array([band["place"] for band in mine], dtype=np.int64)
            found.append((asking[of_tile][who], places[who], ids[in_tile][what], values[what, who]))
    return _keep(found, ["anchor_id", "place", "vec_id", "score"], ["anchor_id", "place"], k)


def _range(count: int) -> Column:
    return F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long"))


def _pair(candidates: DataFrame, anchors: DataFrame, blocks: int, parts: int, run, schema: str) -> DataFrame:
    """`run` on every block of candidates with every block of anchors."""
    left = candidates.withColumn("part", F.explode(_range(parts))).repartition(blocks * parts, "block", "part")
    right = anchors.withColumn("block", F.explode(_range(blocks))).repartition(blocks * parts, "block", "part")
    # the fixed numbers of partitions keep small blocks in tasks of their own
    return left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(run, schema)


def mine(
    rows: DataFrame, is_anchor: Column, positives: int = 5, k: int = 10, low: int = 30, high: int = 90, scale: float = 256.0
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for rows of vec_id, label and embedding."""
    vector = F.transform("embedding", lambda x: x.cast("double")).alias("vector")
    taking_part = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable())
    size = taking_part.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(is_anchor, 1)).alias("a")).first()
    # a few blocks per core at least, so that all work, and no more rows in one than a task can hold
    cores = taking_part.sparkSession.sparkContext.defaultParallelism
    blocks = max(-(-size["n"] // CANDIDATES), min(4 * cores, -(-size["n"] // TILE)), 1)
    parts = max(-(-size["a"] // ANCHORS), 1)
    block = F.pmod(F.xxhash64("vec_id", "vector"), F.lit(blocks)).alias("block")
    named = taking_part.select("vec_id", F.col("label").cast("long").alias("label"), vector, is_anchor.alias("asks"))
    candidates = named.select("vec_id", "label", "vector", block)
    least = F.min(F.struct("label", "vector"))
    anchors = named.where("asks").groupBy(F.col("vec_id").alias("anchor_id")).agg(least.alias("one"))
    part = F.pmod(F.xxhash64("anchor_id"), F.lit(parts)).alias("part")
    anchors = anchors.select("anchor_id", "one.label", "one.vector", part)

    own = _pair(
        candidates, anchors, blocks, parts, lambda one, two: own_label_block(one, two, scale, positives),
        "anchor_id long, vec_id long, score long",
    )
    first = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id")
    pairs = tabled(own.withColumn("place", F.row_number().over(first)).where(F.col("place") <= positives))  # read twice below

    # low * positive <= 100 * negative <= high * positive, as the whole numbers between the two ends
    exact = F.col("score").cast("decimal(25,0)")
    least_score = F.ceil(exact * low / 100).cast("long").alias("least")
    greatest = F.floor(exact * high / 100).cast("long").alias("greatest")
    bands = pairs.where(least_score <= greatest).groupBy("anchor_id").agg(
        F.sort_array(F.collect_list(F.struct(F.col("place").cast("long").alias("place"), least_score, greatest))).alias("bands")
    )  # at most `positives` entries
    asking = anchors.join(bands, "anchor_id")
    found = _pair(
        candidates, asking, blocks, parts, lambda one, two: band_block(one, two, scale, k),
        "anchor_id long, place long, vec_id long, score long",
    )
    best = Window.partitionBy("anchor_id", "place").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    chosen = pairs.select("anchor_id", "place", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return ranked.join(chosen, ["anchor_id", "place"]).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )

"""Exact top-k search by inner product, as threshold aggregation without random access (Fagin et al. 2003).

Vectors become integers, floor(scale * x). Candidates lie in tiles of bounded size, and a tile has one list per
dimension, sorted by value. A query reads each list from the end that the sign of its component prefers, all to the same
depth, some entries at a time; lists of components that are zero are not read. Counted from a list's far end, no
entry lowers a score. So the entries read of a candidate add up to its lower bound, and with the values at the depths
reached for the lists that have not shown it yet, to its upper bound. Reading stops when no candidate outside the k with
the greatest lower bounds can reach the least of these; their final scores are then resolved. Candidates whose lower bound
plus all values at the depths does not reach it need no upper bound of their own. The k best of all tiles are merged.

Every block of queries meets every block of candidates in a task of its own, which cuts it into tiles. Blocks are large, so
a candidate travels once per `QUERIES` queries. Bounds are exact: integers in double precision, or Python's integers
where sums could pass 2**53.

Cases: vectors that are null or hold null or non-finite components take no part, nor do rows without id. A query's own
row is every row with its id. Of several rows under one query id the smallest vector asks. Shorter vectors count as
filled up with zeros; empty ones score 0. Equal scores rank by the smaller id; repeated candidate rows are listed each.
No rows give no rows. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of a block of candidates and of queries, rows of a tile; the parts of its lists after which bounds are compared.
CANDIDATES, QUERIES, TILE = 32_768, 8_192, 4_096
DEPTHS = (1 / 64, 1 / 16, 1 / 4, 1 / 2, 3 / 4, 7 / 8, 15 / 16, 1.0)
FOUND = "query_id long, vec_id long, score long"


def integers(vector: str = "embedding", scale: float = 256.0) -> Column:
    return F.transform(F.col(vector), lambda x: F.floor(F.lit(scale) * x.cast("double")))


def usable(vector: str = "embedding") -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.col(vector).isNotNull() & ~F.coalesce(bad, F.lit(True))


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for row, vector in zip(out, vectors, strict=True):
        row[: len(vector)] = vector
    return out


class Lists:
    """The candidates of a tile, sorted by each dimension, from both ends."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        self.ids, self.vectors = ids, vectors
        self.count, self.width = vectors.shape
        rising = np.argsort(vectors.T, axis=1, kind="stable")  # [dimension, place] -> row
        place = np.empty_like(rising)
        np.put_along_axis(place, rising, np.broadcast_to(np.arange(self.count), rising.shape), axis=1)
        values = np.take_along_axis(vectors.T, rising, axis=1)
        #: Lists 0 to width - 1 begin with the least value, the others with the greatest.
        self.rows = np.concatenate([rising, rising[:, ::-1]])
        self.values = np.concatenate([values, values[:, ::-1]])
        self.places = np.concatenate([place, self.count - 1 - place])

    def best(self, query_id: int, query: np.ndarray, k: int, depths: tuple = DEPTHS) -> tuple[np.ndarray, int]:
        """Rows that hold the k best candidates but for the query's own row, and how many list entries were read."""
        count, others = self.count, self.ids != query_id
        used = np.flatnonzero(query)
        if others.sum() <= k or not len(used):
            return np.flatnonzero(others), 0
        weight = query[used, None]
        lists = used + np.where(query[used] > 0, self.width, 0)
        far = self.values[lists, -1][:, None]
        lower, at, able = np.zeros(count), 0, np.flatnonzero(others)
        for depth in depths:
            to = min(count, max(at + 1, int(np.ceil(depth * count))))
            gains = (self.values[lists, at:to] - far) * weight
            lower += np.bincount(self.rows[lists, at:to].ravel(), weights=gains.ravel(), minlength=count)
            at = to
            reached = gains[:, -1]  # no entry that is still unread is worth more
            least = np.partition(lower[others], -k)[-k]
            able = np.flatnonzero(others & (lower + reached.sum() >= least))
            if len(able) <= count // 4:  # few enough to give each a bound of its own
                unread = self.places[lists][:, able] >= at
                able = able[lower[able] + reached @ unread >= least]
                if len(able) <= k:  # only the k with the greatest lower bounds are left
                    break
            if at == count:
                break
        return able, at * len(used)


def search_block(
    ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, depths: tuple = DEPTHS
) -> tuple[list[tuple[int, int, int]], int]:
    """The k best candidates of each query among these, and how many list entries were read for them."""
    lists, found, read = Lists(ids, vectors), [], 0
    for query_id, query in zip(query_ids, queries, strict=True):
        rows, entries = lists.best(query_id, query, k, depths)
        read += entries
        scores = vectors[rows] @ query
        chosen = np.lexsort((ids[rows], -scores))[:k]
        found += [(int(query_id), int(ids[rows[i]]), int(scores[i])) for i in chosen]
    return found, read


def _exact_block(ids, vectors, query_ids, queries, k: int) -> list[tuple[int, int, int]]:
    """The same by Python's integers, for vectors whose scores pass 2**53."""
    found = []
    for query_id, query in zip(query_ids, queries, strict=True):
        scores = [
            (-sum(int(a) * int(b) for a, b in zip(query, vector, strict=False)), int(id_))
            for id_, vector in zip(ids, vectors, strict=True) if id_ != query_id
        ]
        found += [(int(query_id), id_, -score) for score, id_ in sorted(scores)[:k]]
    return found


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, candidates: int = CANDIDATES, asking: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score. Both inputs have vec_id and `ints`, an array of integers."""

    def run(block: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(block) or not len(asked):
            return pd.DataFrame([], columns=["query_id", "vec_id", "score"])
        width = max(map(len, [*block["ints"], *asked["ints"]]))
        ids, query_ids = block["vec_id"].to_numpy(np.int64), asked["vec_id"].to_numpy(np.int64)
        left, right = _matrix(block["ints"], width), _matrix(asked["ints"], width)
        if 2 * np.abs(left).max(initial=0) * np.abs(right).max(initial=0) * width < 2**53:
            found = []
            for first in range(0, len(ids), TILE):
                tile = slice(first, first + TILE)
                found += search_block(ids[tile], left[tile], query_ids, right, k)[0]
        else:
            found = _exact_block(ids, block["ints"], query_ids, asked["ints"], k)
        best = pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
        return best.groupby("query_id").head(k)

    queries = queries.groupBy("vec_id").agg(F.min("ints").alias("ints"))
    size, cores = vectors.count(), vectors.sparkSession.sparkContext.defaultParallelism
    # a few blocks per core at least, so that all work, and no more rows in one than a task can hold
    blocks = max(-(-size // candidates), min(4 * cores, -(-size // TILE)), 1)
    query_blocks = max(1, -(-queries.count() // asking))
    spread = F.pmod(F.xxhash64("vec_id", "ints"), F.lit(blocks))
    left = vectors.select("vec_id", "ints", spread.alias("block"), F.explode(_range(query_blocks)).alias("part"))
    part = F.pmod(F.xxhash64("vec_id"), F.lit(query_blocks))
    right = queries.select("vec_id", "ints", F.explode(_range(blocks)).alias("block"), part.alias("part"))
    # the fixed number of partitions keeps blocks in tasks of their own
    left, right = (rows.repartition(blocks * query_blocks, "block", "part") for rows in (left, right))
    found = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInPandas(run, FOUND)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _range(count: int) -> Column:
    return F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long"))

"""Near-duplicates by DartMinHash (Christiani 2020), banded joins and exact checks.

Signatures. Hashed darts are thrown into the plane of weight and rank of every element (shingle), about one per unit of
area, by hashes of element and unit cell alone. A text of weight w keeps the darts inside its elements' weights whose
rank is below t / w, with t = k ln k + 2k, so about t darts whatever its size. Every dart has one of k coordinates, and
the earliest dart of each is the signature there. If a coordinate has none, the rank limit doubles. Two texts agree in a
coordinate with the probability of their weighted Jaccard similarity. The weight of a shingle is 1 + ln(times it stands in
the text): for texts without repetition similarity is the plain Jaccard one, repeated lines count more, but not by their number.

Joins. Texts with equal weighted sets of shingles collapse first. The others meet in buckets: `BANDS` bands of `ROWS` coordinates
bring two texts of similarity 0.8 together with a probability of 0.999. No bucket is expanded into all its pairs.
Every member is checked against one member, the one that shares the most buckets; links make components. Buckets that
still hold several components are looked at once more: the members outside the largest one against all members of other
components, but for pairs that are proved to be dissimilar by what both share with the centre. So each pair of a bucket is checked,
proved or already in one class. A check compares whole weighted sets of shingles.

Hot groups: counts and centres are aggregates that sum before they shuffle, and the joins that carry rows are between
stored tables, whose hot keys Spark splits.

A row is known by doc_id and the digest of its text, so different texts under one id are rows of their own. A class is known
by its representative, the least (doc_id, digest): columns class_id and class_text.

Cases: null text counts as empty; texts without words are alone, each in a class of its own, and texts of fewer than five
words have one shingle. Repeated rows are in one class, of which one row stays; unlike texts under one id are in different
classes, with equal class_id but different class_text, and both stay. A null doc_id is not in the
result of `near_duplicates` and stays in that of `representatives`. Very long texts are hashed whole. No rows give no
rows. Other columns are not read by the first and pass through the second.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import spare_names, stage, whole_text, work_dir
from waymark.llm.shingles import counted_shingles, mixed
from waymark.operators.components import connected_components

BANDS, ROWS, SIMILARITY = 24, 6, 0.8
#: Cells of the plane that one step of a task looks at.
CELLS = 1 << 21
#: Distribution of the darts in a cell: Poisson with mean one.
_DARTS = np.cumsum([math.exp(-1) / math.factorial(n) for n in range(12)])
#: Bits of the map of a text's shingles that its centre lacks: a power of two.
BITS = 1024
_LATE = np.uint64(2**64 - 1)


def _throw(elements: np.ndarray, weights: np.ndarray, owner: np.ndarray, limit: np.ndarray, k: int, out: np.ndarray) -> None:
    """Lower `out[text, coordinate]` to the earliest dart of these elements with rank below the text's limit."""
    with np.errstate(over="ignore"):
        tall, wide = np.ceil(limit).astype(np.int64), np.ceil(weights).astype(np.int64)
        cells = wide * tall[owner]
        which = np.repeat(np.arange(len(elements)), cells)
        inner = np.arange(len(which)) - np.repeat(np.cumsum(cells) - cells, cells)
        column, slab = inner // tall[owner[which]], inner % tall[owner[which]]
        seed = mixed(elements[which] + mixed(column.astype(np.uint64) << np.uint64(32) | slab.astype(np.uint64), 2), 3)
        darts = np.searchsorted(_DARTS, (seed >> np.uint64(11)) * 2.0**-53, side="right")
        cell = np.repeat(np.arange(len(which)), darts)
        number = np.arange(len(cell)) - np.repeat(np.cumsum(darts) - darts, darts)
        dart = mixed(seed[cell] + number.astype(np.uint64), 4)
        fine = dart >> np.uint64(32)
        rank = slab[cell] + fine * 2.0**-32
        which = which[cell]
        height = column[cell] + (mixed(dart, 5) >> np.uint64(11)) * 2.0**-53
        hit = (rank < limit[owner[which]]) & (height < weights[which])
        place = owner[which[hit]] * k + (mixed(dart[hit], 6) % np.uint64(k)).astype(np.int64)
        early = (slab[cell[hit]].astype(np.uint64) << np.uint64(32)) | fine[hit]
    np.minimum.at(out.reshape(-1), place, early)


def signatures(elements: np.ndarray, weights: np.ndarray, owner: np.ndarray, texts: int, k: int) -> np.ndarray:
    """One row of k values per text; rows of texts without elements or weight stay at the maximum."""
    out = np.full((texts, k), _LATE)
    whole = np.bincount(owner, weights, texts)
    limit = np.divide(k * math.log(k) + 2 * k, whole, out=np.zeros(texts), where=whole > 0)
    open_ = whole > 0
    while open_.any():
        mine = np.flatnonzero(open_[owner])
        cost = np.cumsum(np.ceil(weights[mine]) * np.ceil(limit[owner[mine]]))
        for part in np.split(mine, np.searchsorted(cost, np.arange(CELLS, cost[-1], CELLS))) if len(mine) else []:
            if len(part):
                _throw(elements[part], weights[part], owner[part], limit, k, out)
        open_ &= (out == _LATE).any(axis=1)
        limit[open_] *= 2
    return out


def band_keys(rows: np.ndarray, bands: int) -> np.ndarray:
    """One value per text and band."""
    parts = rows.reshape(len(rows), bands, -1)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64), parts.shape[:2]).copy()
    for column in range(parts.shape[2]):
        key = mixed(key + parts[:, :, column], 7)
    return key


def weights(counts: np.ndarray) -> np.ndarray:
    """The weight of a shingle that stands so often in a text; at least 1."""
    return 1.0 + np.log(counts)


def _sketch(bands: int, rows: int):
    """Per document: number and whole weight of its shingles, two hashes of their weighted set, the keys of its bands."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.iloc[at : at + 512]
                values, owner, counts = counted_shingles(list(part["text"]))
                heavy = weights(counts)
                keys = band_keys(signatures(values, heavy, owner, len(part), bands * rows), bands)
                with np.errstate(over="ignore"):
                    sets = [np.zeros(len(part), np.uint64) for _ in range(2)]
                    own = values + mixed(counts.astype(np.uint64) - np.uint64(1), 10) - mixed(np.zeros(1, np.uint64), 10)
                    for n, total in enumerate(sets):
                        np.add.at(total, owner, mixed(own, 8 + n))
                yield pd.DataFrame({
                    "doc_id": part["doc_id"].to_numpy(), "digest": part["digest"].to_numpy(),
                    "shingles": np.bincount(owner, minlength=len(part)), "weight": np.bincount(owner, heavy, len(part)),
                    "set_a": sets[0].view(np.int64), "set_b": sets[1].view(np.int64), "bands": list(keys.view(np.int64)),
                })

    return run


def packed(values: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes | None]:
    """A text's shingles as sorted 32-bit values, and their counts if any is not 1."""
    small, first = np.unique((values >> np.uint64(32)).astype("<u4"), return_index=True)
    counts = counts[first]
    return small.tobytes(), counts.astype("<u4").tobytes() if (counts > 1).any() else None


def _unpacked(values: bytes, counts: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    values = np.frombuffer(values, "<u4")
    return values, np.ones(len(values)) if counts is None else weights(np.frombuffer(counts, "<u4"))


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The packed set of each node's text."""
    for batch in batches:
        for at in range(0, len(batch), 512):
            part = batch.iloc[at : at + 512]
            values, owner, counts = counted_shingles(list(part["text"]))
            ends = np.cumsum(np.bincount(owner, minlength=len(part)))[:-1]
            rows = [packed(*own) for own in zip(np.split(values, ends), np.split(counts, ends), strict=True)]
            yield pd.DataFrame({"node": part["node"].to_numpy(), "members": [v for v, _ in rows], "counts": [c for _, c in rows]})


def _outline(extra: np.ndarray, heavy: np.ndarray) -> tuple[list[int], float]:
    """A bit map of these values, and what their weights come to beyond one for each bit."""
    bits = np.zeros(BITS, bool)
    bits[extra >> np.uint32(32 - BITS.bit_length() + 1)] = True
    return np.packbits(bits).view(np.int64).tolist(), float(heavy.sum() - bits.sum())


def similar(left: tuple, right: tuple, least: float, outlines: bool = False) -> tuple:
    """Whether two packed sets have a weighted Jaccard similarity of at least `least`, and the weight of what they share
    in each; with `outlines`, also maps of what the other lacks."""
    (one, heavy_one), (two, heavy_two) = _unpacked(*left), _unpacked(*right)
    _, here, there = np.intersect1d(one, two, assume_unique=True, return_indices=True)
    common = np.minimum(heavy_one[here], heavy_two[there]).sum()
    whole = heavy_one.sum() + heavy_two.sum()
    row = bool(common >= least * (whole - common) - 1e-9), float(heavy_one[here].sum()), float(heavy_two[there].sum())
    if outlines:
        for own, heavy, shared in ((one, heavy_one, here), (two, heavy_two, there)):
            rest = np.ones(len(own), bool)
            rest[shared] = False
            row += _outline(own[rest], heavy[rest])
    return row


def _compared(least: float, outlines: bool):
    names = ["a", "b", "alike", "inside_a", "inside_b", "bits_a", "lost_a", "bits_b", "lost_b"][: 9 if outlines else 5]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            columns = [batch[name] for name in ("a", "b", "left", "left_counts", "right", "right_counts")]
            rows = [(a, b, *similar((v, n), (w, m), least, outlines)) for a, b, v, n, w, m in zip(*columns, strict=True)]
            yield pd.DataFrame(rows, columns=names)

    return run


def _checked(pairs: DataFrame, sets: DataFrame, least: float, outlines: bool = False) -> DataFrame:
    """The pairs with the weights they share, and whether their similarity is at least `least`.

    With `outlines`, also bit maps of the shingles of each that the other lacks.
    """
    left = sets.select(F.col("node").alias("a"), F.col("members").alias("left"), F.col("counts").alias("left_counts"))
    right = sets.select(F.col("node").alias("b"), F.col("members").alias("right"), F.col("counts").alias("right_counts"))
    schema = "a long, b long, alike boolean, inside_a double, inside_b double"
    if outlines:
        schema += ", bits_a array<long>, lost_a double, bits_b array<long>, lost_b double"
    return pairs.join(left, "a").join(right, "b").mapInPandas(_compared(least, outlines), schema)


def _ordered(a: str, b: str) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def digest(text: Column) -> Column:
    """What tells texts under one id apart: 128 bits."""
    return F.unhex(F.md5(text.cast("binary")))


def classes(docs: DataFrame, folder: str, bands: int = BANDS, rows: int = ROWS, least: float = SIMILARITY) -> DataFrame:
    """doc_id, digest, class_id, class_text, class_size, kept, for each row with a doc_id.

    `digest` is that of the row's text, class_id and class_text those of the class's representative, the row that is kept.
    """
    texts = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), whole_text().alias("text"))
    texts = texts.withColumn("digest", digest(F.col("text")))
    schema = "doc_id long, digest binary, shingles long, weight double, set_a long, set_b long, bands array<long>"
    sketches = stage(texts.mapInPandas(_sketch(bands, rows), schema), folder, "sketches")

    # a node stands for a distinct set of shingles; its number is fixed where the table is written
    own = ["shingles", "set_a", "set_b"]
    some = sketches.where("shingles > 0").select("doc_id", "digest", *own, "weight")
    head = F.min(F.struct("doc_id", "digest")).alias("head")
    heads = some.groupBy(*own).agg(head, F.min("weight").alias("weight"))
    heads = heads.select(*own, "weight", F.col("head.doc_id").alias("doc_id"), F.col("head.digest").alias("digest"))
    heads = stage(heads.withColumn("node", F.monotonically_increasing_id()), folder, "heads")
    member_of = some.join(heads.select(*own, "node"), own).select("doc_id", "digest", "node")
    member_of = stage(member_of, folder, "member_of")

    # the head's own row alone; equal rows under one id have equal bands
    first = sketches.select("doc_id", "digest", "bands").join(heads.select("doc_id", "digest", "node", "weight"), ["doc_id", "digest"])
    keys = first.select("node", "weight", F.explode("bands").alias("bucket")).distinct()
    keys = stage(keys, folder, "keys")
    sizes = keys.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = stage(keys.join(stage(sizes, folder, "sizes"), "bucket"), folder, "members")

    # star: everyone against the member that shares the most buckets with others
    reach = stage(members.groupBy("node").agg(F.sum("size").alias("reach")), folder, "reach")
    central = F.max(F.struct(F.col("reach"), -F.col("node")))
    centres = members.join(reach, "node").groupBy("bucket").agg((-central["col2"]).alias("centre"))
    centres = stage(centres, folder, "centres")
    star = members.join(centres, "bucket").where("node <> centre").select(*_ordered("node", "centre")).distinct()
    star = stage(star, folder, "star")

    wanted = stage(members.select("node").distinct(), folder, "wanted")
    named = stage(heads.join(wanted, "node").select("doc_id", "digest", "node"), folder, "named")
    sets = texts.join(named.hint("merge"), ["doc_id", "digest"]).mapInPandas(_sets, "node long, members binary, counts binary")
    sets = stage(sets.dropDuplicates(["node"]), folder, "sets")
    star = stage(_checked(star, sets, least, outlines=True), folder, "compared")
    links = star.where("alike").select("a", "b")
    roots = stage(connected_components(wanted, links, []), folder, "roots")

    # buckets with several components: those outside the largest against all of another component
    placed = members.join(roots, "node")
    placed = stage(placed.select("bucket", "node", "weight", "root"), folder, "placed")
    parts = placed.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n"))
    largest = parts.groupBy("bucket").agg(F.max(F.struct("n", "root"))["root"].alias("main"), F.count(F.lit(1)).alias("parts"))
    mixed_ = stage(largest.where("parts > 1"), folder, "mixed")
    inside = placed.join(mixed_.select("bucket", "main"), "bucket").join(centres, "bucket")
    inside = inside.select("*", *_ordered("node", "centre")).join(star, ["a", "b"], "left")
    first = F.col("node") == F.col("a")
    inside = inside.select(
        "bucket", "node", "weight", "root", "main",
        F.coalesce(F.when(first, F.col("inside_a")).otherwise(F.col("inside_b")), "weight").alias("inside"),
        F.when(first, F.col("bits_a")).otherwise(F.col("bits_b")).alias("bits"),
        F.coalesce(F.when(first, F.col("lost_a")).otherwise(F.col("lost_b")), F.lit(0.0)).alias("lost"),
    )
    inside = stage(inside, folder, "inside")
    outside = inside.where("root <> main").select(
        "bucket", F.col("node").alias("other"), F.col("root").alias("its"), F.col("weight").alias("its_weight"),
        F.col("inside").alias("its_inside"), F.col("bits").alias("its_bits"), F.col("lost").alias("its_lost"),
    )
    # What two texts have in common is part of the centre's shingles, at most the less that either has of them, or not, at
    # most what their maps of other shingles allow: one for a common bit, and the less of what the weights come to beyond
    # that. Where it is too little the pair is proved to be dissimilar.
    shared = sum((F.bit_count(F.col("bits")[i].bitwiseAND(F.col("its_bits")[i])) for i in range(BITS // 64)), F.lit(0))
    most = F.least("inside", "its_inside") + F.coalesce(shared, F.lit(0)) + F.least("lost", "its_lost")
    able = most >= least / (1 + least) * (F.col("weight") + F.col("its_weight")) - 1e-6
    again = inside.join(outside, "bucket").where(able).where("root <> its AND (root = main OR node < other)")
    again = again.select(*_ordered("node", "other")).distinct().join(star, ["a", "b"], "left_anti")
    more = stage(_checked(stage(again, folder, "again"), sets, least).where("alike").select("a", "b"), folder, "more")
    if not more.isEmpty():
        roots = stage(connected_components(wanted, links.union(more), []), folder, "all_roots")

    rooted = member_of.join(roots, "node", "left").select("doc_id", "digest", F.coalesce("root", "node").alias("root"))
    rooted = stage(rooted, folder, "rooted")
    chief = F.min(F.struct("doc_id", "digest")).alias("chief")
    counted = stage(rooted.groupBy("root").agg(chief, F.count(F.lit(1)).alias("class_size")), folder, "counted")
    found = rooted.join(counted, "root").select(
        "doc_id", "digest", F.col("chief.doc_id").alias("class_id"), F.col("chief.digest").alias("class_text"), "class_size"
    )
    alone = sketches.where("shingles = 0").select(
        "doc_id", "digest", F.col("doc_id").alias("class_id"), F.col("digest").alias("class_text"), F.lit(1).cast("long").alias("class_size")
    )
    kept = (F.col("doc_id") == F.col("class_id")) & (F.col("digest") == F.col("class_text"))
    return found.unionByName(alone).withColumn("kept", kept)


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    return classes(docs, work_dir(docs.sparkSession, "dart-minhash"), **options)


def representatives(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns: the representative of each class, and rows without id.

    Of rows that repeat a representative's id and text, one stays.
    """
    its, text, copy = spare_names(docs, 3)
    keyed = docs.withColumn(text, F.when(F.col("doc_id").isNotNull(), digest(whole_text())))
    gone = found.where(~F.col("kept")).select(F.col("doc_id").alias(its), F.col("digest").alias(copy)).distinct()
    same = (F.col("doc_id").cast("long") == F.col(its)) & (F.col(text) == F.col(copy))
    kept = keyed.join(gone, same, "left_anti")
    repeated = found.where("kept").groupBy(F.col("doc_id").alias(its), F.col("digest").alias(copy)).agg(F.count(F.lit(1)).alias("n"))
    repeated = repeated.where("n > 1").drop("n")
    if repeated.isEmpty():
        return kept.drop(text)
    ones = kept.join(repeated, same, "left_semi").dropDuplicates(["doc_id", text])
    return kept.join(repeated, same, "left_anti").unionByName(ones).drop(text)

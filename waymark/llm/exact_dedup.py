"""Exact deduplication of an incoming batch against immutable snapshots, by filters, exact buckets and byte checks.

A snapshot is written once: its documents, its exact buckets (one row per digest: how often, and whose text
stands for it) and a binary fuse filter per bucket of digests. The digests of a batch, one row for each, meet the
filters of their bucket; only positives are joined with the exact buckets. Texts move for digests that occur more than
once, in the batch or with a snapshot, and only these are compared byte by byte with the text that stands for the
digest. Copies within the batch are grouped on their own, so a new text needs no snapshot.

Texts with equal digests and different bytes form classes of their own (by a second digest), so the classes are exact
even with a weak digest. Hot texts: counts are taken before rows move, and the joins that carry rows are between stored
tables, whose hot keys Spark splits.

Cases: null text counts as empty; the empty text is a text like any other. Of rows with equal doc_id and text all are
listed with the same values, and `apply` leaves one. Null doc_ids count as copies and never stay unless all of the class
are null. No rows give no rows. Other columns are not read by `classes` and pass through `apply`.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm import fuse
from waymark.llm.common import spare_names, stage, whole_text, work_dir

#: Digests of a filter.
BUCKET = 1 << 16
FILTERS = "bucket long, buckets long, seed long, segment long, count long, cells binary"


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


@dataclass
class Snapshot:
    documents: DataFrame  # doc_id, digest, text
    exact: DataFrame  # digest, copies, most, stands: greatest and smallest doc_id, whose text stands for it
    filters: DataFrame


def _hash(column: str = "digest") -> Column:
    return F.xxhash64(column)


def _bucketed(digests: DataFrame, buckets: int) -> DataFrame:
    return digests.withColumn("_hash", _hash()).withColumn("_bucket", F.pmod(F.xxhash64("_hash"), F.lit(buckets)))


def _digested(docs: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text"))
    return rows.withColumn("digest", digest(F.col("text")))


def _per_digest(light: DataFrame) -> DataFrame:
    """One row per digest, summed before rows move."""
    return light.groupBy("digest").agg(
        F.count(F.lit(1)).alias("copies"), F.max("doc_id").alias("most"), F.min("doc_id").alias("stands")
    )


def _filters(exact: DataFrame, bucket: int) -> DataFrame:
    buckets = max(1, -(-exact.count() // bucket))

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        stored = fuse.build(rows["_hash"].to_numpy().astype(np.int64).view(np.uint64))
        row = (int(rows["_bucket"].iloc[0]), buckets, *stored)
        return pd.DataFrame([row], columns=[part.split()[0] for part in FILTERS.split(", ")])

    digests = _bucketed(exact.select("digest"), buckets)
    return digests.select("_bucket", "_hash").groupBy("_bucket").applyInPandas(build, FILTERS)


def _clashes(rows: DataFrame, standing: DataFrame) -> DataFrame:
    """Rows whose bytes differ from those of the text that stands for their digest, with a second digest."""
    compared = rows.join(standing, "digest")
    return compared.where("text <> _text").select("doc_id", "digest", F.sha2(F.col("text").cast("binary"), 512).alias("other"))


def _standing(rows: DataFrame, digests: DataFrame) -> DataFrame:
    """The texts of these digests: that of the row whose doc_id stands for it."""
    wanted = digests.select(F.col("digest").alias("_its"), "stands")
    own = rows.join(wanted, (F.col("digest") == F.col("_its")) & F.col("doc_id").eqNullSafe(F.col("stands")))
    return own.groupBy("digest").agg(F.min("text").alias("_text"))


def build_snapshot(docs: DataFrame, folder: str, digest: Callable[[Column], Column] = sha256, bucket: int = BUCKET) -> Snapshot:
    """Write the exact buckets and filters of these documents."""
    rows = _digested(docs, digest)
    exact = stage(_per_digest(rows), folder, "exact")
    return Snapshot(rows, exact, stage(_filters(exact, bucket), folder, "filters"))


def screen(digests: DataFrame, snapshot: Snapshot) -> DataFrame:
    """The digests that the snapshot's filters let through: all it has, and about one in 256 others."""

    def check(asked: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
        if not len(filters) or not len(asked):
            return asked[["digest"]].iloc[:0]
        own = filters.iloc[0]
        hashes = asked["_hash"].to_numpy().astype(np.int64).view(np.uint64)
        return asked.loc[fuse.contains(hashes, own["seed"], own["segment"], own["count"], own["cells"]), ["digest"]]

    buckets = (snapshot.filters.agg(F.max("buckets")).first() or [None])[0] or 1
    asked = _bucketed(digests.select("digest"), buckets)
    return asked.groupBy("_bucket").cogroup(snapshot.filters.groupBy("bucket")).applyInPandas(check, "digest string")


def classes(
    batch: DataFrame, held: DataFrame, folder: str, digest: Callable[[Column], Column] = sha256, bucket: int = BUCKET
) -> DataFrame:
    """One row per document of the batch and the snapshot: doc_id, keep_id, group_size, kept, digest, other.

    `held` are the documents of the snapshot, `batch` those that come in. `other` tells classes of one digest apart.
    """
    snapshot = build_snapshot(held, f"{folder}/snapshot", digest, bucket)
    incoming = _digested(batch, digest)
    fresh = stage(_per_digest(incoming), folder, "incoming")
    hits = stage(screen(fresh, snapshot).join(snapshot.exact, "digest"), folder, "hits")

    # byte checks: copies inside the snapshot, copies inside the batch, and the batch against the snapshot
    again = snapshot.exact.where("copies > 1").select("digest", "stands")
    known = hits.select("digest", "stands")
    first = stage(fresh.where("copies > 1").join(hits, "digest", "left_anti").select("digest", "stands"), folder, "first")
    known = stage(again.union(known).distinct(), folder, "known")
    # by merging at every size: these digests grow with the corpus, and so does what would be broadcast
    held_rows = stage(snapshot.documents.join(known.select("digest").hint("merge"), "digest"), folder, "held_rows")
    new_digests = hits.select("digest").union(first.select("digest")).hint("merge")
    new_rows = stage(incoming.join(new_digests, "digest"), folder, "new_rows")
    texts = stage(_standing(held_rows, known).union(_standing(new_rows, first)), folder, "texts")
    clashes = _clashes(held_rows, texts).union(_clashes(new_rows, texts)).distinct()

    light = snapshot.documents.select("doc_id", "digest").unionByName(incoming.select("doc_id", "digest"))
    both = stage(light, folder, "light")
    clashes = stage(clashes, folder, "clashes")
    if clashes.isEmpty():
        both = both.withColumn("other", F.lit(""))
    else:  # a row keeps its number of copies: clashes hold each (doc_id, digest, other) once
        both = _with_clashes(both, clashes, snapshot.documents.unionByName(incoming))
    groups = both.groupBy("digest", "other").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    listed = both.join(stage(groups, folder, "groups"), ["digest", "other"])
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept")
    return listed.select("doc_id", "keep_id", "group_size", kept, "digest", "other")


def _with_clashes(both: DataFrame, clashes: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of clashing digests, with the second digest of those that differ; the rest as they are."""
    mixed = clashes.select("digest").distinct()
    differing = F.sha2(F.col("text").cast("binary"), 512).alias("_own")
    own = rows.join(mixed, "digest").select("doc_id", "digest", differing)
    marked = own.join(
        clashes.select("digest", F.col("other").alias("_own"), F.col("other")).distinct(), ["digest", "_own"], "left"
    ).select("doc_id", "digest", F.coalesce("other", F.lit("")).alias("other"))
    rest = both.join(mixed, "digest", "left_anti").withColumn("other", F.lit(""))
    return rest.unionByName(marked)


def halves(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One table as a snapshot and a batch of about equal size: every row is in one of them."""
    first = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    return docs.where(first), docs.where(~first)


def apply(docs: DataFrame, found: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """The documents that stay, with all their columns: the row with the greatest doc_id of each class.

    Rows are told apart by doc_id and digest, so several texts under one id need a strong digest here.
    """
    own, its, copy = spare_names(docs, 3)
    rows = docs.withColumn(own, digest(whole_text()))
    gone = found.where("NOT kept").select(F.col("doc_id").alias(its), F.col("digest").alias(copy)).distinct()
    same = F.col("doc_id").eqNullSafe(F.col(its)) & (F.col(own) == F.col(copy))
    kept = rows.join(gone, same, "left_anti")
    repeated = found.where("kept").groupBy(F.col("doc_id").alias(its), F.col("digest").alias(copy)).agg(F.count(F.lit(1)).alias("n"))
    repeated = repeated.where("n > 1").drop("n")
    if repeated.isEmpty():
        return kept.drop(own)
    others = kept.join(repeated, same, "left_anti")
    ones = kept.join(repeated, same, "left_semi").dropDuplicates(["doc_id", "text"])
    return others.unionByName(ones).drop(own)


def deduplicate(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """Classes of a whole table, half of which is taken as the snapshot."""
    held, batch = halves(docs)
    return classes(batch, held, work_dir(docs.sparkSession, "exact-dedup"), digest)

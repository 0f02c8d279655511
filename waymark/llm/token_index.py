"""Token ids of documents as raw files, with a minimal perfect hash index for keyed access.

Format of a folder:
- `payload/<shard>.ids`: the ids of documents in ascending key order, as little-endian integers of 2 bytes if the
  vocabulary allows it, else 4; nothing else is in the file. Shards are numbered in key order.
- `records` (Parquet): key, shard, offset and length of every document, all in ids.
- `index` (Parquet): one row per bucket of keys with a minimal perfect hash function and, by its slots, the keys'
  fingerprints, shards, offsets and lengths.

The key is (doc_id, copy): rows that share a doc_id, or have none, are numbered from 0 in the order they are stored.

Building sorts the texts once, by ranges of doc_id, and encodes them where they land. A task writes its shards under a
name of its own and renames each when it is whole, so a task that is run again replaces equal files. The index is
built per bucket of a hash of the key, of about `BUCKET` keys each, whatever the size of the corpus.

The hash function is a cascade of bit arrays: a key takes the first level on which no other key has its place; its
slot is the number of bits set before it. That number is stored for every `RANKED` bits, so a lookup reads one count and
the words of one such stretch on each level it passes, two on average and at most `LEVELS`, whatever the number of keys.
Keys left after the last level are listed one by one. A stored fingerprint of 32 bits tells absent keys from present ones.

Cases: null text counts as empty and holds the end id alone; null doc_ids come first; long texts are encoded whole; no
rows give an empty index; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from waymark.llm.common import stage, whole_text
from waymark.llm.tokens import BYTES, encoder

#: Keys of a bucket, bytes of a shard, levels of the hash function and bits per key on each.
BUCKET, SHARD, LEVELS, SPARE = 1 << 16, 32 << 20, 24, 2.0
#: Bits between two stored counts of set bits: eight words.
RANKED = 512
RECORDS = "doc_id long, copy long, shard long, offset long, n_tokens long"
INDEX = (
    "bucket long, buckets long, sizes array<long>, bits binary, ranks binary, left_ids array<long>, left_copies array<long>, left_slots array<long>, "
    "fingerprints binary, shards binary, offsets binary, lengths binary"
)


def _open(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


class _Shards:
    """Writes the shards of one task."""

    def __init__(self, folder: str, width: int) -> None:
        self.files, self.folder = _open(f"{folder}/payload")
        self.width, self.number, self.size, self.out = width, TaskContext.get().partitionId() << 20, 0, None
        self.own = f"{self.folder}/.writing-{TaskContext.get().taskAttemptId()}"

    def add(self, ids: np.ndarray, most: int) -> tuple[int, int]:
        """Shard and offset of these ids."""
        if self.out is None:
            self.out, self.size = self.files.open_output_stream(f"{self.own}-{self.number}"), 0
        place = self.number, self.size // self.width
        self.out.write(ids.tobytes())
        self.size += ids.nbytes
        if self.size >= most:
            self.close()
        return place

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.files.move(f"{self.own}-{self.number}", f"{self.folder}/{self.number}.ids")
            self.number, self.out = self.number + 1, None


def write_payload(
    docs: DataFrame, folder: str, tokenizer: str, cut: str = BYTES, end_id: int = 2, width: int = 2, shard: int = SHARD
) -> DataFrame:
    """Write the id files and return the record of every document."""
    kind = f"<u{width}"
    files, place = _open(f"{folder}/payload")
    files.create_dir(place, recursive=True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode_all, out = encoder(tokenizer, cut).encode_all, _Shards(folder, width)
        last, copy = None, -1
        for batch in batches:
            rows = []
            for doc_id, ids in zip(batch["doc_id"], encode_all(batch["text"]), strict=True):
                doc_id = None if pd.isna(doc_id) else int(doc_id)
                copy = copy + 1 if copy >= 0 and doc_id == last else 0
                last = doc_id
                ids = np.append(ids, np.uint32(end_id))
                if ids.max() >= 1 << (8 * width):
                    raise ValueError("an id does not fit into the width of the format")
                rows.append((doc_id, copy, *out.add(ids.astype(kind), shard), len(ids)))
            yield pd.DataFrame(rows, columns=[part.split()[0] for part in RECORDS.split(", ")]).astype("Int64")
        out.close()

    ordered = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text")).repartitionByRange("doc_id")
    return stage(ordered.sortWithinPartitions("doc_id", "text").mapInPandas(run, RECORDS), folder, "records")


def _mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """Well-mixed 64-bit values of 64-bit keys (finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = keys + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) % (1 << 64))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (_mixed(keys, LEVELS + 1) >> np.uint64(32)).astype("<u4")


def build_hash(keys: np.ndarray) -> tuple[list[int], bytes, bytes, np.ndarray, np.ndarray]:
    """Level sizes, bits and counts of the function, the slot of each key, and which keys it leaves over."""
    slots, open_, taken = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
    sizes, bits, ranks = [], [], []
    for level in range(LEVELS):
        if not len(open_):
            break
        size = max(1, int(SPARE * len(open_)) // RANKED) * RANKED
        place = (_mixed(keys[open_], level) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(place, minlength=size) == 1
        settled = alone[place]
        slots[open_[settled]] = taken + (np.cumsum(alone) - 1)[place[settled]]
        each = alone.reshape(-1, RANKED).sum(axis=1)
        ranks.append((taken + np.cumsum(each) - each).astype("<u4"))
        taken += int(alone.sum())
        sizes.append(size)
        bits.append(np.packbits(alone, bitorder="little"))
        open_ = open_[~settled]
    slots[open_] = taken + np.arange(len(open_))
    return sizes, b"".join(map(bytes, bits)), b"".join(map(bytes, ranks)), slots, open_


def find_slots(keys: np.ndarray, sizes: list[int], bits: bytes, ranks: bytes) -> np.ndarray:
    """The slot of each key, -1 where every level is empty at its place."""
    words, counts = np.frombuffer(bits, "<u8").reshape(-1, RANKED // 64), np.frombuffer(ranks, "<u4")
    slots, open_, first = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
    for level, size in enumerate(sizes):
        place = (_mixed(keys[open_], level) % np.uint64(size)).astype(np.int64)
        stretch, word, bit = first + place // RANKED, place % RANKED // 64, (place % 64).astype(np.uint64)
        own = words[stretch, word]
        settled = (own >> bit) & np.uint64(1) == 1
        stretch, word, bit, own = stretch[settled], word[settled], bit[settled], own[settled]
        before = np.where(np.arange(words.shape[1]) < word[:, None], np.bitwise_count(words[stretch]), 0).sum(axis=1)
        before += np.bitwise_count(own & ((np.uint64(1) << bit) - np.uint64(1)))
        slots[open_[settled]] = counts[stretch] + before
        first, open_ = first + size // RANKED, open_[~settled]
    return slots


def _hashed(rows: DataFrame, buckets: int) -> DataFrame:
    key = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), "copy")
    return rows.withColumn("_hash", key).withColumn("_bucket", F.pmod(F.xxhash64("_hash"), F.lit(buckets)))


def build_index(records: DataFrame, folder: str, bucket: int = BUCKET) -> DataFrame:
    """Write and return the index of these records."""

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        sizes, bits, ranks, slots, left = build_hash(rows["_hash"].to_numpy().astype(np.int64).view(np.uint64))
        by_slot = rows.iloc[np.argsort(slots)]
        marks = fingerprints(by_slot["_hash"].to_numpy().astype(np.int64).view(np.uint64))
        none = rows.iloc[left]
        entry = {
            "bucket": int(rows["_bucket"].iloc[0]), "buckets": buckets, "sizes": sizes, "bits": bits, "ranks": ranks, "left_slots": slots[left].tolist(),
            "left_ids": [None if pd.isna(x) else int(x) for x in none["doc_id"]], "left_copies": none["copy"].tolist(),
            "fingerprints": marks.tobytes(), "shards": by_slot["shard"].to_numpy().astype("<i8").tobytes(),
            "offsets": by_slot["offset"].to_numpy().astype("<i8").tobytes(),
            "lengths": by_slot["n_tokens"].to_numpy().astype("<i8").tobytes(),
        }
        return pd.DataFrame({name: [value] for name, value in entry.items()})

    buckets = max(1, -(-records.count() // bucket))
    return stage(_hashed(records, buckets).groupBy("_bucket").applyInPandas(build, INDEX), folder, "index")


def lookup(keys: DataFrame, index: DataFrame) -> DataFrame:
    """Where each of these keys (doc_id, copy) is stored; keys that are not stored give no row."""

    def find(rows: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        out = rows[["doc_id", "copy"]].astype("Int64")
        if not len(found) or not len(rows):
            return out.iloc[:0].assign(shard=0, offset=0, n_tokens=0)
        entry = found.iloc[0]
        hashes = rows["_hash"].to_numpy().astype(np.int64).view(np.uint64)
        slots = find_slots(hashes, list(entry["sizes"]), entry["bits"], entry["ranks"])
        ids = [None if pd.isna(x) else int(x) for x in entry["left_ids"]]
        left = dict(zip(zip(ids, entry["left_copies"], strict=True), entry["left_slots"], strict=True))
        if left:
            asked = [(None if pd.isna(x) else int(x), y) for x, y in zip(rows["doc_id"], rows["copy"], strict=True)]
            slots = np.array([left.get(key, slot) for key, slot in zip(asked, slots, strict=True)])
        known = slots >= 0
        known[known] = np.frombuffer(entry["fingerprints"], "<u4")[slots[known]] == fingerprints(hashes[known])
        at = slots[known]
        stored = {"shard": "shards", "offset": "offsets", "n_tokens": "lengths"}
        return out[known].assign(**{name: np.frombuffer(entry[kept], "<i8")[at] for name, kept in stored.items()})

    buckets = (index.agg(F.max("buckets")).first() or [None])[0] or 1
    asked = _hashed(keys.select("doc_id", "copy").distinct(), buckets)
    return asked.groupBy("_bucket").cogroup(index.groupBy("bucket")).applyInPandas(find, RECORDS)


def read_ids(places: DataFrame, folder: str, columns: str, make, width: int = 2) -> DataFrame:
    """Read the ids at these places; `make(doc_id, copy, ids)` gives the values of `columns` after key and place."""

    def read(rows: pd.DataFrame) -> pd.DataFrame:
        files, place = _open(f"{folder}/payload")
        rows, values = rows.sort_values("offset"), []
        with files.open_input_file(f"{place}/{rows['shard'].iloc[0]}.ids") as file:
            for row in rows.itertuples(index=False):
                file.seek(int(row.offset) * width)
                ids = np.frombuffer(file.read(int(row.n_tokens) * width), f"<u{width}")
                values.append(make(row.doc_id, row.copy, ids))
        names = [part.split()[0] for part in columns.split(", ")]
        return rows.reset_index(drop=True).join(pd.DataFrame(values, columns=names))

    return places.groupBy("shard").applyInPandas(read, f"{RECORDS}, {columns}")


def digest(doc_id, copy, ids: np.ndarray) -> tuple[int, int]:
    """Length and checksum of ids, as 32-bit integers whatever the width they are stored in."""
    return len(ids), zlib.crc32(ids.astype("<u4").tobytes())


def shard_starts(records: DataFrame) -> DataFrame:
    """Ids before each shard. Shards are few: one row for some 30 MB of payload."""
    totals = records.groupBy("shard").agg(F.sum("n_tokens").alias("_tokens"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("shard", F.coalesce(F.sum("_tokens").over(before), F.lit(0)).alias("_before"))


def start(offset: str = "offset") -> Column:
    return F.col("_before") + F.col(offset)


def build(docs: DataFrame, folder: str, tokenizer: str, **options) -> tuple[DataFrame, DataFrame]:
    """Payload, records and index of these documents; returns the latter two."""
    records = write_payload(docs, folder, tokenizer, **options)
    return records, build_index(records, folder)

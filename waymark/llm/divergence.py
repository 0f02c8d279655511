"""How the sources of a language differ in their words: an inverted index built in a single pass, then exact sums.

1. Every task indexes its texts in memory: counts per (language, source) and term, documents per language and term. When
   the index holds `INDEX` postings it is spilled as a run sorted by term, cut by hash shard into blocks of bounded size.
2. The blocks of a shard arrive in the order of their first keys. A heap holds the blocks that are open; the least key is
   taken from them until the next block could hold a lesser one. So a shard is merged as a stream, with little more than
   one block per run in memory, into one posting list per (language, term).
3. Two sources are compared by their smoothed shares of every kept term of the language. Most terms occur in few
   sources, so a pair starts from the value that absent terms give, and streams of corrections are added: terms of either
   source alone from histograms of counts, terms of both from the posting lists. No sum runs over the whole vocabulary
   per pair. All numbers are integers.

A share is p = 1 + floor(10**9 * (count + 1) / (N + V)), N the group's occurrences of kept terms and V their number; the
divergence of p from q at a term is floor((p - q)**2 / q).

Cases: null text, language and source count as ''. A source without terms gets shares too; a language without kept terms
gives 0 for every pair and no terms. Repeated rows are documents of their own. Ties rank by the bytes of the item. Texts
of any length are read whole. No rows give no rows. Other columns are not read.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from waymark.llm.common import stage

TERM = re.compile(rb"[A-Za-z\x80-\xff]+")
#: Postings and terms in memory before a spill, postings that wait to be added up, keys of a block, keys merged at once,
#: postings compared in one task, pairs computed at once.
INDEX, VOCABULARY, WAITING, BLOCK, MERGED, CHUNK, AT_ONCE = 2_000_000, 500_000, 500_000, 2_048, 50_000, 200_000, 1 << 20
#: A term is kept by a language if it is in so many of its documents.
LEAST_DOCUMENTS = 3
WHOLE = 1_000_000_000

#: A block: its keys in order, per key the documents and the number of postings, then the postings of all keys.
BLOCKS_DDL = (
    "shard int, head binary, keys array<binary>, documents array<long>, sizes array<long>, names array<binary>, "
    "sources array<long>, counts array<long>"
)
BLOCKS = pa.schema([
    ("shard", pa.int32()), ("head", pa.binary()), ("keys", pa.list_(pa.binary())), ("documents", pa.list_(pa.int64())),
    ("sizes", pa.list_(pa.int64())), ("names", pa.list_(pa.binary())), ("sources", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())),
])
LISTS = pa.schema([
    ("lang", pa.binary()), ("term", pa.binary()), ("total", pa.int64()), ("sources", pa.list_(pa.binary())), ("counts", pa.list_(pa.int64())),
])
LISTS_DDL = "lang binary, term binary, total long, sources array<binary>, counts array<long>"


def terms(text: bytes) -> list[bytes]:
    """Runs of ASCII letters and characters beyond ASCII of a UTF-8 text; only A to Z become small."""
    return TERM.findall(text.lower())


def _summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of the values of each."""
    if not len(keys):
        return keys, values
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[starts], np.add.reduceat(values[order], starts)


class _Sums:
    """Sums per 64-bit key; what waits is added up before it outgrows what is kept."""

    def __init__(self) -> None:
        self.keys, self.values = np.array([], dtype=np.int64), np.array([], dtype=np.int64)
        self.waiting, self.size = [], 0

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.waiting.append((keys, values))
        self.size += len(keys)
        if self.size >= WAITING + len(self.keys) // 2:
            self.settle()

    def settle(self) -> None:
        keys, values = zip((self.keys, self.values), *self.waiting, strict=True)
        self.keys, self.values = _summed(np.concatenate(keys), np.concatenate(values))
        self.waiting, self.size = [], 0


class Index:
    """Counts per (language, source) and term, and documents per language and term, until they are spilled."""

    def __init__(self) -> None:
        self.vocabulary = defaultdict(count().__next__)
        self.langs, self.groups = defaultdict(count().__next__), defaultdict(count().__next__)
        self.postings, self.documents = _Sums(), _Sums()

    def add(self, lang: bytes, source: bytes, found: list[bytes]) -> None:
        numbers = np.fromiter(map(self.vocabulary.__getitem__, found), np.int64, len(found))
        numbers, counts = np.unique(numbers, return_counts=True)
        lang = self.langs[lang]
        self.postings.add(numbers | (self.groups[lang, source] << 32), counts)
        self.documents.add(numbers | (lang << 32), np.ones(len(numbers), dtype=np.int64))

    def full(self, most: int) -> bool:
        held = len(self.postings.keys) + self.postings.size
        return held >= most or len(self.vocabulary) >= VOCABULARY

    def run(self, shards: int) -> Iterator[pa.RecordBatch]:
        """The postings in the order of (term, language), dealt to the shards by term and cut into blocks."""
        self.postings.settle()
        self.documents.settle()
        words, langs, groups = list(self.vocabulary), list(self.langs), list(self.groups)
        if not words:
            return
        names = sorted({source for _, source in groups})
        place = {name: i for i, name in enumerate(names)}
        lang_of, source_of = np.array([(lang, place[source]) for lang, source in groups], dtype=np.int64).T
        position = np.empty(len(words), dtype=np.int64)
        position[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
        lang_position = np.empty(len(langs), dtype=np.int64)
        lang_position[sorted(range(len(langs)), key=langs.__getitem__)] = np.arange(len(langs))
        shard_of = np.fromiter((zlib.crc32(word) % shards for word in words), np.int64, len(words))
        group, word = self.postings.keys >> 32, self.postings.keys & 0xFFFFFFFF
        lang, source, counts = lang_of[group], source_of[group], self.postings.values
        order = np.lexsort([source, lang_position[lang], position[word], shard_of[word]])
        lang, word, source, counts = lang[order], word[order], source[order], counts[order]
        entry = lang << 32 | word
        starts = np.flatnonzero(np.r_[True, entry[1:] != entry[:-1]])
        documents = self.documents.values[np.searchsorted(self.documents.keys, entry[starts])]
        shard, sizes = shard_of[word[starts]], np.diff(np.r_[starts, len(entry)])
        keys = [words[w] + b"\0" + langs[t] for w, t in zip(word[starts].tolist(), lang[starts].tolist(), strict=True)]
        ends = np.r_[starts, len(entry)]
        self.__init__()
        for first in np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]):
            beyond = int(np.searchsorted(shard, shard[first], "right"))
            for low in range(int(first), beyond, BLOCK):
                high = min(low + BLOCK, beyond)
                own = slice(ends[low], ends[high])
                used, local = np.unique(source[own], return_inverse=True)
                row = [
                    int(shard[low]), keys[low], keys[low:high], documents[low:high], sizes[low:high], [names[i] for i in used], local,
                    counts[own],
                ]
                yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, BLOCKS, strict=True)], schema=BLOCKS)


def spilled_runs(batches: Iterator[pa.RecordBatch], shards: int, most: int) -> Iterator[pa.RecordBatch]:
    index = Index()
    for batch in batches:
        columns = (batch.column(name).to_pylist() for name in ("lang", "source", "text"))
        for lang, source, text in zip(*columns, strict=True):
            index.add(lang, source, terms(text))
            if index.full(most):
                yield from index.run(shards)
    yield from index.run(shards)


class _Block:
    """A block that is being merged."""

    def __init__(self, batch: pa.RecordBatch, row: int) -> None:
        self.keys, self.names = batch.column("keys")[row].as_py(), batch.column("names")[row].as_py()
        arrays = [batch.column(name)[row].values.to_numpy() for name in ("documents", "sizes", "sources", "counts")]
        self.documents, self.sizes, self.sources, self.counts = arrays
        self.starts = np.cumsum(self.sizes) - self.sizes


class Merge:
    """Streams of keys, one per run, merged by a heap; the postings of each key are added up."""

    def __init__(self, least: int) -> None:
        self.least, self.heap, self.opened = least, [], 0
        self.blocks: dict[int, _Block] = {}
        self.keys: list[bytes] = []
        self.taken: list[tuple[int, int, int]] = []  # number of the key, of the block, place in the block

    def open(self, block: _Block) -> None:
        self.blocks[self.opened] = block
        heapq.heappush(self.heap, (block.keys[0], self.opened, 0))
        self.opened += 1

    def advance(self, limit: bytes | None, most: int | None = None) -> None:
        """Take all keys below the limit, or the next `most` keys."""
        heap, keys, taken, blocks = self.heap, self.keys, self.taken, self.blocks
        while heap and (limit is None or heap[0][0] < limit):
            key, number, place = heap[0]
            if not keys or keys[-1] != key:
                if len(keys) == most:
                    return
                keys.append(key)
            taken.append((len(keys) - 1, number, place))
            place += 1
            following = blocks[number].keys
            if place < len(following):
                heapq.heapreplace(heap, (following[place], number, place))
            else:
                heapq.heappop(heap)

    def lists(self) -> Iterator[pa.RecordBatch]:
        """The posting lists of the keys taken so far, which are complete: no open block holds one of them."""
        if not self.keys:
            return
        key, number, place = np.array(self.taken, dtype=np.int64).T
        names: dict[bytes, int] = defaultdict(count().__next__)
        documents = np.zeros(len(self.keys), dtype=np.int64)
        found = []
        order = np.argsort(number, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(number[order])) + 1):
            block = self.blocks[int(number[part[0]])]
            own, at = key[part], place[part]
            documents[own] += block.documents[at]  # a block has a key once
            sizes, starts = block.sizes[at], block.starts[at]
            flat = np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            of = np.array([names[name] for name in block.names], dtype=np.int64)
            found.append((np.repeat(own, sizes) << 32 | of[block.sources[flat]], block.counts[flat]))
        pairs, counts = _summed(*(np.concatenate(column) for column in zip(*found, strict=True)))
        owner = pairs >> 32
        fits = documents[owner] >= self.least
        owner, sources, counts = owner[fits], (pairs & 0xFFFFFFFF)[fits], counts[fits]
        kept, sizes = np.unique(owner, return_counts=True)
        if len(kept):
            ends = np.r_[0, np.cumsum(sizes)]
            cut = [self.keys[i].partition(b"\0") for i in kept.tolist()]
            offsets = pa.array(ends.astype(np.int32))
            columns = [
                pa.array([lang for _, _, lang in cut], pa.binary()), pa.array([term for term, _, _ in cut], pa.binary()),
                pa.array(np.add.reduceat(counts, ends[:-1])),
                pa.ListArray.from_arrays(offsets, pa.array(list(names), pa.binary()).take(pa.array(sources))),
                pa.ListArray.from_arrays(offsets, pa.array(counts)),
            ]
            yield pa.RecordBatch.from_arrays(columns, schema=LISTS)
        self.keys, self.taken = [], []
        opened = {number for _, number, _ in self.heap}
        self.blocks = {number: block for number, block in self.blocks.items() if number in opened}


def merged_lists(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """One posting list per kept term of a language, from blocks in the order of their heads."""
    merge = Merge(least)
    for batch in batches:
        for row, head in enumerate(batch.column("head").to_pylist()):
            merge.advance(head)
            if len(merge.keys) >= MERGED:
                yield from merge.lists()
            merge.open(_Block(batch, row))
    while merge.heap:
        merge.advance(None, MERGED)
        yield from merge.lists()
    yield from merge.lists()


def posting_lists(docs: DataFrame, folder: str, most: int = INDEX, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """lang, term, total, sources, counts of every kept term of every language, as a table in `folder`."""
    spark = docs.sparkSession
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    read = docs.select(*[_bytes(name).alias(name) for name in ("lang", "source", "text")])
    runs = read.mapInArrow(lambda batches: spilled_runs(batches, shards, most), BLOCKS_DDL)
    ordered = runs.repartition(shards, "shard").sortWithinPartitions("head")
    lists = ordered.mapInArrow(lambda batches: merged_lists(batches, least), LISTS_DDL)
    return stage(lists, folder, "postings")


def _bytes(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")


def shares(counts: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """1 + floor(10**9 * (count + 1) / whole), digit by digit in thousands, so that nothing overflows."""
    digits, rest = np.divmod(counts + 1, whole)
    for _ in range(3):
        more, rest = np.divmod(rest * 1000, whole)
        digits = digits * 1000 + more
    return digits + 1


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def absent_and_single(groups: pa.Table, histogram: pa.Table) -> Iterator[tuple[bytes, bytes, int]]:
    """For each source of the histogram with each other source: what terms in neither or in one of the two give.

    Pairs (source, other) and (other, source) both get their corrections for the terms of `source`.
    """
    names = groups["source"].to_pylist()
    place = {name: i for i, name in enumerate(names)}
    whole = groups["whole"].to_numpy()
    vocabulary = groups["terms"].to_numpy()
    base = shares(np.zeros(len(names), dtype=np.int64), whole)
    mine: dict[bytes, list] = {}
    for source, count, number in zip(*(histogram[name].to_pylist() for name in ("source", "count", "number")), strict=True):
        mine.setdefault(source, []).append((count, number))
    for source, bins in mine.items():
        own = place[source]
        counts, numbers = np.array(bins, dtype=np.int64).T
        present = shares(counts, whole[own])
        step = max(1, AT_ONCE // len(bins))
        for first in range(0, len(names), step):
            others = base[None, first : first + step]
            forth = numbers @ (apart(present[:, None], others) - apart(base[own], others))
            back = numbers @ (apart(others, present[:, None]) - apart(others, base[own]))
            forth += vocabulary[first : first + step] * apart(base[own], others[0])
            for i, (one, two) in enumerate(zip(forth.tolist(), back.tolist(), strict=True), first):
                if i != own:
                    yield source, names[i], one
                    yield names[i], source, two


def both(groups: pa.Table, lists: pa.Table) -> Iterator[tuple[bytes, bytes, int]]:
    """What terms of both sources of a pair give beyond the two single corrections, summed over these posting lists."""
    names = groups["source"].to_pylist()
    place = {name: i for i, name in enumerate(names)}
    whole = groups["whole"].to_numpy()
    base = shares(np.zeros(len(names), dtype=np.int64), whole)
    sources, counts = lists["sources"].combine_chunks(), lists["counts"].combine_chunks()
    ends = sources.offsets.to_numpy().astype(np.int64)
    coded = sources.flatten().dictionary_encode()
    who = np.array([place[name] for name in coded.dictionary.to_pylist()], dtype=np.int64)[coded.indices.to_numpy()]
    ends = ends - ends[0]
    present = shares(counts.flatten().to_numpy(), whole[who])
    term_of = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    order = np.argsort(who, kind="stable")
    for entries in np.split(order, np.flatnonzero(np.diff(who[order])) + 1):
        own = who[entries[0]]
        total, meetings = np.zeros(len(names), dtype=np.int64), np.zeros(len(names), dtype=np.int64)
        lengths = np.diff(ends)[term_of[entries]]
        piece = np.cumsum(lengths) // AT_ONCE
        for part in np.split(np.arange(len(entries)), np.flatnonzero(np.diff(piece)) + 1):
            sizes = lengths[part]
            starts = ends[term_of[entries[part]]]
            flat = np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            other, p, q = who[flat], np.repeat(present[entries[part]], sizes), present[flat]
            np.add.at(total, other, apart(p, q) - apart(p, base[other]) - apart(base[own], q))
            meetings += np.bincount(other, minlength=len(names))
        total += meetings * apart(base[own], base)
        for i in np.flatnonzero(meetings):
            if i != own:
                yield names[own], names[i], int(total[i])


PAIRS = pa.schema([("lang", pa.binary()), ("source", pa.binary()), ("item", pa.binary()), ("value", pa.int64())])
PAIRS_DDL = "lang binary, source binary, item binary, value long"


def _table(lang: bytes, found: Iterator[tuple[bytes, bytes, int]]) -> pa.Table:
    rows = list(found)
    columns = zip(*rows, strict=True) if rows else ([], [], [])
    return pa.Table.from_arrays(
        [pa.array([lang] * len(rows), pa.binary())] + [pa.array(c, f.type) for c, f in zip(columns, list(PAIRS)[1:], strict=True)],
        schema=PAIRS,
    )


def _paired(left: DataFrame, parts: DataFrame, part: Column, groups: DataFrame, run) -> DataFrame:
    """`run` on the rows of a part of a language with a copy of the language's groups; `parts` says into how many it is cut."""
    dealt = left.join(parts, "lang").withColumn("part", F.pmod(part, F.col("parts")))
    copies = parts.select("lang", F.sequence(F.lit(0).cast("long"), F.col("parts") - 1).alias("copies"))
    copied = groups.join(copies, "lang").select(
        F.col("lang").alias("of"), F.explode("copies").alias("copy"), "source", "terms", "whole"
    )

    def compute(key: tuple, rows: pa.Table, own: pa.Table) -> pa.Table:
        return _table(key[0].as_py(), run(own, rows) if rows.num_rows else iter(()))

    return dealt.groupBy("lang", "part").cogroup(copied.groupBy("of", "copy")).applyInArrow(compute, PAIRS_DDL)


def audit(docs: DataFrame, folder: str, most_terms: int = 200) -> DataFrame:
    """lang, source, part, item, value, rank: per source all other sources (`pair`) and its most typical terms (`term`)."""
    lists = posting_lists(docs, folder)
    postings = lists.select("lang", "term", "total", F.explode(F.arrays_zip("sources", "counts")).alias("_p")).select(
        "lang", "term", "total", F.col("_p.sources").alias("source"), F.col("_p.counts").alias("count")
    )
    histogram = stage(
        postings.groupBy("lang", "source", "count").agg(F.count(F.lit(1)).alias("number")), folder, "histogram"
    )
    languages = lists.groupBy("lang").agg(
        F.count(F.lit(1)).alias("terms"), F.sum("total").alias("all"), F.sum(F.size("sources").cast("long")).alias("postings")
    )
    occurring = docs.select(_bytes("lang").alias("lang"), _bytes("source").alias("source")).distinct()
    sizes = histogram.groupBy("lang", "source").agg(F.sum(F.col("count") * F.col("number")).alias("own"))
    groups = occurring.join(sizes, ["lang", "source"], "left").join(languages, "lang", "left")
    groups = groups.select(
        "lang", "source", F.coalesce("terms", F.lit(0)).alias("terms"), F.coalesce("postings", F.lit(0)).alias("postings"),
        (F.coalesce("own", F.lit(0)) + F.coalesce("terms", F.lit(0))).alias("whole"),
        (F.coalesce("all", F.lit(0)) + F.coalesce("terms", F.lit(0))).alias("lang_whole"),
    )
    groups = stage(groups, folder, "groups")

    # a language without kept terms has shares of nothing; its pairs are 0
    known = groups.select("lang", "source", "terms", F.greatest("whole", F.lit(1)).alias("whole"))
    empty = known.select("lang", "source", F.lit(0).cast("long").alias("count"), F.lit(0).cast("long").alias("number"))
    number = F.count(F.lit(1))
    cut = groups.groupBy("lang").agg(F.ceil(number / 64).alias("parts"))
    singles = _paired(histogram.unionByName(empty), cut, F.xxhash64("source"), known, absent_and_single)
    cut = groups.groupBy("lang").agg(F.greatest(F.ceil(F.max("postings") / CHUNK), F.lit(1)).alias("parts"))
    doubles = _paired(lists.where(F.size("sources") > 1), cut, F.xxhash64("term"), known, both)
    pairs = singles.unionByName(doubles).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(order))

    def share(count: str, whole: str) -> Column:
        return F.expr(f"1 + CAST({WHOLE} AS DECIMAL(10, 0)) * ({count} + 1) div {whole}")

    typical = postings.join(groups.where("terms > 0").drop("postings"), ["lang", "source"]).select(
        "lang", "source", "term", share("count", "whole").alias("p"), share("total", "lang_whole").alias("q")
    )
    typical = typical.where("p > q").select("lang", "source", F.col("term").alias("item"), F.expr("(p - q) * (p - q) div q").alias("value"))
    typical = typical.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most_terms)
    found = pairs.withColumn("part", F.lit("pair")).unionByName(typical.withColumn("part", F.lit("term")))
    text = [F.col(name).cast("string").alias(name) for name in ("lang", "source")]
    return found.select(*text, "part", F.col("item").cast("string").alias("item"), "value", "rank")

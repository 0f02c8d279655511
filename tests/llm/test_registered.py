"""Registered queries that SQL cannot express, on the whole test table, against brute force."""

import collections
import zlib

import numpy as np
import pytest
from public_tokenizers import path
from tokenizers import Tokenizer

from waymark.llm import queries


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").toPandas()
    return dict(zip(rows["doc_id"], rows["text"].fillna("")))


def encoded(documents, name, end):
    tokenizer = Tokenizer.from_file(path(name))
    return {i: [*tokenizer.encode(text, add_special_tokens=False).ids, end] for i, text in documents.items()}


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_packing_holds_every_id_once(spark, sf_dir, documents):
    ids = encoded(documents, "word_bpe_49k.json", 1)
    pieces, windows = collections.defaultdict(list), collections.defaultdict(list)
    for r in queries.op1_packing(spark, sf_dir).collect():
        assert crc(ids[r.doc_id][r.start : r.start + r.length]) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        pieces[r.doc_id].append((r.start, r.length))
        windows[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(ids)
    for own, total in [(pieces[i], len(ids[i])) for i in ids] + [(own, None) for own in windows.values()]:
        own.sort()
        ends = [0, *np.cumsum([length for _, length in own])]
        assert [start for start, _ in own] == ends[:-1] and (total is None or ends[-1] == total)
        assert total is not None or ends[-1] <= 2048


def test_token_index_gives_every_document_back(spark, sf_dir, documents):
    ids = encoded(documents, "byte_bpe_50k.json", 2)
    before, wanted = 0, []
    for i in sorted(ids):
        wanted.append((i, before, len(ids[i]), crc(ids[i])))
        before += len(ids[i])
    got = queries.op7_token_index(spark, sf_dir).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, got)) == wanted


def test_near_duplicates_are_the_components_of_all_pairs(spark, sf_dir, documents):
    bags = {}
    for i, text in documents.items():
        words = text.lower().split()
        runs = [tuple(words[j : j + 5]) for j in range(max(1, len(words) - 4))] if words else []
        bags[i] = {run: 1 + np.log(n) for run, n in collections.Counter(runs).items()}
    root = {i: i for i in bags}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    names = sorted(bags)
    holders = collections.defaultdict(list)
    for i in names:
        for run in bags[i]:
            holders[run].append(i)
    pairs = {(a, b) for own in holders.values() for n, a in enumerate(own) for b in own[n + 1 :]}
    weights = {i: sum(bag.values()) for i, bag in bags.items()}
    for a, b in pairs:
        common = sum(min(w, bags[b][run]) for run, w in bags[a].items() if run in bags[b])
        if common >= 0.8 * (weights[a] + weights[b] - common):
            low, high = sorted((top(a), top(b)))
            root[high] = low
    got = {r.doc_id: (r.class_id, r.kept) for r in queries.op3_dart_minhash(spark, sf_dir).collect()}
    assert got == {i: (top(i), top(i) == i) for i in names}


@pytest.mark.parametrize("name", ["op4_surrogates", "op5_license_scan", "op6_toxicity", "op10_language"])
def test_one_row_per_document(name, spark, sf_dir, documents):
    got = queries.queries()[name](spark, sf_dir)
    assert sorted(r.doc_id for r in got.select("doc_id").collect()) == sorted(documents)

"""Divergence of sources against brute force, with the awkward cases."""

import collections
import re

import pyarrow as pa
import pytest

from waymark.llm import divergence
from waymark.llm.common import work_dir

SCHEMA = "doc_id long, text string, lang string, source string, item string, rank int, total long"
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
SMALL = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(docs, most=200):
    docs = [(lang or "", source or "", TERM.findall((text or "").translate(SMALL))) for text, lang, source in docs]
    found = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        in_docs = collections.Counter(t for d in own for t in set(d[2]))
        kept = {t for t, n in in_docs.items() if n >= 3}
        counts = {d[1]: collections.Counter() for d in own}
        for _, source, words in own:
            counts[source].update(t for t in words if t in kept)
        whole = sum(counts.values(), collections.Counter())

        def share(count, t):
            return 1 + 10**9 * (count[t] + 1) // (sum(count.values()) + len(kept))

        for source, count in counts.items():
            pairs = [
                (-sum((share(count, t) - share(other, t)) ** 2 // share(other, t) for t in kept), name.encode())
                for name, other in counts.items() if name != source
            ]
            words = [
                (-((share(count, t) - share(whole, t)) ** 2 // share(whole, t)), t.encode())
                for t in kept if count[t] and share(count, t) > share(whole, t)
            ]
            for part, ranked in (("pair", sorted(pairs)), ("term", sorted(words)[:most])):
                found += [(lang, source, part, item.decode(), -value, rank) for rank, (value, item) in enumerate(ranked, 1)]
    return sorted(found)


DOCS = [
    ("The cat, the CAT and the dog", "en", "a"), ("the cat sat", "en", "a"), ("The dog ran; the Dog slept", "en", "b"),
    ("a cat and a dog", "en", "b"), ("a cat", "en", "c"), (None, "en", "silent"), ("", "en", "c"), ("12 34 --", "en", "numbers"),
    ("Ärger ärger ÄRGER straße", "de", "a"), ("Ärger straße", "de", "a"), ("Ärger ärger", "de", "b"), ("straße", "de", "b"),
    ("日本 日本 🙂", "ja", "x"), ("日本", "ja", "y"), ("🙂 日本\x1c日本", "ja", "y"), ("rare words", "fr", "x"), ("others", "fr", "y"),
    ("no language here", None, "a"), ("no language there", None, None), ("no language at all", "", "b"), ("no", None, None),
    ("the cat sat", "en", "a"), (" ".join(f"w{i % 97} cat dog" for i in range(20_000)), "en", "long"),
]


def frame(spark, docs):
    return spark.createDataFrame([(i, *d, "x", 1, 2) for i, d in enumerate(docs)], SCHEMA)


def test_audit_equals_brute_force(spark):
    got = divergence.audit(frame(spark, DOCS * 2).repartition(5), work_dir(spark, "test"))
    assert sorted(tuple(row) for row in got.collect()) == brute(DOCS * 2)


@pytest.mark.parametrize("sizes", [(7, 1 << 20, 3, 2, 5), (1 << 20, 4, 1, 1, 1), (50, 50, 10, 2048, 50_000)])
def test_many_runs_merge_into_whole_lists(monkeypatch, sizes):
    """Spills after a few postings or terms, small blocks, few keys at once: the lists are those of all texts."""
    for name, size in zip(("VOCABULARY", "WAITING", "BLOCK", "MERGED"), sizes[1:], strict=True):
        monkeypatch.setattr(divergence, name, size)
    docs = [((lang or "").encode(), (source or "").encode(), (text or "").encode()) for text, lang, source in DOCS * 3]
    texts = pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*docs, strict=True)], names=["lang", "source", "text"])
    runs = [batch for part in (texts.slice(0, 30), texts.slice(30)) for batch in divergence.spilled_runs([part], 3, sizes[0])]
    rows = sorted((row for batch in runs for row in batch.to_pylist()), key=lambda row: row["head"])
    found, heads = {}, []
    for shard in range(3):
        blocks = [pa.RecordBatch.from_pylist([row], divergence.BLOCKS) for row in rows if row["shard"] == shard]
        heads += [len(blocks)]
        for batch in divergence.merged_lists(blocks, 3):
            for row in batch.to_pylist():
                assert (row["lang"], row["term"]) not in found
                found[row["lang"], row["term"]] = dict(zip(row["sources"], row["counts"], strict=True))
                assert row["total"] == sum(row["counts"])
    wanted, documents = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, source, text in docs:
        words = divergence.terms(text)
        documents.update((lang, word) for word in set(words))
        for word in words:
            wanted[lang, word][source] += 1
    assert found == {key: dict(value) for key, value in wanted.items() if documents[key] >= 3} and min(heads) > 1


def test_small_parts_give_the_same_pairs(spark, monkeypatch):
    """Pairs from parts of three postings, five numbers at once."""
    monkeypatch.setattr(divergence, "CHUNK", 3)
    monkeypatch.setattr(divergence, "AT_ONCE", 5)
    docs = DOCS[:-1]
    got = divergence.audit(frame(spark, docs), work_dir(spark, "test"))
    assert sorted(tuple(row) for row in got.collect()) == brute(docs)


def test_many_sources_and_a_short_list_of_terms(spark):
    docs = [(f"alpha beta w{i % 11} w{i % 7} " + "gamma " * (i % 5), "en", f"s{i % 150}") for i in range(450)]
    got = divergence.audit(frame(spark, docs), work_dir(spark, "test"), most_terms=4)
    assert sorted(tuple(row) for row in got.collect()) == brute(docs, 4)


def test_empty_table(spark):
    assert divergence.audit(frame(spark, []), work_dir(spark, "test")).collect() == []


def test_shares_do_not_overflow():
    import numpy as np

    counts, whole = np.array([0, 5, 10**14, 10**15 - 2]), np.array([10**15, 7, 10**15, 10**15 - 1])
    assert divergence.shares(counts, whole).tolist() == [
        1 + 10**9 * (c + 1) // w for c, w in zip(counts.tolist(), whole.tolist(), strict=True)
    ]

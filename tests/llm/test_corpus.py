"""The corpus operators against brute force, on small tables with the awkward cases."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from waymark.llm import (
    boosting, dart_minhash, exact_dedup, fuse, language, license_scan, mixing, packing, queries, surrogates, token_index, tokens,
    topk, toxicity,
)
from waymark.llm.tokens import BYTES, WORDS, Encoder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, kept boolean, _row int"
WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def rows(texts):
    return [(i, text, None, None, None, "x", None, 1) for i, text in enumerate(texts)]


LONG = " ".join(f"word{i % 977} other{i % 13}" for i in range(20_000))
NEAR = " ".join(f"near{i}" for i in range(200))
TEXTS = [None, "", "", "a", "a", LONG, LONG, NEAR, NEAR + " one more", NEAR.replace("near100", "far"), "ß İ\n\n  tail  ", "one two three"]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, copies, a repeated row and a row without id, with clashing extra columns."""
    extra = [rows(["again"])[0], (None, "no id", None, None, None, "x", None, 1), (None, "a", None, None, None, "x", None, 1)]
    return spark.createDataFrame(rows(TEXTS) + [rows(TEXTS)[7]] + extra, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture()
def folder(tmp_path):
    return f"file://{tmp_path}"


@settings(max_examples=150, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.text(alphabet=st.sampled_from("ab'sté  \n\t.,!?12x　́\x1cÀ日🙂"), max_size=40))
def test_ids_of_chunks_are_the_ids_of_the_whole(text):
    for path, cut in ((WORD, WORDS), (BYTE, BYTES)):
        own = _ENCODERS.setdefault(path, Encoder(path, cut))
        assert own.encode(text) == own.ids(text)


_ENCODERS = {}


@settings(max_examples=150, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet=st.sampled_from("ab'sté  \n\n\t.,!?12x　́\x1cÀ日🙂×_-\x85\xa0я—&"), max_size=30), max_size=6), st.sampled_from([1, 20, 10**6]))
def test_ids_of_many_texts_are_those_of_each(texts, stretch):
    own = _ENCODERS.setdefault(BYTE, Encoder(BYTE, BYTES))
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(tokens, "STRETCH", stretch)
        assert [ids.tobytes() for ids in own.encode_all(texts)] == list(map(own.ids, texts))


def test_equal_pieces_of_texts_are_encoded_once(monkeypatch):
    """Time: only the different pieces of a stretch reach the cache, and the new words among them the model in one call."""
    own, asked, new = Encoder(BYTE, BYTES), [], []
    pieces, words = own.pieces, own.words
    monkeypatch.setattr(own, "pieces", lambda found: asked.append(list(found)) or pieces(found))
    monkeypatch.setattr(own, "words", lambda found: new.append(list(found)) or words(found))
    texts = ["one two, one été&&&\ntwo one.  Two"] * 1000
    assert [ids.tobytes() for ids in own.encode_all(texts)] == [own.ids(texts[0])] * 1000
    assert len(asked) == len(new) == 1 and len(set(asked[0])) == len(asked[0]) < 12
    assert set(new[0]) == {"one", " two", " one", "two"}


def test_packing_places_every_id_once(odd, none):
    assert packing.pack(none, WORD).count() == 0
    got = packing.pack(odd, WORD, block=3000, payload=True).toPandas()
    tokenizer = Tokenizer.from_file(WORD)
    wanted = collections.Counter(
        (None if row.doc_id is None else row.doc_id, tuple(tokenizer.encode(row.text or "", add_special_tokens=False).ids + [1]))
        for row in odd.select("doc_id", "text").collect()
    )
    assert got.length.sum() == sum(len(ids) * n for (_, ids), n in wanted.items())
    for _, window in got.sort_values("offset").groupby("sequence_id"):
        assert list(window.offset) == [0, *np.cumsum(window.length)[:-1]]
        assert window.length.sum() <= window.window.iloc[0] <= 2048
    for row in got.itertuples():
        assert row.ids_crc32 == zlib.crc32(row.ids) and len(row.ids) == 4 * row.length
    whole = {doc: ids for doc, ids in wanted if doc == 5}[5]
    pieces = got[got.doc_id == 5].sort_values("start")
    assert b"".join(pieces.ids) == np.array(whole, "<u4").tobytes()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 5000), max_size=60), st.booleans())
def test_windows_are_full_but_for_the_last(lengths, last):
    packed, short = packing.pack_block(lengths, packing.TIERS, [], last)
    placed = [piece for _, pieces in packed for piece in pieces] + short
    for document, length in enumerate(lengths):
        own = sorted((start, size) for doc, start, size in placed if doc == document)
        assert [start for start, _ in own] == [0, *np.cumsum([size for _, size in own])[:-1]] and sum(s for _, s in own) == length
    assert sum(sum(p[2] for p in pieces) < tier for tier, pieces in packed) <= int(last)


def test_step_groups_are_balanced():
    sizes = [2048] * 40 + [1024] * 30 + [256] * 50
    loads = np.bincount(packing.step_groups(sizes, 16 * 2048), sizes)
    assert loads.max() - loads.min() <= 2048 and loads.sum() == sum(sizes)


def test_token_files_come_back(spark, odd, none, folder):
    records, index = token_index.build(odd, folder, BYTE, shard=1 << 12)
    found = token_index.read_ids(token_index.lookup(records, index), folder, "n long, crc long", token_index.digest)
    got = found.join(token_index.shard_starts(records), "shard").withColumn("start", token_index.start()).toPandas()
    tokenizer = Tokenizer.from_file(BYTE)
    docs = odd.select("doc_id", "text").toPandas()
    wanted = collections.Counter()
    for doc_id, text in zip(docs.doc_id, docs.text):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        wanted[None if pd.isna(doc_id) else int(doc_id), len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    assert wanted == collections.Counter(
        (None if pd.isna(r.doc_id) else int(r.doc_id), r.n, r.crc) for r in got.itertuples()
    )
    got = got.sort_values("start")
    assert list(got.start) == [0, *np.cumsum(got.n)[:-1]] and got.doc_id.dropna().is_monotonic_increasing
    assert token_index.lookup(spark.createDataFrame([(10**6, 0), (3, 7)], "doc_id long, copy long"), index).count() == 0
    records, index = token_index.build(none, f"{folder}/none", BYTE)
    assert records.count() == 0 and token_index.lookup(records, index).count() == 0


def test_hash_function_is_minimal_and_perfect():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**63, 20_000).astype(np.uint64))
    sizes, bits, ranks, slots, left = token_index.build_hash(keys)
    assert sorted(slots) == list(range(len(keys)))
    found = token_index.find_slots(keys, sizes, bits, ranks)
    inside = np.setdiff1d(np.arange(len(keys)), left)
    assert (found[inside] == slots[inside]).all()


@pytest.mark.parametrize("count", [1, 3, 700, 20_000])
def test_a_lookup_reads_one_stretch_a_level(count):
    """With all other words and counts wiped out, a single key still finds its slot."""
    keys = np.unique(np.random.default_rng(count).integers(0, 2**63, count).astype(np.uint64))
    sizes, bits, ranks, slots, left = token_index.build_hash(keys)
    for at in set(range(0, len(keys), max(1, len(keys) // 40))) - set(left.tolist()):
        words, counts, first = np.zeros(len(bits) // 64, dtype="V64"), np.zeros(len(ranks) // 4, dtype="<u4"), 0
        for level, size in enumerate(sizes):
            own = first + int(token_index._mixed(keys[at : at + 1], level)[0] % np.uint64(size)) // token_index.RANKED
            words[own], counts[own] = np.frombuffer(bits, "V64")[own], np.frombuffer(ranks, "<u4")[own]
            first += size // token_index.RANKED
        assert token_index.find_slots(keys[at : at + 1], sizes, words.tobytes(), counts.tobytes())[0] == slots[at]


@pytest.mark.parametrize("count", [0, 1, 2, 3, 50, 30_000])
def test_filters_hold_all_their_keys(count):
    rng = np.random.default_rng(count)
    keys, others = rng.integers(0, 2**63, count).astype(np.uint64), rng.integers(0, 2**63, 50_000).astype(np.uint64)
    stored = fuse.build(keys)
    assert fuse.contains(keys, *stored).all()
    if count > 100:
        assert fuse.contains(others, *stored).mean() < 0.01 and len(stored[3]) < 1.4 * count


def weak(text):
    return F.pmod(F.crc32(text.cast("binary")), F.lit(3)).cast("string")


@pytest.mark.parametrize("digest", [exact_dedup.sha256, weak])
def test_exact_classes(odd, none, folder, digest):
    held, batch = exact_dedup.halves(odd)
    assert held.count() + batch.count() == odd.count()
    found = exact_dedup.classes(batch, held, folder, digest)
    docs = [(r.doc_id, r.text or "") for r in odd.select("doc_id", "text").collect()]
    wanted = []
    for doc_id, text in docs:
        ids = [i for i, other in docs if other == text]
        keep = max((i for i in ids if i is not None), default=None)
        wanted.append((doc_id, keep, len(ids), doc_id == keep))
    got = [(r.doc_id, r.keep_id, r.group_size, r.kept) for r in found.collect()]
    assert sorted(map(str, got)) == sorted(map(str, wanted))
    if digest is not weak:  # one id stands for two texts here
        kept = exact_dedup.apply(odd, found, digest).select(*odd.columns).collect()
        assert sorted((r.text or "") for r in kept) == sorted({text for _, text in docs})
    assert exact_dedup.classes(none, none, f"{folder}/none").count() == 0


def test_near_classes(odd, none, folder):
    found = {(r.doc_id, bytes(r.digest)): (r.class_id, r.class_size) for r in dart_minhash.classes(odd, folder).collect()}
    of = lambda i: found[i, hashlib.md5((TEXTS[i] or "").encode()).digest()]
    assert of(7) == (7, 4) and of(8)[0] == of(9)[0] == 7  # 7 stands twice
    assert of(5) == of(6) == (5, 2) and of(3) == of(4) == (3, 2)
    assert of(1) == (1, 1) and of(2) == (2, 1) and of(11) == (11, 1)
    assert of(0) == (0, 1) == found[0, hashlib.md5(b"again").digest()]
    kept = dart_minhash.representatives(odd, dart_minhash.classes(odd, f"{folder}/b")).collect()
    assert len([r for r in kept if r.doc_id == 7]) == 1 and len([r for r in kept if r.doc_id is None]) == 2
    assert sorted(r.text or "" for r in kept if r.doc_id == 0) == ["", "again"]  # unlike texts under one id both stay
    assert dart_minhash.classes(none, f"{folder}/none").count() == 0


def test_unlike_texts_under_one_id(spark, folder):
    """Each finds its own near copy, and none is lost."""
    one, two = (" ".join(f"{c}{i}" for i in range(100)) for c in "ab")
    docs = [(1, one), (1, two), (2, " ".join(f"c{i}" for i in range(100))), (3, two + " z"), (4, one + " y"), (4, two + " x")]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in docs], "doc_id long, text string, _own0 string, _gone string")
    found = dart_minhash.classes(docs, folder)
    kinds = {}
    for row in found.collect():
        kinds.setdefault((row.class_id, bytes(row.class_text)), []).append((row.doc_id, row.kept))
    assert sorted(sorted(own) for own in kinds.values()) == [
        [(1, True), (3, False), (4, False)], [(1, True), (4, False)], [(2, True)]
    ]
    kept = dart_minhash.representatives(docs, found)
    assert kept.columns == docs.columns and sorted(r.text for r in kept.collect()) == sorted([one, two, " ".join(f"c{i}" for i in range(100))])


def test_similarity_is_weighted(spark, folder):
    """Classes and the check of a pair against brute force over counts of shingles."""
    rng = np.random.default_rng(8)
    lines = [" ".join(f"l{n}w{i}" for i in range(8)) for n in range(30)]
    texts = []
    for _ in range(25):
        base = list(rng.choice(lines, 12))
        texts.append("\n".join(base))
        for _ in range(3):
            changed = list(base)
            for at in rng.choice(12, int(rng.integers(1, 4)), replace=False):
                changed[at] = str(rng.choice(lines)) if rng.random() < 0.5 else changed[at] + " more"
            texts.append("\n".join(changed + [base[0]] * int(rng.integers(0, 6))))

    def bag(text):
        words = text.lower().split()
        counts = collections.Counter(tuple(words[j : j + 5]) for j in range(len(words) - 4))
        return {shingle: 1 + np.log(n) for shingle, n in counts.items()}

    bags = [bag(text) for text in texts]
    alike = {}
    for a in range(len(texts)):
        for b in range(a):
            both = sum(min(bags[a][s], bags[b][s]) for s in bags[a].keys() & bags[b].keys())
            alike[b, a] = both / (sum(bags[a].values()) + sum(bags[b].values()) - both)
    sets = [dart_minhash.packed(v, n) for v, _, n in (dart_minhash.counted_shingles([text]) for text in texts)]
    for (a, b), wanted in alike.items():
        assert dart_minhash.similar(sets[a], sets[b], 0.8)[0] == (wanted >= 0.8)
    roots = list(range(len(texts)))
    for (a, b), wanted in alike.items():
        if wanted >= 0.8:
            low, high = sorted((roots[a], roots[b]))
            roots = [low if root == high else root for root in roots]
    got = dart_minhash.classes(spark.createDataFrame(rows(texts), SCHEMA), folder)
    assert {r.doc_id: r.class_id for r in got.collect()} == dict(enumerate(roots))
    assert len(set(roots)) < len(texts)


def test_signatures_agree_as_weighted_sets_do():
    rng = np.random.default_rng(5)
    elements = rng.integers(0, 2**63, 60).astype(np.uint64)
    left, right = rng.uniform(0.2, 3, 60), rng.uniform(0.2, 3, 60)
    k = 2000
    rows_ = dart_minhash.signatures(np.tile(elements, 2), np.concatenate([left, right]), np.repeat([0, 1], 60), 2, k)
    wanted = np.minimum(left, right).sum() / np.maximum(left, right).sum()
    assert (rows_ != dart_minhash._LATE).all() and abs((rows_[0] == rows_[1]).mean() - wanted) < 0.05


def test_family_of_near_copies_is_one_class(spark, folder):
    """One original with copies that are near to it but hardly to each other, and texts that share a passage only."""
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words)]
    for i in range(60):
        copy = list(words)
        for at in rng.choice(400, 7, replace=False):
            copy[at] = f"e{i}x{at}"
        texts.append(" ".join(copy))
    texts += [" ".join(words[:60] + [f"o{i}y{j}" for j in range(150)]) for i in range(60)]
    sets = [{tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)} for t in texts]
    roots = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                low, high = sorted((roots[a], roots[b]))
                roots = [low if root == high else root for root in roots]
    got = dart_minhash.classes(spark.createDataFrame(rows(texts), SCHEMA), folder)
    assert {r.doc_id: r.class_id for r in got.collect()} == dict(enumerate(roots))


def test_mix_fills_shortages_from_siblings_first(spark, none):
    docs = [(i, "x" * 396, lang, source) for i, (lang, source) in enumerate([("a", "s1")] * 2 + [("a", "s2")] * 20 + [("b", "s1")] * 20)]
    docs = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    drawn = mixing.draw(docs, ["lang", "source"], [F.lit(1), F.lit(1)], share=0.5, epochs=1)
    taken = {(r["lang"], r["source"]): r["t"] for r in drawn.groupBy("lang", "source").agg(F.sum(mixing.TAKEN).alias("t")).collect()}
    assert taken == {("a", "s1"): 200, ("a", "s2"): 850, ("b", "s1"): 1050}
    again = mixing.draw(docs, ["lang", "source"], [F.lit(1), F.lit(1)], share=1.5, epochs=2)
    assert again.agg(F.sum(mixing.TAKEN)).first()[0] == 42 * 100 * 3 // 2 and again.agg(F.max(mixing.EPOCH)).first()[0] == 1
    assert mixing.draw(none, ["lang", "source"], [F.lit(1), F.lit(1)], share=0.5).count() == 0


def test_mix_of_odd_rows(odd):
    drawn = mixing.draw(queries.with_domain(odd), queries.MIX_LEVELS, queries.mix_weights(), share=1.0, epochs=1)
    assert drawn.count() == odd.count() and drawn.where(F.col(mixing.TAKEN) != F.col(mixing.TOKENS)).count() == 0


def test_mix_does_not_depend_on_the_order_of_rows(spark):
    """Many texts under one id and under none, and columns with the names that are used inside."""
    texts = [(1 if i % 2 else None, "w" * (i % 23) + str(i), "en", "s", "k", 7, "t") for i in range(120)]
    schema = "doc_id long, text string, lang string, source string, mix_key string, mix_tokens int, mix_0 string"
    one, two = (
        mixing.draw(spark.createDataFrame(rows_, schema).coalesce(1), ["lang", "source"], [F.lit(1), F.lit(1)], share=0.55, epochs=2)
        for rows_ in (texts, texts[::-1])
    )
    assert one.columns == ["doc_id", "text", "lang", "source", "mix_key", "mix_0", "mix_tokens", "mix_epoch", "mix_taken"]
    found = sorted(map(str, one.collect()))
    assert found == sorted(map(str, two.collect())) and len(found) > 50
    assert {(r.mix_key, r.mix_0) for r in one.collect()} == {("k", "t")}


def test_files_do_not_depend_on_the_order_of_rows(spark, folder):
    """Several texts under one id and under none get the same numbers and places, as after a retried task."""
    texts = [(i % 3 or None, f"text {i}") for i in range(40)]
    found = []
    for name, own in (("one", texts), ("two", texts[::-1])):
        docs = spark.createDataFrame(own, "doc_id long, text string").coalesce(1)
        records, index = token_index.build(docs, f"{folder}/{name}", BYTE)
        read = token_index.read_ids(token_index.lookup(records, index), f"{folder}/{name}", "ids_read long, ids_crc32 long", token_index.digest)
        found.append(sorted(map(str, read.drop("shard").collect())))
    assert found[0] == found[1] and len(found[0]) == 40


@pytest.mark.parametrize("name", ["_digest", "_gone", "_its", "_own0", "count"])
def test_exact_dedup_keeps_columns_of_any_name(spark, name):
    docs = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (2, "a", "y"), (3, "b", "z")], f"doc_id long, text string, {name} string")
    kept = exact_dedup.apply(docs, exact_dedup.deduplicate(docs))
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect())) == [(2, "a", "y"), (3, "b", "z")]


TEXT = (
    'Mail ann.b@mail3.example.com, call +1 (017) 555-7713 or +1 (017) 555-7713; token = "04DBEBAB91AB85687D33EEAAF9AC699E1188F962" '
    "from 161.17.88.162. Card 4111 1111 1111 1111. Mrs Anna Schmidt met Herr Schmidt. Version 1.2.3.4.5 of 2024-01-02."
)


def test_surrogates_keep_format_and_identity():
    text, count = surrogates.replace(TEXT, b"k", {})
    assert count == 9 and surrogates.replace(TEXT, b"k", {})[0] == text != surrogates.replace(TEXT, b"other", {})[0]
    shape = lambda x: re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub(r"\d", "0", x)))
    assert shape(text.split(" Card")[0].split("from")[0]) == shape(TEXT.split(" Card")[0].split("from")[0])
    for private in ("ann.b", "555-7713", "04DBEBAB", "161.17", "4111 1111 1111", "Schmidt"):
        assert private not in text
    phones = re.findall(r"\+1 \(\d{3}\) \d{3}-\d{4}", text)
    assert len(phones) == 2 and phones[0] == phones[1] and "1.2.3.4.5 of 2024-01-02" in text
    card = re.search(r"Card ([\d ]+)\.", text).group(1).replace(" ", "")
    assert surrogates._luhn(card[:-1]) == int(card[-1])
    last = re.search(r"Mrs (\w+) ([\w-]+) met Herr ([\w-]+)\.", text)
    assert last.group(2) == last.group(3) and last.group(1) in surrogates.NAMES["latin"]["f"]


@pytest.mark.parametrize(
    "text, private",
    [
        ("+1 (017) 555-7713 161.17.88.162", ["555-7713", "161.17.88.162"]), ("ping 10.0.0.1 now", ["10.0.0.1"]), ("dns 8.8.8.8 here", ["8.8.8.8"]),
        ("pay 41 11 11 11 11 11 11 11 now", ["41 11 11 11 11 11 11 11"]), ("pay 05 11 11 11 11 11 11 11 now", ["05 11 11 11 11 11 11 11"]),
        ("tel +33 6 12 34 56 78.", ["6 12 34 56 78"]), ("tel +49 30 1234 56.", ["30 1234 56"]), ("tel +47 123 45 678.", ["123 45 678"]),
        ("tel +49 (0)30 123456.", ["(0)30 123456"]), ("tel 01 23 45 67 89.", ["01 23 45 67 89"]), ("tel +1 (017) 555-7713 12 left", ["(017) 555-7713"]),
        ("Mr McDonald came.", ["McDonald"]), ("Mr O'Neil came.", ["O'Neil"]), ("Mr O’Neil came.", ["O’Neil"]), ("MR JOHN SMITH.", ["JOHN", "SMITH"]),
        ("Dr Martin Luther King.", ["Martin", "Luther", "King"]), ("Herr Ludwig van Beethoven.", ["Ludwig", "Beethoven"]), ("Mr Łukasz Żak.", ["Łukasz", "Żak"]),
        ("Mr d'Artagnan came.", ["Artagnan"]), ("Prof. Dr. Schmidt.", ["Schmidt"]), ("Mr J. R. Smith.", ["Smith"]), ("Mme\u00a0Élodie Şahin.", ["Élodie", "Şahin"]),
        ("Herr Mu\u0308ller kam.", ["Mu\u0308ller"]), ("Mr Παπαδόπουλος.", ["Παπαδόπουλος"]), ("Mrs Anne-Marie Lloyd-Jones.", ["Anne-Marie", "Lloyd-Jones"]),
    ],
)
def test_private_data_is_found_whole(text, private):
    spans = [(start, end) for start, end, *_ in surrogates.detect(text)]
    for value in private:
        at = text.index(value)
        assert any(start <= at and at + len(value) <= end for start, end in spans), spans
    assert len(spans) == len(private)
    changed, _ = surrogates.replace(text, b"k", {})
    assert not any(value in changed for value in private)


def test_no_entity_reaches_further_than_it_should():
    text = "tel +1 (017) 555-7713 12 left"
    assert [text[start:end] for start, end, *_ in surrogates.detect(text)] == ["+1 (017) 555-7713"]
    assert surrogates.detect("Mr and Mrs were 12 or 3.4, at 10:20 on 2024-01-02; Dr is a title") == []
    assert surrogates.detect("Mr O'Neil")[0][3] == surrogates.detect("Mr O’Neil")[0][3]


def test_surrogates_stay_distinct(spark, odd, folder):
    names = [f"Herr {a}{b}er kam." for a in ("Al", "Be", "Co", "Du", "Em", "Fa") for b in "bdfgklmnprst"]
    docs = spark.createDataFrame(rows(names + [None, "", TEXT, TEXT]), SCHEMA)
    got = surrogates.anonymise(docs, b"k", folder).orderBy("doc_id").collect()
    shown = [re.search(r"Herr ([\w-]+)", r.text).group(1) for r in got[: len(names)]]
    assert len(set(shown)) == len(names) and not {f"Herr {x} kam." for x in shown} & set(names)
    assert got[-4].text is None and got[-3].text == "" and got[-2].text == got[-1].text and got[-1].n_entities == 9
    assert got[0].ids == "x"
    assert surrogates.anonymise(odd.limit(0), b"k", f"{folder}/none").count() == 0


def test_spellings_of_a_number_stay_one_entity():
    """What is kept of a number follows from its value, whatever separates the country code."""
    spellings = ["+1 555-123-4567", "+1555 123-4567", "+1 (555) 123-4567", "+15551234567 ", "+1 555 123 4567"]
    shown = {re.sub(r"\D", "", surrogates.replace(text, b"k", {})[0]) for text in spellings}
    assert len(shown) == 1 and shown.pop().startswith("1")
    german = {re.sub(r"\D", "", surrogates.replace(text, b"k", {})[0]) for text in ("+49 30 123 4567", "+4930 1234567", "+49301234567")}
    assert len(german) == 1 and german.pop().startswith("49")


def test_a_full_space_of_values_widens(spark, folder):
    """All 6,561 addresses of four digits from 1 to 9: no two entities share a surrogate, none shows a real one."""
    texts = [f"host {a}.{b}.{c}.{d} up" for a in range(1, 10) for b in range(1, 10) for c in range(1, 10) for d in range(1, 10)]
    docs = spark.createDataFrame([(i, t, "mine", [1], "x") for i, t in enumerate(texts)], "doc_id long, text string, text_key string, _attempts array<int>, _own0 string")
    got = surrogates.anonymise(docs, b"k", folder).collect()
    shown = [row.text.split()[1] for row in got]
    assert len(set(shown)) == len(texts) and set(shown).isdisjoint(t.split()[1] for t in texts)
    assert {(row.text_key, tuple(row["_attempts"]), row["_own0"]) for row in got} == {("mine", (1,), "x")}
    assert all(row.n_entities == 1 for row in got)


def test_licences(spark, odd, folder):
    texts = {
        "mit": "intro\nReleased under the MIT License.", "gpl": "This work is licensed under the GNU General Public License, version 3.",
        "apache": "x\nLICENSED UNDER THE APACHE LICENSE, VERSION 2.0.\ny", "cc-by-nc": "Licensed under CC BY-NC 4.0.",
        "unknown": "Licensed under the Blorbo License, Version 2.0", "none": "nothing of the kind",
    }
    docs = spark.createDataFrame(rows(texts.values()), SCHEMA).unionByName(odd.withColumn("doc_id", F.col("doc_id") + 100))
    got = {r.doc_id: r.license for r in license_scan.scan(docs, folder).collect()}
    assert [got[i] for i in range(len(texts))] == list(texts) and {got[i] for i in got if i is None or i >= 100} == {"none"}
    plan = license_scan.scan(docs, f"{folder}/p")._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_short_and_wrapped_licences(spark, folder):
    texts = [
        ("proprietary", "some words\nAll rights reserved.\nother words"), ("mit", "MIT License"), ("mit", "words\n\nLicense: MIT\n\nwords"),
        ("apache", "Apache License 2.0"), ("gpl", "intro\n\nThis work is licensed under the GNU General\nPublic License, version 3.\n\nend"),
        ("gpl", "# This work is licensed\n# under the GNU\n# General Public License, version 3."), ("unknown", "Blorbo License"),
        ("unknown", "License: Blorbo"), ("unknown", "Licensed under the Blorbo\nLicense, Version 2.0"), ("proprietary", "All rights\nreserved."),
        ("none", "all of\nthe rights"),
    ]
    got = license_scan.scan(spark.createDataFrame(rows([text for _, text in texts]), SCHEMA), folder).orderBy("doc_id").collect()
    assert [r.license for r in got] == [wanted for wanted, _ in texts] and got[0].cue_lines == 1


FILLER = "river stone cloud table green window paper music garden winter market silver bridge letter orange doctor forest engine"


def prose(seed, count):
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice(FILLER.split(), count))


def test_every_family_and_what_only_looks_like_a_licence(spark, folder):
    texts = [
        ("apache", "Apache-2.0"), ("apache", "Licence: Apache License, Version 2.0"), ("mit", "This code is under the MIT licence.\nThe MIT License"),
        ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
        ("gpl", "Licence: GPL version 2 or later"), ("gpl", "SPDX-License-Identifier: GPL-3.0-or-later"), ("lgpl", "License: LGPL-2.1"),
        ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted"), ("bsd", "BSD 3-Clause License"),
        ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
        ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"), ("cc-by", "Licensed under CC BY 4.0"),
        ("cc-by-sa", "Licensed under CC BY-SA 4.0"), ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
        ("public-domain", "This is free and unencumbered software released into the public domain"), ("proprietary", "All rights reserved."),
        ("none", "we drove past the licensed copyright office"), ("none", "his driving license was in the glove box"),
        ("none", "you need a fishing license in winter"), ("unknown", "Licensed under the Blorbo License, Version 2.0"),
    ]
    fill = [("none", prose(i, 60)) for i in range(80)]
    docs = [(f, f"{prose(100 + i, 12)}\n{t}\n{prose(200 + i, 9)}") for i, (f, t) in enumerate(texts)] + fill
    got = license_scan.scan(spark.createDataFrame(rows([t for _, t in docs]), SCHEMA), folder).orderBy("doc_id").collect()
    wrong = [(texts[i] if i < len(texts) else "filler", r.license) for i, ((f, _), r) in enumerate(zip(docs, got)) if r.license != f]
    assert not wrong


@pytest.mark.parametrize("lines", [2, 5, 9, 17])
def test_notices_wrapped_over_any_number_of_lines(spark, folder, lines):
    """In the middle of a paragraph of 60 lines, as comments too."""
    notice = "it under the terms of the GNU General Public License as published by the Free Software Foundation".split()
    cut = [" ".join(part) for part in np.array_split(np.array(notice), lines)]
    texts = ["\n".join(sign + line for line in [*(prose(i, 7) for i in range(30)), *cut, *(prose(i, 7) for i in range(30, 60))]) for sign in ("", "# ", " * ")]
    fill = [prose(i, 60) for i in range(60)]
    got = license_scan.scan(spark.createDataFrame(rows(texts + fill), SCHEMA), folder).orderBy("doc_id").collect()
    assert [r.license for r in got] == ["gpl"] * 3 + ["none"] * 60


def test_licence_scan_of_tables_without_cues(spark, odd, none, folder):
    assert license_scan.scan(none, f"{folder}/none").collect() == []
    got = license_scan.scan(odd, f"{folder}/odd")
    assert got.count() == odd.count() and {(r.license, r.probability, r.cue_lines) for r in got.collect()} == {("none", 0.0, 0)}


def test_boosting_and_calibration():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(2000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    model = boosting.fit(x[:1500], y[:1500])
    margins = model.margin(x[1500:])
    assert ((margins > 0) == (y[1500:] == 1)).mean() > 0.95
    curve = boosting.calibrate(margins, y[1500:])
    assert (np.diff(curve(np.sort(margins))) >= 0).all() and 0 <= curve(margins).min() <= curve(margins).max() <= 1


def test_toxicity_on_given_labels(spark, sf_dir, odd, none, folder):
    big = sf_dir.replace("sf0.001", "sf0.01")
    scored = queries.op6_toxicity(spark, big)
    labels = spark.read.parquet(f"{big}/labels.parquet")
    got = scored.join(labels, "doc_id").where("held_out").toPandas()
    right = got.score.rank()[got.toxic == 1].sum() - (n := (got.toxic == 1).sum()) * (n + 1) / 2
    assert right / (n * (len(got) - n)) > 0.8 and scored.where("score < 0 OR score > 1").count() == 0
    model = toxicity.learn(odd, spark.createDataFrame([(3, 1), (4, 0), (5, None)], "doc_id long, toxic int"), folder)
    assert toxicity.score(odd, model).count() == odd.count()
    assert toxicity.learn(none, labels, f"{folder}/n").share == 0 and toxicity.reject(none, model).count() == 0
    assert toxicity.reject(odd, toxicity.Model({}, None, None, 0.0)).columns == odd.columns


def test_scores_do_not_shift_with_the_number_of_labels(spark, folder):
    """A word that four of five toxic texts have and one of ten others: nearly half of its texts are toxic."""
    filler = "river stone cloud table green window paper".split()

    def table(count):
        rng = np.random.default_rng(count)
        marks = [int(i % 10 == 0) for i in range(count)]
        has = [rng.random() < (0.8 if mark else 0.1) for mark in marks]
        texts = [" ".join([*rng.choice(filler, 12), *(["vilest"] * own), *rng.choice(filler, 3)]) for own in has]
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        return docs, spark.createDataFrame(list(enumerate(marks)), "doc_id long, toxic int")

    scores = []
    for count in (1500, 15_000):
        model = toxicity.learn(*table(count), f"{folder}/{count}", toxic=600, clean=1350)
        assert abs(model.share - 0.1) < 0.01
        probes = [" ".join([*filler[i:], *filler[:i], *filler[:5], "vilest", *filler[i:][:3]]) for i in range(7)]
        scores.append(model.score(probes, toxicity.Lexicon(model.entries)).mean())
    assert abs(scores[0] - scores[1]) < 0.15 and all(0.3 < score < 0.62 for score in scores), scores


def test_language_on_given_labels(spark, sf_dir, odd, none, folder):
    big = sf_dir.replace("sf0.001", "sf0.01")
    got = queries.op10_language(spark, big).join(spark.read.parquet(f"{big}/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = got.where("held_out").toPandas()
    assert (held.lang == held.lang_pred).mean() > 0.97 and held.score.between(0, 1).all()
    model = language.learn(none, folder)
    assert {r.lang_pred for r in language.classify(odd, model).collect()} == {"und"}
    taught = language.learn(spark.createDataFrame([(1, "aaa bbb abab", "x"), (2, None, "y"), (3, "ccc", None)], "doc_id long, text string, lang string"), f"{folder}/t")
    found = language.classify(spark.createDataFrame(rows(["abab aaa", "zzz", "12 !", None, "", "a" * 3_000_000]), SCHEMA), taught).orderBy("doc_id").collect()
    assert [r.lang_pred for r in found] == ["x", "x", "und", "und", "und", "x"] and found[0].score == 1 and found[1].score == 0


def test_more_languages_than_bits_of_a_word(spark, folder):
    """Seventy languages, each with letters of its own; the rarer ones have fewer texts."""
    own = [chr(0x4E00 + 10 * i) + chr(0x4E01 + 10 * i) + chr(0x4E02 + 10 * i) for i in range(70)]
    texts = [(own[i] * 3, f"l{i:02}") for i in range(70) for _ in range(2 if i < 35 else 1)]
    taught = spark.createDataFrame([(n, text, lang) for n, (text, lang) in enumerate(texts)], "doc_id long, text string, lang string")
    model = language.learn(taught, folder)
    found = language.classify(spark.createDataFrame(rows([text * 2 for text in own]), SCHEMA), model).orderBy("doc_id").collect()
    assert [r.lang_pred for r in found] == [f"l{i:02}" for i in range(70)] and len(model.languages) == 70


def test_chunks_lose_no_grams(monkeypatch):
    texts = ["abc def ghij", "", "klm nop qrs tuv"]
    whole = [np.sort(np.concatenate([v[o == i] for v, o in language.grams(texts)])) for i in range(3)]
    monkeypatch.setattr(language, "CHUNK", 4)
    parts = [np.sort(np.concatenate([v[o == i] for v, o in language.grams(texts)])) for i in range(3)]
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(whole, parts))


def test_search_of_odd_vectors(spark):
    vectors = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, None), (3, [None, 1.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 0.0]),
               (6, []), (7, [-3.0, 0.5]), (7, [-3.0, 0.5]), (None, [9.0, 9.0]), (8, [1e30, 0.0]), (50, [0.5])]
    table = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    table = table.where(F.col("vec_id").isNotNull() & topk.usable()).select("vec_id", topk.integers().alias("ints"))
    assert sorted({r.vec_id for r in table.collect()}) == [0, 1, 6, 7, 8, 50]
    small = table.where("vec_id <> 8")
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in topk.search(small, small.where("vec_id % 50 = 0"), candidates=2).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 256 * 256 * 5), (0, 2, 50, 256 * 128), (0, 3, 6, 0), (0, 4, 7, -256 * 512), (0, 5, 7, -256 * 512),
                   (50, 1, 0, 256 * 128), (50, 2, 1, 256 * 128), (50, 3, 6, 0), (50, 4, 7, -768 * 128), (50, 5, 7, -768 * 128)]
    assert topk.search(small.limit(0), small.limit(0)).count() == 0


def test_search_stops_early_and_is_exact():
    rng = np.random.default_rng(4)
    vectors = np.floor(rng.normal(size=(3000, 8)) * 10)
    vectors[:40] += 500
    found, read = topk.search_block(np.arange(3000), vectors, np.arange(5), vectors[:5], 5)
    scores = vectors @ vectors[:5].T
    for query in range(5):
        order = [i for i in np.lexsort((np.arange(3000), -scores[:, query])) if i != query][:5]
        assert [v for q, v, _ in found if q == query] == order
    assert read < 2 * 3000 * 8 / 3


@pytest.mark.parametrize("sizes", [(32_768, 8_192, 2_048), (40, 3, 16)])
def test_search_over_many_tiles_equals_brute_force(spark, monkeypatch, sizes):
    """Blocks of candidates and of queries, and tiles within them; ties and repeated rows."""
    monkeypatch.setattr(topk, "TILE", sizes[2])
    rng = np.random.default_rng(6)
    ints = rng.integers(-3, 4, (300, 6))
    ints[100:140] = ints[0]
    table = [(int(i), [int(x) for x in row]) for i, row in enumerate(ints)] + [(7, [int(x) for x in ints[7]])]
    df = spark.createDataFrame(table, "vec_id long, ints array<long>")
    got = topk.search(df, df.where("vec_id % 20 = 0"), candidates=sizes[0], asking=sizes[1])
    wanted = []
    for query in range(0, 300, 20):
        scored = sorted((-int(np.dot(ints[query], row)), i) for i, row in table if i != query)[:5]
        wanted += [(query, rank, i, -score) for rank, (score, i) in enumerate(scored, 1)]
    assert sorted(map(tuple, got.collect())) == wanted


def test_lists_are_read_to_a_depth_and_no_further(spark, sf_dir):
    """The embeddings of the table: bounds hold at every depth, and some entries are never read."""
    rows = queries.table(spark, sf_dir, "embeddings").where(topk.usable()).select("vec_id", topk.integers().alias("ints")).toPandas()
    ids, vectors = rows["vec_id"].to_numpy(), np.array(rows["ints"].tolist(), dtype=float)
    lists, read = topk.Lists(ids, vectors), 0
    for place in range(0, len(ids), 50):
        found, entries = lists.best(ids[place], vectors[place], 5)
        read += entries
        scores = np.where(ids == ids[place], -np.inf, vectors @ vectors[place])
        assert set(np.lexsort((ids, -scores))[:5]) <= set(found) and (scores[found] >= np.sort(scores)[-5]).all()
    assert 0 < read < len(range(0, len(ids), 50)) * vectors.size


def test_pipeline_stages(spark, sf_dir, folder, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("kept", F.lit(1))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "near dedup", "mixing", "packing"]
    counts = [docs.count()]
    for number, (name, step) in enumerate(corpus_pipeline.STAGES):
        out = step(spark, docs, sf_dir)
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(f"{folder}/{number}")
        before, docs = docs, spark.read.parquet(f"{folder}/{number}")
        counts.append(docs.count())
        if name == "exact dedup":
            assert docs.count() == before.select(F.coalesce("text", F.lit(""))).distinct().count()
    assert counts[0] >= counts[1] >= counts[2] >= counts[3] > counts[4]
    assert {r.doc_id for r in docs.select("doc_id").collect()} == {r.doc_id for r in before.select("doc_id").collect()}


@pytest.mark.parametrize("name", sorted(queries.CHECKS))
def test_query_equals_its_sql(name, spark, duck, sf_dir):
    got = queries.queries()[name](spark, sf_dir).toPandas()
    wanted = duck.execute(queries.CHECKS[name]).df()
    columns = sorted(wanted.columns)
    assert columns == sorted(got.columns)
    assert sorted(map(tuple, got[columns].astype(str).values)) == sorted(map(tuple, wanted[columns].astype(str).values))


def test_digest_is_the_lowercase_hex_of_the_text(spark, sf_dir):
    got = queries.op9_exact_dedup(spark, sf_dir).limit(3).join(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id")
    assert all(r.text_sha256 == hashlib.sha256(r.text.encode()).hexdigest() for r in got.collect())

"""Toxicity by gradient-boosted trees over dense features of the whole text, with isotonic calibration.

Features: densities, counts and weights of lexicon words, how often they stand within five words of a second-person
pronoun, shares of capitals, punctuation and symbols, and rates of obfuscated words (letters mixed with digits or signs
that stand for letters), whose lexicon hits are counted too. The lexicon is learned: words and beginnings of words
that occur in clearly more toxic than other labelled texts.

Lexicon, trees and calibration are fitted on a bounded sample of labelled rows, at most about `TOXIC` toxic and `CLEAN`
other documents, chosen by a hash among all labelled rows; two thirds make the lexicon and grow the trees, the last
third, which neither has seen, calibrates. The
sample's feature table (some 20 numbers per row) is all that reaches the driver. A row of the sample weighs as many
labelled rows of its class as it stands for, by exact counts of all labels, so that scores keep to the share of toxic
labels however few of a class are drawn; the mean weight is one. Scoring is one pass over the texts.

Cases: null text counts as empty, and an empty text has a score like any other. Long texts are read whole. Repeated
rows score alike; several labels of one id count as toxic if one is. Null labels teach nothing. With no toxic or no
clean label among the documents the score is the share of toxic ones, 0 without labels. `score` and `reject` pass other columns through.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from waymark.llm import boosting
from waymark.llm.common import CAPITALS, sampled, stage, whole_text

TOXIC, CLEAN, LEXICON, THRESHOLD = 3000, 6000, 4000, 0.3
#: Beginnings of words that the lexicon may hold, least documents and least strength of an entry.
STEMS, SEEN, STRENGTH = (5, 6, 7), 4, 4.0
NEAR = 5
#: Second-person pronouns and possessives in English, French, German and Spanish.
SECOND = frozenset(
    "you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine deinen deiner ihr euch "
    "tú ti usted ustedes tus vosotros".split()
)
#: Digits and signs that stand for letters.
SIGNS = str.maketrans("013457@$!", "oieastasi")
_WORD = re.compile(r"[^\W\d_]+")
_MIXED = re.compile(r"[^\W\d_]+(?:[013457@$!*.\-]+[^\W\d_]+)+")
#: Where a mixed word may go on after a letter; it begins with few characters, so a text is searched fast.
_INSIDE = re.compile(r"[013457@$!*.\-]+(?=[^\W\d_])")
_CAPITAL = re.compile(f"[{CAPITALS}]+")
NAMES = (
    "weight_density weight_most weight_sum hits hit_density distinct near_second near_density second_density "
    "capital_rate shouted exclaimed questioned symbol_rate digit_rate punctuation_rate obfuscated obfuscated_hits "
    "obfuscated_density words_log length_mean line_log"
).split()


class Lexicon(dict):
    """word -> weight, 0 for words that neither are entries nor begin with one. Remembers a bounded number of words."""

    def __init__(self, entries: dict[str, float]) -> None:
        self.entries = entries

    def __missing__(self, word: str) -> float:
        stems = [word[:n] + "*" for n in STEMS if len(word) > n]
        weight = max((self.entries.get(key, 0.0) for key in (word, *stems)), default=0.0)
        if len(self) >= 200_000:
            self.clear()
        self[word] = weight
        return weight


def mixed_words(low: str) -> list[str]:
    """Words of letters with digits or signs between them. Only the pieces between white space that may hold one are searched."""
    found, done = [], 0
    for hit in _INSIDE.finditer(low):
        start, stop = hit.span()
        if start < done or not start or not low[start - 1].isalpha():
            continue
        while start > done and not low[start - 1].isspace():
            start -= 1
        while stop < len(low) and not low[stop].isspace():
            stop += 1
        found += _MIXED.findall(low, start, stop)
        done = stop
    return found


def capitals(text: str, low: str) -> tuple[int, int]:
    """How many capitals a text has, and how many runs of two or more of them."""
    if len(text) != len(low):  # a few capitals have a longer small form
        runs = [len(run) for run in _CAPITAL.findall(text)]
        return sum(runs), sum(size > 1 for size in runs)
    one, two = (np.frombuffer(x.encode("utf-32-le", "surrogatepass"), "<u4") for x in (text, low))
    big = one != two
    if not big.any():
        return 0, 0
    inner = big[1:] & big[:-1]  # a run of n has n - 1 of these, side by side
    return int(big.sum()), int(inner[:1].sum() + (inner[1:] & ~inner[:-1]).sum())


def features(text: str, lexicon: Lexicon) -> list[float]:
    low, size = text.lower(), max(1, len(text))
    words = _WORD.findall(low)
    count = max(1, len(words))
    weights = np.fromiter(map(lexicon.__getitem__, words), float, len(words))
    hits = np.flatnonzero(weights)
    second = np.flatnonzero(np.fromiter(map(SECOND.__contains__, words), bool, len(words)))
    near = 0
    if len(hits) and len(second):
        at = np.searchsorted(second, hits)
        after = np.abs(second[np.minimum(at, len(second) - 1)] - hits)
        before = np.abs(second[np.maximum(at - 1, 0)] - hits)
        near = int((np.minimum(after, before) <= NEAR).sum())
    joined = [word for word in mixed_words(low) if not word.replace(".", "").replace("-", "").isalpha() or word.count(".") > 1]
    plain = [re.sub(r"[*.\-]", "", word).translate(SIGNS) for word in joined]
    hidden = sum(lexicon[word] > 0 for word in plain)
    letters = max(1, sum(map(len, words)))
    upper, shouted = capitals(text, low)
    signs = Counter({sign: text.count(sign) for sign in ".,!?#$%&*|"})
    symbols = sum(signs[sign] for sign in "#$%&*|")
    total = float(weights.sum())
    return [
        total / count, float(weights.max(initial=0)), total, len(hits), len(hits) / count,
        len({words[i] for i in hits}), near, near / count, len(second) / count,
        upper / letters, shouted / count, signs["!"] / count, signs["?"] / count, symbols / size,
        sum(map(low.count, "0123456789")) / size, (signs["."] + signs[","]) / count, len(joined), hidden,
        len(joined) / count, np.log1p(len(words)), letters / count, np.log1p(text.count("\n")),
    ]


@dataclass
class Model:
    entries: dict[str, float]
    trees: boosting.Trees | None
    curve: boosting.Isotonic | None
    share: float

    def score(self, texts: list[str], lexicon: Lexicon) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.share)
        rows = np.array([features(text, lexicon) for text in texts]).reshape(len(texts), len(NAMES))
        return np.clip(self.curve(self.trees.margin(rows)), 0.0, 1.0)


def _entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Documents per word and stem, toxic ones and all, summed per batch."""
    for batch in batches:
        seen, toxic = Counter(), Counter()
        for text, label in zip(batch["text"], batch["toxic"], strict=True):
            words = set(_WORD.findall(text.lower()))
            own = {word for word in words if len(word) <= 24} | {word[:n] + "*" for word in words for n in STEMS if len(word) > n}
            seen.update(own)
            if label:
                toxic.update(own)
        rows = [(entry, often, toxic[entry]) for entry, often in seen.items()]
        yield pd.DataFrame(rows, columns=["entry", "seen", "toxic"])


def _lexicon(sample: DataFrame, share: float, weights: tuple[float, float]) -> dict[str, float]:
    """Entries whose documents are toxic far more often than by chance, with the logarithm of their odds.

    `weights` are those of a clean and of a toxic row. `SEEN` counts rows as they are.
    """
    counted = sample.mapInPandas(_entries, "entry string, seen long, toxic long").groupBy("entry")
    counted = counted.agg(F.sum("seen").alias("seen"), F.sum("toxic").alias("toxic"))
    clean, toxic = (F.col("seen") - F.col("toxic")) * F.lit(weights[0]), F.col("toxic") * F.lit(weights[1])
    expected = (clean + toxic) * F.lit(share)
    strength = (toxic - expected) / F.sqrt(expected * F.lit(1 - share) + 1)
    odds = (toxic + 0.5 * weights[1]) * (1 - share) / ((clean + 0.5 * weights[0]) * share)
    strong = counted.where(F.col("toxic") >= SEEN).select("entry", strength.alias("strength"), F.log(odds).alias("weight"))
    rows = strong.where((F.col("strength") >= STRENGTH) & (F.col("weight") >= 1.5))
    return {row["entry"]: row["weight"] for row in rows.orderBy(F.desc("strength"), "entry").limit(LEXICON).collect()}


def learn(docs: DataFrame, labels: DataFrame, folder: str, toxic: int = TOXIC, clean: int = CLEAN) -> Model:
    """Fit on `docs` that have a label; `labels` has doc_id and toxic, and only rows one may learn from."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL")
    known = known.groupBy("doc_id").agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    bounded = sampled(known.where("toxic = 1"), "doc_id", "toxic", toxic).unionByName(
        sampled(known.where("toxic = 0"), "doc_id", "toxic", clean)
    )
    labelled, drawn = ({row["toxic"]: row["count"] for row in rows.groupBy("toxic").count().collect()} for rows in (known, bounded))
    texts = docs.select("doc_id", whole_text().alias("text"))
    # the sample has a fixed bound, about 9,000 rows of an id and a flag
    sample = stage(texts.join(F.broadcast(bounded), "doc_id").dropDuplicates(["doc_id"]), folder, "sample")
    # every third of a class in the order of ids: a few thousand ids and flags
    place = F.row_number().over(Window.partitionBy("toxic").orderBy("doc_id"))
    thirds = sample.select("doc_id", "toxic").select("doc_id", (place % 3 == 0).alias("held"))
    sample = sample.join(F.broadcast(thirds), "doc_id").repartition(16, "doc_id")
    parts = {(row["toxic"], row["held"]): row["count"] for row in sample.groupBy("toxic", "held").count().collect()}
    found = {mark: parts.get((mark, True), 0) + parts.get((mark, False), 0) for mark in (0, 1)}
    found = {mark: n for mark, n in found.items() if n}
    stands = {mark: n * labelled[mark] / drawn[mark] for mark, n in found.items()}  # labelled rows that the class stands for
    share = stands.get(1, 0.0) / max(1.0, sum(stands.values()))
    if len(found) < 2:
        return Model({}, None, None, share)
    mean = sum(stands.values()) / sum(found.values())
    weights = tuple(stands[mark] / found[mark] / mean for mark in (0, 1))
    apart = len(parts) == 4  # a third of the rows is neither in the lexicon nor in the trees, where there are rows of both classes
    entries = _lexicon(sample.where("NOT held") if apart else sample, share, weights)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon = Lexicon(entries)
        for batch in batches:
            rows = [features(text, lexicon) for text in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "toxic": batch["toxic"], "held": batch["held"], "features": rows})

    measured = sample.mapInPandas(measure, "doc_id long, toxic int, held boolean, features array<double>")
    table = measured.orderBy("doc_id").toPandas()
    rows, marks = np.array(table["features"].tolist()), table["toxic"].to_numpy(float)
    held = table["held"].to_numpy(bool) if apart else np.ones(len(rows), bool)
    grown = ~held if apart else held
    heavy = np.where(marks == 1, weights[1], weights[0])
    trees = boosting.fit(rows[grown], marks[grown], heavy[grown])
    return Model(entries, trees, boosting.calibrate(trees.margin(rows[held]), marks[held], heavy[held]), share)


def _texts(batch: pa.RecordBatch) -> list[str]:
    return [text or "" for text in batch.column(batch.schema.get_field_index("text")).to_pylist()]


def score(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """The documents with the chance that label 1 fits; a column of that name is replaced."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(model.entries)
        for batch in batches:
            values = pa.array(model.score(_texts(batch), lexicon), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, values], [*batch.schema.names, column])

    docs = docs.drop(column)
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())]))


def reject(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score below the threshold, with their own columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(model.entries)
        for batch in batches:
            yield batch.filter(pa.array(model.score(_texts(batch), lexicon) < threshold))

    return docs.mapInArrow(run, docs.schema)

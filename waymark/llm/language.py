"""Language identification by n-grams in a bit-sliced Bloom filter.

Learning counts the letter n-grams (three and four code points, with word borders) of labelled texts per language and
keeps those that make up at least `RATE` of a language's n-grams, and at least `PART` of the rate they have in the
language where they are most frequent. One table of bit masks, as many 64-bit words wide as the languages need, holds all
languages: bit l of the three places of an n-gram is set if language l has it. The conjunction of the three masks gives every language that has an n-gram at
once. A text's masks are counted per language; the counts are corrected for the share of n-grams that the filter
shows by mistake, (hits - n * error) / (1 - error), and the highest decides.

The filter is fitted on at most about `BOUND` texts of each language, chosen by a hash; counts of languages cover all
learning rows. Its size is bounded by 1 / `RATE` n-grams for each language.

Cases: null texts and texts without a letter are `und` with score 0. A text whose n-grams nobody has gets the most
frequent language and score 0; ties go to the more frequent language, then by name. Without learning rows all texts are
`und`. Whole texts count, however long; repeated rows are scored alike. `classify` passes other columns through.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from waymark.llm.common import sampled, stage, whole_text

BOUND, RATE, PART, WORD = 2000, 5e-5, 0.05, 64
SIZES, PROBES, NONE = (3, 4), 3, "und"
#: Code points of texts that are hashed at a time.
CHUNK = 1 << 20
_LETTERS = np.array([chr(c).isalpha() for c in range(0x110000)])


def _mixed(x: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) % (1 << 64))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(31))


def grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(n-grams as 64-bit values, index of the text of each), for chunks of texts. Long texts take several chunks."""
    codes, owners, length = [], [], 0
    for owner, text in enumerate(texts):
        points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), "<u4").astype(np.uint64)
        for start in range(0, max(1, len(points) - 1), CHUNK):
            piece = points[start : start + CHUNK + max(SIZES) - 1]  # overlapping, so that no n-gram is lost
            codes.append(piece)
            owners.append((owner, len(piece), min(CHUNK, len(points) - start)))
            length += len(piece)
            if length >= CHUNK:
                yield _hashed(codes, owners)
                codes, owners, length = [], [], 0
    if codes:
        yield _hashed(codes, owners)


def _hashed(codes: list[np.ndarray], owners: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    points = np.concatenate(codes)
    lengths = np.array([length for _, length, _ in owners])
    owner = np.repeat(np.array([owner for owner, _, _ in owners]), lengths)
    place = np.arange(len(points)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    room, starts = np.repeat(lengths, lengths) - place, place < np.repeat(np.array([n for _, _, n in owners]), lengths)
    letter = _LETTERS[points]
    points = np.where(letter, points, np.uint64(0))
    found, whose = [], []
    for size in SIZES:
        if len(points) < size:
            continue
        count = len(points) - size + 1
        inner = np.ones(count, bool)
        for step in range(1, size - 1):  # a border may only open or close an n-gram
            inner &= letter[step : count + step]
        keep = np.flatnonzero(inner & (letter[:count] | letter[size - 1 :]) & starts[:count] & (room[:count] >= size))
        with np.errstate(over="ignore"):
            value = np.full(len(keep), size, np.uint64)
            for step in range(size):
                value = value * np.uint64(1_000_003) + points[keep + step]
        found.append(value)
        whose.append(owner[keep])
    return np.concatenate(found or [np.zeros(0, np.uint64)]), np.concatenate(whose or [np.zeros(0, np.int64)])


def _bit(masks: np.ndarray, language: int) -> np.ndarray:
    return (masks[:, language // WORD] >> np.uint64(language % WORD)) & np.uint64(1)


@dataclass
class Model:
    languages: list[str]  # the most frequent first
    masks: np.ndarray  # one row per place, 64 languages to a word
    errors: np.ndarray  # per language: share of other n-grams that its bits show by mistake

    def hits(self, values: np.ndarray) -> np.ndarray:
        found = np.full((len(values), self.masks.shape[1]), np.uint64(2**64 - 1))
        for probe in range(PROBES):
            found &= self.masks[(_mixed(values, probe) % np.uint64(len(self.masks))).astype(np.int64)]
        return found

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        if not self.languages:
            return [NONE] * len(texts), np.zeros(len(texts))
        total, counts = np.zeros(len(texts)), np.zeros((len(texts), len(self.languages)))
        for values, owner in grams(texts):
            found = self.hits(values)
            total += np.bincount(owner, minlength=len(texts))
            for language in range(len(self.languages)):
                bit = _bit(found, language)
                counts[:, language] += np.bincount(owner, weights=bit, minlength=len(texts))
        corrected = np.maximum((counts - total[:, None] * self.errors) / (1 - self.errors), 0)
        best, whole = corrected.argmax(axis=1), corrected.sum(axis=1)
        score = np.divide(corrected.max(axis=1), whole, out=np.zeros(len(texts)), where=whole > 0)
        lettered = np.array([any(map(str.isalpha, text)) for text in texts], bool)
        names = [self.languages[i] if known else NONE for i, known in zip(best, lettered, strict=True)]
        return names, np.where(lettered, score, 0.0)


def learn(rows: DataFrame, folder: str, bound: int = BOUND, rate: float = RATE) -> Model:
    """Fit on rows with `doc_id`, `text` and `lang`; those without language teach nothing."""
    rows = rows.where("lang IS NOT NULL").select("doc_id", "lang", whole_text().alias("text"))
    frequent = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()
    languages = [row["lang"] for row in frequent]
    if not languages:
        return Model([], np.zeros((1, 1), np.uint64), np.zeros(0))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, texts in batch.groupby("lang")["text"]:
                for values, _ in grams(list(texts)):
                    kinds, often = np.unique(values, return_counts=True)
                    yield pd.DataFrame({"lang": lang, "gram": kinds.view(np.int64), "often": often})

    sample = sampled(rows, "doc_id", "lang", bound)
    counted = sample.select("lang", "text").mapInPandas(count, "lang string, gram long, often long")
    counted = stage(counted.groupBy("lang", "gram").agg(F.sum("often").alias("often")), folder, "grams")
    wholes = counted.groupBy("lang").agg(F.sum("often").alias("whole"))
    rated = counted.join(wholes, "lang").withColumn("rate", F.col("often") / F.col("whole")).where(F.col("rate") >= rate)
    highest = F.max("rate").over(Window.partitionBy("gram"))
    kept = rated.withColumn("highest", highest).where(F.col("rate") >= PART * F.col("highest")).toPandas()

    values = kept["gram"].to_numpy(np.int64).view(np.uint64)
    owner = kept["lang"].map({name: i for i, name in enumerate(languages)}).to_numpy(np.int64)
    slots = 1 << max(10, math.ceil(math.log2(8 * max(1, kept["gram"].nunique()))))
    masks = np.zeros((slots, -(-len(languages) // WORD)), np.uint64)
    for probe in range(PROBES):
        places = (_mixed(values, probe) % np.uint64(slots)).astype(np.int64)
        np.bitwise_or.at(masks, (places, owner // WORD), np.uint64(1) << (owner % WORD).astype(np.uint64))
    filled = [np.mean(_bit(masks, i)) for i in range(len(languages))]
    return Model(languages, masks, np.array(filled) ** PROBES)


def classify(docs: DataFrame, model: Model, prediction: str = "lang_pred", score: str = "score") -> DataFrame:
    """The documents with two more columns, the language of the whole text and its share of the counted n-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [text or "" for text in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            names, scores = model.predict(texts)
            columns = [*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, prediction, score])

    docs = docs.drop(prediction, score)
    added = [T.StructField(prediction, T.StringType()), T.StructField(score, T.DoubleType())]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *added]))

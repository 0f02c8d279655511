"""From raw documents to packed training windows: each stage works on what the one before it kept.

`STAGES` lists (name, function of session, documents and folder of tables); every result is written as Parquet and read
again before the next stage. All but the last return the columns of `documents`. No SQL can express the learned
stage, so `ORACLE_SQL` is None and tests compare the stages with brute force.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from waymark.llm import dart_minhash, exact_dedup, mixing, packing, toxicity
from waymark.llm.common import held_out, stage, table, work_dir
from waymark.llm.queries import MIX_LEVELS, mix_weights, with_domain
from waymark.session import prepare

#: Share of the tokens that the mix takes. Every document is taken once at most.
SHARE = 0.9


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the threshold; learned from those that have a label and may be learned from."""
    labels = table(spark, sf_dir, "labels").where(~held_out("doc_id", 4, 2))
    return toxicity.reject(docs, toxicity.learn(docs, labels, work_dir(spark, "toxicity")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the greatest doc_id."""
    return exact_dedup.apply(docs, exact_dedup.deduplicate(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of texts linked by a similarity of 0.8 or more, the row with the smallest doc_id."""
    return dart_minhash.representatives(docs, dart_minhash.near_duplicates(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn to the target weights; the last one of a leaf is kept whole."""
    drawn = mixing.draw(with_domain(docs), MIX_LEVELS, mix_weights(), share=SHARE, epochs=1)
    return drawn.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The windows, one row per piece of a document."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("mixing", mix),
    ("packing", pack),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages over `documents`."""
    docs = table(prepare(spark), sf_dir, "documents")
    folder = work_dir(spark, "pipeline")
    for number, (_, step) in enumerate(STAGES):
        docs = stage(step(spark, docs, sf_dir), folder, f"stage-{number}")
    return docs

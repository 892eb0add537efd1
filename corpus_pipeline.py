"""A training corpus from ``documents``: reject, deduplicate, mix, encode.

Each stage takes ``(spark, docs, sf_dir)``, works on all rows that the stage before kept, and returns a
table that is written as Parquet and read again as the next stage's ``docs``. All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.llm import bpe_codec, exact_dedup, mixing, quality, simhash
from turnwise.llm.common import documents, labels, materialize

#: Shares of words by domain of ``labels`` after mixing.
TARGETS = {"clean": 0.98, "toxic": 0.02}


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; it learns from the votes on ``docs``."""
    return quality.keep_good(docs, quality.train(docs))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the smallest ``doc_id`` stays."""
    return exact_dedup.drop_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints the smallest ``doc_id`` stays."""
    return simhash.drop_near_duplicates(docs)


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are taken at the rates that bring the domains of ``TARGETS`` to their shares. Junk is no domain
    here: the first stage has rejected it, and copies of what is left of it would undo the dedup stages."""
    named = labels(spark, sf_dir).select(
        "doc_id", mixing.domain_of(F.col("quality"), F.col("toxic")).alias("domain")).filter(F.col("domain").isin(*TARGETS))
    model, steps, _ = mixing.plan(docs, named, TARGETS)
    return mixing.apply_rates(docs, model, steps)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with the digests of the ids and of the text decoded from them."""
    return bpe_codec.round_trip(docs)


STAGES = [
    ("quality classifier", reject_low_quality),
    ("exact dedup", drop_exact_copies),
    ("simhash near-dedup", drop_near_copies),
    ("mixing to target weights", mix_to_targets),
    ("bpe encoding", encode),
]

# Trained models and token ids cannot be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

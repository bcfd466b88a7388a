"""The corpus pipeline: toxicity, SimHash near-dedup, personal data, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as Parquet
below the shared checkpoint folder and reads it back as the next stage's documents. All stages but the
last return the columns of ``documents``. What they do with nulls, repeated rows, empty and very long
texts and empty tables is what their operators' modules say; extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promolens.llm import mixing, pii_bootstrap, sentencepiece_codec, simhash_ball, toxicity
from promolens.llm.common import read, store

#: Documents with at least this score go.
TOXIC = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays below ``TOXIC``; the fit uses ``labels`` and the documents of this stage."""
    weights, bias = toxicity.train(docs, read(spark, sf_dir, "labels"), F.lit(True))
    return toxicity.keep_below(docs, weights, bias, TOXIC)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component."""
    return simhash_ball.deduplicate(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with every span of personal data replaced by its kind; n_chars follows the text."""
    return pii_bootstrap.mask(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed(docs)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, round_trip of every row."""
    return sentencepiece_codec.encode(docs)


STAGES = [("toxicity", drop_toxic), ("simhash_near_dedup", drop_near_copies), ("personal_data", mask_personal_data),
          ("mixing", mix_sources), ("sentencepiece", to_tokens)]

#: Toxicity, SimHash and SentencePiece are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs

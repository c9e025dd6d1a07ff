"""A corpus pipeline: documents without toxic, unidentified and near-duplicate ones, secrets removed, packed into sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm import jaccard, langid, packing, secrets, toxicity
from sparkloom.llm.bpe import vocabulary_path
from sparkloom.llm.common import stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below the threshold."""
    return toxicity.clean_documents(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is determined."""
    return langid.keep_identified(docs, langid.fit(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return jaccard.keep_one_of_group(docs)


def remove_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark."""
    return secrets.redact_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as pieces of sequences of 1024 tokens."""
    return packing.pack(docs, vocabulary_path("byte_bpe_50k.json"), end_id=2)


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", keep_identified),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", remove_secrets),
    ("packing", pack_sequences),
]

#: The model of the first stage is learned; SQL can't express it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

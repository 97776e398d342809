"""A training corpus from raw documents in five stages, each of them one of the corpus operators.

Each stage gets what the one before kept, and all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfloom.llm import exact, jaccard, mixing, pieces, quality
from shelfloom.session import materialise


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the quality classifier rejects."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_of_equal_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the largest id of each group of equal texts."""
    return exact.drop_copies(docs)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group that links of 0.8 over five-word n-grams connect."""
    return jaccard.drop_near_copies(docs, width=5, percent=80)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat and drop documents so that sources come near their target weights."""
    return mixing.mix(docs)


def encoded_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sampled pieces of each document, with the proof that they decode to its text."""
    return pieces.encode_documents(docs)


STAGES = [
    ("quality classifier", good_documents),
    ("exact dedup", one_of_equal_texts),
    ("n-gram Jaccard join", one_of_near_copies),
    ("mixing sources to target weights", mixed_sources),
    ("SentencePiece encoding and decoding", encoded_documents),
]

# A trained classifier, links followed to their end and a sampled path are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each writes its rows and the next reads them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

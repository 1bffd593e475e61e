"""From raw documents to packed sequences: language, quality, near-duplicates, packing.

A table without rows passes through all stages. Columns of the documents that have the name
of one that a stage works out stay as they are, and are not read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from aislebrook.llm import langid, queries, simhash, weaklabels
from aislebrook.sources.scratch import materialize

# Bytes of texts that packing encodes at a time: executors still hold what the stages before took.
PACKED_AT_ONCE = 1 << 20


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the models of all languages recognise. A null text, or one
    without letters, has none and goes; a null `lang` only keeps the row from the training."""
    return langid.keep_identified(docs, langid.train(docs))


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labellers' votes on them, keeps. Equal
    texts have equal scores, so copies stay or go together; one without words goes."""
    return weaklabels.keep_good(docs, *weaklabels.train(docs))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id, one row where
    that id is repeated. Texts without a word are one group."""
    return simhash.one_of_each(docs, shingle=3, radius=3)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in their sequences; a null or empty text is its end id."""
    return queries.pieces(docs, PACKED_AT_ONCE)


STAGES = [("language ID", identified), ("quality classifier", good), ("SimHash near-dedup", distinct), ("packing", packed)]

# Models, fingerprints and vocabularies have no SQL; the tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs

"""Cleans a corpus in five stages, each written as Parquet and read again as the next one's documents.

All stages but the last return the columns of ``documents``. Where to write comes from ``spark.checkpoint.dir``, the
folder that all executors share.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablelore.llm import circulant, disclosure, packing, toxicity, tries
from tablelore.session import checkpoint_folder


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on the labels of this corpus, does not reject."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.not_toxic(docs, model)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal text the one with the smallest id."""
    return tries.first_of_each(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, and those without any word."""
    return circulant.first_of_each(docs)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and disclosing terms taken out of their text."""
    return disclosure.sanitised(docs).withColumn("n_chars", F.length("text").cast("bigint")).select(docs.columns)


def as_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of at most 2048 tokens."""
    return packing.packed(docs)


STAGES = [
    ("toxicity", without_toxic), ("exact_dedup", without_copies), ("near_dedup", without_near_copies),
    ("personal_data", without_personal_data), ("packing", as_sequences),
]

#: A classifier and a tokenizer are beyond SQL; the tests run the stages against plain loops instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs

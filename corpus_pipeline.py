"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns the documents that go on; its result is written as
Parquet and read again as the next one's docs. The last returns the packed pieces. A document without
doc_id goes through every stage like any other; no documents give no pieces.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from paperloom.llm._shared import documents, shared_folder
from paperloom.llm.exact_dedup import drop_duplicates
from paperloom.llm.language_id import accepted_documents
from paperloom.llm.mixing import mixed_documents
from paperloom.llm.packing import pack_documents
from paperloom.llm.simhash_dedup import one_of_each


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language models accept; those without a letter, or too unlikely in every language, go."""
    return accepted_documents(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each distinct text, that with the largest doc_id."""
    return drop_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the least doc_id."""
    return one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: up to two times, or not at all."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens with their place in a sequence."""
    return pack_documents(docs)


STAGES = [("language", language), ("exact", exact), ("near", near), ("mixing", mixing), ("packing", packing)]

#: Language models and XXH64 fingerprints have no SQL form; a test holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs

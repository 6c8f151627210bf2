"""The corpus pipeline: documents in, packed training sequences out.

Each stage works on all rows that the one before it kept, written as Parquet and read again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from repoaudit.llm import common, language_id, packing, quality_classifier, secret_scans, simhash_dedup


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the quality classifier scores at its threshold or above."""
    model = quality_classifier.train(docs, common.table(spark, sf_dir, "labels"))
    return common.keep_rows(docs, lambda d, keep: quality_classifier.classify(d, model, keep=keep), "predicted = 1")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is identified with accepted probability."""
    model = language_id.train(docs)
    return common.keep_rows(docs, lambda d, keep: language_id.identify(d, model, keep=keep), "accepted")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps, of each group of near-duplicates, the document with the smallest id.

    Linked are texts whose whole sets of five-word shingles have a Jaccard similarity of 0.8 or more. Candidates come from fingerprints within two bits and from
    MinHash bands. Documents are told apart by id and text, so no text is lost where an id repeats; of rows equal in both one stays.
    """
    return simhash_dedup.deduplicate(docs, n=5, limit=2, least=0.8)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks every secret in the texts; all documents stay."""
    return secret_scans.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in sequences of at most 2048 tokens."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", quality),
    ("language ID", language),
    ("SimHash near-dedup", near_duplicates),
    ("secret scans", secrets),
    ("best-fit packing", pack),
]

#: Trained models and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """All stages over ``documents``; each result but the last is a Parquet table in ``folder``, one of its own in the shared checkpoint folder if not given.

    The result reads the last of these tables, so they stay until the caller deletes them.
    """
    docs = common.table(spark, sf_dir, "documents")
    folder = folder or f"{common.shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
    return docs

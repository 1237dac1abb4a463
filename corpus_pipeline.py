"""The corpus pipeline: from raw documents to packed training sequences."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from plantwatch.llm import mixing, ngram_join, packing, quality, queries, secrets
from plantwatch.session import fresh_path


def drop_bad(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, quality.train(docs, queries.table(spark, sf_dir, "labels")), queries.KEEP_SCORE)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one document stays."""
    return ngram_join.keep_one(docs)


def clean_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are cut out of the texts; every document stays."""
    return secrets.remove_secrets(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are dropped or repeated towards the target weights of their sources."""
    return mixing.repeat_rows(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: pieces of documents with their ids and places."""
    return packing.pack_documents(docs, queries.TOKENIZER)


STAGES = [
    ("quality_classifier", drop_bad),
    ("ngram_join", drop_near_copies),
    ("secret_scan", clean_secrets),
    ("mix_sources", mix_sources),
    ("packing", pack),
]

#: Neither the classifier nor the tokenizer can be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))
    for name, stage in STAGES:
        path = fresh_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

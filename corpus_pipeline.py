"""A corpus from raw documents: toxic ones and copies go, sources are mixed, and what is left is encoded.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. Stages are written as
Parquet and read again, so each starts from a committed table. Null and empty texts, ties, repeated rows, empty tables and other
columns are as the operators' docstrings say; no stage fails on them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from textloom.llm.bpe import encoding_digests
from textloom.llm.exact_dedup import drop_copies
from textloom.llm.mixing import mixed_documents
from textloom.llm.near_dedup import drop_near_copies
from textloom.llm.toxicity import drop_toxic
from textloom.plans.scratch import settle

RANKS = "byte_bpe_multi_50k.tiktoken"


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more are rejected; the classifier learns from the labels of ``sf_dir``."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts the one with the largest doc_id stays."""
    return drop_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of similarity 0.8 or more join, the one with the smallest doc_id stays."""
    return drop_near_copies(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: not at all, once or twice."""
    return mixed_documents(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of each row."""
    return encoding_digests(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", without_toxic),
    ("exact dedup", without_copies),
    ("MinHash near-dedup", without_near_copies),
    ("mixing sources to target weights", mixed),
    ("byte-level BPE encoding and decoding", encoded),
]

#: Training, signatures and merges are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

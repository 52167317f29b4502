"""A corpus pipeline: quality rules, near-dedup, secret scans, mixing, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next stage's docs. All stages but the last return
the columns of documents, whatever these are and however named. An empty table
stays empty through all stages. Stages' outputs are kept in the shared folder, as
the last one is read from there; the cluster clears it with the checkpoints.
ORACLE_SQL is None: byte-pair encoding and the recall of
the near-dedup stage aren't expressible in SQL, so tests hold run() against plain
Python instead.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from guardwalk.llm import bpe, mixing, neardup, quality, secrets
from guardwalk.session import checkpoint_dir


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a rule of the threshold table go, null and empty texts among them; null ids and repeated rows are judged like others."""
    return quality.keep_quality(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, similarity 0.8.

    It is the one with the least id; of several rows with that id one stays. Documents without words or without id stay, all their rows.
    """
    return neardup.drop_near_copies(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by a mark; every document and row stays, null and empty texts as they are."""
    return secrets.redact_secrets(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the numbers that the mix takes of them: none, one or several rows.

    Texts without words weigh nothing and go. A null source is a source of its own; documents of one source, id and length share their copies.
    """
    return mixing.mixed_documents(docs)


def encode_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts, and digests of the ids and of the bytes decoded from them; a null text is empty, repeated rows give repeated results."""
    return bpe.encode_texts(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality rules", quality_rules),
    ("near-dedup", near_dedup),
    ("secret scans", secret_scans),
    ("mixing", mix_sources),
    ("byte-level BPE", encode_bpe),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs

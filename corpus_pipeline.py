"""The corpus pipeline: quality rules, near duplicates, secrets, source mix, encoding.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe, mixing, ngram_join, quality, secrets
from tidemark.llm.common import Staging, table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the default policy keeps."""
    return quality.filter_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest id, of each group linked at 0.8 on five-word shingles."""
    return ngram_join.keep_one(docs, n=5, percent=80)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret in their texts replaced by its kind."""
    return secrets.redact(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.mix_documents(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and digests of every document of the mix."""
    return bpe.encode_documents(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


STAGES = [("quality rules", quality_rules), ("near duplicates", near_duplicates), ("secret scans", secret_scans), ("source mix", source_mix), ("byte-level BPE", byte_bpe)]

#: The encoding can't be written in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what a stage was given is let go when its own documents are written."""
    docs, tables, before = table(spark, sf_dir, "documents"), Staging(spark), None
    for name, stage in STAGES[:-1]:
        docs = tables.put(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
        if before is not None:
            tables.drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)

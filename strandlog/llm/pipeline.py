"""Corpus preparation in stages.

Each stage takes what the one before kept: it gets (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet in the shared folder and read again as the next one's ``docs``. All but the last return the columns of
``documents``; the last returns the packed pieces. SQL can express neither the classifiers nor the packing, so there is
no ``ORACLE_SQL``; tests hold the whole pipeline against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandlog.llm import decontamination, near_duplicates, packing, quality, secrets
from strandlog.llm.common import cut, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quadratic discriminant on document statistics: documents below its threshold go."""
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def keep_first(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: of each group of near copies the document with the smallest id stays."""
    return near_duplicates.keep_first(docs)


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: contaminated documents go."""
    return decontamination.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret scan: every document stays, a mark takes the place of each secret, and n_chars follows the text."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing along a Hilbert curve: the pieces of all documents in sequences of 4096 tokens."""
    return packing.pack(docs)


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", keep_first),
    ("decontamination", keep_clean),
    ("secrets", redact),
    ("packing", pack),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

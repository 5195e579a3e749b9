"""A corpus pipeline: drop low quality, drop copies, keep one of each near-duplicate class, mix the
sources, and encode.

Every stage takes the documents that the one before it kept, and all but the last return the columns of
`documents`. Mixing shows every remaining document at least once and documents of small sources up to
REPETITION_LIMIT times, so a document may be in the result more than once, always with the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfcast.llm import bpe, exact_dedup, mixing, near_dedup, quality
from shelfcast.llm.queries import byte_vocabulary
from shelfcast.sources.storage import stage

REPETITION_LIMIT = 2.0
ORACLE_SQL = None  # learned scores, sketches and merges are beyond SQL; see tests/llm


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_exact_duplicates(docs)


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.drop_near_duplicates(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(docs, repetition_limit=REPETITION_LIMIT).select(*docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(docs, byte_vocabulary()).drop("decoded_text")


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_deduplication),
    ("MinHash near-dedup", near_deduplication),
    ("mixing sources to target weights", source_mixing),
    ("BPE encoding and decoding", encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The encoded mix of `documents`; between stages the documents are stored as Parquet."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, apply in STAGES[:-1]:
        docs = stage(apply(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)

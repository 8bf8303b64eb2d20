"""A training-corpus pipeline over ``documents``: five stages, each by one operator of ``reqsight.llm``.

Each stage takes ``(spark, docs, sf_dir)`` and works on every row its predecessor kept; its result is written as
Parquet in the shared checkpoint folder and read again, so a lost executor or a failed stage repeats one stage only.
All stages but the last return the columns of their input.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, functions as F

from reqsight.llm import bpe, decontaminate, exact_dedup, quality, simhash
from reqsight.llm.common import read
from reqsight.llm.queries import tokenizer_path
from reqsight.session import shared_path


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; it learns from the labels of the given tables."""
    model = quality.train(quality.sample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")))
    return quality.keep_good(docs, model)


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text: the one with the largest doc_id."""
    return exact_dedup.drop_duplicates(docs)


def distinct_fingerprints(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: the one with the smallest doc_id."""
    return simhash.drop_near_duplicates(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of the benchmark."""
    return decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers) and decoded text of what is left."""
    r = bpe.encode_decode(docs, tokenizer_path())
    return r.select("doc_id", F.expr("octet_length(ids) div 4").cast("bigint").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("quality_classifier", good_documents),
    ("exact_dedup", distinct_texts),
    ("simhash_near_dedup", distinct_fingerprints),
    ("benchmark_decontamination", uncontaminated),
    ("bpe_encoding", encoded),
]

#: The classifier and the tokenizer have no SQL form; tests/llm/test_pipeline.py holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    base = shared_path(spark, f"pipeline-{uuid4().hex}")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return docs

"""A corpus pipeline: good documents, one of each near-duplicate group, no benchmark passages, no secrets, token ids."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm import bpe, decontam, quality_gam, secrets, simhash
from driftline.llm.common import remove_folder, shared_folder, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_gam.keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact_secrets(docs)


def encode_and_decode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, and what they decode to."""
    done = bpe.round_trip(docs.select("doc_id", "lang", "source", "text"), carry=["doc_id", "lang", "source"])
    return done.select("doc_id", "lang", "source", "n_tokens", F.col("ids").alias("input_ids"), "decoded")


STAGES = [
    ("quality classifier", quality),
    ("near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("secret scan", redact),
    ("bpe encoding and decoding", encode_and_decode),
]

#: The classifier and the tokenizer can't be said in SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written to the shared folder and read again.

    A stage's table goes when the next one is written; the last one stays, as the
    result is read from it. An empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            remove_folder(spark, f"{folder}/{k - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)

"""From raw documents to training documents: five stages, each over all that the one before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each
stage's result as Parquet in the shared folder and reads it as the next one's
docs. All but the last return the columns of documents.

1. quality: documents whose probability of the upper grade is below a half go.
2. exact: of equal texts the longest original stays, then the smallest id.
3. near: of each component of near duplicates the smallest id stays.
4. leaks: documents that hold a benchmark item go.
5. tokens: byte-level BPE ids, with digests of the ids and of what they decode to.

Nulls, empty and very long texts, repeated rows and further columns are the
operators' cases; an empty table passes through every stage as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerflow.llm import bpe, decontaminate, exact_dedup, quality, simhash
from ledgerflow.llm.shared import written


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.select_good(docs, quality.fit(docs, labels))


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_exact_copies(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_copies(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digests of the ids and of the bytes that they decode to."""
    ids = bpe.encode(docs, decoded=True)
    return ids.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("text_sha256"))


STAGES = [("quality", keep_good), ("exact", drop_exact), ("near", drop_near), ("leaks", drop_leaks), ("tokens", to_tokens)]

ORACLE_SQL = None  # a fitted model, fingerprints and BPE are not SQL; tests/llm checks the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs

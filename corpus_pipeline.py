"""The corpus pipeline: stages that run one after another, each on all rows that the one before it kept.

Toxic documents go, of equal texts one row stays, of near duplicates one row stays, documents that hold a benchmark
passage go, and what is left is encoded. All stages but the last return the columns of `documents`.

Defined results: an empty table gives no rows; null texts count as empty, and one empty text stays; without labels of both
kinds no document is toxic; rows without an identifier are rows like others; of fully repeated rows one stays; very long
texts pass whole; extra columns go along up to the last stage, which returns those of its operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siltstone.llm import bpe, common, decontam, dedup, near, toxicity

#: A learned score, connected components and BPE have no SQL form.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.filter_clean(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near.deduplicate(docs, similarity=0.8, miss=1e-5)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.remove_leaked(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.round_trip(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written to the shared folder and read again, and goes once the next is there."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder, before = common.scratch(spark, "pipeline"), None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            common.discard(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs

"""The corpus pipeline: from raw documents to training shards.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps, with their columns; the last returns their
places. No SQL expresses the near-duplicate and the decontamination stage, so the pipeline has no ORACLE_SQL; its tests
hold it against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from triplake.llm import decontam, minhash, mixing, quality, sharding
from triplake.llm.shared import table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.quality_filter(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.near_dedup(docs, width=5)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.resample(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(docs)


STAGES = [("quality", quality_rules), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix", mix_sources), ("shard", shard)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

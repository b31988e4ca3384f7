"""A corpus pipeline of five stages, each one operator over all that the last one kept.

1. toxicity: documents predicted toxic go;
2. near_dedup: of each group of near copies the document with the smallest id stays;
3. decontaminate: documents with benchmark passages go;
4. mix: documents are sampled to the target mix of sources, languages and layouts;
5. shard: every document left gets its shard and slot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusforge.llm import decontaminate, minhash, mixing, sharding, toxicity
from corpusforge.llm._common import shared_dir, table

#: Training, raking and components are iterative, so SQL can't give these rows.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.keep_first(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def sample_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.keep_mixed(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.result(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("mix", sample_mix),
    ("shard", shard),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stored and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = shared_dir(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)

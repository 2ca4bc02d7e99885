"""From raw documents to shards, in five stages: each reads what the one before has written."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession

from lakesearch.llm import common, decontaminate, dedup, mixing, quality, sharding


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line-first cleaning: failing lines go, documents that lose too much go."""
    return quality.keep_clean(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component: five-word shingles, similarity 0.8."""
    return dedup.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover half or more of a benchmark item go."""
    return decontaminate.remove_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str, repeat: bool = False) -> DataFrame:
    """op8's mixture.  With `repeat`, as the pipeline takes it, each document stands there as often as it has copies, at
    most four whole blocks, and its rows are alike; without, each document of the mixture stands there once.  The budget
    is all tokens and no weight is over four times its share, so a tiny source shrinks nothing."""
    return mixing.realise(docs, repeat=repeat)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row with its shard and its slot there; the copies of a document get slots of their own."""
    done = sharding.shard(docs.drop("shard", "slot"))
    return done.withColumnsRenamed({"_shard": "shard", "_slot": "slot"})


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("source_mixing", partial(source_mixing, repeat=True)),
    ("sharding", shards),
]

#: No stage can be said in SQL: the rules and signatures are hash kernels, and tiling is greedy.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; between stages the rows lie as Parquet in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = common.save(stage(spark, docs, sf_dir), f"pipeline-{k}-{name}")
    return docs

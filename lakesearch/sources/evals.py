"""Evaluation corpus files: explicit schemas, strict reading, and write-once freezing of recordings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERY = "struct<id:string,query:string,language:string,category:string,sites:array<string>>"
CATALOG = f"version int, created_at date, purpose string, queries array<{QUERY}>"
POOL = f"version int, kind string, query {QUERY}, captured_at timestamp, node string, status string, elapsed_ms double, response_sha256 string, error_code string, candidates array<struct<id:string,url:string,title:string,snippet:string,original_rank:int>>, evidence struct<target_results:int,verified_results:int>"
JUDGMENTS = "version int, query_id string, pool_sha256 string, assessor struct<kind:string,id:string>, judged_at timestamp, basis string, judgments array<struct<id:string,grade:int,reason:string>>"


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON files under `path`, one document each; a document that does not fit the schema fails the read."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def hashed(records: DataFrame, body: str = "response") -> DataFrame:
    """`records` with whether the recorded hash is that of the body."""
    return records.withColumn("hash_ok", F.sha2(F.col(body), 256) == F.col("response_sha256"))


def freeze(records: DataFrame, frozen: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(rows to write, conflicts): what is frozen already is left alone, and must have the same hash."""
    both = records.join(frozen.select(F.col(key).alias("_k"), F.col("response_sha256").alias("_h")), records[key] == F.col("_k"), "left")
    return both.where("_k is null").drop("_k", "_h"), both.where(F.col("_k").isNotNull() & ~F.col("response_sha256").eqNullSafe(F.col("_h"))).drop("_k", "_h")

"""Queries of request flow, bodies, identifiers and process trees, over events and documents."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import cache as CA
from ..operators import flow as FL
from ..registry import query
from ..sources import bodies as B
from ..sources.tables import table

_REQ = "(select event_id as seq, 'u' || user_id as pool, epoch_us(ts) // 1000 as at_ms from events)"


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.unix_millis(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select(F.concat(F.lit("u"), "user_id").alias("pool"), F.col("event_id").alias("seq"), F.col("event_type").alias("key"), at.alias("at"), ((F.col("event_id") % 50) * 400_000).alias("duration"))


@query("H05_single_flight")
def single_flight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FL.single_flight(_requests(spark, sf_dir))


@query("H06_pacing", f"select pool, seq, (max(at_ms - 3600000 * (k - 1)) over (partition by pool order by k rows unbounded preceding) + 3600000 * (k - 1))::bigint as starts from (select *, row_number() over (partition by pool order by at_ms, seq) as k from {_REQ} r) x")
def pacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FL.spaced(_requests(spark, sf_dir), 3_600_000).select("pool", "seq", "starts")


@query("H07_permits")
def permits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FL.paced(_requests(spark, sf_dir), 1000, 2)


@query("H09_robots_cache")
def robots_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which lookups a cache of 256 origins for five minutes would answer; every event looks up its user's origin."""
    w = Window.orderBy("ts", "event_id").partitionBy(F.col("user_id") % 8)
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 8).cast("string").alias("cache"), F.row_number().over(w).cast("long").alias("seq"), F.col("user_id").cast("string").alias("key"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at"), F.lit(1).alias("size"), F.lit(False).alias("failed"))
    return CA.replay(e, 300_000, 256, 1 << 40)


@query("H12_page_memo", "select user_id, event_type, count(*)::bigint as requests, min(event_id)::bigint as computed_by from events group by all")
def page_memo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frozen pages are computed by the first request of a cursor and read by the others."""
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("requests"), F.min("event_id").alias("computed_by"))


@query("X23_stable_ids", "select doc_id, 'snapshot_' || sha256(doc_id || '|' || sha256(text)) || '_text' as snapshot_id from documents")
def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers from content in place of random ones, so that a task run again gives the same."""
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("snapshot_"), F.sha2(F.concat_ws("|", "doc_id", F.sha2("text", 256)), 256), F.lit("_text")).alias("snapshot_id"))


@query("J13_process_tree", "with recursive r(node) as (select distinct user_id from events where user_id % 50 = 7 union select e.user_id from (select distinct user_id from events) e join r on e.user_id // 2 = r.node and e.user_id <> r.node) select node from r")
def process_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "events").select(F.col("user_id").alias("node")).distinct()
    edges = users.select(F.floor(F.col("node") / 2).cast("long").alias("parent"), "node").where("parent <> node")
    return FL.reachable(edges, users.where("node % 50 = 7"))


@query("S17_body_decode", "select doc_id, case when length(text) > 20000 or octet_length(encode(text)) > 20000 then 'RESPONSE_TOO_LARGE' end as error, case when octet_length(encode(text)) <= 20000 then sha256(text) end as sha from documents")
def body_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    def pack(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            kinds = [("identity", "gzip", "deflate")[d % 3] for d in part.doc_id]
            made = {"identity": lambda b: b, "deflate": zlib.compress, "gzip": lambda b: (c := zlib.compressobj(6, zlib.DEFLATED, 31)).compress(b) + c.flush()}
            yield pd.DataFrame({"doc_id": part.doc_id, "body": [made[k](t.encode()) for k, t in zip(kinds, part.text, strict=True)], "encoding": kinds})

    packed = table(spark, sf_dir, "documents").select("doc_id", "text").mapInPandas(pack, "doc_id long, body binary, encoding string")
    return B.decoded(packed, "doc_id", most_out=20_000).select("doc_id", "error", F.sha2("body", 256).alias("sha"))

"""Queries of specifications and settings: requests and patches made of events, and why they are refused."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import api
from .. import settings as ST
from ..registry import query
from ..sources.tables import table


@query("F21_input_checks", """select event_id, case when event_id % 6 = 0 then 'use sites or include_domains, not both' when event_id % 5 = 0 and event_id % 3 <> 0 then 'max_evidence_results and fetch_engine need evidence_mode extract'
when event_id % 11 = 0 then chr(39) || 'not a host' || chr(39) || ' is no registrable host name' when event_id % 7 = 0 and (event_id % 2 = 0 or event_id % 6 = 3) then 'the excluded domains cover all sites' when event_id % 5 = 0 and event_id % 8 > 5 then 'too many evidence results' end as refused from events""")
def input_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("event_id")
    site = F.array(F.concat(F.lit("s"), F.col("user_id"), F.lit(".Example.com")))
    return api.refusals(
        table(spark, sf_dir, "events").select(
            "event_id", F.when(at % 2 == 0, site).alias("sites"), F.when(at % 3 == 0, site).alias("include_domains"),
            F.when(at % 11 == 0, F.array(F.lit("not a host"))).when(at % 7 == 0, F.array(F.lit("example.com."))).alias("exclude_domains"),
            F.when(at % 3 == 0, "extract").otherwise("none").alias("evidence_mode"), F.when(at % 5 == 0, (at % 8).cast("int")).alias("max_evidence_results"),
        ), "event_id",
    )


_PATCH = """'{"fetch":{"max_chars":' || (event_id % 60) * 1000 || '},"search":{"limit":' || event_id % 9 || ',"evidence":{"default_max_results":' || event_id % 8 || '}}}'"""


@query("F22_config_checks", "select event_id, case when (event_id % 60) * 1000 > 50000 or event_id % 8 > 5 then 'a default is over its maximum' end as refused from events")
def config_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    patches = table(spark, sf_dir, "events").select("event_id", F.expr(_PATCH).alias("patch"))
    return ST.patched(patches, "event_id").select("event_id", "refused")


@query("F26_config_merge", """select event_id, case event_id % 4 when 1 then 'no setting __proto__' when 2 then 'search is a group of settings' when 3 then 'limit must be of type int' end as refused,
case when event_id % 4 = 0 then '{"search":{"limit":' || event_id % 9 || ',"max_sites":20,"include_subdomains":true,"max_upstream_requests":4,"max_pages_per_query":2,"max_candidates":80,"cache_ttl_seconds":300,"evidence":{"default_max_results":3,"max_results":5,"max_passages_per_result":3,"max_chars_per_passage":1600,"max_chars_per_result":4000,"max_candidate_passages":32}},"fetch":{"max_chars":12000,"max_output_chars":50000,"max_redirects":5,"default_engine":"static"},"ranking_mode":"upstream","snapshot_ttl_seconds":86400}' end as settings from events""")
def config_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("event_id")
    good = F.concat(F.lit('{"search":{"limit":'), at % 9, F.lit("}}"))
    bad = F.when(at % 4 == 1, '{"__proto__":{"limit":1}}').when(at % 4 == 2, '{"search":5}').when(at % 4 == 3, '{"search":{"limit":"8"}}')
    return ST.patched(table(spark, sf_dir, "events").select("event_id", F.coalesce(bad, good).alias("patch")), "event_id")

"""From raw hits to frozen candidate pools: scope, canonical form, first occurrence, rank, pages of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls as U


def order_hits(hits: DataFrame) -> DataFrame:
    """`hits` (pool, page, branch, pos, ...) with `seq`: pages first, then branches, then positions, from 1."""
    return hits.withColumn("seq", F.row_number().over(Window.partitionBy("pool").orderBy("page", "branch", "pos")).cast("long"))


def within_budget(hits: DataFrame, requests: int, pages: int, candidates: int) -> DataFrame:
    """The hits a bounded collection sees: the first pages, requests in order, then candidates before any filter."""
    asked = hits.select("pool", "page", "branch").distinct().where(F.col("page") <= pages)
    asked = asked.withColumn("request", F.row_number().over(Window.partitionBy("pool").orderBy("page", "branch"))).where(F.col("request") <= requests)
    return order_hits(hits.join(asked.drop("request"), ["pool", "page", "branch"], "left_semi")).where(F.col("seq") <= candidates)


def deduplicate(hits: DataFrame) -> DataFrame:
    """One row per pool and canonical URL: the first hit's columns, all engines in order of first sight, and its rank.

    Two stages of partial aggregation, so a URL that half the hits share is no task's burden.
    """
    seen = hits.withColumn("canonical", U.canonical(F.col("url"))).where("canonical is not null")
    first = seen.groupBy("pool", "canonical").agg(F.min_by(F.struct("title", "snippet", "url"), "seq").alias("hit"), F.min("seq").alias("seq"))
    engine = seen.select("pool", "canonical", F.explode("engines").alias("engine"), "seq").groupBy("pool", "canonical", "engine").agg(F.min("seq").alias("at"))
    engines = engine.groupBy("pool", "canonical").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "engine"))), lambda x: x["engine"]).alias("providers"))
    rank = F.row_number().over(Window.partitionBy("pool").orderBy("seq")).cast("long")
    return first.join(engines, ["pool", "canonical"]).select("pool", "canonical", "hit.title", "hit.snippet", "providers", "seq").withColumn("rank", rank)


def collect(hits: DataFrame, sites: list[str], excluded: list[str], requests: int = 4, pages: int = 2, candidates: int = 80) -> tuple[DataFrame, DataFrame]:
    """The frozen pools and, for each, how many hits were seen and removed by scope."""
    seen = within_budget(hits, requests, pages, candidates).withColumn("inside", U.in_scope(F.col("url"), sites, excluded))
    counts = seen.groupBy("pool").agg(F.count("*").alias("seen"), F.count_if(~F.col("inside")).alias("removed"))
    return deduplicate(seen.where("inside")), counts


def page_of(rank: Column, offset: int, limit: int) -> Column:
    return (rank > offset) & (rank <= offset + limit)


def scope_by_join(urls: DataFrame, sites: DataFrame, excluded: DataFrame) -> DataFrame:
    """The rows of `urls` whose host or one of its parents is in `sites` and none in `excluded` (column domain), by equi-joins.

    A host has as many parents as labels, so each side is joined on equality and no pair of host and domain is tried.
    """
    labels = F.split(U.part(F.col("url"), "host"), r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    flat = urls.select("url", F.explode(parents).alias("domain")).distinct()
    inside = flat.join(sites, "domain", "left_semi").select("url").distinct()
    outside = flat.join(excluded, "domain", "left_semi").select("url").distinct()
    return urls.join(inside, "url", "left_semi").join(outside, "url", "left_anti")

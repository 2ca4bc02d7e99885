"""Graded relevance metrics and the evaluation report.

A metric that cannot be measured is null, never 0: a pool without a relevant item
has no nDCG, no reciprocal rank and no recall, and means skip nulls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STATUSES = ("ok", "partial", "empty")
FAILED = ("error", "transport_error", "unknown")


def mismatches(ranking: DataFrame, judgments: DataFrame) -> DataFrame:
    """query, id that only one side has, or that a side has twice; empty if ranking and judgments cover the same ids."""
    key = ["query", "id"]
    twice = lambda df: df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select(*key)
    return ranking.join(judgments, key, "left_anti").select(*key).union(judgments.join(ranking, key, "left_anti").select(*key)).union(twice(ranking)).union(twice(judgments))


def gain(grade: Column, rank: Column) -> Column:
    return (F.pow(F.lit(2.0), grade) - 1) / F.log2(rank + 1)


def metrics(ranking: DataFrame, judgments: DataFrame, k: int) -> DataFrame:
    """query, ndcg, mrr, recall, relevant, pool_size at k; ranking (query, id, rank), judgments (query, id, grade)."""
    if not 1 <= k <= 200:
        raise ValueError("k must be from 1 to 200")
    both = ranking.join(judgments, ["query", "id"])
    ideal = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("grade"), "id"))
    top, best = F.col("rank") <= k, F.col("ideal") <= k
    found = both.withColumn("ideal", ideal).groupBy("query").agg(
        F.sum(F.when(top, gain(F.col("grade"), F.col("rank"))).otherwise(0.0)).alias("dcg"), F.sum(F.when(best, gain(F.col("grade"), F.col("ideal"))).otherwise(0.0)).alias("idcg"),
        F.min(F.when(top & (F.col("grade") > 0), F.col("rank"))).alias("first"), F.count_if(top & (F.col("grade") > 0)).alias("hits"), F.count_if(F.col("grade") > 0).alias("relevant"), F.count("*").alias("pool_size"),
    )
    some = F.col("relevant") > 0
    return found.select("query", F.when(some, F.col("dcg") / F.col("idcg")).alias("ndcg"), F.when(some, F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("mrr"), F.when(some, F.col("hits") / F.col("relevant")).alias("recall"), "relevant", "pool_size")


def nearest_rank(column: str, p: float) -> Column:
    """The value at place ceil(n * p) of the ascending values; null if there is none."""
    return F.expr(f"percentile_disc({p}) within group (order by {column})")


def report(rows: DataFrame) -> DataFrame:
    """One row of coverage, availability, evidence and latency, from rows (status, candidates, target, verified, elapsed_ms)."""
    done = F.col("status").isin(*STATUSES)
    return rows.agg(
        F.count("*").alias("recorded"), F.count_if(done).alias("completed"), F.count_if(F.col("status").isin(*FAILED)).alias("failed"), F.count_if(F.col("candidates") > 0).alias("nonempty"),
        (F.count_if(done) / F.nullif(F.count("*"), F.lit(0))).alias("completion_rate"), F.coalesce(F.sum("target"), F.lit(0)).alias("target"), F.coalesce(F.sum("verified"), F.lit(0)).alias("verified"),
        (F.sum("verified") / F.nullif(F.sum("target"), F.lit(0))).alias("evidence_coverage"), nearest_rank("elapsed_ms", 0.5).alias("p50"), nearest_rank("elapsed_ms", 0.95).alias("p95"),
    )


def pool_violations(pools: DataFrame) -> DataFrame:
    """pool and the rule it breaks; pools (pool, status, target, verified, candidates array of (id, original_rank))."""
    ids = F.transform("candidates", lambda c: c["id"])
    dense = F.forall(F.transform("candidates", lambda c, i: c["original_rank"] == i + 1), lambda x: x)
    rules = {
        "duplicate_id": F.size(F.array_distinct(ids)) != F.size(ids), "rank_not_dense": ~dense,
        "candidates_despite_status": F.col("status").isin("empty", "error", "transport_error") & (F.size("candidates") > 0),
        "verified_over_target": F.col("verified") > F.col("target"), "target_over_candidates": F.col("target") > F.size("candidates"),
    }
    broken = F.array_compact(F.array(*(F.when(cond, F.lit(name)) for name, cond in rules.items())))
    return pools.select("pool", F.explode(broken).alias("rule"))

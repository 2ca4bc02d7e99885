"""Evaluation of the three ranking modes on a frozen corpus of pools and judgments.

Pools and judgments are files of `sources.evals`; candidates are ranked by title and
snippet within their pool, and metrics are averaged over the judged pools in which
they can be measured.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import evals
from . import evaluation as E
from . import ranking as R

MODES = ("upstream", "bm25", "bm25_mmr")


def load(spark: SparkSession, pools: str, judgments: str) -> tuple[DataFrame, DataFrame]:
    """(candidates, judgments) by query id: text and original rank, and grade."""
    raw = evals.read(spark, pools, evals.POOL)
    names = raw.select(F.xxhash64("query.id").alias("pool"), F.col("query.id").alias("query"), F.col("query.query").alias("question"), F.explode("candidates").alias("c"))
    rows = names.select("pool", "query", "question", F.col("c.original_rank").cast("long").alias("id"), F.col("c.id").alias("key"), F.concat_ws("\n", "c.title", "c.snippet").alias("text"))
    judged = evals.read(spark, judgments, evals.JUDGMENTS).select(F.col("query_id").alias("query"), F.explode("judgments").alias("j"))
    return rows, judged.select("query", F.col("j.id").alias("key"), F.col("j.grade").alias("grade"))


def rankings(rows: DataFrame) -> DataFrame:
    """pool, id, mode, rank of every candidate in every mode."""
    queries = rows.select(F.col("pool").alias("query"), "pool", F.col("question").alias("text")).distinct()
    scored = R.bm25(queries, rows).withColumnsRenamed({"query": "pool"})
    full = rows.join(scored, ["pool", "id"], "left").fillna(0.0, ["score"])
    full = full.withColumn("rank", F.row_number().over(Window.partitionBy("pool").orderBy(F.desc("score"), "id")).cast("long"))
    mmr = R.mmr(full.drop("query").withColumnRenamed("pool", "query")).select(F.col("query").alias("pool"), "id", F.col("rank").alias("bm25"), F.col("mmr_rank").alias("bm25_mmr"), F.col("id").alias("upstream"))
    one = F.explode(F.array(*(F.struct(F.lit(m).alias("mode"), F.col(m).alias("rank")) for m in MODES))).alias("m")
    return mmr.select("pool", "id", one).select("pool", "id", "m.*")


def evaluate(spark: SparkSession, pools: str, judgments: str) -> DataFrame:
    """mode, judged, ndcg_5, ndcg_10, recall_5 and mrr_10, averaged over the pools that have them."""
    rows, judged = load(spark, pools, judgments)
    ranked = rankings(rows).join(rows.select("pool", "id", "query", "key"), ["pool", "id"])
    order = ranked.join(judged.select("query").distinct(), "query", "left_semi").select(F.concat_ws("|", "mode", "query").alias("query"), F.col("key").alias("id"), "rank", "mode")
    grades = judged.crossJoin(F.broadcast(spark.createDataFrame([(m,) for m in MODES], "mode string"))).select(F.concat_ws("|", "mode", "query").alias("query"), F.col("key").alias("id"), "grade")
    at = lambda k: E.metrics(order.select("query", "id", "rank"), grades, k)
    both = at(5).select("query", F.col("ndcg").alias("ndcg_5"), F.col("recall").alias("recall_5")).join(at(10).select("query", F.col("ndcg").alias("ndcg_10"), F.col("mrr").alias("mrr_10")), "query")
    return both.groupBy(F.split_part("query", F.lit("|"), F.lit(1)).alias("mode")).agg(F.count("ndcg_10").alias("judged"), *(F.avg(c).alias(c) for c in ("ndcg_5", "ndcg_10", "recall_5", "mrr_10")))

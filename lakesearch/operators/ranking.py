"""BM25, maximal marginal relevance and reciprocal rank fusion.

Statistics are those of a pool: the number of its candidates, their mean length and
a term's document frequency among them.  Only occurrences of query terms are
counted, so nothing grows with the vocabulary; a candidate without any scores 0.

Candidates are read twice and never shuffled: once for the statistics, which are one
aggregate of (pool, term), and once to be scored.  The second pass looks words up in
the query terms, `BROADCAST` pairs of query and term at most, adds up a candidate's
scores for all queries of its pool within its batch, and keeps the `k` best of a query
in the task.  More queries than that meet the candidates in a join on pool and term.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..shipping import ship

K1, B = 1.2, 0.75
LAMBDA = 0.75
POOL_LIMIT = 200
BROADCAST = 1 << 20
CELLS = 1 << 21
DIGITS = 6


def query_terms(queries: DataFrame, text: str = "text") -> DataFrame:
    """query, term: each query's distinct terms, site operators aside."""
    return queries.select("query", F.explode(F.array_distinct(X.tokens(X.content_query(F.col(text))))).alias("term"))


def term_counts(candidates: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """pool, id, term, tf, dl of `candidates` (pool, id, text), for the given terms only."""
    words = candidates.select("pool", "id", X.tokens(F.col("text")).alias("words")).select("pool", "id", F.size("words").alias("dl"), F.explode("words").alias("term"))
    if terms is not None:
        words = words.join(terms.select("term").distinct(), "term", "left_semi")
    return words.groupBy("pool", "id", "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


def pool_stats(candidates: DataFrame) -> DataFrame:
    """pool, n, avgdl; a mean length of zero counts as one."""
    size = F.size(X.tokens(F.col("text")))
    return candidates.groupBy("pool").agg(F.count("*").alias("n"), F.coalesce(F.nullif(F.avg(size), F.lit(0.0)), F.lit(1.0)).alias("avgdl"))


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def saturation(tf: Column, dl: Column, avgdl: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def term_stats(candidates: DataFrame, terms: DataFrame) -> DataFrame:
    """pool, term, df, total of the given terms, in one pass; the term '' stands for the pool: its size and the sum of its lengths."""
    words = candidates.select("pool", X.tokens(F.col("text")).alias("words"))
    known = terms.select("term").union(terms.sparkSession.createDataFrame([("",)], "term string")).distinct()
    each = words.select("pool", F.size("words").alias("dl"), F.explode(F.concat(F.array_distinct("words"), F.array(F.lit("")))).alias("term"))
    return each.join(known, "term", "left_semi").groupBy("pool", "term").agg(F.count("*").alias("df"), F.sum("dl").alias("total"))


def bm25(queries: DataFrame, candidates: DataFrame, k: int | None = None) -> DataFrame:
    """query, id, score of every candidate with a query term, or of at least the `k` best of each query; queries (query,
    pool, text), candidates (pool, id, text)."""
    spark = queries.sparkSession
    terms = query_terms(queries)
    asked = terms.join(queries.select("query", "pool"), "query")
    stats = term_stats(candidates, terms)
    pools = stats.where("term = ''").select("pool", F.col("df").alias("n"), F.coalesce(F.nullif(F.col("total") / F.col("df"), F.lit(0.0)), F.lit(1.0)).alias("avgdl"))
    weights = asked.join(stats.select("pool", "term", "df"), ["pool", "term"]).join(pools, "pool").select("pool", "term", "query", "avgdl", idf(F.col("n"), F.col("df")).alias("idf"))
    held = weights.limit(BROADCAST + 1).toPandas()
    if len(held) > BROADCAST:
        scored = term_counts(candidates, terms).join(weights, ["pool", "term"])
        return scored.groupBy("query", "id").agg(F.sum(F.col("idf") * saturation(F.col("tf"), F.col("dl"), F.col("avgdl"))).alias("score"))
    ship(spark)
    shared = spark.sparkContext.broadcast({pool: _Pool(rows) for pool, rows in held.groupby("pool")})
    field = lambda df, name: df.schema[name].dataType
    schema = T.StructType([T.StructField("query", field(queries, "query")), T.StructField("id", field(candidates, "id")), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[pd.DataFrame] = []
        size = 0
        for batch in batches:
            found = [x for x in _scored(batch, shared.value) if len(x)]
            if k is None:
                yield from (pa.RecordBatch.from_pandas(x, preserve_index=False) for x in found)
                continue
            best += found
            size += sum(map(len, found))
            if size > CELLS:
                best = [_best(pd.concat(best), k)]
                size = len(best[0])
        if best:
            yield pa.RecordBatch.from_pandas(_best(pd.concat(best), k), preserve_index=False)

    return candidates.select("pool", "id", X.tokens(F.col("text")).alias("words")).mapInArrow(run, schema)


class _Pool:
    """The terms asked of a pool, their weights, and which queries ask each."""

    def __init__(self, rows: pd.DataFrame):
        rows = rows.sort_values(["term", "query"])
        self.queries, self.query = np.unique(rows["query"].to_numpy(), return_inverse=True)
        self.terms, self.start = np.unique(rows["term"].to_numpy(object), return_index=True)
        self.idf, self.avgdl = rows["idf"].to_numpy()[self.start], float(rows["avgdl"].iloc[0])
        self.start = np.append(self.start, len(rows))
        self.values = pa.array(self.terms.tolist(), pa.string())


def _scored(batch: pa.RecordBatch, pools: dict) -> Iterator[pd.DataFrame]:
    """query, id, score of a batch of candidates (pool, id, words)."""
    names = np.array(batch.column(0).to_pylist(), object)
    for name in dict.fromkeys(names.tolist()):
        if name not in pools:
            continue
        pool, rows = pools[name], np.flatnonzero(names == name)
        step = max(1, CELLS // len(pool.queries))
        for lo in range(0, len(rows), step):
            part = batch.take(pa.array(rows[lo : lo + step]))
            words, ids = part.column(2), part.column(1).to_pandas()
            dl = np.diff(words.offsets.to_numpy()).astype(float)
            code = pc.fill_null(pc.index_in(words.flatten(), value_set=pool.values), -1).to_numpy().astype(np.int64)
            row = np.repeat(np.arange(len(dl)), dl.astype(np.int64))[code >= 0]
            cell, tf = np.unique(row * len(pool.terms) + code[code >= 0], return_counts=True)
            row, code = cell // len(pool.terms), cell % len(pool.terms)
            part_score = pool.idf[code] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl[row] / pool.avgdl))
            n = pool.start[code + 1] - pool.start[code]
            at = np.repeat(pool.start[code] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            cell = np.repeat(row, n) * len(pool.queries) + pool.query[at]
            total = np.bincount(cell, np.repeat(part_score, n), len(dl) * len(pool.queries))
            hit = np.flatnonzero(np.bincount(cell, minlength=len(total)))
            yield pd.DataFrame({"query": pool.queries[hit % len(pool.queries)], "id": ids.to_numpy()[hit // len(pool.queries)], "score": total[hit]})


def _best(rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best of each query; all that are as good as the last to `DIGITS` places stay, so that ties are settled once."""
    shown = rows["score"].round(DIGITS)
    last = shown.groupby(rows["query"]).transform(lambda x: x.nlargest(k).iloc[-1])
    some = rows[shown >= last - 10.0**-DIGITS]
    some = some.assign(_shown=some["score"].round(DIGITS)).sort_values(["query", "_shown", "id"], ascending=[True, False, True])
    place = some.groupby("query").cumcount()
    return some[place < 2 * k].drop(columns="_shown")


def top(scored: DataFrame, k: int, digits: int = DIGITS) -> DataFrame:
    """The k best of each query, with rank; equal to `digits` places, the smaller id goes first."""
    order = Window.partitionBy("query").orderBy(F.desc(F.round("score", digits)), "id")
    return scored.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def mmr_order(scores: Sequence[float], sets: Sequence[frozenset]) -> list[int]:
    """The order in which candidates, best first, are chosen: relevance against likeness to what is chosen already."""
    best = max(scores, default=0.0)
    if best <= 0:
        return list(range(len(scores)))
    like = [0.0] * len(scores)
    left, order = list(range(len(scores))), []
    while left:
        pick = max(left, key=lambda i: (LAMBDA * scores[i] / best - (1 - LAMBDA) * like[i], -i))
        left.remove(pick)
        order.append(pick)
        for i in left:
            both = len(sets[pick] & sets[i])
            union = len(sets[pick]) + len(sets[i]) - both
            like[i] = max(like[i], both / union if union else 0.0)
    return order


def mmr(ranked: DataFrame) -> DataFrame:
    """`ranked` (query, id, score, rank, text) with mmr_rank.  A query's rows, `POOL_LIMIT` at most, are one group."""

    def group(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rank").reset_index(drop=True)
        if len(rows) > POOL_LIMIT:
            raise ValueError(f"a pool of {len(rows)} candidates is over the limit of {POOL_LIMIT}")
        order = mmr_order(rows.score.tolist(), [frozenset(x) for x in rows.terms])
        out = rows.loc[order, ["query", "id", "score", "rank"]].reset_index(drop=True)
        out["mmr_rank"] = range(1, len(out) + 1)
        return out

    rows = ranked.select("query", "id", "score", "rank", F.array_distinct(X.tokens(F.col("text"))).alias("terms"))
    return rows.groupBy("query").applyInPandas(group, "query long, id long, score double, rank long, mmr_rank long")


def reciprocal_rank_fusion(lists: DataFrame, k: float = 60.0) -> DataFrame:
    """query, id, score from `lists` (query, list, id, pos from 1): an id counts once a list, where it stands first."""
    if not 0 < k < float("inf"):
        raise ValueError("k must be positive and finite")
    first = lists.groupBy("query", "list", "id").agg(F.min("pos").alias("pos"))
    return first.groupBy("query", "id").agg(F.sum(1.0 / (F.lit(k) + F.col("pos"))).alias("score"))

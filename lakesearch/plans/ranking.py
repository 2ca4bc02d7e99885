"""Queries of ranking and evaluation: every benchmark item as a query, documents as one pool or as pools by source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import evaluation as E
from ..operators import ranking as R
from ..registry import query
from ..sources.tables import table

TOK = r"[\p{L}\p{N}]+"
TOP = 10
_QT = f"(select item_id as query, unnest(list_distinct(regexp_extract_all(lower(text), '{TOK}'))) as term from benchmark)"
_DOC = f"(select doc_id as id, regexp_extract_all(lower(text), '{TOK}') as w from documents)"
_TF = f"(select id, term, count(*) as tf, any_value(dl) as dl from (select id, len(w) as dl, unnest(w) as term from {_DOC} a) b where term in (select term from {_QT} c) group by id, term)"


def _bm25_cte() -> str:
    return f"""tf as materialized (select * from {_TF} d), df as (select term, count(*) as df from tf group by term), st as (select count(*) as n, coalesce(nullif(avg(len(w)), 0), 1) as avgdl from {_DOC} e),
scored as (select query, id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) as score from tf join df using (term) join {_QT} q using (term), st group by query, id),
ranked as (select query, id, score, row_number() over (partition by query order by round(score, 6) desc, id) as rank from scored)"""


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), F.lit(0).alias("pool"), "text")


def _corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.lit(0).alias("pool"), F.col("doc_id").alias("id"), "text")


def ranked(spark: SparkSession, sf_dir: str, k: int = TOP) -> DataFrame:
    """query, id, score, rank of the k best documents of every benchmark item."""
    return R.top(R.bm25(_queries(spark, sf_dir), _corpus(spark, sf_dir), k), k)


@query("A04_bm25", f"with {_bm25_cte()} select query, id, round(score, 5) as score, rank::bigint as rank from ranked where rank <= {TOP}")
def bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(spark, sf_dir).select("query", "id", F.round("score", 5).alias("score"), "rank")


@query("T01_bm25_order", f"with {_bm25_cte()} select query, id, rank::bigint as rank from ranked where rank <= 100")
def bm25_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(spark, sf_dir, 100).select("query", "id", "rank")


@query("A01_document_frequency", f"select term, count(*)::bigint as df from {_TF} d group by term")
def document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.term_counts(_corpus(spark, sf_dir), R.query_terms(_queries(spark, sf_dir))).groupBy("term").agg(F.count("*").alias("df"))


@query("A02_mean_length", f"select source, round(avg(len(regexp_extract_all(lower(text), '{TOK}'))), 6) as avgdl, count(*)::bigint as n from documents group by source")
def mean_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("pool"), "text")
    return R.pool_stats(docs).select(F.col("pool").alias("source"), F.round("avgdl", 6).alias("avgdl"), "n")


@query("A03_term_frequency", f"select id, term, tf::bigint as tf from {_TF} d")
def term_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.term_counts(_corpus(spark, sf_dir), R.query_terms(_queries(spark, sf_dir))).select("id", "term", "tf")


@query("J04_term_join", f"select query, id, count(*)::bigint as matched from {_TF} d join {_QT} q using (term) group by query, id")
def term_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = R.query_terms(_queries(spark, sf_dir))
    return R.term_counts(_corpus(spark, sf_dir), terms).join(terms, "term").groupBy("query", "id").agg(F.count("*").alias("matched"))


_LISTS = f"""with {_bm25_cte()}, a as (select query, 0 as list, id, rank as pos from ranked where rank <= 50), b as (select query, 1 as list, id, row_number() over (partition by query order by id) as pos from a),
l as (select * from a union all select * from b union all select query, list, id, pos + 50 from a)"""


def _lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = ranked(spark, sf_dir, 50).select("query", F.lit(0).alias("list"), "id", F.col("rank").alias("pos"))
    b = a.select("query", F.lit(1).alias("list"), "id", F.row_number().over(Window.partitionBy("query").orderBy("id")).cast("long").alias("pos"))
    return a.union(b).union(a.withColumn("pos", F.col("pos") + 50))


@query("A14_rank_fusion", f"{_LISTS}, f as (select query, list, id, min(pos) as pos from l group by all) select query, id, round(sum(1.0 / (60 + pos)), 9) as score from f group by query, id")
def rank_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.reciprocal_rank_fusion(_lists(spark, sf_dir)).select("query", "id", F.round("score", 9).alias("score"))


_SETS = f"(select r.query, r.id, r.rank, list_distinct(regexp_extract_all(lower(text), '{TOK}')) as s from ranked r join documents d on r.id = d.doc_id where rank <= {TOP})"


def _with_text(rows: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), "id")


@query("J06_jaccard_pairs", f"with {_bm25_cte()} select a.query, a.id as a, b.id as b, round(len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))), 9) as jaccard from {_SETS} a join {_SETS} b on a.query = b.query and a.rank < b.rank")
def jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _with_text(ranked(spark, sf_dir), spark, sf_dir).select("query", "id", "rank", F.array_distinct(X.tokens(F.col("text"))).alias("s"))
    other = s.select("query", F.col("id").alias("b"), F.col("rank").alias("rank_b"), F.col("s").alias("s_b"))
    return s.join(other, "query").where("rank < rank_b").select("query", F.col("id").alias("a"), "b", F.round(X.jaccard(F.col("s"), F.col("s_b")), 9).alias("jaccard"))


@query("U02_term_sets", f"with {_bm25_cte()} select a.query, a.id, len(list_intersect(a.s, q.s))::bigint as both, len(list_distinct(list_concat(a.s, q.s)))::bigint as either from {_SETS} a join (select query, list(term) as s from {_QT} t group by query) q using (query)")
def term_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = R.query_terms(_queries(spark, sf_dir)).groupBy("query").agg(F.collect_set("term").alias("q"))
    s = _with_text(ranked(spark, sf_dir), spark, sf_dir).select("query", "id", F.array_distinct(X.tokens(F.col("text"))).alias("s")).join(terms, "query")
    return s.select("query", "id", F.size(F.array_intersect("s", "q")).cast("long").alias("both"), F.size(F.array_union("s", "q")).cast("long").alias("either"))


@query("W02_rank_columns", f"with {_bm25_cte()} select query, id, rank::bigint as rank, (row_number() over (partition by query order by id))::bigint as original_rank, (count(*) over (partition by query))::bigint as corpus_size from ranked where rank <= 50")
def rank_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("query")
    return ranked(spark, sf_dir, 50).select("query", "id", "rank", F.row_number().over(w.orderBy("id")).cast("long").alias("original_rank"), F.count("*").over(w).alias("corpus_size"))


def mmr_pool(spark: SparkSession, sf_dir: str, k: int = 50) -> DataFrame:
    return R.mmr(_with_text(ranked(spark, sf_dir, k), spark, sf_dir))


@query("T03_mmr")
def mmr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mmr_pool(spark, sf_dir)


@query("C01_rank_candidates")
def rank_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All three modes side by side: upstream (by id), bm25, bm25_mmr."""
    pool = mmr_pool(spark, sf_dir).withColumn("upstream", F.row_number().over(Window.partitionBy("query").orderBy("id")).cast("long"))
    one = lambda mode, rank, score: F.struct(F.lit(mode).alias("mode"), F.col(rank).alias("rank"), score.alias("score"))
    modes = F.array(one("upstream", "upstream", F.lit(None).cast("double")), one("bm25", "rank", F.col("score")), one("bm25_mmr", "mmr_rank", F.col("score")))
    return pool.select("query", "id", F.explode(modes).alias("m")).select("query", "id", "m.*")


# Evaluation: pools are sources, ranked by length of text; the grade quality * (2 - toxic) stands in for judgments.

_JUDGED = "(select source as query, doc_id as id, row_number() over (partition by source order by length(text) desc, doc_id) as rank, quality * (2 - toxic) as grade from documents join labels using (doc_id))"


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    rank = F.row_number().over(Window.partitionBy("source").orderBy(F.desc(F.length("text")), "doc_id")).cast("long")
    return both.select(F.col("source").alias("query"), F.col("doc_id").alias("id"), rank.alias("rank"), (F.col("quality") * (2 - F.col("toxic"))).alias("grade"))


def _metrics_sql(k: int) -> str:
    return f"""(select query, case when relevant > 0 then dcg / idcg end as ndcg, case when relevant > 0 then coalesce(1 / first, 0) end as mrr, case when relevant > 0 then hits / relevant end as recall, relevant, pool_size from (
select query, sum(case when rank <= {k} then (pow(2, grade) - 1) / log2(rank + 1) else 0 end) as dcg, sum(case when best <= {k} then (pow(2, grade) - 1) / log2(best + 1) else 0 end) as idcg, min(rank) filter (where rank <= {k} and grade > 0) as first,
count(*) filter (where rank <= {k} and grade > 0) as hits, count(*) filter (where grade > 0) as relevant, count(*) as pool_size from (select *, row_number() over (partition by query order by grade desc, id) as best from {_JUDGED} j) b group by query))"""


def _metrics(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    j = _judged(spark, sf_dir)
    return E.metrics(j.select("query", "id", "rank"), j.select("query", "id", "grade"), k)


def _register_metrics() -> None:
    for name, column, k in (("A07_ndcg", "ndcg", 10), ("A08_mrr", "mrr", 10), ("A09_pooled_recall", "recall", 20)):

        def run(spark: SparkSession, sf_dir: str, column: str = column, k: int = k) -> DataFrame:
            return _metrics(spark, sf_dir, k).select("query", F.round(column, 9).alias(column))

        query(name, f"select query, round({column}, 9) as {column} from {_metrics_sql(k)} m")(run)


_register_metrics()


@query("C08_evaluate_ranking", f"select query, round(ndcg, 9) as ndcg, round(mrr, 9) as mrr, round(recall, 9) as recall, relevant::bigint as relevant, pool_size::bigint as pool_size from {_metrics_sql(5)} m")
def evaluate_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metrics(spark, sf_dir, 5).select("query", *(F.round(c, 9).alias(c) for c in ("ndcg", "mrr", "recall")), "relevant", "pool_size")


@query("A10_macro_average", f"select round(avg(ndcg), 9) as ndcg, round(avg(mrr), 9) as mrr, count(ndcg)::bigint as measured from {_metrics_sql(10)} m")
def macro_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metrics(spark, sf_dir, 10).agg(F.round(F.avg("ndcg"), 9).alias("ndcg"), F.round(F.avg("mrr"), 9).alias("mrr"), F.count("ndcg").alias("measured"))


@query("A11_percentile", "select event_type, quantile_disc(value, 0.5) as p50, quantile_disc(value, 0.95) as p95 from events group by event_type")
def percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(E.nearest_rank("value", 0.5).alias("p50"), E.nearest_rank("value", 0.95).alias("p95"))


_RUNS = "(select user_id, ['ok', 'partial', 'empty', 'error', 'transport_error'][user_id % 5 + 1] as status, case when user_id % 5 < 2 then count(*) else 0 end as candidates, case when user_id % 5 < 2 then 3 else 0 end as target, case when user_id % 5 < 2 then user_id % 4 else 0 end as verified, sum(value) as elapsed_ms from events group by user_id)"


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("user_id") % 5
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.sum("value").alias("elapsed_ms"))
    return e.select("user_id", F.element_at(F.array(*map(F.lit, ["ok", "partial", "empty", "error", "transport_error"])), (u + 1).cast("int")).alias("status"), F.when(u < 2, F.col("n")).otherwise(0).alias("candidates"), F.when(u < 2, 3).otherwise(0).alias("target"), F.when(u < 2, F.col("user_id") % 4).otherwise(0).alias("verified"), "elapsed_ms")


@query("A12_status_histogram", f"select status, count(*)::bigint as n from {_RUNS} r group by status")
def status_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _runs(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"))


_REPORT = f"""select count(*)::bigint as recorded, (count(*) filter (status in ('ok', 'partial', 'empty')))::bigint as completed, (count(*) filter (status in ('error', 'transport_error')))::bigint as failed, (count(*) filter (candidates > 0))::bigint as nonempty,
(count(*) filter (status in ('ok', 'partial', 'empty'))) / count(*) as completion_rate, sum(target)::bigint as target, sum(verified)::bigint as verified, sum(verified) / sum(target) as evidence_coverage"""


@query("A13_coverage", f"{_REPORT} from {_RUNS} r")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.report(_runs(spark, sf_dir)).drop("p50", "p95")


@query("C09_report", f"{_REPORT}, round(quantile_disc(elapsed_ms, 0.5), 6) as p50, round(quantile_disc(elapsed_ms, 0.95), 6) as p95 from {_RUNS} r")
def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.report(_runs(spark, sf_dir)).withColumns({"p50": F.round("p50", 6), "p95": F.round("p95", 6)})


@query("S15_report_json", f"select to_json(x)::varchar as report from ({_REPORT}, quantile_disc(elapsed_ms, 0.5) as p50, quantile_disc(elapsed_ms, 0.95) as p95 from {_RUNS} r) x")
def report_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = E.report(_runs(spark, sf_dir))
    return r.select(F.to_json(F.struct(*r.columns)).alias("report"))


@query("J01_judged_join", f"select query, id, rank::bigint as rank, grade::bigint as grade from {_JUDGED} j")
def judged_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = _judged(spark, sf_dir)
    return j.select("query", "id", "rank").join(j.select("query", "id", F.col("grade").cast("long").alias("grade")), ["query", "id"])


@query("U04_same_ids", "select source as query, doc_id as id from documents where doc_id not in (select doc_id from labels)")
def same_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("query"), F.col("doc_id").alias("id"))
    return E.mismatches(docs, docs.join(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")), "id", "left_semi").select("query", "id"))


_POOLS = "(select source as pool, sha256(string_agg(doc_id::varchar, ',' order by doc_id)) as hash, count(*) as n from documents group by source)"


def _pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("doc_id")), lambda x: x.cast("string")), ",")
    return table(spark, sf_dir, "documents").groupBy(F.col("source").alias("pool")).agg(F.sha2(ids, 256).alias("hash"), F.count("*").alias("n"))


@query("J02_pool_judgments", f"select pool, n::bigint as n, judged::bigint as judged, case when judged is null then 'missing' else 'complete' end as status from {_POOLS} p left join (select source as pool, count(*) as judged from documents join labels using (doc_id) where right(source, 1) <> '7' group by source) j using (pool)")
def pool_judgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").where(F.right("source", F.lit(1)) != "7").groupBy(F.col("source").alias("pool")).agg(F.count("*").alias("judged"))
    return _pools(spark, sf_dir).join(judged, "pool", "left").select("pool", "n", "judged", F.when(F.col("judged").isNull(), "missing").otherwise("complete").alias("status"))


@query("J03_in_catalog", "select doc_id from documents c where exists (select 1 from documents d where d.text = c.text and d.lang = c.lang and d.doc_id < c.doc_id)")
def in_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose text and language an earlier one has: a semi-join on the full row, hashed once."""
    c = table(spark, sf_dir, "documents").select("doc_id", "lang", F.sha2("text", 256).alias("sha"))
    first = c.groupBy("sha", "lang").agg(F.min("doc_id").alias("first"))
    return c.join(first, (c["sha"] == first["sha"]) & (c["lang"] == first["lang"]) & (first["first"] < c["doc_id"]), "left_semi").select("doc_id")


@query("U06_unrecorded", "select doc_id from documents except select doc_id from labels")
def unrecorded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id").exceptAll(table(spark, sf_dir, "labels").select("doc_id"))


@query("T10_ideal_order", f"select query, id, grade::bigint as grade, (row_number() over (partition by query order by grade desc, id))::bigint as ideal_rank from {_JUDGED} j")
def ideal_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir).select("query", "id", F.col("grade").cast("long").alias("grade"), F.row_number().over(Window.partitionBy("query").orderBy(F.desc("grade"), "id")).cast("long").alias("ideal_rank"))


_BAD = "(select conv_id as pool, list(turn order by turn) as turns, case when conv_id % 4 = 0 then 'error' else 'ok' end as status, conv_id % 5 as target, conv_id % 6 as verified from conversations group by conv_id)"


@query("F23_pool_consistency", f"""select pool, unnest(list_filter([case when status = 'error' and len(turns) > 0 then 'candidates_despite_status' end, case when verified > target then 'verified_over_target' end, case when target > len(turns) then 'target_over_candidates' end,
 case when pool % 7 = 0 and len(turns) > 1 then 'rank_not_dense' end], lambda x: x is not null)) as rule from {_BAD} p""")
def pool_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    turns = c.groupBy(F.col("conv_id").alias("pool")).agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    rank = lambda t, i: F.struct(t.alias("id"), F.when((F.col("pool") % 7 == 0) & (i > 0), i + 3).otherwise(i + 1).alias("original_rank"))
    pools = turns.select("pool", F.when(F.col("pool") % 4 == 0, "error").otherwise("ok").alias("status"), (F.col("pool") % 5).alias("target"), (F.col("pool") % 6).alias("verified"), F.transform("turns", rank).alias("candidates"))
    return E.pool_violations(pools)

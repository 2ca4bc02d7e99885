"""The two tools, search and fetch, as functions of DataFrames, for one specification or many queries at once.

`websearch` takes the hits of any number of queries (pool, page, branch, pos, url,
title, snippet, engines), the queries (pool, text), and, for evidence, snapshots
keyed by canonical URL.  `webfetch` pages through snapshots.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .functions import text as X
from .functions import urls as U
from .operators import evidence as E
from .operators import passages as P
from .operators import pools
from .operators import ranking as R
from .operators import segments as S
from .settings import InvalidArgument, Settings
from .shipping import ship


@dataclass(frozen=True)
class SearchSpec:
    sites: tuple[str, ...] = ()
    exclude_domains: tuple[str, ...] = ()
    include_subdomains: bool = True
    ranking_mode: str = "upstream"
    limit: int = 8
    offset: int = 0
    evidence_mode: str = "none"
    evidence_results: int = 0


def resolve(settings: Settings, *, sites: list[str] | None = None, include_domains: list[str] | None = None, exclude_domains: list[str] | None = None, include_subdomains: bool | None = None, ranking_mode: str | None = None, limit: int | None = None, offset: int = 0, evidence_mode: str = "none", max_evidence_results: int | None = None, fetch_engine: str | None = None) -> SearchSpec:
    """A checked specification; what contradicts itself or the limits is refused."""
    if sites is not None and include_domains is not None:
        raise InvalidArgument("use sites or include_domains, not both")
    if (max_evidence_results is not None or fetch_engine is not None) and evidence_mode != "extract":
        raise InvalidArgument("max_evidence_results and fetch_engine need evidence_mode extract")
    wanted = sorted({_domain(x) for x in (sites or include_domains or [])})
    excluded = sorted({_domain(x) for x in (exclude_domains or [])})
    below = settings.search.include_subdomains if include_subdomains is None else include_subdomains
    if max(len(wanted), len(excluded)) > settings.search.max_sites:
        raise InvalidArgument("too many sites")
    covers = lambda host, d: host == d or (below and host.endswith("." + d))
    if wanted and all(any(covers(s, d) for d in excluded) for s in wanted):
        raise InvalidArgument("the excluded domains cover all sites")
    evidence = settings.search.evidence
    results = (evidence.default_max_results if max_evidence_results is None else max_evidence_results) if evidence_mode == "extract" else 0
    if results > evidence.max_results:
        raise InvalidArgument("too many evidence results")
    mode = ranking_mode or settings.ranking_mode
    if mode != "upstream" and settings.search.max_candidates > R.POOL_LIMIT:
        raise InvalidArgument(f"ranking takes at most {R.POOL_LIMIT} candidates")
    return SearchSpec(tuple(wanted), tuple(excluded), below, mode, limit or settings.search.limit, offset, evidence_mode, results)


def refusals(requests: DataFrame, key: str, settings: Settings | None = None) -> DataFrame:
    """key and why `resolve` refuses the request (null if it does not), for rows whose columns are its options; null is not given."""
    options = [c for c in requests.columns if c != key]
    limits = settings or Settings()

    def one(row: tuple[object, ...]) -> str | None:
        given = {k: v for k, v in zip(options, row, strict=True) if v is not None}
        try:
            resolve(limits, **given)
        except InvalidArgument as why:
            return str(why)
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in options), strict=True) if options else [()] * batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array([one(r) for r in rows], pa.string())], names=[key, "refused"])

    ship(requests.sparkSession)
    return requests.mapInArrow(run, f"{key} {requests.schema[key].dataType.simpleString()}, refused string")


def _domain(name: str) -> str:
    host = name.lower().removesuffix(".")
    labels = host.split(".")
    good = all(re.fullmatch(r"[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?", x) for x in labels)
    if not good or len(labels) < 2 or len(host) > 253 or re.fullmatch(r"\d+|0x[0-9a-f]*", labels[-1]) or host in U.SUFFIXES:
        raise InvalidArgument(f"{name!r} is no registrable host name")
    return host


def websearch(spec: SearchSpec, settings: Settings, queries: DataFrame, hits: DataFrame, snapshots: DataFrame | None = None) -> DataFrame:
    """One row per result of the asked page: rank, URL, providers, relevance, ranking, evidence status and quotes."""
    ship(hits.sparkSession)
    s = settings.search
    pool, counts = pools.collect(hits, list(spec.sites), list(spec.exclude_domains), s.max_upstream_requests, s.max_pages_per_query, s.max_candidates)
    text = F.concat_ws("\n", "title", "snippet")
    rows = pool.join(queries.select("pool", F.col("text").alias("question")), "pool").withColumns({"relevance": X.coverage(F.col("question"), text), "original_rank": F.col("rank"), "score": F.lit(None).cast("double")})
    if spec.ranking_mode != "upstream":
        asked = queries.select(F.col("pool").alias("query"), "pool", "text")
        scored = R.bm25(asked, rows.select("pool", F.col("rank").alias("id"), text.alias("text")))
        rows = rows.drop("score").join(scored.select(F.col("query").alias("pool"), F.col("id").alias("original_rank"), "score"), ["pool", "original_rank"], "left").fillna(0.0, ["score"])
        order = Window.partitionBy("pool").orderBy(F.desc("score"), "original_rank")
        rows = rows.withColumn("rank", F.row_number().over(order).cast("long"))
        if spec.ranking_mode == "bm25_mmr":
            new = R.mmr(rows.select(F.col("pool").alias("query"), F.col("original_rank").alias("id"), "score", "rank", text.alias("text")))
            rows = rows.drop("rank").join(new.select(F.col("query").alias("pool"), F.col("id").alias("original_rank"), F.col("mmr_rank").alias("rank")), ["pool", "original_rank"])
    rows = rows.withColumn("corpus_size", F.count("*").over(Window.partitionBy("pool"))).where(pools.page_of(F.col("rank"), spec.offset, spec.limit)).join(counts, "pool", "left")
    rows = rows.withColumn("source_id", F.concat(F.lit("source_"), F.sha2("canonical", 256)))
    in_budget = F.col("rank") - spec.offset <= spec.evidence_results
    quotes = F.lit(None).cast("array<struct<start_char:bigint,quote:string>>")
    if spec.evidence_mode == "extract" and snapshots is not None:
        snap = S.snapshot(snapshots.select(F.col("url").alias("canonical"), "url", "text"), key="canonical")
        targets = rows.where(in_budget).select("pool", "canonical", "question").join(snap.select("canonical", "content", "segments"), "canonical")
        targets = targets.withColumn("id", F.xxhash64("canonical")).withColumnRenamed("pool", "query")
        e = s.evidence
        chosen = P.select_passages(targets, e.max_candidate_passages, e.max_chars_per_passage)
        page = E.first_page(chosen, e.max_passages_per_result, e.max_chars_per_result, ["query", "id"])
        found = page.groupBy(F.col("query").alias("pool"), F.col("id").alias("_id")).agg(F.array_sort(F.collect_list(F.struct("start_char", "quote"))).alias("quotes"))
        known = snap.select("canonical", F.lit(True).alias("_known"))
        rows = rows.withColumn("_id", F.xxhash64("canonical")).join(found, ["pool", "_id"], "left").join(known, "canonical", "left").drop("_id")
    else:
        rows = rows.withColumns({"quotes": quotes, "_known": F.lit(False)})
    status = E.status_columns(F.lit(spec.evidence_mode == "extract"), in_budget, F.coalesce("_known", F.lit(False)), F.col("quotes").isNotNull(), F.lit(False), F.lit(False))
    return rows.withColumns(status).select("pool", "rank", "source_id", F.col("canonical").alias("url"), "title", "snippet", "providers", "relevance", "score", "original_rank", "corpus_size", "evidence_status", "confidence", "quotes", F.col("removed").alias("removed_count"))


def webfetch(settings: Settings, documents: DataFrame, max_chars: int | None = None) -> DataFrame:
    """Every page of every document (url, text), with hash, clipped segments and the offset of the next."""
    size = max_chars or settings.fetch.max_chars
    if size > settings.fetch.max_output_chars:
        raise InvalidArgument("max_chars is over the limit")
    snap = S.snapshot(documents.select(F.col("url").alias("_key"), "url", "text"), key="_key")
    pages = S.pages(snap.select("snapshot_id", "content"), size, "snapshot_id", "content").withColumnRenamed("content", "page_content")
    both = pages.join(snap, "snapshot_id")
    start, end = F.col("page") * size, F.col("page") * size + F.length("page_content")
    own = F.filter("segments", lambda s: (s["end_char"] > start) & (s["start_char"] < end))
    clip = F.transform(own, lambda s: F.struct(s["id"].alias("id"), F.greatest(s["start_char"], start).alias("start_char"), F.least(s["end_char"], end).alias("end_char")))
    return both.select("url", "snapshot_id", "content_sha256", "page", F.col("page_content").alias("content"), clip.alias("segments"), "next_offset", F.col("next_offset").isNotNull().alias("truncated"))

"""Queries of segments, pages, passages, evidence, and the composed search and fetch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import evidence as E
from ..operators import passages as P
from ..operators import segments as S
from ..registry import ORACLE_SQL, query
from ..sources.tables import table
from . import ranking as K

MOST = 400
_PAR = r"[^\n]*(?:\n[^\n]+)*(?:\n+|$)"
_D2 = "(select doc_id, replace(text, chr(10), chr(10) || chr(10)) as text from documents)"
_SEG = f"""(select doc_id, n, s as text, (sum(length(s)) over (partition by doc_id order by n rows unbounded preceding) - length(s))::bigint as start_char, (sum(length(s)) over (partition by doc_id order by n rows unbounded preceding))::bigint as end_char
 from (select doc_id, n, p[n] as s from (select doc_id, list_filter(regexp_extract_all(text, '{_PAR}'), lambda x: x <> '') as p from {_D2} a) b, lateral (select unnest(range(1, len(p) + 1)) as n) c) d)"""


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with an empty line between paragraphs, and a URL."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n")).alias("text"), F.concat(F.lit("https://"), "source", F.lit(".example.com/"), "doc_id").alias("url"))


@query("X05_paragraphs", f"select doc_id, count(*)::bigint as n_segments, max(length(text))::bigint as longest from {_SEG} s group by doc_id")
def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = docs(spark, sf_dir).select("doc_id", S.paragraphs(F.col("text")).alias("p"))
    return p.select("doc_id", F.size("p").cast("long").alias("n_segments"), F.array_max(F.transform("p", lambda s: F.length(s))).cast("long").alias("longest"))


@query("W03_segment_offsets", f"select doc_id, n::bigint as n, start_char, end_char, sha256(text) as sha from {_SEG} s")
def segment_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.segments(docs(spark, sf_dir)).select("doc_id", "n", "start_char", "end_char", F.sha2("text", 256).alias("sha"))


@query("T05_document_pages", f"select doc_id, p::bigint as page, sha256(substring(text, p * 1500 + 1, 1500)) as sha, case when (p + 1) * 1500 < length(text) then ((p + 1) * 1500)::bigint end as next_offset from {_D2} d, lateral (select unnest(range(0, greatest(ceil(length(text) / 1500), 1)::bigint)) as p) x")
def document_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.pages(docs(spark, sf_dir), 1500).select("doc_id", "page", F.sha2("content", 256).alias("sha"), "next_offset")


@query("J05_interval_overlap", f"select i.doc_id, i.page::bigint as page, list_sort(list(s.n::bigint)) as segments from (select doc_id, p as page, p * 1500 as a, least((p + 1) * 1500, length(text)) as b from {_D2} d, lateral (select unnest(range(0, greatest(ceil(length(text) / 1500), 1)::bigint)) as p) x) i join {_SEG} s on i.doc_id = s.doc_id and s.start_char < i.b and s.end_char > i.a group by all")
def interval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = S.pages(docs(spark, sf_dir), 1500).select("doc_id", "page", (F.col("page") * 1500).alias("start"), (F.col("page") * 1500 + F.length("content")).alias("end"))
    hit = S.overlapping(pages, S.segments(docs(spark, sf_dir)).drop("text"))
    return hit.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list("n")).alias("segments"))


_SNAP_BAD = "case doc_id % 10 when 1 then 'hash' when 2 then 'segments' when 3 then 'id' end"


@query("F18_snapshot_integrity", f"select doc_id, {_SNAP_BAD} as rule from documents where doc_id % 10 in (1, 2, 3)")
def snapshot_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots of which some have been tampered with: the hash, the segments, the id."""
    k = F.col("doc_id") % 10
    s = S.snapshot(docs(spark, sf_dir)).withColumns({
        "content_sha256": F.when(k == 1, F.reverse("content_sha256")).otherwise(F.col("content_sha256")), "segments": F.when(k == 2, F.slice("segments", 2, 1000000)).otherwise(F.col("segments")),
        "snapshot_id": F.when(k == 3, F.concat("doc_id", F.lit("_x"))).otherwise(F.concat(F.lit("snapshot_"), "doc_id", F.lit("_text"))),
    })
    return S.integrity_violations(s).select(F.regexp_extract("snapshot_id", r"\d+", 0).cast("long").alias("doc_id"), "rule")


@query("S11_snapshot_store", f"select doc_id, sha256(text) as content_sha256, 'source_' || sha256('https://' || source || '.example.com/' || doc_id) as source_id from (select doc_id, source, replace(text, chr(10), chr(10) || chr(10)) as text from documents) d")
def snapshot_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write once: the second batch's snapshots that are stored already are left out by an anti-join on their id."""
    new = S.snapshot(docs(spark, sf_dir)).select("doc_id", "snapshot_id", "source_id", "content_sha256")
    stored = new.where("doc_id % 2 = 0")
    return stored.unionByName(new.join(stored.select("snapshot_id"), "snapshot_id", "left_anti")).select("doc_id", "content_sha256", "source_id")


_UNITS = f"""(select s.*, length(t) between 1 and 100 and not regexp_matches(t, '[.!?。！？;；:]$') as heading, len(list_intersect(list_distinct(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')), q)) > 0 as matched, regexp_matches(t, '(?i)^(?:{"|".join(X.OPENERS)})(?:[^0-9A-Za-z_]|$)|(?:^|[^0-9A-Za-z_])(?:{"|".join(X.MODALS)})(?:[^0-9A-Za-z_]|$)') as qualifies
 from (select *, trim(text, chr(10) || ' ') as t, ['the', 'der', 'les', 'los', 'of'] as q from {_SEG} a) s)"""
_WORDS = ["the", "der", "les", "los", "of"]


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return S.segments(docs(spark, sf_dir)).withColumns({"heading": X.is_heading(t), "matched": F.arrays_overlap(X.tokens(t), F.array(*map(F.lit, _WORDS))), "qualifies": X.qualifies_context(t)})


@query("J07_contiguous_neighbours", f"select doc_id, n::bigint as n, coalesce(lag(end_char) over w = start_char, false) as joins_previous, coalesce(lead(start_char) over w = end_char, false) as joins_next, (lead(n, 2) over w)::bigint as second_next from {_SEG} s window w as (partition by doc_id order by n)")
def contiguous_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy("n")
    return S.segments(docs(spark, sf_dir)).select("doc_id", "n", F.coalesce(F.lag("end_char").over(w) == F.col("start_char"), F.lit(False)).alias("joins_previous"), F.coalesce(F.lead("start_char").over(w) == F.col("end_char"), F.lit(False)).alias("joins_next"), F.lead("n", 2).over(w).alias("second_next"))


@query("W04_context_windows", f"""with u as (select *, lag(end_char) over w as pe, lag(start_char) over w as ps, lag(heading) over w as ph, lag(matched or qualifies) over w as pm,
 lead(start_char) over w as s1, lead(end_char) over w as e1, lead(heading) over w as h1, lead(matched or qualifies) over w as m1, lead(start_char, 2) over w as s2, lead(end_char, 2) over w as e2, lead(heading, 2) over w as h2, lead(matched or qualifies, 2) over w as m2 from {_UNITS} x window w as (partition by doc_id order by n)),
v as (select *, case when pe = start_char and end_char - ps <= {MOST} and (ph or (not heading and pm)) then ps else start_char end as from_char from u),
x as (select *, coalesce(not h1 and s1 = end_char and (heading or m1) and e1 - from_char <= {MOST}, false) as t1 from v)
select doc_id, n::bigint as n, from_char, case when t1 and coalesce(not h2 and s2 = e1 and (heading or m2) and e2 - from_char <= {MOST}, false) then e2 when t1 then e1 else end_char end as to_char from x where matched and end_char - start_char <= {MOST}""")
def context_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.context_neighbours(_units(spark, sf_dir), MOST).select("doc_id", "n", "from_char", "to_char")


@query("A06_unit_frequency", f"select doc_id, t as term, count(*)::bigint as units from (select doc_id, n, unnest(list_intersect(list_distinct(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')), ['the', 'der', 'les', 'los', 'of'])) as t from {_SEG} s) x group by all")
def unit_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = F.array_intersect(F.array_distinct(X.tokens(F.col("text"))), F.array(*map(F.lit, _WORDS)))
    return S.segments(docs(spark, sf_dir)).select("doc_id", F.explode(terms).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("units"))


def _passages(spark: SparkSession, sf_dir: str, count: int = 8, best: int = 3) -> DataFrame:
    """Passages of the best documents of every benchmark item."""
    top = K.ranked(spark, sf_dir, best).select("query", "id")
    snaps = S.snapshot(docs(spark, sf_dir)).withColumnRenamed("doc_id", "id")
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), F.col("text").alias("question"))
    return P.select_passages(top.join(snaps.select("id", "content", "segments"), "id").join(items, "query"), count, MOST)


@query("C02_select_passages")
def select_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _passages(spark, sf_dir)


_MERGED = f"""with recursive w as (select doc_id, from_char, to_char, row_number() over (partition by doc_id order by from_char, to_char) as i from ({ORACLE_SQL["W04_context_windows"]}) x),
r(doc_id, i, a, b, part) as (select doc_id, i, from_char, to_char, 1 from w where i = 1 union all
 select w.doc_id, w.i, case when from_char <= b and greatest(b, to_char) - a <= {MOST} then a else from_char end, case when from_char <= b and greatest(b, to_char) - a <= {MOST} then greatest(b, to_char) else to_char end, case when from_char <= b and greatest(b, to_char) - a <= {MOST} then part else part + 1 end
 from r join w on w.doc_id = r.doc_id and w.i = r.i + 1)
select doc_id, min(a)::bigint as from_char, max(b)::bigint as to_char from r group by doc_id, part"""


@query("W05_budgeted_merge", _MERGED)
def budgeted_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Context windows of a document merged as long as the union fits: a fold over each document's sorted windows."""
    import pandas as pd

    def run(parts):
        for part in parts:
            out = []
            for row in part.itertuples(index=False):
                out += [(row.doc_id, a, b) for a, b in P.merge(sorted((w["from_char"], w["to_char"]) for w in row.windows), MOST)]
            yield pd.DataFrame(out, columns=["doc_id", "from_char", "to_char"])

    windows = P.context_neighbours(_units(spark, sf_dir), MOST).groupBy("doc_id").agg(F.collect_list(F.struct("from_char", "to_char")).alias("windows"))
    return windows.mapInPandas(run, "doc_id long, from_char long, to_char long")


@query("T02_passage_priority")
def passage_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _passages(spark, sf_dir, count=64).select("query", "id", "priority", "start_char", F.round("coverage", 6).alias("coverage"))


@query("W06_novelty_order")
def novelty_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How display order differs from the order of choice."""
    shown = F.row_number().over(Window.partitionBy("query", "id").orderBy("start_char")).cast("long")
    return _passages(spark, sf_dir).select("query", "id", "priority", shown.alias("shown"))


# Evidence of segments: a document's segments, longest first, as passages of its snapshot.

_EV = f"(select doc_id as id, row_number() over (partition by doc_id order by length(text) desc, n) as priority, start_char, end_char, text as quote from {_SEG} s where length(text) <= 600)"


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg = S.segments(docs(spark, sf_dir)).where(F.length("text") <= 600)
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc(F.length("text")), "n")).cast("long")
    passages = seg.select(F.col("doc_id").alias("id"), rank.alias("priority"), "start_char", "end_char", F.col("text").alias("quote"))
    return E.prepare(passages, S.snapshot(docs(spark, sf_dir)).withColumnRenamed("doc_id", "id"))


@query("F19_evidence_exact", f"select id, priority::bigint as priority, id % 13 <> 5 as exact from {_EV} e")
def evidence_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _evidence(spark, sf_dir).withColumn("quote", F.when(F.col("id") % 13 == 5, F.concat("quote", F.lit("x"))).otherwise(F.col("quote")))
    return e.select("id", "priority", E.is_exact(F.col("content"), F.col("content_sha256"), F.col("start_char").cast("int"), F.col("end_char").cast("int"), F.col("quote")).alias("exact"))


_RUN = f"(select *, sum(length(quote) + 2) over (partition by id order by priority) - 2 as used from {_EV} e)"
_PAGE = f"(select * from (select *, bool_and(used <= 1200 and priority <= 3) over (partition by id order by priority) as ok from {_RUN} r) q where ok)"


@query("T06_evidence_page", f"select id, priority::bigint as priority, (row_number() over (partition by id order by start_char))::bigint as shown from {_PAGE} p")
def evidence_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.first_page(_evidence(spark, sf_dir), 3, 1200, ["id"]).select("id", "priority", "shown")


@query("A18_evidence_chars", f"select id, sum(length(quote))::bigint as evidence_chars, count(*)::bigint as entries from {_PAGE} p group by id")
def evidence_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.first_page(_evidence(spark, sf_dir), 3, 1200, ["id"]).groupBy("id").agg(F.sum(F.length("quote")).alias("evidence_chars"), F.count("*").alias("entries"))


@query("C07_evidence_pages", f"select p.id, (count(*))::bigint as shown, any_value(total)::bigint as total, count(*) < any_value(total) as has_more, list(p.start_char order by p.start_char) as starts from {_PAGE} p join (select id, count(*) as total from {_EV} e group by id) t using (id) group by p.id")
def evidence_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _evidence(spark, sf_dir)
    page = E.first_page(e, 3, 1200, ["id"]).groupBy("id").agg(F.count("*").alias("shown"), F.array_sort(F.collect_list("start_char")).alias("starts"))
    return page.join(e.groupBy("id").agg(F.count("*").alias("total")), "id").select("id", "shown", "total", (F.col("shown") < F.col("total")).alias("has_more"), "starts")


@query("J12_plan_snapshot", f"select id, count(*)::bigint as entries, any_value(sha256(d.text)) as content_sha256 from {_EV} e join {_D2} d on e.id = d.doc_id group by id")
def plan_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evidence(spark, sf_dir).groupBy("id").agg(F.count("*").alias("entries"), F.first("content_sha256").alias("content_sha256"))


_RES = "(select doc_id as id, doc_id % 10 + 1 as rank, doc_id % 2 = 0 as requested, doc_id % 3 <> 0 as fetched, doc_id % 5 <> 0 as matched, doc_id % 7 = 0 as scoped, doc_id % 4 = 0 as warned from documents)"
_STATUS = "case when not requested then 'not_requested' when rank > 5 then 'skipped_budget' when fetched and matched then 'verified' when fetched then 'no_match' when scoped then 'out_of_scope' else 'unavailable' end"


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select(d.alias("id"), (d % 10 + 1).alias("rank"), (d % 2 == 0).alias("requested"), (d % 3 != 0).alias("fetched"), (d % 5 != 0).alias("matched"), (d % 7 == 0).alias("scoped"), (d % 4 == 0).alias("warned"))
    return rows.withColumns(E.status_columns(F.col("requested"), F.col("rank") <= 5, F.col("fetched"), F.col("matched"), F.col("scoped"), F.col("warned")))


@query("X21_evidence_status", f"select id, {_STATUS} as evidence_status from {_RES} r")
def evidence_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _results(spark, sf_dir).select("id", "evidence_status")


@query("X20_confidence", f"select id, case {_STATUS} when 'verified' then case when warned then 'medium' else 'high' end when 'no_match' then 'low' when 'out_of_scope' then 'low' when 'unavailable' then 'low' else 'unknown' end as confidence from {_RES} r")
def confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _results(spark, sf_dir).select("id", "confidence")


@query("A19_evidence_summary", f"select rank, (count(*) filter (requested and rank <= 5))::bigint as target, (count(*) filter ({_STATUS} = 'verified'))::bigint as verified, case when count(*) filter (requested and rank <= 5) > count(*) filter ({_STATUS} = 'verified') then 'partial' else 'ok' end as status from {_RES} r group by rank")
def evidence_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _results(spark, sf_dir).groupBy("rank").agg(F.count_if(F.col("requested") & (F.col("rank") <= 5)).alias("target"), F.count_if(F.col("evidence_status") == "verified").alias("verified"))
    return s.withColumn("status", F.when(F.col("target") > F.col("verified"), "partial").otherwise("ok"))


@query("T07_evidence_targets", f"with {K._bm25_cte()} select query, id, (rank - 5)::bigint as rank_in_page from ranked where rank > 5 and rank <= 10 and rank - 5 <= 2")
def evidence_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = K.ranked(spark, sf_dir, 10).where("rank > 5").withColumn("rank_in_page", F.col("rank") - 5)
    return page.where("rank_in_page <= 2").select("query", "id", "rank_in_page")


@query("C04_enrich")
def enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verified evidence of the two best documents of every item."""
    passages = _passages(spark, sf_dir, best=2)
    e = E.prepare(passages, S.snapshot(docs(spark, sf_dir)).withColumnRenamed("doc_id", "id"))
    page = E.first_page(e, 3, 1200, ["query", "id"])
    exact = E.is_exact(F.col("content"), F.col("content_sha256"), F.col("start_char").cast("int"), F.col("end_char").cast("int"), F.col("quote"))
    return page.select("query", "id", "evidence_id", "shown", "quote", "segment_ids", exact.alias("exact"))


@query("C05_websearch")
def websearch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search of every item: the best ten, reranked for diversity, with how much verified evidence the first two have."""
    found = K.mmr_pool(spark, sf_dir, 10)
    quoted = enrich(spark, sf_dir).groupBy("query", "id").agg(F.count_if("exact").alias("verified_quotes"), F.sum(F.length("quote")).alias("evidence_chars"))
    both = found.join(quoted, ["query", "id"], "left")
    flags = {k: F.lit(v) for k, v in (("requested", True), ("scoped", False), ("warned", False))}
    status = E.status_columns(flags["requested"], F.col("rank") <= 2, F.col("rank") <= 2, F.coalesce(F.col("verified_quotes") > 0, F.lit(False)), flags["scoped"], flags["warned"])
    return both.select("query", "id", "mmr_rank", F.col("rank").alias("original_rank"), F.round("score", 6).alias("score"), F.coalesce("verified_quotes", F.lit(0)).alias("verified_quotes"), F.coalesce("evidence_chars", F.lit(0)).alias("evidence_chars"), *(v.alias(k) for k, v in status.items()))


@query("C06_webfetch", f"select i.doc_id, i.page::bigint as page, i.b::bigint as end_char, i.b < i.len as truncated, list(s.n::bigint order by s.n) as segments, list(greatest(s.start_char, i.a)::bigint order by s.n) as starts, list(least(s.end_char, i.b)::bigint order by s.n) as ends from (select doc_id, p as page, p * 4000 as a, least((p + 1) * 4000, length(text)) as b, length(text) as len from {_D2} d, lateral (select unnest(range(0, greatest(ceil(length(text) / 4000), 1)::bigint)) as p) x) i join {_SEG} s on i.doc_id = s.doc_id and s.start_char < i.b and s.end_char > i.a group by all")
def webfetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page of every snapshot, with its segments clipped to it."""
    size = 4000
    pages = S.pages(docs(spark, sf_dir), size).select("doc_id", "page", (F.col("page") * size).alias("start"), (F.col("page") * size + F.length("content")).alias("end"), F.col("next_offset").isNotNull().alias("truncated"))
    hit = S.overlapping(pages, S.segments(docs(spark, sf_dir)).drop("text"))
    one = F.struct("n", F.greatest("start_char", "start").alias("a"), F.least("end_char", "end").alias("b"))
    rows = hit.groupBy("doc_id", "page", "end", "truncated").agg(F.array_sort(F.collect_list(one)).alias("s"))
    return rows.select("doc_id", "page", F.col("end").alias("end_char"), "truncated", F.transform("s", lambda x: x["n"]).alias("segments"), F.transform("s", lambda x: x["a"]).alias("starts"), F.transform("s", lambda x: x["b"]).alias("ends"))

"""Queries of source health, traces, contracts, responses and page sources, over events and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import urls as U
from ..operators import cache as CA
from ..operators import contracts as CT
from ..operators import health as H
from ..operators import redaction as RD
from ..operators import traces as TR
from ..registry import query
from ..sources import evals as EV
from ..sources import html_pages as HP
from ..sources import responses as RS
from ..sources import robots as RB
from ..sources.tables import table

# Observations: an event is an answer of its user's source; its type says what came of it.
_OBS = "(select event_id, 's' || user_id as source, row_number() over (partition by user_id order by ts, event_id) as sequence, epoch_us(ts) // 1000 as at_ms, event_type = 'error' as failed, event_id % 4 = 0 as blocked from events)"


def _observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    failed = F.col("event_type") == "error"
    return table(spark, sf_dir, "events").select(
        "event_id", F.concat(F.lit("s"), "user_id").alias("source"), F.row_number().over(w).cast("long").alias("sequence"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at"),
        F.when(failed, F.when(F.col("event_id") % 4 == 0, "UPSTREAM_BLOCKED").otherwise("TIMEOUT")).alias("code"), F.lit(False).alias("suspended"), (~failed).alias("succeeded"), F.lit(True).alias("complete"),
    )


@query("A16_engine_counters", f"select source, count(*)::bigint as submitted, (count(*) filter (failed))::bigint as failed, max(run)::bigint as longest_run from (select *, case when failed then row_number() over (partition by source, island order by sequence) - case when island > 0 then 1 else 0 end else 0 end as run from (select *, sum(case when failed then 0 else 1 end) over (partition by source order by sequence rows unbounded preceding) as island from {_OBS} o) i) r group by source")
def engine_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = H.consecutive_failures(_observations(spark, sf_dir), F.col("code").isNotNull())
    return runs.groupBy("source").agg(F.count("*").alias("submitted"), F.count("code").alias("failed"), F.max("consecutive").alias("longest_run"))


@query("A17_health_rollup", f"select source, case when failed = n then 'unavailable' when failed > 0 then 'degraded' else 'ready' end as status from (select source, count(*) as n, count(*) filter (failed) as failed from {_OBS} o group by source) x")
def health_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _observations(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n"), F.count("code").alias("failed"))
    return s.select("source", H.rollup(F.col("n"), F.col("failed"), F.col("n"), F.lit(None), F.lit(False)).alias("status"))


@query("H01_circuit_breaker", f"""with i as (select *, sum(case when failed then 0 else 1 end) over (partition by source order by sequence rows unbounded preceding) as island from {_OBS} o), r as (select *, sum(case when failed then 1 else 0 end) over (partition by source, island order by sequence rows unbounded preceding) as run from i),
l as (select *, row_number() over (partition by source order by sequence desc) as k, count(*) over (partition by source) as n, count(*) filter (failed) over (partition by source) as fails from r)
select source, sequence::bigint as newest, run::bigint as consecutive, fails::bigint as failures, n::bigint as observations, (case when failed then at_ms + least(1800000, (case when blocked then 300000 else 30000 end) * pow(2, least(10, run - 1))) else 0 end)::bigint as cooldown_until,
 case when failed then case when blocked then 'UPSTREAM_BLOCKED' else 'TIMEOUT' end end as last_error, false as suspended, at_ms::bigint as at_, case when failed then 'cooling_down' else 'healthy' end as status from l where k = 1""")
def circuit_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.fold(_observations(spark, sf_dir)).withColumnRenamed("at", "at_")


@query("H01_admission")
def admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event is a request of its user's pool for four sources; each is answered two hours on, and an error event is a failure of one of them."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.unix_millis(F.col("ts").cast("timestamp")).alias("at"))
    sources, later = F.array(*(F.concat(F.lit("s"), ((F.col("user_id") + k) % 7).cast("string")) for k in range(4))), F.col("at") + 7_200_000
    none = F.lit(None).cast("string")
    base = [F.concat(F.lit("p"), "user_id").alias("pool"), F.col("event_id").alias("request"), sources.alias("sources")]
    asks = e.select(*base, "at", F.lit(2).alias("kind"), none.alias("source"), none.alias("code"), F.lit(False).alias("succeeded"))
    ends = e.select(*base, later.alias("at"), F.lit(1).alias("kind"), none.alias("source"), none.alias("code"), F.lit(False).alias("succeeded"))
    failed = (F.col("event_type") == "error") & (F.col("s.at") == F.col("event_id") % 4)
    answers = e.select(*base, later.alias("at"), "event_type", "event_id", F.explode(F.transform(sources, lambda x, i: F.struct(x.alias("name"), i.alias("at")))).alias("s"))
    answers = answers.select("pool", "request", "sources", "at", F.lit(0).alias("kind"), F.col("s.name").alias("source"), F.when(failed, F.when(F.col("event_id") % 3 == 0, "UPSTREAM_BLOCKED").otherwise("TIMEOUT")).alias("code"), (~failed).alias("succeeded"))
    return H.admissions(asks.union(ends).union(answers).withColumns({"suspended": F.lit(False), "complete": F.lit(True)}))


@query("H02_late_observations", f"select event_id from (select *, max(seq) over (partition by source order by at_ms, seq rows between unbounded preceding and 1 preceding) as newest from (select event_id, source, at_ms, case when event_id % 9 = 0 then greatest(sequence - 5, 1) else sequence end as seq from {_OBS} o) s) x where newest is null or seq >= newest")
def late_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    late = F.when(F.col("event_id") % 9 == 0, F.greatest(F.col("sequence") - 5, F.lit(1))).otherwise(F.col("sequence"))
    return H.applied(_observations(spark, sf_dir).withColumn("sequence", late)).select("event_id")


@query("H03_missing_diagnostics", f"select source, count(*)::bigint as observations from {_OBS} o where failed or event_id % 3 <> 0 group by source")
def missing_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    third = F.col("event_id") % 3 == 0
    o = _observations(spark, sf_dir).withColumns({"succeeded": F.col("succeeded") & ~third, "complete": F.lit(False)})
    return H.fold(o).where("observations > 0").select("source", "observations")


@query("J08_engine_join", f"select e.source, e.n::bigint as n, coalesce(f.n, 0)::bigint as failures, coalesce(s.n, 0)::bigint as successes from (select source, count(*) as n from {_OBS} o group by source) e left join (select source, count(*) as n from {_OBS} o where failed group by source) f using (source) left join (select source, count(*) as n from {_OBS} o where not failed group by source) s using (source)")
def engine_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources with their failures and successes: three aggregates of one scan instead of two joins with it."""
    return _observations(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n"), F.count("code").alias("failures"), F.count_if("succeeded").alias("successes"))


@query("H04_cache_replay")
def cache_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").select(F.concat(F.lit("u"), "user_id").alias("cache"), F.row_number().over(w).cast("long").alias("seq"), F.concat("event_type", (F.col("event_id") % 3).cast("string")).alias("key"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at"), (F.col("event_id") % 700 + 100).alias("size"), (F.col("event_type") == "error").alias("failed"))
    return CA.replay(e, 86_400_000 * 3, 5, 3000)


@query("A21_cache_counters", "select event_type, count(*)::bigint as requests, (count(*) filter (value > 50))::bigint as over, round(sum(value), 4) as total from events group by event_type")
def cache_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("requests"), F.count_if(F.col("value") > 50).alias("over"), F.round(F.sum("value"), 4).alias("total"))


# Traces: a run is a user's day; its events are spans, each below the one three before.
_SPANS = "(select event_id, user_id || '-' || ts::date as run, event_id::varchar as span, epoch_us(ts) // 1000 as started_ms, case when event_type <> 'error' then (value * 1000)::bigint end as duration_ms, lag(event_id::varchar, 3) over (partition by user_id, ts::date order by ts, event_id) as parent from events)"


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_format("ts", "yyyy-MM-dd")
    w = Window.partitionBy("user_id", day).orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("event_id", F.concat_ws("-", F.col("user_id").cast("string"), day).alias("run"), F.col("event_id").cast("string").alias("span"), F.unix_millis(F.col("ts").cast("timestamp")).alias("started_ms"), F.when(F.col("event_type") != "error", F.round(F.col("value") * 1000).cast("long")).alias("duration_ms"), F.lag(F.col("event_id").cast("string"), 3).over(w).alias("parent"))


@query("J10_span_tree", f"with recursive s as (select * from {_SPANS} x), t(run, span, depth) as (select run, span, 0 from s where parent is null union all select s.run, s.span, t.depth + 1 from s join t on s.run = t.run and s.parent = t.span) select run, span, least(depth, 6)::bigint as depth from t")
def span_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TR.depths(_spans(spark, sf_dir)).select("run", "span", "depth")


@query("A22_observed_end", f"select run, min(started_ms)::bigint as run_started, max(started_ms + coalesce(duration_ms, 0))::bigint as run_end from {_SPANS} s group by run")
def observed_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TR.observed_end(_spans(spark, sf_dir))


@query("W08_waterfall", f"""select event_id, case when b > a then round(greatest(0, least(112, (started_ms - a) / (b - a) * 116)), 6) end as x, case when b > a then round(case when duration_ms is null then 2 else greatest(2, least(116 - greatest(0, least(112, (started_ms - a) / (b - a) * 116)), duration_ms / (b - a) * 116)) end, 6) end as bar
from (select *, min(started_ms) over (partition by run) as a, max(started_ms + coalesce(duration_ms, 0)) over (partition by run) as b from {_SPANS} s) z""")
def waterfall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TR.waterfall(_spans(spark, sf_dir)).select("event_id", F.round("x", 6).alias("x"), F.round("bar", 6).alias("bar"))


_TRACES = "(select run as id, min(started_ms) as started_ms from {s} s group by run)".format(s=_SPANS)


@query("W07_retention", f"select id, started_ms::bigint as started_ms, (row_number() over (order by started_ms desc, id desc))::bigint as rank from {_TRACES} t where started_ms > (select max(started_ms) - 86400000 from {_TRACES} u) order by started_ms desc, id desc limit 100")
def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _spans(spark, sf_dir).groupBy(F.col("run").alias("id")).agg(F.min("started_ms").alias("started_ms"))
    now = t.agg(F.max("started_ms").alias("now"))
    return TR.retained(t.join(F.broadcast(now)), F.col("now")).select("id", "started_ms", "rank")


@query("S12_trace_store", f"select run as id, count(*)::bigint as spans, list(span order by started_ms, span) as span_ids from {_SPANS} s group by run")
def trace_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = F.struct("started_ms", "span")
    return _spans(spark, sf_dir).groupBy(F.col("run").alias("id")).agg(F.count("*").alias("spans"), F.transform(F.array_sort(F.collect_list(one)), lambda x: x["span"]).alias("span_ids"))


@query("H10_interrupted", "select user_id, case when user_id % 3 = 0 and user_id % 2 = 1 then 'interrupted' when user_id % 3 = 0 then 'running' else 'ok' end as status from (select distinct user_id from events) u")
def interrupted(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    runs = users.select(F.col("user_id").alias("id"), F.when(F.col("user_id") % 3 == 0, "running").otherwise("ok").alias("status"), F.col("user_id").alias("owner"))
    return TR.interrupted(runs, users.where("user_id % 2 = 0").select(F.col("user_id").alias("owner"))).select(F.col("id").alias("user_id"), "status")


@query("F24_redaction")
def redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    record = F.to_json(F.struct(F.col("event_type").alias("name"), F.lit("Bearer abc").alias("note"), F.lit("k").alias("api_key"), F.lit("https://u:p@example.com/a?b=c").alias("url"), F.col("value"), F.struct(F.lit("x").alias("title")).alias("message"), F.col("props").alias("text")))
    return table(spark, sf_dir, "events").select("event_id", RD.redacted(record).alias("record"))


@query("F17_expiry", "select event_id from events where ts + interval (event_id % 48) hour > timestamp '2024-01-20 00:00:00'")
def expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("expires_at", F.expr("ts + make_interval(0, 0, 0, 0, cast(event_id % 48 as int), 0, 0)"))
    return CT.live(e, F.expr("timestamp_ntz'2024-01-20 00:00:00'")).select("event_id")


@query("J09_cursor_kind", "select event_id, case when event_id % 5 = 0 then 'CURSOR_NOT_FOUND' when event_id % 2 = 1 then 'CURSOR_MISMATCH' when event_id % 3 = 0 then 'CURSOR_EXPIRED' end as error from events")
def cursor_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    stored = e.where("event_id % 5 <> 0").select(F.col("event_id").alias("_id"), F.when(F.col("event_id") % 2 == 1, "search").otherwise("fetch").alias("kind"), F.when(F.col("event_id") % 3 == 0, 0).otherwise(10).alias("expires"))
    both = e.join(stored, F.col("event_id") == F.col("_id"), "left")
    return both.select("event_id", CT.cursor_error(F.col("expires"), F.lit(5), F.col("kind"), F.lit("fetch")).alias("error"))


@query("F20_contract_rules", """select event_id, unnest(list_filter([case when s = 'partial' and event_id % 2 = 0 then 'partial_has_warnings' end, case when s in ('ok', 'partial') and event_id % 3 = 0 then 'answer_has_results' end, case when s in ('empty', 'error') and event_id % 3 <> 0 then 'empty_has_none' end,
 case when (s = 'error') <> (event_id % 4 = 3) then 'error_has_code' end, case when event_id % 7 = 0 then 'none_has_no_evidence' end], lambda x: x is not null)) as rule from (select event_id, ['ok', 'partial', 'empty', 'error'][event_id % 4 + 1] as s from events) e""")
def contract_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(e, F.element_at(F.array(*map(F.lit, ["ok", "partial", "empty", "error"])), (e % 4 + 1).cast("int")).alias("status"), F.when(e % 3 == 0, 0).otherwise(5).alias("n_results"), (e % 2).alias("n_warnings"), F.lit(False).alias("has_cursor"), F.lit("none").alias("mode"), F.when(e % 7 == 0, 1).otherwise(0).alias("n_evidence"), F.lit(False).alias("more"), F.when(e % 4 == 3, "TIMEOUT").alias("error"))
    return CT.violations(rows, "event_id", CT.answer_rules())


# Responses: ten pages make one; every seventh result names an engine that is not allowed, every eleventh has no title.
_RESP = "(select page_id, page_id // 10 as response_id, page_id % 10 + 1 as pos, page_id % 77 = 7 as bad_engine, page_id % 11 = 0 as untitled from pages)"


def _responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    row = F.struct(F.col("page_id").alias("_o"), F.col("url"), F.when(F.col("page_id") % 11 != 0, F.repeat(F.col("url"), F.lit(20))).alias("title"), F.lit("snippet").alias("content"), F.lit("2024-03-01").alias("publishedDate"), F.when(F.col("page_id") % 77 == 7, F.array(F.lit("nope"))).otherwise(F.array(F.lit("brave"), F.lit("ddg"))).alias("engines"))
    rows = p.groupBy(F.floor(F.col("page_id") / 10).cast("long").alias("response_id")).agg(F.array_sort(F.collect_list(row)).alias("results"))
    idle = F.array(F.array(F.lit("brave"), F.lit("HTTP 429"), F.lit("true")), F.array(F.lit("other"), F.lit("timeout")))
    return rows.select("response_id", F.to_json(F.struct("results", idle.alias("unresponsive_engines"), (F.col("response_id") % 2 == 0).alias("paging"))).alias("body"))


@query("S02_response_parse", f"select response_id::bigint as response_id, pos::bigint as pos, case when untitled then 'invalid_result' when bad_engine then 'unconfigured_engine' end as error, case when not untitled then 500 end::bigint as title_chars, response_id % 2 = 1 as exhausted, bool_or(bad_engine and not untitled) over (partition by response_id) as failed from {_RESP} r join (select page_id, url from pages) p using (page_id)")
def response_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return RS.parse(_responses(spark, sf_dir), ["brave", "ddg"]).select("response_id", "pos", "error", F.length("title").cast("long").alias("title_chars"), "exhausted", "failed")


@query("S02_engine_failures", f"select distinct response_id::bigint as response_id, unnest(['brave', 'unconfigured_engine']) as engine, unnest(['UPSTREAM_BLOCKED', 'TIMEOUT']) as code from {_RESP} r")
def engine_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return RS.failures(_responses(spark, sf_dir), ["brave", "ddg"]).select("response_id", "engine", "code")


@query("S06_extraction")
def extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return HP.readable(table(spark, sf_dir, "pages")).select("page_id", "title", F.length("text").alias("n_chars"), F.sha2("text", 256).alias("sha"), "error")


@query("X16_markdown")
def markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return HP.readable(table(spark, sf_dir, "pages")).select("page_id", "markdown")


_META = """replace(html, '<head>', '<head><meta property="og:site_name" content="Site ' || page_id || '"><meta name="description" content="About ' || page_id || '"><link rel="canonical" href="https://example.com/' || page_id || '">')"""


@query("S08_page_metadata", """select page_id, regexp_extract(html, '<title>(.*?)</title>', 1) as title, regexp_extract(html, '<html lang="([^"]*)"', 1) as language, 'https://example.com/' || page_id as canonical_url, 'Site ' || page_id as site_name, 'About ' || page_id as description, null::varchar as image_url from pages""")
def page_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = F.concat(F.lit('<head><meta property="og:site_name" content="Site '), "page_id", F.lit('"><meta name="description" content="About '), "page_id", F.lit('"><link rel="canonical" href="https://example.com/'), "page_id", F.lit('">'))
    p = table(spark, sf_dir, "pages").select("page_id", F.replace(F.col("html"), F.lit("<head>"), tags).alias("html"))
    found = HP.declared()
    return p.select("page_id", *(found[c].alias(c) for c in ("title", "language", "canonical_url", "site_name", "description", "image_url")))


@query("S09_json_ld_logo", "select page_id, case when page_id % 3 = 0 then regexp_extract(url, '^https?://[^/]*', 0) || '/l.png' end as logo_url from pages")
def json_ld_logo(spark: SparkSession, sf_dir: str) -> DataFrame:
    tag = F.concat(F.lit('<script type="application/ld+json">{"@graph":[{"@type":"Person","logo":"/p.png"},{"@type":"https://schema.org/Article","publisher":{"@type":"Organization","logo":{"url":"/l.png"}}}]}</script></head>'))
    html = F.when(F.col("page_id") % 3 == 0, F.replace(F.col("html"), F.lit("</head>"), tag)).otherwise(F.col("html"))
    return HP.logos(table(spark, sf_dir, "pages").select("page_id", "url", html.alias("html")))


@query("F14_robots", "select page_id, not (regexp_extract(url, '://[^/]*(/[^?#]*)', 1) like '/en%' and regexp_extract(url, '://[^/]*(/[^?#]*)', 1) not like '/en/1%') as allowed from pages")
def robots(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", U.part(F.col("url"), "host").alias("host"), U.part(F.col("url"), "path").alias("path"))
    body = F.lit("User-agent: other\nDisallow: /\n\nUser-agent: *\nDisallow: /en # all\nAllow: /en/1\n")
    return RB.decide(p, RB.rules(p.select("host").distinct().withColumn("body", body))).select("page_id", "allowed")


@query("S13_eval_corpus", "select item_id, text as query, length(text)::bigint as n_chars from benchmark")
def eval_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog as JSON text, read back with its schema, strictly."""
    b = table(spark, sf_dir, "benchmark")
    one = F.to_json(F.struct(F.col("item_id").cast("string").alias("id"), F.col("text").alias("query"), F.lit("en").alias("language"), F.lit("concept").alias("category"), F.array().cast("array<string>").alias("sites")))
    q = b.select(F.from_json(one, EV.QUERY, {"mode": "FAILFAST"}).alias("q"))
    return q.select(F.col("q.id").cast("long").alias("item_id"), F.col("q.query").alias("query"), F.length("q.query").cast("long").alias("n_chars"))


@query("S14_pool_freeze", "select doc_id, case when doc_id % 2 = 1 then 'write' else 'conflict' end as outcome from documents where doc_id % 2 = 1 or doc_id % 8 = 0")
def pool_freeze(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("response_sha256"))
    frozen = d.where("id % 2 = 0").withColumn("response_sha256", F.when(F.col("id") % 8 == 0, F.reverse("response_sha256")).otherwise(F.col("response_sha256")))
    new, conflicts = EV.freeze(d, frozen)
    return new.select(F.col("id").alias("doc_id"), F.lit("write").alias("outcome")).union(conflicts.select("id", F.lit("conflict")))


# Extensions of our own, not the reference's.


@query("E01_session_windows", "select user_id, count(*)::bigint as sessions from (select user_id, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minute then 0 else 1 end as new from events) s where new = 1 group by user_id")
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy("user_id", F.session_window("ts", "30 minutes")).agg(F.count("*").alias("n")).groupBy("user_id").agg(F.count("*").alias("sessions"))

"""Queries of URL functions, scopes, pools and page metadata, over pages and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import urls as U
from ..operators import pools as P
from ..registry import query
from ..sources.tables import table

SITES = ["example.com", "example.org"]
EXCLUDED = ["blog.ththwh.example.org", "www.ththhe.example.com"]
_ENGINES = ["brave", "ddg", "mojeek"]

_RE = r"(?i)^(https?)://(?:([^/?#@]*)@)?([^/?#:@]*)(?::(\d*))?(/[^?#]*)?(\?[^#]*)?(#.*)?$"
_PARTS = f"""(select page_id, url, lower(regexp_extract(url, '{_RE}', 1)) as scheme, lower(regexp_extract(url, '{_RE}', 3)) as host,
  case when regexp_extract(url, '{_RE}', 5) = '' then '/' else regexp_extract(url, '{_RE}', 5) end as path, regexp_extract(url, '{_RE}', 6) as query, regexp_extract(url, '{_RE}', 7) as fragment from pages)"""
_TRACK = ", ".join(f"'{x}'" for x in U.TRACKING)
_KEPT = f"list_filter(string_split(substring(query, 2), '&'), lambda p: not list_contains([{_TRACK}], lower(string_split(p, '=')[1])))"
_CANON = f"scheme || '://' || host || path || case when query = '' or len({_KEPT}) = 0 or array_to_string({_KEPT}, '&') = '' then '' else '?' || array_to_string({_KEPT}, '&') end"


def _scope(sites: list[str], excluded: list[str], host: str = "host") -> str:
    inside = lambda names: " or ".join(f"({host} = '{d}' or ends_with({host}, '.{d}'))" for d in names)
    return f"({inside(sites)}) and not ({inside(excluded)})"


@query("X11_url_parts", f"select page_id, scheme, host, path, query, fragment, scheme || '://' || host as origin from {_PARTS}")
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", *(U.part(url, p).alias(p) for p in ("scheme", "host", "path", "query", "fragment")), U.origin(url).alias("origin"))


@query("F06_canonical_url", f"select page_id, {_CANON} as canonical from {_PARTS}")
def canonical_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", U.canonical(F.col("url")).alias("canonical"))


@query("F05_scope", f"select page_id, {_scope(SITES, EXCLUDED)} as inside from {_PARTS}")
def scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", U.in_scope(F.col("url"), SITES, EXCLUDED).alias("inside"))


@query("J11_scope_join", f"select page_id from {_PARTS} where {_scope(SITES, EXCLUDED)}")
def scope_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda names: spark.createDataFrame([(x,) for x in names], "domain string")
    return P.scope_by_join(table(spark, sf_dir, "pages"), of(SITES), of(EXCLUDED)).select("page_id")


@query("F03_domain_normalize", """select page_id, case page_id % 6 when 0 then host when 1 then host when 2 then null when 3 then null when 4 then null else null end as domain
from (select page_id, regexp_extract(url, '://([^/?#:@]*)', 1) as host from pages)""")
def domain_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = U.part(F.col("url"), "host")
    name = F.when(F.col("page_id") % 6 == 0, F.upper(host)).when(F.col("page_id") % 6 == 1, F.concat(host, F.lit("."))).when(F.col("page_id") % 6 == 2, F.col("url")).when(F.col("page_id") % 6 == 3, F.lit("127.0.0.1")).when(F.col("page_id") % 6 == 4, F.lit("co.uk")).otherwise(F.concat(F.lit("-"), host))
    return table(spark, sf_dir, "pages").select("page_id", U.normal_domain(name).alias("domain"))


@query("F04_resolve_scope", f"""select list_sort(list(distinct host)) as sites, bool_and({_scope(SITES, EXCLUDED).split(' and not ')[1]}) as all_excluded from {_PARTS}""")
def resolve_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    hosts = table(spark, sf_dir, "pages").select(U.normal_domain(U.part(F.col("url"), "host")).alias("host")).distinct()
    covered = F.exists(F.array(*map(F.lit, EXCLUDED)), lambda d: U.host_in(F.col("host"), d))
    return hosts.agg(F.array_sort(F.collect_set("host")).alias("sites"), F.bool_and(covered).alias("all_excluded"))


@query("F07_display_url", """select page_id, case page_id % 5 when 0 then url when 1 then null when 2 then 'http://93.184.216.34/a' when 3 then null else null end as shown from pages""")
def display_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.expr("case page_id % 5 when 0 then url when 1 then replace(url, '://', '://user@') when 2 then 'http://93.184.216.34/a' when 3 then 'http://192.168.1.1/' else 'https://printer.local/x' end")
    return table(spark, sf_dir, "pages").select("page_id", U.display_url(url).alias("shown"))


@query("F08_fetch_policy", "select page_id, page_id % 4 in (0, 1) as allowed from pages")
def fetch_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = U.part(F.col("url"), "host")
    url = F.when(F.col("page_id") % 4 == 0, F.col("url")).when(F.col("page_id") % 4 == 1, F.concat(F.lit("https://"), host, F.lit(":443/x"))).when(F.col("page_id") % 4 == 2, F.concat(F.lit("http://"), host, F.lit(":8080/"))).otherwise(F.concat(F.lit("ftp://"), host))
    return table(spark, sf_dir, "pages").select("page_id", U.may_fetch(url).alias("allowed"))


_IP = "(case event_id % 4 when 0 then 10 when 1 then 127 when 2 then 8 else 192 end)"


@query("F09_public_address", """select page_id, not bool_or(event_id % 4 in (0, 1) or (event_id % 4 = 3 and user_id % 256 = 168)) as all_public from (select user_id as page_id, event_id, user_id from events) group by page_id""")
def public_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.expr(f"{_IP}")
    ip = F.concat_ws(".", first.cast("string"), (F.col("user_id") % 256).cast("string"), F.lit("8"), (F.col("event_id") % 200 + 1).cast("string"))
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("page_id")).agg(F.bool_and(U.is_public_address(ip)).alias("all_public"))


@query("X14_address_range", """select event_id, case when a = 127 then 'loopback' when a = 169 and b = 254 then 'link_local' when a between 224 and 239 then 'multicast'
when a in (0, 10) or a >= 240 or (a = 172 and b between 16 and 31) or (a = 192 and b in (0, 168)) or (a = 198 and b in (18, 19)) then 'private' when a = 100 and b between 64 and 127 then 'special' else 'unicast' end as range
from (select event_id, event_id % 256 as a, user_id % 256 as b from events) x""")
def address_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    ip = F.concat_ws(".", (F.col("event_id") % 256).cast("string"), (F.col("user_id") % 256).cast("string"), F.lit("0"), F.lit("1"))
    return table(spark, sf_dir, "events").select("event_id", U.address_range(ip).alias("range"))


@query("X13_idna")
def idna(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = F.lower(F.regexp_extract("text", r"[\p{L}]{3,20}", 0))
    return table(spark, sf_dir, "documents").select("doc_id", U.idna_ascii(F.concat(word, F.lit(".example"))).alias("host"))


@query("F10_redirect_policy", f"""select page_id, case when (page_id % 7) >= 5 then 'FETCH_BLOCKED:limit' when target is null then 'HTTP_ERROR:location' when scheme = 'https' and starts_with(target, 'http:') then 'FETCH_BLOCKED:downgrade' end as refused
from (select page_id, scheme, lead(url) over (order by page_id) as target from {_PARTS})""")
def redirect_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    following = pages.select((F.col("page_id") - 1).alias("page_id"), F.col("url").alias("target"))
    return pages.join(following, "page_id", "left").select("page_id", U.may_redirect(F.col("url"), F.col("target"), F.col("page_id") % 7, 5).alias("refused"))


@query("F25_resource_type", "select event_id, event_type in ('view', 'click', 'search') as allowed from events")
def resource_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.col("event_type").isin("view", "click", "search").alias("allowed"))


@query("X12_registrable_domain", f"select page_id, array_to_string(string_split(host, '.')[-2:], '.') as domain from {_PARTS}")
def registrable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", U.registrable(U.part(F.col("url"), "host")).alias("domain"))


@query("S10_url_metadata", f"""select page_id, host as hostname, array_to_string(string_split(host, '.')[-2:], '.') as domain, scheme || '://' || host as origin, host || path || query as display_url, scheme || '://' || host || '/favicon.ico' as favicon_url, 'origin_fallback' as favicon_provenance from {_PARTS}""")
def url_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "pages").select("page_id", U.metadata(F.col("url")).alias("m"))
    return m.select("page_id", *(f"m.{c}" for c in ("hostname", "domain", "origin", "display_url", "favicon_url", "favicon_provenance")))


_HITS = f"""(select page_id % 3 as pool, (page_id // 40) % 3 + 1 as page, page_id % 2 as branch, page_id as pos, u as url, host as title, path as snippet, [list_value({', '.join(f"'{e}'" for e in _ENGINES)})[page_id % 3 + 1], 'base'] as engines, {_CANON} as canonical, host
  from (select *, case when page_id % 5 = 0 then scheme || '://' || host || '/same?utm_id=' || page_id else url end as u from {_PARTS}) z1)"""


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as search hits of three pools; every fifth leads to its host's /same page."""
    pages = table(spark, sf_dir, "pages")
    url = F.when(F.col("page_id") % 5 == 0, F.concat(U.origin(F.col("url")), F.lit("/same?utm_id="), F.col("page_id"))).otherwise(F.col("url"))
    return pages.select(
        (F.col("page_id") % 3).alias("pool"), (F.floor(F.col("page_id") / 40) % 3 + 1).cast("long").alias("page"), (F.col("page_id") % 2).alias("branch"), F.col("page_id").alias("pos"), url.alias("url"),
        U.part(F.col("url"), "host").alias("title"), U.part(F.col("url"), "path").alias("snippet"), F.array(F.element_at(F.array(*map(F.lit, _ENGINES)), (F.col("page_id") % 3 + 1).cast("int")), F.lit("base")).alias("engines"),
    )


_CANON_HIT = "case when pos % 5 = 0 then regexp_extract(url, '^(https?://[^/]*/same)', 1) else canonical end"
_SEQ = f"(select *, {_CANON_HIT} as c, row_number() over (partition by pool order by page, branch, pos) as seq from {_HITS} h)"
_FIRST = f"(select pool, c as canonical, min(seq) as seq, min_by(title, seq) as title from {_SEQ} s group by pool, c)"


@query("W01_frozen_rank", f"select pool::bigint as pool, canonical, row_number() over (partition by pool order by seq)::bigint as rank from {_FIRST} f")
def frozen_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.deduplicate(P.order_hits(_hits(spark, sf_dir))).select("pool", "canonical", "rank")


@query("U01_branch_union", f"select pool::bigint as pool, count(*)::bigint as hits, count(distinct c)::bigint as urls from {_SEQ} s group by pool")
def branch_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _hits(spark, sf_dir)
    both = hits.where("branch = 0").unionByName(hits.where("branch = 1"))
    return both.groupBy("pool").agg(F.count("*").alias("hits")).join(P.deduplicate(P.order_hits(both)).groupBy("pool").agg(F.count("*").alias("urls")), "pool")


@query("A15_provider_union", f"select pool::bigint as pool, c as canonical, list_sort(list_distinct(flatten(list(engines)))) as providers from {_SEQ} s group by pool, c")
def provider_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.deduplicate(P.order_hits(_hits(spark, sf_dir))).select("pool", "canonical", F.array_sort("providers").alias("providers"))


_ASKED = "(select pool, page, branch from (select pool, page, branch, row_number() over (partition by pool order by page, branch) as r from (select distinct pool, page, branch from {h} h2 where page <= 2) q) q2 where r <= 4)".format(h=_HITS)
_BUDGET = f"(select * from (select s.*, {_CANON_HIT} as c, row_number() over (partition by s.pool order by s.page, s.branch, s.pos) as seq from {_HITS} s join {_ASKED} a on s.pool = a.pool and s.page = a.page and s.branch = a.branch) b where seq <= 80)"


@query("A20_removed_count", f"select pool::bigint as pool, count(*)::bigint as seen, (count(*) filter (where not ({_scope(SITES, EXCLUDED)})))::bigint as removed from {_BUDGET} b group by pool")
def removed_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.collect(_hits(spark, sf_dir), SITES, EXCLUDED)[1]


@query("C03_collect", f"select pool::bigint as pool, c as canonical, row_number() over (partition by pool order by min(seq))::bigint as rank from {_BUDGET} b where {_scope(SITES, EXCLUDED)} group by pool, c")
def collect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.collect(_hits(spark, sf_dir), SITES, EXCLUDED)[0].select("pool", "canonical", "rank")


@query("T08_budgets", f"select pool::bigint as pool, count(*)::bigint as candidates, max(page)::bigint as pages, count(distinct page * 10 + branch)::bigint as requests from {_BUDGET} b group by pool")
def budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.within_budget(_hits(spark, sf_dir), 4, 2, 80).groupBy("pool").agg(F.count("*").alias("candidates"), F.max("page").alias("pages"), F.count_distinct("page", "branch").alias("requests"))


@query("T04_result_page", f"select pool, canonical, rank from (select pool::bigint as pool, canonical, row_number() over (partition by pool order by seq)::bigint as rank from {_FIRST} f) r where rank > 5 and rank <= 15")
def result_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.deduplicate(P.order_hits(_hits(spark, sf_dir))).where(P.page_of(F.col("rank"), 5, 10)).select("pool", "canonical", "rank")


@query("T09_sorted_sites", f"select page_id % 10 as bucket, list_sort(list(distinct host)) as sites from {_PARTS} group by 1")
def sorted_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").groupBy((F.col("page_id") % 10).alias("bucket")).agg(F.array_sort(F.collect_set(U.part(F.col("url"), "host"))).alias("sites"))


@query("U03_distinct_hosts", f"select distinct host from {_PARTS}")
def distinct_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(U.part(F.col("url"), "host").alias("host")).distinct()


@query("U05_site_exclusion", f"select distinct host from {_PARTS} where not ({_scope(SITES, EXCLUDED).split(' and not ')[1]})")
def site_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    hosts = table(spark, sf_dir, "pages").select(U.part(F.col("url"), "host").alias("host")).distinct()
    parents = hosts.select("host", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("host", r"\."))), lambda i: F.array_join(F.slice(F.split("host", r"\."), i, 99), "."))).alias("domain"))
    gone = parents.join(spark.createDataFrame([(x,) for x in EXCLUDED], "domain string"), "domain", "left_semi")
    return hosts.join(gone.select("host").distinct(), "host", "left_anti")


@query("X22_scope_report", """select page_id, case when s or e then 'application' else 'none' end as enforcement, case when s then 'query_rewrite' when e then 'post_filter_only' else 'none' end as upstream_mode from (select page_id, page_id % 2 = 1 as s, page_id % 3 = 1 as e from pages)""")
def scope_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites, excluded = F.col("page_id") % 2 == 1, F.col("page_id") % 3 == 1
    return table(spark, sf_dir, "pages").select("page_id", F.when(sites | excluded, "application").otherwise("none").alias("enforcement"), F.when(sites, "query_rewrite").when(excluded, "post_filter_only").otherwise("none").alias("upstream_mode"))


@query("H08_crawl_delay", f"""select page_id, host, (page_id * 10 + greatest(max(0) over w, 0))::bigint as asked, (max(page_id * 10 - 1000 * (k - 1)) over (partition by host order by k rows unbounded preceding) + 1000 * (k - 1))::bigint as starts
from (select page_id, host, row_number() over (partition by host order by page_id) as k from {_PARTS}) x window w as (partition by host order by k rows unbounded preceding)""")
def crawl_delay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each fetch of a host may start if two starts are a second apart: a running maximum, not a loop."""
    host = Window.partitionBy("host").orderBy("page_id")
    asked = table(spark, sf_dir, "pages").select("page_id", U.part(F.col("url"), "host").alias("host"), (F.col("page_id") * 10).alias("asked")).withColumn("k", F.row_number().over(host) - 1)
    latest = F.max(F.col("asked") - 1000 * F.col("k")).over(host.rowsBetween(Window.unboundedPreceding, 0))
    return asked.select("page_id", "host", "asked", (latest + 1000 * F.col("k")).cast("long").alias("starts"))

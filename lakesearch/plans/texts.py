"""Queries of text predicates and scalar functions, over documents, pages, benchmark and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..registry import query
from ..sources.tables import table

#: The white space class and the token class as RE2 writes them.
WS = r"\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
TRIM = rf"^[{WS}]+|[{WS}]+$"
TOK = r"[\p{L}\p{N}]+"


def _trim(x: str) -> str:
    return f"regexp_replace({x}, '{TRIM}', '', 'g')"


_SITE = rf"""(?i)(^|[{WS}])-?site:(?:"[^"]*"|''[^'']*''|[^{WS}]+)"""


@query("F01_content_query", f"""select item_id, {_trim(f"regexp_replace(q, '{_SITE}', {chr(39)}{chr(92)}1{chr(39)}, 'g')")} as content
from (select item_id, 'site:example.com ' || text || ' -site:"a b.org" SITE:''x y'' tail' as q from benchmark)""")
def content_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.concat(F.lit("site:example.com "), F.col("text"), F.lit(" -site:\"a b.org\" SITE:'x y' tail"))
    return table(spark, sf_dir, "benchmark").select("item_id", X.content_query(q).alias("content"))


@query("F02_query_guard", f"""select item_id, case when {_trim("q")} = '' or length(q) > 4000 then 'length'
  when len(list_filter(string_split_regex(q, '[{WS}\\x1C-\\x1F\\x{{85}}]+'), lambda p: regexp_matches(p, '^[!:]') or regexp_matches(p, '^<\\p{{N}}'))) > 0 then 'directive' end as refused
from (select item_id, case item_id % 5 when 0 then text when 1 then '!go ' || text when 2 then text || chr(28) || ':fr' when 3 then '  ' else text || ' <3 x' end as q from benchmark)""")
def query_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.expr("case item_id % 5 when 0 then text when 1 then concat('!go ', text) when 2 then concat(text, char(28), ':fr') when 3 then '  ' else concat(text, ' <3 x') end")
    return table(spark, sf_dir, "benchmark").select("item_id", X.query_error(q).alias("refused"))


@query("F11_challenge_page", """select page_id, regexp_matches(s, '(?i)<title[^>]*>\\s*(?:just a moment|attention required|access denied|verify (?:you|your)|captcha)') or regexp_matches(s, '(?i)cf-chl-|challenge-platform|id=["'']captcha') as challenge
from (select page_id, substring(case when page_id % 7 = 0 then replace(html, '<title>', '<title> Just a moment ') when page_id % 11 = 0 then html || '<p id="captcha">' else html end, 1, 30000) as s from pages)""")
def challenge_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.expr("""case when page_id % 7 = 0 then replace(html, '<title>', '<title> Just a moment ') when page_id % 11 = 0 then concat(html, '<p id="captcha">') else html end""")
    return table(spark, sf_dir, "pages").select("page_id", X.is_challenge(html).alias("challenge"))


@query("F12_http_status", """select event_id, case when s = 429 then 'RATE_LIMITED' when s = 403 then 'UPSTREAM_BLOCKED' when s < 200 or s >= 300 then 'HTTP_ERROR' when ct not in ('text/html', 'text/plain') then 'UNSUPPORTED_CONTENT_TYPE' end as page_error,
  case when s in (403, 429) then 'UPSTREAM_BLOCKED' when s < 200 or s >= 300 then 'UPSTREAM_UNAVAILABLE' when ct <> 'application/json' then 'UPSTREAM_BLOCKED' end as search_error
from (select event_id, [200, 204, 301, 403, 404, 429, 500][event_id % 7 + 1] as s, ['text/html', 'text/plain', 'application/json', 'image/png'][event_id % 4 + 1] as ct from events)""")
def http_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.expr("element_at(array(200, 204, 301, 403, 404, 429, 500), cast(event_id % 7 + 1 as int))")
    kind = F.expr("element_at(array('text/html; charset=utf-8', 'Text/Plain', 'application/json', 'image/png'), cast(event_id % 4 + 1 as int))")
    return table(spark, sf_dir, "events").select("event_id", X.http_outcome(status, kind).alias("page_error"), X.search_outcome(status, kind).alias("search_error"))


@query("F13_failure_class", """select event_id, case event_id % 5 when 0 then 'UPSTREAM_BLOCKED' when 1 then 'TIMEOUT' when 2 then 'UPSTREAM_BLOCKED' when 3 then 'UPSTREAM_UNAVAILABLE' else 'TIMEOUT' end as code from events""")
def failure_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = F.expr("element_at(array('CAPTCHA required', 'request timeout', 'HTTP 429 after timeout', 'parsing error', 'Timed-out'), cast(event_id % 5 + 1 as int))")
    return table(spark, sf_dir, "events").select("event_id", X.failure_code(reason).alias("code"))


_LINES = "(select doc_id, i, string_split(text, chr(10))[i] as line from documents, lateral (select unnest(range(1, len(string_split(text, chr(10))) + 1)) as i) x)"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "line")).withColumn("i", (F.col("i") + 1).cast("long"))


@query("F15_heading", f"""select doc_id, i::bigint as i, length(t) between 1 and 100 and not regexp_matches(t, '[.!?。！？;；:]$') as heading from (select doc_id, i, {_trim("line")} as t from {_LINES} y)""")
def heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select("doc_id", "i", X.is_heading(F.col("line")).alias("heading"))


@query("F16_context_qualifier", f"""select doc_id, i::bigint as i, regexp_matches(t, '(?i)^(?:{"|".join(X.OPENERS)})(?:[^0-9A-Za-z_]|$)|(?:^|[^0-9A-Za-z_])(?:{"|".join(X.MODALS)})(?:[^0-9A-Za-z_]|$)') or regexp_matches(t, '^(?:{"|".join(X.OPENERS_ZH)})|{"|".join(X.MODALS_ZH)}') as qualifies
from (select doc_id, i, {_trim("line")} as t from {_LINES} y)""")
def context_qualifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select("doc_id", "i", X.qualifies_context(F.col("line")).alias("qualifies"))


@query("X01_nfkc_lower")
def nfkc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(X.nfkc_lower("text"), 256).alias("sha"))


@query("X02_word_tokens", f"select doc_id, len(t)::bigint as n_tokens, len(list_distinct(t))::bigint as n_distinct, t[1] as first_token from (select doc_id, regexp_extract_all(lower(text), '{TOK}') as t from documents)")
def word_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "documents").select("doc_id", X.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"), F.get("t", F.lit(0)).alias("first_token"))


@query("X03_sentences", rf"""select doc_id, len(s)::bigint as n_sentences, list_sum(list_transform(s, lambda x: length(x)))::bigint as n_chars
from (select doc_id, list_filter(regexp_extract_all(regexp_replace(text, '[\r\n]', ' ', 'g'), '[^.!?。！？]*(?:[.!?]+["'')\]]*(?:[{WS}]+|$)|[。！？]+[{WS}]*|[.!?]+|$)'), lambda x: x <> '') as s from documents)""")
def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "documents").select("doc_id", X.sentences(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("n_chars"))


@query("X04_code_points", "select doc_id, length(text)::bigint as n_chars, substring(text, 11, 40) as part, (strpos(text, 'e') - 1)::bigint as first_e from documents")
def code_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.length("text").cast("long").alias("n_chars"), F.substring("text", 11, 40).alias("part"), (F.locate("e", "text") - 1).cast("long").alias("first_e"))


@query("X06_clean_layout", rf"""select doc_id, sha256({_trim(r"regexp_replace(regexp_replace(t, '[\t ]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g')")}) as sha from (select doc_id, replace(text, chr(10), '  ' || chr(9) || chr(10) || chr(10) || chr(10)) as t from documents)""")
def clean_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.replace(F.col("text"), F.lit("\n"), F.lit("  \t\n\n\n"))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(X.clean_layout(t), 256).alias("sha"))


@query("X07_display_text", rf"""select page_id, case when t <> '' then substring(t, 1, 300) end as display from (select page_id, {_trim(rf"regexp_replace(regexp_replace(regexp_replace(html, '<[^>]*>', '', 'g'), '[\x00-\x1F\x7F]', ' ', 'g'), '[{WS}]+', ' ', 'g')")} as t from pages)""")
def display_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", X.display_text(F.col("html"), 300).alias("display"))


@query("X08_strict_date", """select event_id, case event_id % 6 when 0 then ts::date::timestamp when 1 then date_trunc('second', ts) when 2 then date_trunc('second', ts) - interval 2 hour end as at from events""")
def strict_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.expr("""case event_id % 6 when 0 then date_format(ts, 'yyyy-MM-dd') when 1 then concat(date_format(ts, 'yyyy-MM-dd\\'T\\'HH:mm:ss'), 'Z') when 2 then concat(date_format(ts, 'yyyy-MM-dd\\'T\\'HH:mm:ss'), '+02:00')
      when 3 then concat(year(ts), '-02-30') when 4 then date_format(ts, 'MMM d, yyyy') else concat(date_format(ts, 'yyyy-MM-dd\\'T\\'HH:mm:ss'), '') end""")
    return table(spark, sf_dir, "events").select("event_id", X.strict_date(raw).cast("timestamp_ntz").alias("at"))


@query("X09_sha256", "select doc_id, sha256(text) as content_sha256, 'source_' || sha256(source) as source_id from documents")
def sha256(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("content_sha256"), F.concat(F.lit("source_"), F.sha2("source", 256)).alias("source_id"))


@query("X10_fingerprint", """select item_id, sha256('{"version":"lakesearch-1","query":' || to_json(text) || ',"ranking":"bm25","evidence":"paragraph_context_v2"}') as fingerprint from benchmark""")
def fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = F.struct(F.lit("lakesearch-1").alias("version"), F.col("text").alias("query"), F.lit("bm25").alias("ranking"), F.lit("paragraph_context_v2").alias("evidence"))
    return table(spark, sf_dir, "benchmark").select("item_id", F.sha2(F.to_json(spec), 256).alias("fingerprint"))


@query("X15_markdown_escape", r"""select doc_id, sha256(regexp_replace(text, '([\\`*_{}\[\]()<>#+.!|~-])', '\\\1', 'g')) as sha from documents""")
def markdown_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(X.markdown_escape(F.col("text")), 256).alias("sha"))


@query("X17_json", "select event_id, (props->>'k')::bigint as k, json_valid(props) as valid, '{\"event\":' || event_id || ',\"type\":\"' || event_type || '\"}' as encoded from events")
def json_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.try_parse_json("props").isNotNull().alias("valid"), F.to_json(F.struct(F.col("event_id").alias("event"), F.col("event_type").alias("type"))).alias("encoded"))


@query("X18_math", "select event_id, round(ln(1 + abs(value)), 9) as ln_v, round(log2(2 + abs(value)), 9) as log2_v, round(pow(2, event_id % 5) - 1, 9) as gain, ceil(value)::bigint as up, greatest(value, 0) as pos from events")
def math(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return table(spark, sf_dir, "events").select("event_id", F.round(F.log(1 + F.abs(v)), 9).alias("ln_v"), F.round(F.log2(2 + F.abs(v)), 9).alias("log2_v"), F.round(F.pow(F.lit(2.0), F.col("event_id") % 5) - 1, 9).alias("gain"), F.ceil(v).cast("long").alias("up"), F.greatest(v, F.lit(0.0)).alias("pos"))


@query("X19_backoff", "select event_id, least(1800000, (case when event_id % 3 = 0 then 300000 else 30000 end) * pow(2, least(10, event_id % 13)))::bigint as rest_ms from events")
def backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.when(F.col("event_id") % 3 == 0, "UPSTREAM_BLOCKED").otherwise("TIMEOUT")
    return table(spark, sf_dir, "events").select("event_id", X.backoff_ms(F.col("event_id") % 13 + 1, code, F.lit(False)).alias("rest_ms"))


@query("X24_retry_after", "select event_id, (case event_id % 4 when 0 then 1000.0 when 1 then (event_id % 50) * 1000.0 when 2 then 5000.0 end)::double as wait_ms from events where event_id % 4 <> 1 or event_id % 50 > 0 union all select event_id, null from events where event_id % 4 = 1 and event_id % 50 = 0")
def retry_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.date_trunc("second", F.col("ts"))
    value = F.when(F.col("event_id") % 4 == 0, F.lit(None)).when(F.col("event_id") % 4 == 1, (F.col("event_id") % 50).cast("string")).when(F.col("event_id") % 4 == 2, F.date_format(at + F.expr("interval 5 seconds"), "EEE, dd MMM yyyy HH:mm:ss 'GMT'")).otherwise(F.lit("soon"))
    return table(spark, sf_dir, "events").select("event_id", X.retry_after_ms(value, F.unix_millis(at.cast("timestamp"))).alias("wait_ms"))


@query("S05_fetch_route", rf"""select page_id, case when length(regexp_replace(regexp_replace(html, '<[^>]*>', '', 'g'), '[{WS}]', '', 'g')) < 80 then 'rendered' else 'static' end as backend
from (select page_id, substring(html, 1, case when page_id % 3 = 0 then 250 else 100000000 end) as html from pages)""")
def fetch_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.expr("substring(html, 1, case when page_id % 3 = 0 then 250 else 100000000 end)")
    text = F.regexp_replace(html, "<[^>]*>", "")
    return table(spark, sf_dir, "pages").select("page_id", F.when(X.needs_rendering(F.lit("text/html"), text), "rendered").otherwise("static").alias("backend"))


@query("S07_plain_text", rf"""select doc_id, case when t <> '' and not regexp_matches(t, '(?i)^(?:<!doctype[{WS}]+html|<html)') then sha256(t) end as sha
from (select doc_id, {_trim("case doc_id % 9 when 0 then '  <!DOCTYPE  html>' || text when 1 then '<HTML>' when 2 then '  ' else ' ' || text || chr(10) end")} as t from documents)""")
def plain_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.expr("case doc_id % 9 when 0 then concat('  <!DOCTYPE  html>', text) when 1 then '<HTML>' when 2 then '  ' else concat(' ', text, '\\n') end")
    decoded = F.decode(F.encode(body, "UTF-8"), "UTF-8")
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(X.plain_text(decoded), 256).alias("sha"))


@query("A05_lexical_coverage", f"""with q as (select item_id, list_distinct(regexp_extract_all(lower(text), '{TOK}')) as q from benchmark), d as (select conv_id, turn, list_distinct(regexp_extract_all(lower(text), '{TOK}')) as t from conversations)
select conv_id, turn, item_id, case when len(q) > 0 and len(t) > 0 then round(len(list_intersect(q, t)) / len(q), 9) end as score from d join q on item_id = conv_id % (select count(*) from benchmark)""")
def lexical_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, c = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "conversations")
    n = b.agg(F.count("*").alias("n"))
    both = c.join(F.broadcast(n)).join(b.withColumnRenamed("text", "q"), F.col("conv_id") % F.col("n") == F.col("item_id"))
    return both.select("conv_id", "turn", "item_id", F.round(X.coverage(F.col("q"), F.col("text"))["score"], 9).alias("score"))

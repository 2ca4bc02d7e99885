"""Text predicates and transformations as Column expressions.

JavaScript and Java disagree on what `\\s` and `\\b` are, so white space is the
explicit class `WS` and word borders are ASCII, spelled out.  Lengths and offsets
count code points.  Tokens follow the profile `portable_v1`: lower case, runs of
letters and digits of any script, each Han character by itself, as there is no
dictionary to find words among them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: White space as ECMAScript has it.
WS = r"\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
TOKEN = r"\p{IsHan}|[\p{L}\p{N}&&[^\p{IsHan}]]+"
TOKENIZER = "portable_v1"

#: Openers that make a paragraph a condition, a negation or a reference back, and words that do so anywhere.
OPENERS = "if unless except however but for when provided otherwise only this these those it they such server servers client clients".split()
MODALS = "not never must should may".split()
OPENERS_ZH = ("如果", "除非", "但是", "然而", "这些", "该", "此", "注意", "例如", "为了")
MODALS_ZH = ("不能", "不得", "不应", "必须", "应当")

#: What marks an access challenge.
CHALLENGE_TITLE = r"(?i)<title[^>]*>\s*(?:just a moment|attention required|access denied|verify (?:you|your)|captcha)"
CHALLENGE_MARK = r"(?i)cf-chl-|challenge-platform|id=[\"']captcha"


def trim_ws(text: Column) -> Column:
    return F.regexp_replace(text, rf"^[{WS}]+|[{WS}]+\z", "")


def content_query(query: Column) -> Column:
    """The query without its site: and -site: operators, quoted arguments included."""
    operator = rf"(?i)(^|[{WS}])-?site:(?:\"[^\"]*\"|'[^']*'|[^{WS}]+)"
    return trim_ws(F.regexp_replace(query, operator, "$1"))


def query_error(query: Column) -> Column:
    """Why a query is refused: null if it is not."""
    parts = F.split(query, rf"[{WS}\x1C-\x1F\x85]+")
    directive = F.exists(parts, lambda p: p.rlike(r"^[!:]") | p.rlike(r"^<\p{N}"))
    return F.when((trim_ws(query) == "") | (F.length(query) > 4000), "length").when(directive, "directive")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def coverage(query: Column, text: Column) -> Column:
    """Struct of score, method and matched terms: null score if either side has no term, 0 if nothing matches."""
    q, t = F.array_distinct(tokens(content_query(query))), F.array_distinct(tokens(text))
    matched = F.array_intersect(q, t)
    none = (F.size(q) == 0) | (F.size(t) == 0)
    reason = F.when(F.size(q) == 0, "no_query_terms").when(F.size(t) == 0, "no_evaluable_text")
    return F.struct(
        F.when(~none, F.size(matched) / F.size(q)).alias("score"), F.when(none, "none").otherwise("lexical_coverage_v1").alias("method"),
        F.when(none, F.array().cast("array<string>")).otherwise(matched).alias("matched_terms"), reason.alias("reason"),
    )


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays without repeats; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def is_heading(text: Column) -> Column:
    trimmed = trim_ws(text)
    return F.length(trimmed).between(1, 100) & ~trimmed.rlike(r"[.!?。！？;；:]\z")


def qualifies_context(text: Column) -> Column:
    """Whether a paragraph conditions, negates or refers back, in English or Chinese."""
    openers, modals = "|".join(OPENERS), "|".join(MODALS)
    low = trim_ws(text)
    english = rf"(?i)^(?:{openers})(?:[^0-9A-Za-z_]|\z)|(?:^|[^0-9A-Za-z_])(?:{modals})(?:[^0-9A-Za-z_]|\z)"
    chinese = "^(?:" + "|".join(OPENERS_ZH) + ")|" + "|".join(MODALS_ZH)
    return low.rlike(english) | low.rlike(chinese)


def clean_layout(text: Column) -> Column:
    """No blanks at line ends, no more than one empty line, trimmed."""
    return trim_ws(F.regexp_replace(F.regexp_replace(text, r"[\t ]+\n", "\n"), r"\n{3,}", "\n\n"))


def display_text(text: Column, limit: int) -> Column:
    """Tags and control characters out, white space collapsed, at most `limit` code points; empty becomes null."""
    plain = F.regexp_replace(F.regexp_replace(text, r"<[^>]*>", ""), r"[\x00-\x1F\x7F]", " ")
    one = trim_ws(F.regexp_replace(plain, rf"[{WS}]+", " "))
    return F.when(one != "", F.substring(one, 1, limit))


def markdown_escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\`*_{}\[\]()<>#+.!|~-])", r"\\$1")


def plain_text(body: Column) -> Column:
    """A plain text body, trimmed; null if it is empty or looks like HTML."""
    text = trim_ws(body)
    return F.when((text != "") & ~text.rlike(rf"(?i)^[{WS}]*(?:<!doctype[{WS}]+html|<html)"), text)


def is_challenge(html: Column) -> Column:
    """Whether the first 30000 characters hold the marks of an access challenge."""
    sample = F.substring(html, 1, 30000)
    return sample.rlike(CHALLENGE_TITLE) | sample.rlike(CHALLENGE_MARK)


def needs_rendering(content_type: Column, text: Column) -> Column:
    """Whether an HTML page has fewer than 80 characters that are not white space."""
    return content_type.isin("text/html", "application/xhtml+xml") & (F.length(F.regexp_replace(text, rf"[{WS}]", "")) < 80)


def strict_date(text: Column) -> Column:
    """A date or an offset date-time as UTC timestamp; null for anything vague or impossible."""
    shape = text.rlike(r"^\d{4}-\d{2}-\d{2}(?:\z|T\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?:Z|[+-]\d{2}:\d{2})\z)")
    day = F.call_function("try_to_date", F.substring(text, 1, 10), F.lit("yyyy-MM-dd"))
    full = F.when(F.length(text) == 10, F.concat(text, F.lit("T00:00:00Z"))).otherwise(text)
    return F.when(shape & day.isNotNull(), F.try_to_timestamp(full))


def retry_after_ms(value: Column, now_ms: Column) -> Column:
    """Milliseconds a Retry-After header asks for, from seconds or a date; 1000 without one; null if neither."""
    number = value.try_cast("double")
    when = F.unix_millis(F.try_to_timestamp(F.regexp_extract(value, r"^\w{3}, (.*) GMT\z", 1), F.lit("dd MMM yyyy HH:mm:ss")))
    wait = F.when(value.isNull() | (value == ""), 1000.0).when(number.isNotNull(), number * 1000).otherwise((when - now_ms).cast("double"))
    return F.when(wait > 0, wait)


def http_outcome(status: Column, content_type: Column) -> Column:
    """Error code of a page response, null if it may be parsed."""
    kind = F.lower(trim_ws(F.split_part(content_type, F.lit(";"), F.lit(1))))
    return (
        F.when(status == 429, "RATE_LIMITED").when(status == 403, "UPSTREAM_BLOCKED").when((status < 200) | (status >= 300), "HTTP_ERROR")
        .when(~kind.isin("text/html", "application/xhtml+xml", "text/plain", "text/markdown"), "UNSUPPORTED_CONTENT_TYPE")
    )


def search_outcome(status: Column, content_type: Column) -> Column:
    """Error code of a search endpoint's response, null if it may be parsed."""
    json = F.lower(content_type).rlike(r"(?:^|[^0-9a-z_])application/(?:[a-z0-9.+-]+\+)?json(?:[^0-9a-z_]|\z)")
    return F.when(status.isin(403, 429), "UPSTREAM_BLOCKED").when((status < 200) | (status >= 300), "UPSTREAM_UNAVAILABLE").when(~F.coalesce(json, F.lit(False)), "UPSTREAM_BLOCKED")


def failure_code(reason: Column) -> Column:
    """The class of an upstream failure message."""
    blocked = r"(?i)captcha|blocked|forbidden|access.denied|too.many.requests|429"
    return F.when(reason.rlike(blocked), "UPSTREAM_BLOCKED").when(reason.rlike(r"(?i)timeout|timed.out"), "TIMEOUT").otherwise("UPSTREAM_UNAVAILABLE")


def backoff_ms(consecutive: Column, code: Column, suspended: Column) -> Column:
    """How long a failing source rests: doubling from 300 s if blocked or suspended, else from 30 s, at most half an hour."""
    base = F.when((code == "UPSTREAM_BLOCKED") | F.coalesce(suspended, F.lit(False)), 300_000.0).otherwise(30_000.0)
    return F.least(F.lit(1_800_000.0), base * F.pow(F.lit(2.0), F.least(F.lit(10), consecutive - 1))).cast("long")


@F.pandas_udf(StringType())
def nfkc_lower(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """NFKC, then lower case: Spark has no function for the first."""
    for part in parts:
        yield part.str.normalize("NFKC").str.lower()


def nfkc_tokens(text: Column) -> Column:
    """Tokens of the profile nfkc_v1."""
    return F.regexp_extract_all(nfkc_lower(text), F.lit(TOKEN), F.lit(0))


def sentences(text: Column) -> Column:
    """Sentences with what follows them up to the next, line breaks read as spaces; together they are the text."""
    return F.filter(F.regexp_extract_all(F.regexp_replace(text, r"[\r\n]", " "), F.lit(r"[^.!?。！？]*(?:[.!?]+[\"')\]]*(?:[" + WS + r"]+|\z)|[。！？]+[" + WS + r"]*|[.!?]+|\z)"), F.lit(0)), lambda s: s != "")

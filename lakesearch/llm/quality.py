"""Line-first cleaning: rules judge each line, failing lines go, and a document that loses too much goes.

A line without a word is kept and weighs nothing.  A line with a word fails if

* symbols: more than `max_symbols` of `#*$%&|<>` for each word;
* navigation: at least `nav_bars` words that are bars or bullets alone, and one such for each `nav_every` words or fewer;
* shouting: `min_letters` ASCII letters or more, over `max_upper` of them upper case;
* repetition: at least `min_repeat` words, fewer than `min_distinct` of them distinct, or over `max_stutter` of
  them equal to the word before;
* boilerplate: it has one of `BOILERPLATE` and at most `boiler_words` words;
* punctuation: from 2 to `bare_words` words, none of them with closing punctuation at the line's end,
  in a run of at least `bare_run` such lines (lists of links; a lone heading stays).

A document is rejected if the base rules fail (under 10 words; over 20 % of its
words in five-word windows that occur twice) or if failing lines hold over
`max_lost` of its words.  Null text counts as empty, is rejected for want of
words and cleans to null.  Repeated rows are judged alike; other columns pass through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

#: Phrases of site furniture, in lower case.
BOILERPLATE = (
    "all rights reserved", "privacy policy", "cookie policy", "terms of use", "terms of service", "terms and conditions",
    "accept cookies", "use cookies", "uses cookies", "enable javascript", "javascript is disabled", "lorem ipsum",
    "sign up for", "subscribe to our", "click here", "read more", "share this", "skip to content", "log in to", "powered by",
)
_BOILER = re.compile(b"|".join(re.escape(x.encode()) for x in BOILERPLATE))
_SYMBOL = C.byte_set(b"#*$%&|<>")
#: What separates or marks entries, and what closes a line.
BARS, CLOSING = "|>*-·•»", ".!?:;\"')]}»’”…。！？"
_UPPER, _LETTER = C.byte_set(bytes(range(65, 91))), C.byte_set(bytes([*range(65, 91), *range(97, 123)]))


def _marked(data: np.ndarray, chars: str) -> np.ndarray:
    """Which bytes belong to one of the characters."""
    out = C.byte_set("".join(c for c in chars if c < "\x80").encode())[data]
    for c in (c.encode() for c in chars if c >= "\x80"):
        at = np.flatnonzero(data == c[0])
        at = at[at + len(c) <= len(data)]
        for k in range(1, len(c)):
            at = at[data[at + k] == c[k]]
        for k in range(len(c)):
            out[at + k] = True
    return out


@dataclass(frozen=True)
class Rules:
    max_symbols: float = 0.3
    nav_bars: int = 2
    nav_every: int = 6
    min_letters: int = 12
    max_upper: float = 0.7
    min_repeat: int = 12
    min_distinct: float = 0.25
    max_stutter: float = 0.3
    boiler_words: int = 25
    bare_words: int = 6
    bare_run: int = 3
    max_lost: float = 0.35


FIELDS = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("word_chars", T.LongType()), T.StructField("n_symbols", T.LongType()),
    T.StructField("n_dup_lines", T.LongType()), T.StructField("n_repeat_words", T.LongType()), T.StructField("base_failed", T.BooleanType()),
    T.StructField("kept", T.BooleanType()), T.StructField("n_lines_failed", T.LongType()), T.StructField("n_words_lost", T.LongType()),
    T.StructField("clean_text", T.StringType()),
])


def judge(data: np.ndarray, bounds: np.ndarray, rules: Rules, with_text: bool) -> dict[str, np.ndarray | list]:
    """All figures of a chunk of texts, and the passing lines of those where a line fails."""
    inside = ~C.SPACE[data]
    starts, ends, first = C.word_spans(data, bounds, inside)
    words = C.span_hashes(data, starts, ends)
    n_words = np.diff(first)
    symbols = _SYMBOL[data]

    # words in five-word windows that the row has twice or more
    grams, at = C.gram_hashes(words, first, 5)
    row_of_word = np.repeat(np.arange(len(n_words)), n_words)
    key = C.mix(grams + row_of_word[at].astype(C.U) * C.U(C.BASE))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, at[twice], 1)
    np.add.at(cover, at[twice] + 5, -1)
    n_repeat = C.per_row(np.cumsum(cover[:-1]) > 0, first)

    # lines: each row has one more than it has line feeds
    feeds = np.flatnonzero(data == 10)
    line_at = np.sort(np.concatenate([bounds[:-1], feeds + 1]), kind="stable")
    line_end = np.sort(np.concatenate([feeds, bounds[1:]]), kind="stable")
    n_lines = C.per_row(data == 10, bounds) + 1
    row = np.repeat(np.arange(len(n_lines)), n_lines)
    span = np.concatenate([[0], np.cumsum(n_lines)])

    def of_line(flags: np.ndarray) -> np.ndarray:
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[line_end] - total[line_at]

    lo, hi = np.searchsorted(starts, line_at), np.searchsorted(starts, line_end)
    w = hi - lo
    content = C.span_hashes(data, line_at, line_end)
    key = np.where(w > 0, C.mix(content + row.astype(C.U) * C.U(C.BASE)), C.U(0))
    has = np.flatnonzero(w > 0)
    _, once = np.unique(key[has], return_index=True)
    distinct = np.zeros(len(w), bool)
    distinct[has[once]] = True
    n_dup = C.per_row((w > 0) & ~distinct, span)

    # the rules
    n_symbols = of_line(symbols)
    fail = n_symbols > rules.max_symbols * w
    bad = np.zeros(len(data) + 1, np.int64)
    np.cumsum(inside & ~_marked(data, BARS), out=bad[1:])
    bars = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(bad[ends] == bad[starts], out=bars[1:])
    n_bars = bars[hi] - bars[lo]
    fail |= (n_bars >= rules.nav_bars) & (n_bars * rules.nav_every >= w)
    letters = of_line(_LETTER[data])
    fail |= (letters >= rules.min_letters) & (of_line(_UPPER[data]) > rules.max_upper * letters)
    line_of_word = np.repeat(np.arange(len(w)), w)
    own = C.mix(words + line_of_word.astype(C.U) * C.U(C.BASE))
    _, once = np.unique(own, return_index=True)
    fresh = np.zeros(len(words) + 1, np.int64)
    flags = np.zeros(len(words), bool)
    flags[once] = True
    np.cumsum(flags, out=fresh[1:])
    fail |= (w >= rules.min_repeat) & (fresh[hi] - fresh[lo] < rules.min_distinct * w)
    stutter = np.zeros(len(words) + 1, np.int64)
    if len(words):
        np.cumsum((words[1:] == words[:-1]) & (line_of_word[1:] == line_of_word[:-1]), out=stutter[2:])
    fail |= (w >= rules.min_repeat) & (stutter[hi] - stutter[np.minimum(lo, len(words))] > rules.max_stutter * w)
    hits = np.fromiter((m.start() for m in _BOILER.finditer(C.LOWER[data].tobytes())), np.int64)
    boiler = np.zeros(len(w), bool)
    if len(hits):
        boiler[np.searchsorted(line_at, hits, "right") - 1] = True
    fail |= boiler & (w <= rules.boiler_words)
    closed = np.zeros(len(w), bool)
    closed[has] = _marked(data, CLOSING)[ends[hi[has] - 1] - 1]
    bare = (w >= 2) & (w <= rules.bare_words) & ~closed
    new_run = np.concatenate([[True], (bare[1:] != bare[:-1]) | (row[1:] != row[:-1])]) if len(w) else np.empty(0, bool)
    run = np.cumsum(new_run) - 1
    fail |= bare & (np.bincount(run, minlength=1)[run] >= rules.bare_run)
    fail &= w > 0

    lost = np.zeros(len(w) + 1, np.int64)
    np.cumsum(np.where(fail, w, 0), out=lost[1:])
    n_lost = lost[span[1:]] - lost[span[:-1]]
    base_failed = (n_words < 10) | (100 * n_repeat > 20 * n_words)
    out = {
        "n_words": n_words, "word_chars": C.per_row(inside & (data & 0xC0 != 0x80), bounds), "n_symbols": C.per_row(symbols, bounds),
        "n_dup_lines": n_dup, "n_repeat_words": n_repeat, "base_failed": base_failed, "kept": ~base_failed & (n_lost <= rules.max_lost * n_words),
        "n_lines_failed": C.per_row(fail, span), "n_words_lost": n_lost,
    }
    if with_text:
        raw = data.tobytes()
        texts: list[str | None] = [None] * len(n_lines)
        for i in np.flatnonzero(out["n_lines_failed"]):
            a, b = span[i], span[i + 1]
            texts[i] = b"\n".join(raw[line_at[j] : line_end[j]] for j in range(a, b) if not fail[j]).decode("utf-8", "replace")
        out["clean_text"] = texts
    return out


def quality(docs: DataFrame, text: str = "text", rules: Rules = Rules(), with_text: bool = True) -> DataFrame:
    """`docs` with one struct column `quality`: the counts, the verdicts and `clean_text`, the passing lines.

    One pass over the rows, no shuffle.  Only the text goes to Python, and a text comes back only where
    lines have failed.  `with_text=False` leaves `clean_text` out.  A column of `docs` that is named
    `quality` itself gives way.
    """
    C.small_batches(docs.sparkSession)
    docs = docs.drop("quality")
    fields = [f for f in FIELDS if with_text or f.name != "clean_text"]
    arrow = [pa.field(f.name, {"long": pa.int64(), "bigint": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}[f.dataType.simpleString()]) for f in fields]

    def judged(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            parts = [pa.array([], pa.struct(arrow))]
            for _, data, bounds in C.chunks([pa.RecordBatch.from_arrays([column], names=["t"])], "t"):
                got = judge(data, bounds, rules, with_text)
                parts.append(pa.StructArray.from_arrays([pa.array(got[f.name], f.type) for f in arrow], fields=arrow))
            yield pa.concat_arrays(parts)

    # not to be moved or repeated by the optimiser: one evaluation a row, whatever is selected from it
    found = docs.withColumn("quality", F.arrow_udf(judged, T.StructType(fields)).asNondeterministic()(F.col(text)))
    if not with_text:
        return found
    clean = F.when(F.col("quality.n_lines_failed") > 0, F.col("quality.clean_text")).otherwise(F.col(text))
    return found.withColumn("quality", F.col("quality").withField("clean_text", clean))


def keep_clean(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The kept documents, their failing lines removed, in the columns of `docs`; n_chars follows the text if it is there."""
    done = quality(docs.select(C.packed(docs), "text"), rules=rules).where("quality.kept")
    again = {"text": F.col("quality.clean_text"), "n_chars": F.length("quality.clean_text").cast("long")}
    return done.select(*(again[c].alias(c) if c in again else F.col("_row")[c].alias(c) for c in docs.columns))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(C.documents(spark, sf_dir).select("doc_id", "text"), with_text=False).select("doc_id", "quality.*")


def oracle_sql(rules: Rules = Rules()) -> str:
    boiler = "|".join(BOILERPLATE)
    gram = " || ' ' || ".join(f"w[i + {k}]" for k in range(5))
    word, closing = r"[^\x20\x09-\x0D]+", "".join("\\" + c if c in "]" else c for c in CLOSING.replace("'", "''"))
    return f"""
with d as materialized (select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '{word}') as w from documents),
g as (select doc_id, i, {gram} as g from d, lateral (select unnest(range(1, len(w) - 3)) as i) x),
rep as (select doc_id, count(distinct i + k) as n from (select doc_id, i, count(*) over (partition by doc_id, g) as m from g) y, range(5) z(k) where m > 1 group by doc_id),
l as materialized (select doc_id, j, s[j] as line, regexp_extract_all(s[j], '{word}') as w from (select doc_id, string_split(t, chr(10)) as s from d) e, lateral (select unnest(range(1, len(s) + 1)) as j) x),
f as (select doc_id, j, line, len(w) as n, len(regexp_extract_all(line, '[#*$%&|<>]')) as symbols, len(list_filter(w, lambda x: regexp_matches(x, '^[|>*·•»-]+$'))) as bars, len(regexp_extract_all(line, '[A-Za-z]')) as letters, len(regexp_extract_all(line, '[A-Z]')) as uppers,
  len(list_distinct(list_transform(w, lambda x: x))) as fresh, len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) as stutter,
  regexp_matches(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{boiler}') as boiler, len(w) between 2 and {rules.bare_words} and not regexp_matches(w[-1], '[{closing}]$') as bare from l),
r as (select *, sum(case when bare then 0 else 1 end) over (partition by doc_id order by j rows unbounded preceding) as island from f),
b as (select *, case when bare then count(*) filter (bare) over (partition by doc_id, island) else 0 end as run from r),
v as (select *, n > 0 and (symbols > {rules.max_symbols} * n or (bars >= {rules.nav_bars} and bars * {rules.nav_every} >= n) or (letters >= {rules.min_letters} and uppers > {rules.max_upper} * letters)
  or (n >= {rules.min_repeat} and (fresh < {rules.min_distinct} * n or stutter > {rules.max_stutter} * n)) or (boiler and n <= {rules.boiler_words}) or run >= {rules.bare_run}) as fails from b),
a as (select doc_id, sum(symbols) as n_symbols, count(*) filter (n > 0) - count(distinct line) filter (n > 0) as n_dup, count(*) filter (fails) as n_failed, coalesce(sum(n) filter (fails), 0) as lost from v group by doc_id),
x as (select d.doc_id, len(w) as n_words, coalesce(list_sum(list_transform(w, lambda y: length(y))), 0) as word_chars, n_symbols, n_dup, coalesce(rep.n, 0) as n_repeat, n_failed, lost from d join a using (doc_id) left join rep using (doc_id))
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols, n_dup::bigint as n_dup_lines, n_repeat::bigint as n_repeat_words, n_words < 10 or 100 * n_repeat > 20 * n_words as base_failed,
  not (n_words < 10 or 100 * n_repeat > 20 * n_words) and lost <= {rules.max_lost} * n_words as kept, n_failed::bigint as n_lines_failed, lost::bigint as n_words_lost from x"""

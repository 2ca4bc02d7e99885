"""Paragraph segments with exact offsets, snapshots, pages of code points, integrity checks.

Offsets count code points and are half open.  A segment is a paragraph with the line
feeds that end it, so a text's segments, put together, are the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A run of lines up to two or more line feeds or the end; free of look-ahead, so that RE2 reads it alike.
PARAGRAPH = r"[^\n]*(?:\n[^\n]+)*(?:\n+|\z)"


def paragraphs(text: Column) -> Column:
    return F.filter(F.regexp_extract_all(text, F.lit(PARAGRAPH), F.lit(0)), lambda s: s != "")


def with_offsets(parts: Column) -> Column:
    """Structs (id, text, start_char, end_char) of consecutive parts: a running sum inside the array, no shuffle."""
    zero = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<id:string,text:string,start_char:int,end_char:int>>").alias("out"))

    def step(acc: Column, part: Column) -> Column:
        end = acc["end"] + F.length(part)
        row = F.struct(F.concat(F.lit("segment_"), F.size(acc["out"]) + 1).alias("id"), part.alias("text"), acc["end"].alias("start_char"), end.alias("end_char"))
        return F.struct(end.alias("end"), F.array_append(acc["out"], row).alias("out"))

    return F.aggregate(parts, zero, step)["out"]


def segments(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per segment: key, n (from 1), text, start_char, end_char.

    Offsets come from the lengths of the parts before, by position, so a document of
    many segments costs no quadratic array building.
    """
    parts = docs.select(key, paragraphs(F.col(text)).alias("_parts"))
    lengths = F.transform("_parts", lambda s: F.length(s))
    rows = parts.select(key, F.posexplode(F.arrays_zip(F.col("_parts").alias("text"), lengths.alias("len"))).alias("n", "part"))
    w = Window.partitionBy(key).orderBy("n")
    end = F.sum("part.len").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.select(key, (F.col("n") + 1).cast("long").alias("n"), F.col("part.text").alias("text"), (end - F.col("part.len")).alias("start_char"), end.alias("end_char"))


def snapshot(docs: DataFrame, extractor: str = "plain-1", key: str = "doc_id", text: str = "text", url: str = "url") -> DataFrame:
    """Immutable snapshots: source id from the URL, content hash, segments; the snapshot id is of URL, content and format."""
    content = F.col(text)
    sha = F.sha2(content, 256)
    return docs.select(
        key, F.concat(F.lit("source_"), F.sha2(url, 256)).alias("source_id"), F.concat(F.lit("snapshot_"), F.sha2(F.concat_ws("|", url, sha), 256), F.lit("_text")).alias("snapshot_id"),
        F.col(url).alias("url"), F.lit("text").alias("format"), content.alias("content"), sha.alias("content_sha256"), F.lit(extractor).alias("extractor_version"), with_offsets(paragraphs(content)).alias("segments"),
    )


def integrity_violations(snapshots: DataFrame) -> DataFrame:
    """snapshot_id and rule for each rule a stored snapshot breaks, everything derived anew."""
    rules = {
        "hash": F.sha2("content", 256) != F.col("content_sha256"), "source_id": F.concat(F.lit("source_"), F.sha2("url", 256)) != F.col("source_id"),
        "segments": F.col("segments") != with_offsets(paragraphs(F.col("content"))), "id": ~F.col("snapshot_id").rlike(r"^snapshot_[0-9a-f-]+_(?:text|markdown)\z") | ~F.col("snapshot_id").endswith(F.col("format")),
    }
    broken = F.array_compact(F.array(*(F.when(F.coalesce(cond, F.lit(True)), F.lit(name)) for name, cond in rules.items())))
    return snapshots.select("snapshot_id", F.explode(broken).alias("rule"))


def pages(docs: DataFrame, size: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A text's pages of `size` code points: key, page, content, next_offset (null on the last)."""
    n = F.length(text)
    page = F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(n / size) - 1, F.lit(0)).cast("int")))
    rows = docs.select(key, text, n.alias("_n"), page.alias("page"))
    after = (F.col("page") + 1) * size
    return rows.select(key, F.col("page").cast("long").alias("page"), F.substring(F.col(text), F.col("page") * size + 1, F.lit(size)).alias("content"), F.when(after < F.col("_n"), after.cast("long")).alias("next_offset"))


def overlapping(intervals: DataFrame, parts: DataFrame, key: str = "doc_id") -> DataFrame:
    """Intervals (key, start, end) with the parts (key, n, start_char, end_char) they touch: an equi-join on the key first."""
    return intervals.join(parts, key).where((F.col("start_char") < F.col("end")) & (F.col("end_char") > F.col("start")))

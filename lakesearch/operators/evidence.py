"""Evidence entries, their exactness, and their pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def prepare(passages: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Passages (id, priority, start_char, end_char, quote) as evidence of their snapshots (id, snapshot_id, content_sha256, segments, url)."""
    both = passages.join(snapshots, "id")
    touched = F.filter("segments", lambda s: (s["end_char"] > F.col("start_char")) & (s["start_char"] < F.col("end_char")))
    return both.withColumn("segment_ids", F.transform(touched, lambda s: s["id"])).withColumn("evidence_id", F.concat_ws(":", "snapshot_id", F.col("start_char").cast("string"), F.col("end_char").cast("string")))


def is_exact(content: Column, content_sha256: Column, start: Column, end: Column, quote: Column) -> Column:
    """Whether the quote is what the snapshot has at its offsets, and the snapshot is what was hashed."""
    inside = (start >= 0) & (end > start) & (end <= F.length(content))
    return inside & (F.substring(content, start + 1, end - start) == quote) & (F.sha2(content, 256) == content_sha256)


def first_page(evidence: DataFrame, per_page: int, max_chars: int, keys: list[str]) -> DataFrame:
    """`evidence` of the first page: the longest prefix by priority that fits, two characters between entries; in page order."""
    w = Window.partitionBy(*keys).orderBy("priority").rowsBetween(Window.unboundedPreceding, 0)
    size = F.length("quote")
    used = F.sum(size + 2).over(w) - 2
    rows = evidence.withColumn("used", used).withColumn("fits", (F.col("used") <= max_chars) & (F.row_number().over(Window.partitionBy(*keys).orderBy("priority")) <= per_page))
    stays = F.min(F.col("fits").cast("int")).over(w) == 1  # nothing after the first that does not fit
    page = rows.withColumn("stays", stays).where("stays")
    shown = F.row_number().over(Window.partitionBy(*keys).orderBy("start_char")).cast("long")
    return page.withColumn("shown", shown).drop("fits", "stays")


def status_columns(requested: Column, in_budget: Column, verified: Column, matched: Column, blocked_by_scope: Column, warned: Column) -> dict[str, Column]:
    """evidence_status and confidence of a result row."""
    status = (
        F.when(~requested, "not_requested").when(~in_budget, "skipped_budget").when(verified & matched, "verified").when(verified, "no_match")
        .when(blocked_by_scope, "out_of_scope").otherwise("unavailable")
    )
    level = F.when(status == "verified", F.when(warned, "medium").otherwise("high")).when(status.isin("no_match", "out_of_scope", "unavailable"), "low").otherwise("unknown")
    return {"evidence_status": status, "confidence": level}

"""Execution traces: trees of timed spans, waterfalls and retention."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY_MS = 86_400_000
KEEP = 100


def retained(traces: DataFrame, now_ms: Column, age_ms: int = DAY_MS, keep: int = KEEP) -> DataFrame:
    """The newest `keep` traces (id, started_ms) of the last `age_ms`; the limit is pushed below the shuffle by rank."""
    order = Window.orderBy(F.desc("started_ms"), F.desc("id"))
    young = traces.where(F.col("started_ms") > now_ms - age_ms).orderBy(F.desc("started_ms"), F.desc("id")).limit(keep)
    return young.withColumn("rank", F.row_number().over(order).cast("long"))


def observed_end(spans: DataFrame) -> DataFrame:
    """run, started_ms and the latest known end of its spans (run, started_ms, duration_ms)."""
    return spans.groupBy("run").agg(F.min("started_ms").alias("run_started"), F.max(F.col("started_ms") + F.coalesce("duration_ms", F.lit(0))).alias("run_end"))


def waterfall(spans: DataFrame, width: float = 116.0) -> DataFrame:
    """`spans` with x and bar width on a track of `width`, clamped so that every bar can be seen."""
    both = spans.join(observed_end(spans), "run")
    total = F.col("run_end") - F.col("run_started")
    x = F.greatest(F.lit(0.0), F.least(F.lit(width - 4), (F.col("started_ms") - F.col("run_started")) / total * width))
    bar = F.when(F.col("duration_ms").isNotNull(), F.greatest(F.lit(2.0), F.least(width - x, F.col("duration_ms") / total * width))).otherwise(2.0)
    return both.withColumns({"x": F.when(total > 0, x), "bar": F.when(total > 0, bar)})


def walk(spans: list[tuple[str, str | None]]) -> list[tuple[str, int]]:
    """(span, depth) of the spans (span, parent) of one trace, children below their parents.

    What no root leads to, a span whose parent is missing or a cycle, is appended in
    the order given, its first span at depth 0; a span is shown once.
    """
    children: dict[str | None, list[str]] = {}
    for span, parent in spans:
        children.setdefault(parent, []).append(span)
    out, seen = [], set()
    for start in [*children.get(None, []), *(s for s, _ in spans)]:
        todo = [(start, 0)]
        while todo:
            span, depth = todo.pop()
            if span not in seen:
                seen.add(span)
                out.append((span, depth))
                todo += [(c, depth + 1) for c in reversed(children.get(span, []))]
    return out


def depths(spans: DataFrame, order: tuple[str, ...] = ("started_ms", "span"), most: int = 6) -> DataFrame:
    """run, span, depth (`most` at the deepest) and place in display order of spans (run, span, parent).

    A trace holds a few hundred spans by its own limit, so each is one row of a batch.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for row in part.itertuples(index=False):
                shown = walk([(s["span"], s["parent"]) for s in row.spans])
                out += [(row.run, span, min(depth, most), i + 1) for i, (span, depth) in enumerate(shown)]
            yield pd.DataFrame(out, columns=["run", "span", "depth", "place"])

    kind = spans.schema["run"].dataType.simpleString()
    held = spans.groupBy("run").agg(F.array_sort(F.collect_list(F.struct(*order, F.col("span").alias("_s"), "parent"))).alias("_spans"))
    rows = held.select("run", F.transform("_spans", lambda s: F.struct(s["_s"].alias("span"), s["parent"].alias("parent"))).alias("spans"))
    return rows.mapInPandas(run, f"run {kind}, span string, depth long, place long")


def interrupted(traces: DataFrame, owners: DataFrame) -> DataFrame:
    """`traces` (id, status, owner) whose running ones without a live owner are interrupted."""
    alive = owners.select(F.col("owner").alias("_alive")).distinct()
    both = traces.join(alive, traces["owner"] == F.col("_alive"), "left")
    return both.withColumn("status", F.when((F.col("status") == "running") & F.col("_alive").isNull(), "interrupted").otherwise(F.col("status"))).drop("_alive")

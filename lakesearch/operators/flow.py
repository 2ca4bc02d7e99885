"""Flow of requests, replayed: sharing of calls in flight, permits and pacing, and reach in a tree of processes.

Each replay is a fold over one key's requests in order; it holds the calls in flight
or the permits, never the requests.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _folded(rows: DataFrame, key: str, order: list[str], columns: list[str], schema: str, start: Callable[[], Callable[[tuple], tuple]]) -> DataFrame:
    """`rows` through `start()`, a fresh step for each key, in order."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, step = None, None
        for part in parts:
            out = []
            for row in part.itertuples(index=False):
                if step is None or row[0] != current:
                    current, step = row[0], start()
                out.append(step(row))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in schema.split(", ")])

    return rows.select(key, *columns).repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


def single_flight(requests: DataFrame) -> DataFrame:
    """`requests` (pool, seq, key, at, duration) with `call`: the seq of the call that answers, its own if none of the key is in flight."""

    def start() -> Callable[[tuple], tuple]:
        flying: dict[str, tuple[int, int]] = {}

        def step(row: tuple) -> tuple:
            pool, seq, key, at, duration = row
            call, end = flying.get(key, (seq, at))
            if at >= end:
                call, end = seq, at + duration
                flying[key] = (call, end)
            return pool, seq, call

        return step

    return _folded(requests, "pool", ["at", "seq"], ["seq", "key", "at", "duration"], "pool string, seq long, call long", start)


def paced(requests: DataFrame, gap: int, permits: int) -> DataFrame:
    """`requests` (pool, seq, at, duration) with `starts`: first come, first served, `gap` between starts, `permits` at a time."""

    def start() -> Callable[[tuple], tuple]:
        ends: list[int] = []
        free = [0]

        def step(row: tuple) -> tuple:
            pool, seq, at, duration = row
            begins = max(at, free[0])
            if len(ends) >= permits:
                begins = max(begins, heapq.heappop(ends))
            heapq.heappush(ends, begins + duration)
            free[0] = begins + gap
            return pool, seq, begins

        return step

    return _folded(requests, "pool", ["at", "seq"], ["seq", "at", "duration"], "pool string, seq long, starts long", start)


def spaced(requests: DataFrame, gap: int) -> DataFrame:
    """The same with any number at a time: a running maximum instead of a fold."""
    w = Window.partitionBy("pool").orderBy("at", "seq")
    rows = requests.withColumn("_k", F.row_number().over(w) - 1)
    latest = F.max(F.col("at") - gap * F.col("_k")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("starts", (latest + gap * F.col("_k")).cast("long")).drop("_k")


def reachable(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """node: the roots and all below them over edges (parent, node); cycles end.

    Where every node has one parent at most, as processes have, nodes look to ancestors
    twice as far away each round, so a chain of n takes log n rounds.  Otherwise the
    search goes level by level for as long as there is something new.
    """
    found = roots.select("node").distinct()
    several = edges.distinct().groupBy("node").agg(F.count("*").alias("n")).where("n > 1")
    if several.isEmpty():
        return found.union(_below_by_doubling(edges, found)).distinct()
    front = found
    while True:
        below = _kept(edges.join(front.withColumnRenamed("node", "parent"), "parent", "left_semi").select("node").distinct().join(found, "node", "left_anti"))
        if below.isEmpty():
            return found
        found, front = _kept(found.union(below)), below


def _below_by_doubling(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """The nodes of a forest that have a root among their ancestors."""
    mark = roots.select(F.col("node").alias("_root"))
    state = edges.distinct().join(mark, F.col("parent") == F.col("_root"), "left").select("node", F.col("parent").alias("up"), F.col("_root").isNotNull().alias("below"))
    state, steps = _kept(state), max(1, edges.count()).bit_length()
    for _ in range(steps):  # 2**steps is more than the length of any path
        above = state.select(F.col("node").alias("up"), F.col("up").alias("further"), F.col("below").alias("also"))
        state = _kept(state.join(above, "up", "left").select("node", F.col("further").alias("up"), (F.col("below") | F.coalesce("also", F.lit(False))).alias("below")))
        if state.where("up is not null and not below").isEmpty():
            break
    return state.where("below").select("node")


def _kept(df: DataFrame) -> DataFrame:
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.persist()

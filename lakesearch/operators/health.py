"""Source health: a circuit breaker for each source, as a fold over its ordered observations.

An observation carries the sequence number of the selection it answers; one older
than the newest applied is ignored, and one without diagnostics, failure or result
changes nothing.  A failure rests the source, twice as long each time in a row; a
success heals it; after its rest a source is half open.  A pool's gate then lets one request
probe it and keeps the others from it until that request has ended.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

LONG_REST, SHORT_REST, MOST_REST = 300_000, 30_000, 1_800_000


@dataclass
class State:
    newest: int = 0
    consecutive: int = 0
    failures: int = 0
    observations: int = 0
    cooldown_until: int = 0
    last_error: str | None = None
    suspended: bool | None = None
    at: int | None = None

    def observe(self, sequence: int, at: int, code: str | None, suspended: bool | None, succeeded: bool, complete: bool) -> None:
        if sequence < self.newest or (code is None and not succeeded and not complete):
            return
        self.newest, self.at = sequence, at
        self.observations += 1
        if code is None:
            self.consecutive, self.cooldown_until, self.last_error, self.suspended = 0, 0, None, False
            return
        self.consecutive += 1
        self.failures += 1
        self.last_error, self.suspended = code, suspended
        rest = LONG_REST if code == "UPSTREAM_BLOCKED" or suspended else SHORT_REST
        self.cooldown_until = at + min(MOST_REST, rest * 2 ** min(10, self.consecutive - 1))

    def status(self, now: int) -> str:
        if self.cooldown_until > 0:
            return "cooling_down" if self.cooldown_until > now else "half_open"
        return "unknown" if self.at is None else "healthy"


SCHEMA = "source string, newest long, consecutive long, failures long, observations long, cooldown_until long, last_error string, suspended boolean, at long, status string"


def fold(observations: DataFrame, now: int | None = None) -> DataFrame:
    """The state of each source after all its observations (source, sequence, at, code, suspended, succeeded, complete).

    One row a source comes out; a source's observations pass through one task in
    Arrow batches, ordered, and only the state is held.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        source, state = None, State()
        done = []

        def close() -> None:
            if source is not None:
                done.append({"source": source, **asdict(state), "status": state.status(now if now is not None else (state.at or 0))})

        for part in parts:
            for row in part.itertuples(index=False):
                if row.source != source:
                    close()
                    source, state = row.source, State()
                state.observe(int(row.sequence), int(row.at), row.code if isinstance(row.code, str) else None, None if pd.isna(row.suspended) else bool(row.suspended), bool(row.succeeded), bool(row.complete))
        close()
        yield pd.DataFrame(done, columns=[x.split()[0] for x in SCHEMA.split(", ")])

    columns = ["source", "sequence", "at", "code", "suspended", "succeeded", "complete"]
    return observations.select(*columns).repartition("source").sortWithinPartitions("source", "sequence", "at").mapInPandas(run, SCHEMA)


def applied(observations: DataFrame) -> DataFrame:
    """The observations that are not late: their sequence is at least every earlier one's, by arrival (at)."""
    w = Window.partitionBy("source").orderBy("at", "sequence").rowsBetween(Window.unboundedPreceding, -1)
    return observations.withColumn("_newest", F.max("sequence").over(w)).where(F.col("_newest").isNull() | (F.col("sequence") >= F.col("_newest"))).drop("_newest")


def consecutive_failures(observations: DataFrame, failed: Column) -> DataFrame:
    """`observations` with the length of the run of failures that each one ends: islands between successes."""
    w = Window.partitionBy("source").orderBy("sequence")
    island = F.sum((~failed).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = observations.withColumn("_island", island).withColumn("_failed", failed.cast("int"))
    run = F.sum("_failed").over(Window.partitionBy("source", "_island").orderBy("sequence").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("consecutive", run.cast("long")).drop("_island", "_failed")


def rollup(sources: Column, resting: Column, requests: Column, last_error: Column, closed: Column) -> Column:
    """The provider's status from how many of its sources rest."""
    return (
        F.when(closed, "closed").when(resting == sources, "unavailable").when(resting > 0, "degraded").when(last_error.isNotNull(), "unavailable")
        .when(requests > 0, "ready").otherwise("idle")
    )


def rest_ms(observations: DataFrame) -> DataFrame:
    """`observations` with the rest each failure starts, from its place in its run of failures."""
    runs = consecutive_failures(observations, F.col("code").isNotNull())
    return runs.withColumn("rest_ms", F.when(F.col("code").isNotNull(), X.backoff_ms(F.col("consecutive"), F.col("code"), F.col("suspended"))))


# Admission: which sources a request may ask, with one probe at a time for each that has rested.

ADMITTED = "pool string, request long, asked array<string>, skipped array<string>, probes array<string>, error string, retry_ms long"


@dataclass
class Gate:
    """The sources of one pool: their states, and which request probes each."""

    states: dict[str, State] = field(default_factory=dict)
    probing: dict[str, int] = field(default_factory=dict)

    def admit(self, request: int, sources: list[str], now: int) -> dict:
        """Sources that rest or are being probed are skipped; a rested one is asked as this request's probe; none at all is an error."""
        waits = {s: max(0, self.states.setdefault(s, State()).cooldown_until - now) for s in sources}
        asked = [s for s in sources if not waits[s] and s not in self.probing]
        probes = [s for s in asked if self.states[s].cooldown_until]
        self.probing |= dict.fromkeys(probes, request)
        answer = {"request": request, "asked": asked, "skipped": [s for s in sources if s not in asked], "probes": probes, "error": None, "retry_ms": None}
        if not asked:
            blocked = any(self.states[s].last_error == "UPSTREAM_BLOCKED" for s in sources)
            answer |= {"error": "UPSTREAM_BLOCKED" if blocked else "UPSTREAM_UNAVAILABLE", "retry_ms": min(waits.values(), default=0)}
        return answer

    def end(self, request: int) -> None:
        """Whatever came of a request, the sources it probed may be probed again."""
        self.probing = {s: r for s, r in self.probing.items() if r != request}


def admissions(actions: DataFrame) -> DataFrame:
    """What every request of a pool is answered, from the pool's actions in order of (at, kind, request).

    actions: pool, at, kind (0 an answer of one source, 1 the end of a request, 2 a request), request,
    sources (of a request: all of its pool), and source, code, suspended, succeeded, complete of an answer.
    An answer of a source the request has not asked changes nothing.  A pool's actions pass through one
    task in Arrow batches; held are its sources' states and, of the requests not ended, what they asked.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pool, gate, open_ = None, Gate(), {}
        for part in parts:
            done = []
            for row in part.itertuples(index=False):
                if row.pool != pool:
                    pool, gate, open_ = row.pool, Gate(), {}
                request = int(row.request)
                if row.kind == 2:
                    answer = gate.admit(request, list(row.sources), int(row.at))
                    open_[request] = set(answer["asked"])
                    done.append({"pool": pool, **answer})
                elif row.kind == 1:
                    gate.end(request)
                    open_.pop(request, None)
                elif row.source in open_.get(request, ()):
                    code = row.code if isinstance(row.code, str) else None
                    gate.states[row.source].observe(request, int(row.at), code, None if pd.isna(row.suspended) else bool(row.suspended), bool(row.succeeded), bool(row.complete))
            out = pd.DataFrame(done, columns=[x.split()[0] for x in ADMITTED.split(", ")])
            yield out.astype({"request": "int64", "retry_ms": "Int64"})

    columns = ["pool", "at", "kind", "request", "sources", "source", "code", "suspended", "succeeded", "complete"]
    return actions.select(*columns).repartition("pool").sortWithinPartitions("pool", "at", "kind", "request").mapInPandas(run, ADMITTED)

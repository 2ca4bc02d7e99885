"""The circuit breaker over a stream: one state for each source, updated as observations arrive."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, fields

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.health import SCHEMA, State

_STATE = "newest long, consecutive long, failures long, observations long, cooldown_until long, last_error string, suspended boolean, at long"
_NAMES = [f.name for f in fields(State)]


def _update(key: tuple[str], parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
    state = State(**dict(zip(_NAMES, held.get, strict=True))) if held.exists else State()
    rows = pd.concat(parts).sort_values(["sequence", "at"], kind="stable")
    for row in rows.itertuples(index=False):
        state.observe(int(row.sequence), int(row.at), row.code if isinstance(row.code, str) else None, None if pd.isna(row.suspended) else bool(row.suspended), bool(row.succeeded), bool(row.complete))
    held.update(tuple(getattr(state, n) for n in _NAMES))
    yield pd.DataFrame([{"source": key[0], **asdict(state), "status": state.status(state.at or 0)}], columns=[x.split()[0] for x in SCHEMA.split(", ")])


def health(observations: DataFrame) -> DataFrame:
    """The state of every source that a trigger brings observations of; late sequences change nothing."""
    return observations.groupBy("source").applyInPandasWithState(_update, SCHEMA, _STATE, "update", GroupStateTimeout.NoTimeout)

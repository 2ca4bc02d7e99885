"""Settings: limits with their defaults, merged with a patch and checked against each other."""

from __future__ import annotations

import dataclasses
import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class InvalidArgument(ValueError):
    """A specification that cannot be run."""


@dataclass(frozen=True)
class Evidence:
    default_max_results: int = 3
    max_results: int = 5
    max_passages_per_result: int = 3
    max_chars_per_passage: int = 1600
    max_chars_per_result: int = 4000
    max_candidate_passages: int = 32


@dataclass(frozen=True)
class Search:
    limit: int = 8
    max_sites: int = 20
    include_subdomains: bool = True
    max_upstream_requests: int = 4
    max_pages_per_query: int = 2
    max_candidates: int = 80
    cache_ttl_seconds: int = 300
    evidence: Evidence = field(default_factory=Evidence)


@dataclass(frozen=True)
class Fetch:
    max_chars: int = 12_000
    max_output_chars: int = 50_000
    max_redirects: int = 5
    default_engine: str = "static"


@dataclass(frozen=True)
class Settings:
    search: Search = field(default_factory=Search)
    fetch: Fetch = field(default_factory=Fetch)
    ranking_mode: str = "upstream"
    snapshot_ttl_seconds: int = 86_400


def merge(base: Any, patch: dict[str, Any]) -> Any:
    """`base` with the values of `patch`, part by part; keys it does not have are refused."""
    changes = {}
    for key, value in patch.items():
        if key.startswith("_") or key not in {f.name for f in dataclasses.fields(base)}:
            raise InvalidArgument(f"no setting {key}")
        old = getattr(base, key)
        if dataclasses.is_dataclass(old):
            if not isinstance(value, dict):
                raise InvalidArgument(f"{key} is a group of settings")
            changes[key] = merge(old, value)
        elif type(value) is not type(old):
            raise InvalidArgument(f"{key} must be of type {type(old).__name__}")
        else:
            changes[key] = value
    return dataclasses.replace(base, **changes)


def load(patch: dict[str, Any] | None = None) -> Settings:
    """Defaults with `patch`; no default may be over its own maximum."""
    s = merge(Settings(), patch or {})
    e = s.search.evidence
    if s.fetch.max_chars > s.fetch.max_output_chars or e.default_max_results > e.max_results or e.max_chars_per_passage > e.max_chars_per_result or e.max_passages_per_result > e.max_candidate_passages:
        raise InvalidArgument("a default is over its maximum")
    if s.ranking_mode not in ("upstream", "bm25", "bm25_mmr"):
        raise InvalidArgument(f"no ranking mode {s.ranking_mode}")
    return s


def patched(patches: DataFrame, key: str) -> DataFrame:
    """key, refused (why, or null) and settings (JSON, or null) of rows with a `patch` in JSON; a null one changes nothing."""

    def one(patch: str | None) -> tuple[str | None, str | None]:
        try:
            given = json.loads(patch) if patch is not None else {}
            if not isinstance(given, dict):
                raise InvalidArgument("a patch is an object")
            return None, json.dumps(dataclasses.asdict(load(given)), separators=(",", ":"))
        except ValueError as why:  # what is no JSON, too
            return str(why), None

    @F.pandas_udf("refused string, settings string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame([one(p) for p in part], columns=["refused", "settings"])

    return patches.select(key, run("patch").alias("_done")).select(key, "_done.refused", "_done.settings")

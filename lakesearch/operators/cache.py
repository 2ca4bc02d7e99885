"""Replay of a result cache bounded by age, entries and bytes: which requests it would have answered."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame


class Replay:
    """Entries live `ttl` from when they were stored, hits do not prolong them; the least recently stored or used goes first."""

    def __init__(self, ttl: int, entries: int, size: int):
        self.ttl, self.entries, self.size = ttl, entries, size
        self.held: OrderedDict[str, tuple[int, int]] = OrderedDict()
        self.bytes = 0

    def drop(self, key: str) -> None:
        if key in self.held:
            self.bytes -= self.held.pop(key)[1]

    def request(self, key: str, at: int, size: int, failed: bool) -> bool:
        found = self.held.get(key)
        if found and at - found[0] < self.ttl:
            self.held.move_to_end(key)
            return True
        if failed or not self.ttl or size > self.size:
            return False
        for old in [k for k, (t, _) in self.held.items() if at - t >= self.ttl]:
            self.drop(old)
        self.drop(key)
        self.held[key] = (at, size)
        self.bytes += size
        while len(self.held) > self.entries or self.bytes > self.size:
            self.drop(next(iter(self.held)))
        return False


def replay(requests: DataFrame, ttl: int, entries: int, size: int) -> DataFrame:
    """`requests` (cache, seq, key, at, size, failed) with hit; each cache is replayed in order, holding only its entries."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, cache = None, Replay(ttl, entries, size)
        for part in parts:
            hits = []
            for row in part.itertuples(index=False):
                if row.cache != name:
                    name, cache = row.cache, Replay(ttl, entries, size)
                hits.append(cache.request(row.key, int(row.at), int(row.size), bool(row.failed)))
            yield pd.DataFrame({"cache": part.cache, "seq": part.seq, "hit": hits})

    columns = ["cache", "seq", "key", "at", "size", "failed"]
    return requests.select(*columns).repartition("cache").sortWithinPartitions("cache", "seq").mapInPandas(run, "cache string, seq long, hit boolean")

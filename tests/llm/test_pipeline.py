from __future__ import annotations

import collections
import math

import corpus_pipeline as P
from parity import SF

from lakesearch.llm import decontaminate, quality


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = P.run(spark, SF)
    rows = out.collect()
    ids = [r["doc_id"] for r in rows]
    clean = {r["doc_id"] for r in quality.keep_clean(docs).collect()}
    leaked = {r["doc_id"] for r in decontaminate.leaks(quality.keep_clean(docs), spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert len(ids) == len(set(ids)) and set(ids) <= clean - leaked
    sizes = [sum(r["shard"] == s for r in rows) for s in range(8)]
    assert max(sizes) - min(sizes) <= 1 and set(docs.columns) < set(out.columns)
    assert [n for n, _ in P.STAGES] == ["quality_rules", "near_dedup", "decontamination", "source_mixing", "sharding"]


def test_stages_keep_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in P.STAGES[:-1]:
        assert stage(spark, docs, SF).dtypes == docs.dtypes


def test_odd_rows(odd, spark):
    df = odd
    for _, stage in P.STAGES[:-1]:
        df = stage(spark, df, SF)
    assert P.STAGES[-1][1](spark, df, SF).count() <= odd.count()


def test_a_tiny_source_shrinks_nothing(spark):
    """One hot source, 19 equal ones and a null one of a single document: all but the hot one stay whole."""
    sizes = {"hot": 950, **{f"s{i:02}": 100 for i in range(19)}, None: 1}
    rows = [(s, k) for s, n in sizes.items() for k in range(n)]
    docs = spark.createDataFrame([(i, s, "w " * 5) for i, (s, _) in enumerate(rows)], "doc_id long, source string, text string")
    ids = [r["doc_id"] for r in P.source_mixing(spark, docs, SF).collect()]
    kept = collections.Counter(rows[i][0] for i in ids)
    # brute force: the least exponent whose weights are at most four times the shares, if the one for the entropy is below
    total = len(rows)
    weights = lambda x: {s: (n / total) ** x / sum((m / total) ** x for m in sizes.values()) for s, n in sizes.items()}
    xs = [k / 10_000 for k in range(10_001)]
    x = min(x for x in xs if max(w * total / sizes[s] for s, w in weights(x).items()) <= 4)
    even = lambda w: -sum(v * math.log(v) for v in w.values()) / math.log(len(w))
    x = max(x, max((x for x in xs if even(weights(x)) >= 0.95), default=0.0))
    want = {s: min(n, weights(x)[s] * total) for s, n in sizes.items()}
    assert len(ids) == len(set(ids)) and all(want[s] - 2 <= kept[s] <= want[s] + 1 for s in sizes)
    assert all(kept[s] == n for s, n in sizes.items() if s != "hot")


def test_the_mixture_repeats_small_sources(spark):
    """The stage gives the whole mixture: tokens in proportion to the weights, small sources repeated, a slot for each copy."""
    sizes = {"hot": 950, **{f"s{i:02}": 100 for i in range(19)}, None: 1}
    rows = [(s, k) for s, n in sizes.items() for k in range(n)]
    docs = spark.createDataFrame([(i, s, "w " * 5) for i, (s, _) in enumerate(rows)], "doc_id long, source string, text string")
    stages = dict(P.STAGES)
    mixed = stages["source_mixing"](spark, docs, SF)
    copies = collections.Counter(r["doc_id"] for r in mixed.collect())
    total = len(rows)
    weights = lambda x: {s: (n / total) ** x / sum((m / total) ** x for m in sizes.values()) for s, n in sizes.items()}
    x = min(x for x in (k / 10_000 for k in range(10_001)) if max(w * total / sizes[s] for s, w in weights(x).items()) <= 4)  # the tiny source's four copies bind
    spent = collections.Counter()
    for i, n in copies.items():
        spent[rows[i][0]] += n
    assert copies[total - 1] == 4 and max(copies.values()) == 4
    assert all(abs(spent[s] - weights(x)[s] * total) <= 2 for s in sizes if s is not None)
    for s, n in sizes.items():  # whole blocks and a part of the next
        own = [copies[i] for i, (t, _) in enumerate(rows) if t == s]
        assert max(own) - min(own) <= 1 and (s == "hot" or min(own) >= 1)
    out = stages["sharding"](spark, mixed, SF).collect()
    assert collections.Counter(r["doc_id"] for r in out) == copies
    for s in range(8):
        slots = sorted(r["slot"] for r in out if r["shard"] == s)
        assert slots == list(range(len(slots))) and abs(len(slots) - len(out) / 8) < 1

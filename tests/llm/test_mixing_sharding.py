from __future__ import annotations

import collections
import math
import random
import re

import pytest
from parity import SF
from pyspark.sql import functions as F

from lakesearch.llm import mixing as M
from lakesearch.llm import sharding as S


def weights(shares, x):
    p = [s**x for s in shares]
    return [v / sum(p) for v in p]


def entropy(w):
    return -sum(v * math.log(v) for v in w) / math.log(len(w))


def docs_of(spark, sizes):
    rows, k = [], 0
    for name, n in sizes.items():
        for _ in range(n):
            rows.append((k, name, " ".join(["w"] * (k % 7 + 1))))
            k += 1
    return spark.createDataFrame(rows, "doc_id long, source string, text string")


@pytest.mark.parametrize(("target", "repeats", "budget"), [(0.95, 4.0, 1.0), (0.99, 1.5, 1.0), (0.5, 4.0, 1.0), (0.95, 1.0, None), (0.9, 8.0, 3.0)])
def test_mixture(spark, target, repeats, budget):
    docs = docs_of(spark, {"a": 900, "b": 90, "c": 60, "d": 40})
    rows = M.mix(docs, target, repeats, budget).collect()
    tokens = collections.Counter()
    for r in rows:
        tokens[r["source"]] += r["_tokens"]
    total = sum(tokens.values())
    names = sorted(tokens)
    shares = [tokens[n] / total for n in names]
    w = {r["source"]: r["_weight"] for r in rows}
    got = [w[n] for n in names]
    assert math.isclose(sum(got), 1)
    x = math.log(got[0] / got[1]) / math.log(shares[0] / shares[1])
    assert all(math.isclose(a, b, rel_tol=1e-6) for a, b in zip(got, weights(shares, x)))
    assert -1e-9 <= x <= 1 + 1e-9
    if budget is not None and max(v * budget / s for v, s in zip(weights(shares, x + 1e-4), shares)) >= repeats - 1e-2:
        assert max(v * budget / s for v, s in zip(got, shares)) <= repeats + 1e-6  # the repetition limit binds
    else:
        assert entropy(got) >= min(target, 1) - 1e-6 or math.isclose(x, 0, abs_tol=1e-6)
        assert x > 1 - 1e-6 or entropy(weights(shares, x + 1e-4)) < target
    spend = budget * total if budget is not None else repeats * min(tokens[n] / v for n, v in zip(names, got))
    for n, v in zip(names, got):
        used = sum(r["_tokens"] * r["_copies"] for r in rows if r["source"] == n)
        assert used <= v * spend * (1 + 1e-6) and used > v * spend - 8
        assert len({r["_copies"] for r in rows if r["source"] == n}) <= 2  # whole blocks and one part


def test_realise_repeats(spark):
    docs = docs_of(spark, {"a": 300, "b": 20})
    mixed = M.mix(docs, 0.99, 10.0, 1.0).collect()
    out = collections.Counter(r["doc_id"] for r in M.realise(docs, target_entropy=0.99, max_repeats=10.0, budget_share=1.0).collect())
    assert out == {r["doc_id"]: r["_copies"] for r in mixed if r["_copies"]} and max(out.values()) > 1


def test_slices_do_not_matter(spark, monkeypatch):
    docs = docs_of(spark, {"a": 500, "b": 50})
    one = {r["doc_id"]: r["_copies"] for r in M.mix(docs, 0.97, 4.0, 0.7).collect()}
    monkeypatch.setattr(M, "PER_SLICE", 7)
    assert {r["doc_id"]: r["_copies"] for r in M.mix(docs, 0.97, 4.0, 0.7).collect()} == one


def test_tokens(spark):
    for r in M.mix(spark.read.parquet(f"{SF}/documents.parquet")).collect():
        assert r["_tokens"] == len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))


def brute_shards(ids, shards, replicas, load_factor):
    """The walk of the ring, one document at a time."""
    nodes = S.ring(shards, replicas)
    owners = [s for _, s in nodes]
    quota = S.quotas(len(ids), shards, load_factor, owners)
    slots, out = [0] * shards, {}
    for place, d in sorted((S.place("null" if i is None else str(i)), i) for i in ids):
        at = next((k for k, (p, _) in enumerate(nodes) if p >= place), len(nodes))
        while slots[owners[at % len(nodes)]] >= quota[owners[at % len(nodes)]]:
            at += 1
        s = owners[at % len(nodes)]
        out[d] = (s, slots[s])
        slots[s] += 1
    return out


@pytest.mark.parametrize(("n", "shards", "factor"), [(0, 3, 1.0), (5, 8, 1.0), (1003, 8, 1.0), (1003, 8, 1.1), (400, 3, 1.25)])
def test_ring(spark, monkeypatch, n, shards, factor):
    monkeypatch.setattr(S, "PER_SLICE", 50)
    docs = spark.range(n).selectExpr("id as doc_id")
    got = {r["doc_id"]: (r["_shard"], r["_slot"]) for r in S.shard(docs, shards, 16, factor).collect()}
    assert got == brute_shards(range(n), shards, 16, factor)
    sizes = collections.Counter(s for s, _ in got.values())
    if factor == 1.0 and n:
        counts = [sizes[s] for s in range(shards)]
        assert max(counts) - min(counts) <= 1
    for s, size in sizes.items():
        assert sorted(k for t, k in got.values() if t == s) == list(range(size))
        assert size <= max(1, math.ceil(factor * n / shards))


def test_few_move(spark):
    docs = spark.range(3000).selectExpr("id as doc_id")
    a, b = ({r["doc_id"]: r["_shard"] for r in S.shard(docs, k, 128, 1.25).collect()} for k in (8, 9))
    assert sum(a[d] != b[d] for d in a) < 3000 * 0.3


def test_query_columns(spark):
    import zlib

    from lakesearch.llm.queries import QUERIES

    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in QUERIES["op6_sharding"](spark, SF).collect():
        raw = text[r["doc_id"]].encode()
        assert r["size"] == len(raw) + 1 and r["text_crc32"] == zlib.crc32(raw) and r["law"] == "rows" and r["grown_shard"] is None


def brute_copies(rows, target, most):
    """Slow version of the mixture: (place, copies, weight) of rows (doc_id, source, text), orders of blocks as Spark hashes them."""
    words = [len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in rows]
    by_source = collections.defaultdict(list)
    for i, r in enumerate(rows):
        by_source[r["source"]].append(i)
    total = {s: sum(words[i] for i in at) for s, at in by_source.items()}
    live, all_words = {s: n for s, n in total.items() if n}, sum(words)
    mixture = lambda x: (lambda z: {s: (n / all_words) ** x / z for s, n in live.items()})(sum((n / all_words) ** x for n in live.values()))
    entropy = lambda x: -sum(w * math.log(w) for w in mixture(x).values()) / math.log(len(live))
    repeats = lambda x: max(mixture(x)[s] * all_words / n for s, n in live.items())

    def edge(holds, low, high):  # holds at low and not at high, or nowhere
        for _ in range(60):
            middle = (low + high) / 2
            low, high = (middle, high) if holds(middle) else (low, middle)
        return low

    x = 1.0
    if len(live) > 1:
        x = 1.0 if entropy(1.0) >= target else edge(lambda v: entropy(v) >= target, 0.0, 1.0)
        if repeats(x) > most:
            x = max(x, 1 - edge(lambda v: repeats(1 - v) <= most, 0.0, 1.0))
    weights, out = mixture(x), [0] * len(rows)
    for s, at in by_source.items():
        if not total[s]:
            blocks, rest = 1, -1
        else:
            part = weights[s] * all_words
            blocks = int(part / total[s] + 1e-6)
            rest = part - blocks * total[s]
        spent = 0
        for i in sorted(at, key=lambda i: (rows[i]["order"][blocks], rows[i]["doc_id"], words[i])):
            out[i] = blocks + (spent + words[i] <= rest)
            spent += words[i]
    return out, weights


def test_copies_against_brute_force(spark):
    """Every row's copies, on a skewed table with a tiny source, a null source and texts without words."""
    rng = random.Random(11)
    data, at = [], 0
    for source, n in (("hot", 90), ("mid", 25), ("small", 8), ("tiny", 1), (None, 5), ("empty", 2)):
        for _ in range(n):
            text = None if source == "empty" else " ".join("w" for _ in range(rng.randint(0, 40) if source != "tiny" else 7))
            data.append((at, text, source))
            at += 1
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    order = F.array(*(F.shiftrightunsigned(F.xxhash64(F.lit(0), F.lit(b).cast("long"), F.col("doc_id")), 4) for b in range(60)))
    rows = df.select("*", order.alias("order")).collect()
    for target, most in ((0.95, 4.0), (0.6, 4.0), (0.99, 50.0)):
        want, weights = brute_copies(rows, target, most)
        got = {r["doc_id"]: (r["_copies"], r["_weight"]) for r in M.mix(df, target, most).collect()}
        assert {r["doc_id"]: n for r, n in zip(rows, want, strict=True)} == {d: c for d, (c, _) in got.items()}
        for r in rows:
            assert math.isclose(got[r["doc_id"]][1], weights.get(r["source"], 0.0), abs_tol=1e-6)


def test_tokens_are_runs_of_other_characters(spark):
    texts = [None, "", " ", "\t\n\x0b\x0c\r ", "a", " a", "a ", "a\x0bb\x0cc\rd  e\tf\n", "\u00a0 \u2003 \x1c", "  \u6c49\u5b57 \U0001f600\n\n\x00 ", "a" * 5000 + " b" * 5000]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", M.n_tokens(F.col("text")).alias("n")).collect()
    assert {r["i"]: r["n"] for r in got} == {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in enumerate(texts)}

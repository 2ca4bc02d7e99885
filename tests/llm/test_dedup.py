from __future__ import annotations

import random
import re

import pytest
from parity import SF

from lakesearch.llm import dedup as D

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if len(words) >= k else frozenset([tuple(words)] if words else [])


def brute(rows, plan):
    sets = {d: shingles(t, plan.words) for d, t in rows}
    up = {d: d for d in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= plan.percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {d: (len(sets[d]), find(d), find(d) == d) for d in sets}


def result(df, plan):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in D.near_duplicates(df, plan).collect()}


@pytest.mark.parametrize("plan", [D.Plan(words=3, percent=85), D.Plan()])
def test_documents(spark, plan):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert result(docs, plan) == brute([(r["doc_id"], r["text"]) for r in docs.collect()], plan)


def test_large_group_of_near_copies(spark):
    """Copies of one text with more and more words changed: many pairs lie close to the threshold."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for d in range(250):
        words = list(base)
        for i in rng.sample(range(len(words)), rng.randint(0, 9)):
            words[i] = f"x{d}-{i}"
        rows.append((d, " ".join(words)))
    plan = D.Plan(words=3, percent=85, block=64)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(df, plan) == brute(rows, plan)


def test_chain_is_one_component(spark):
    rows = [(d, " ".join(f"w{i}" for i in range(d * 3, d * 3 + 60))) for d in range(40)]
    plan = D.Plan(words=3, percent=85)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(df, plan) == brute(rows, plan)


def test_least_matches_grow():
    found = dict(D.least_matches(D.Plan()))
    assert found[64] < 64 * 0.8 and found[1024] > 1024 * 0.72 and list(found.values()) == sorted(found.values())


def test_repeated_and_null_ids(spark):
    """Rows are linked by their own texts, whatever their ids."""
    a, b = " ".join(f"a{i}" for i in range(200)), " ".join(f"b{i}" for i in range(200))
    near = b.replace("b199", "c")
    plan = D.Plan(words=3, percent=85)
    df = spark.createDataFrame([(1, a), (1, b), (2, near)], "doc_id long, text string")
    assert sorted(tuple(r) for r in D.near_duplicates(df, plan).collect()) == [(1, 198, 1, True), (1, 198, 1, True), (2, 198, 1, False)]
    df = spark.createDataFrame([(None, b), (None, b), (7, near), (None, a), (None, a), (8, None), (8, None), (9, "one")], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in D.near_duplicates(df, plan).collect()), key=str)
    assert got == sorted([(None, 7, False), (None, 7, False), (7, 7, True), (None, None, True), (None, None, True), (8, 8, True), (8, 8, True), (9, 9, True)], key=str)


def test_one_row_of_each_group_stays(spark):
    a, b = " ".join(f"a{i}" for i in range(200)), " ".join(f"b{i}" for i in range(200))
    rows = [(1, a, 0), (1, a, 1), (1, b, 2), (2, b, 3), (5, a, 4), (5, "quite another text", 5), (None, a, 6), (None, "of its own", 7), (None, "of its own", 8), (3, None, 9), (3, None, 10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n long").coalesce(1)
    kept = sorted(r["n"] for r in D.keep_one(df).collect())
    assert [x for x in kept if x > 1] == [2, 5, 7, 9, 10] and len([x for x in kept if x < 2]) == 1

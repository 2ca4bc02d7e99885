from __future__ import annotations

import random

import numpy as np
from parity import SF
from hypothesis import given, settings
from hypothesis import strategies as st

from lakesearch.llm import decontaminate as D


def greedy(doc, item, match):
    """Greedy string tiling as defined: the longest unmarked match first, all pairs of places tried."""
    in_doc, in_item, found = [False] * len(doc), [False] * len(item), []
    while True:
        best = None
        for t in range(len(item)):
            for p in range(len(doc)):
                n = 0
                while t + n < len(item) and p + n < len(doc) and item[t + n] == doc[p + n] and not in_item[t + n] and not in_doc[p + n]:
                    n += 1
                if n >= match and (best is None or (-n, t, p) < best):
                    best = (-n, t, p)
        if best is None:
            return found
        n, t, p = -best[0], best[1], best[2]
        for i in range(n):
            in_item[t + i] = in_doc[p + i] = True
        found.append((t, p, n))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=24), st.lists(st.integers(0, 3), max_size=14), st.integers(2, 4))
def test_tiles(doc, item, match):
    hits = [(p, t) for p in range(len(doc) - match + 1) for t in range(len(item) - match + 1) if doc[p : p + match] == item[t : t + match]]
    p, t = (np.array([h[i] for h in hits], np.int64) for i in (0, 1))
    assert D.tiles(np.array(doc), np.array(item), p, t, match) == greedy(doc, item, match)


def _words(rng, n):
    return ["".join(rng.choices("abcdefghij", k=6)) for _ in range(n)]


def test_reordered_and_changed(spark):
    rng = random.Random(1)
    item = _words(rng, 40)
    a, b = item[:20], item[20:]
    noise = lambda n: _words(rng, n)
    docs = {
        1: noise(50) + item + noise(50), 2: noise(9) + b + noise(30) + a, 3: noise(100), 4: noise(5) + item[:19] + noise(5), 5: [w.upper() + "," for w in item], 6: [w for i, w in enumerate(item) if i % 8],
        7: item[::-1], 8: [x for i in range(0, 40, 4) for x in item[i : i + 4] + noise(1)],
    }
    df = spark.createDataFrame([(k, " ".join(v)) for k, v in docs.items()], "doc_id long, text string")
    bench = spark.createDataFrame([(10, " ".join(item)), (11, "too short")], "item_id long, text string")
    got = {r["doc_id"]: r for r in D.leaks(df, bench).collect()}
    assert set(got) == {1, 2, 5, 6}
    assert got[2]["n_tiles"] == 2 and got[2]["coverage"] == 1.0 and got[2]["longest_tile"] == 20
    assert {r["doc_id"] for r in D.remove_leaks(df, bench).collect()} == {3, 4, 7, 8}
    small = {(r["doc_id"], r["n_covered"]) for r in D.leaks(df, bench, block=1).collect()}  # one item a block
    assert small == {(k, r["n_covered"]) for k, r in got.items()}


def test_accents_fold():
    import pyarrow as pa

    from lakesearch.llm import common as C

    one = lambda s: D.folded_words(*C.text_bytes(pa.array([s])))[0].tolist()
    assert one("École — “Été” x y") == one("école été X y")


def test_documents_against_brute_force(spark):
    docs, bench = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    import re

    fold = lambda t: re.findall(r"[0-9a-zß-ÿ]+", t.lower())
    items = {r["item_id"]: fold(r["text"]) for r in bench.collect()}
    want = {}
    for d in docs.collect():
        words = fold(d["text"])
        grams = {tuple(words[i : i + 5]) for i in range(len(words) - 4)}
        for k, item in items.items():
            seeds = sum(tuple(item[i : i + 5]) in grams for i in range(len(item) - 4))
            if seeds * 5 >= 0.5 * len(item) and len(words) < 3000:
                covered = sum(n for _, _, n in greedy(words, item, 5))
                if covered >= 0.5 * len(item):
                    want[d["doc_id"], k] = covered
    long = {r["doc_id"] for r in docs.collect() if len(fold(r["text"])) >= 3000}
    got = {(r["doc_id"], r["item_id"]): r["n_covered"] for r in D.leaks(docs, bench).collect() if r["doc_id"] not in long}
    assert got == want and want


def test_words_of_all_scripts():
    import pyarrow as pa
    import regex

    from lakesearch.llm import common as C

    texts = ["Hello, WORLD été ÉTÉ x_y", "汉字テストabc汉 déf", "", "ПРИВЕТ мир 123", "ไทย a", "日", "本x", "é z"]
    words = lambda t: D.folded_words(*C.text_bytes(pa.array(t)))
    alone = "".join(rf"\p{{Script={x}}}" for x in D.UNSPACED)
    pattern = regex.compile(rf"(?V1)[[{alone}]&&[\p{{L}}\p{{M}}\p{{N}}]]|[[\p{{L}}\p{{M}}\p{{N}}]--[{alone}]]+")
    got, first = words(texts)
    for i, t in enumerate(texts):
        assert got[first[i] : first[i + 1]].tolist() == [words([w.lower()])[0].tolist()[0] for w in pattern.findall(t)]


def test_copies_in_other_scripts_and_short_items(spark):
    chinese, russian, japanese = "人工智能正在改变世界，它会带来许多新的机会。", "Москва является столицей России и крупнейшим городом страны", "東京は日本の首都であり、世界でも大きな都市の一つです。"
    docs = [(1, f"前言。{chinese}结束"), (2, f"Слово. {russian.upper()}!"), (3, f"はじめに{japanese}おわり"), (4, "nothing of the kind stands here at all"), (5, "so: Forty-two, IS the answer"), (6, "forty is two"), (7, None)]
    bench = [(1, chinese), (2, russian), (3, japanese), (4, "forty two is"), (5, "!!"), (6, None)]
    df, items = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    assert {(r["doc_id"], r["item_id"], r["coverage"]) for r in D.leaks(df, items).collect()} == {(1, 1, 1.0), (2, 2, 1.0), (3, 3, 1.0), (5, 4, 1.0)}
    assert {r["doc_id"] for r in D.remove_leaks(df, items).collect()} == {4, 5, 6, 7}

"""Licence scans and line deduplication."""

from __future__ import annotations

import itertools
import random
import re

from lakesearch.llm import licenses, lines


def test_labels(spark):
    mit = licenses.TEMPLATES[2][1]
    texts = {
        1: "Released under the MIT License.", 2: "x " + mit.upper().replace(" ", ", ") + " y", 3: "Licensed under CC BY-NC 4.0.", 4: "the mit licence", 5: None, 6: "General, PUBLIC license! apache\nlicense mit license mit license",
        7: " ".join(w for i, w in enumerate(mit.split()) if i % 17 != 5), 8: "Licensed under the Apache License, Version 2.0.", 9: " ".join(sorted(mit.split())),
    }
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert (got[1]["labels"], got[1]["base_labels"], got[1]["n_base"], got[1]["first_word"]) == ("mit", "mit", 1, 3)
    assert got[2]["labels"] == "mit" and got[2]["n_base"] == 0 and got[2]["score"] == 1.0
    assert got[3]["labels"] == "cc-by-nc" and got[3]["base_labels"] == ""
    assert got[4]["labels"] == "" and got[4]["score"] == 0
    assert (got[5]["n_words"], got[5]["labels"], got[5]["first_word"]) == (0, "", None)
    assert (got[6]["n_base"], got[6]["first_word"], got[6]["last_word"], got[6]["base_labels"]) == (4, 0, 7, "apache,gpl,mit")
    assert got[7]["labels"] == "mit" and 0.7 <= got[7]["score"] < 1
    assert got[8]["labels"] == "apache" and got[9]["labels"] == ""


def test_names_and_identifiers(spark):
    texts = {
        1: "// SPDX-License-Identifier: Apache-2.0", 2: "SPDX-License-Identifier: GPL-2.0-or-later", 3: "SPDX-License-Identifier: Proprietary", 4: "Distributed under the Boost Software License, Version 1.0.",
        5: "Mozilla Public License Version 2.0", 6: "the GNU Affero General Public License", 7: "SPDX-License-Identifier: CC-BY-SA-4.0", 8: "Licensed under the Apple License", 9: "the mozilla public library",
    }
    got = {r["doc_id"]: r["labels"] for r in licenses.scan(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == {1: "apache", 2: "gpl", 3: "", 4: "bsl", 5: "mpl", 6: "agpl,gpl", 7: "cc-by-sa", 8: "", 9: ""}


def test_words_and_equal_rows(spark, monkeypatch):
    """Words counted against Python's own, at both ends of the text and beyond ASCII; equal rows all come back."""
    monkeypatch.setattr(licenses, "BLOCK", 3)
    texts = ["", None, " ", "a", " a", "a ", " a b ", "\u212ait License", "mit \u00c9t\u00e9 license", "MIT License", "..mit license..", "\u0130mit license mit\nlicense", "x" * 50 + " mit" + " license" * 3]
    rows = [(i % 4 or None, t) for i, t in enumerate(texts)] + [(9, " mit license")] * 7 + [(None, None)] * 4
    want = []
    for key, t in rows:
        w = re.findall(licenses.WORD, (t or "").translate(str.maketrans(licenses.UPPER, licenses.LOWER)))
        at = [i for i in range(len(w) - 1) if w[i : i + 2] == ["mit", "license"]]
        want.append((key, len(w), len(at), at[0] if at else None, at[-1] if at else None, "mit" if at else "", 0.5 if at else 0.0))
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_words", "n_base", "first_word", "last_word", "labels", "score").collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def distance_at_most_one(a, b):
    if a == b:
        return True
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def test_near_lines(spark):
    rng = random.Random(5)
    base = [[f"w{rng.randint(0, 3)}" for _ in range(rng.randint(3, 8))] for _ in range(25)]
    out = []
    for words in base:
        for _ in range(6):
            w = list(words)
            for _ in range(rng.randint(0, 2)):
                i = rng.randrange(len(w))
                w = rng.choice([w[:i] + w[i + 1 :], w[:i] + ["new"] + w[i:], w[:i] + ["other"] + w[i + 1 :]])
            out.append(" ".join(w))
    rng.shuffle(out)
    docs = [(d, "\n".join(out[d * 10 : d * 10 + 10])) for d in range(15)]
    places = [((d, i), tuple(x.split())) for d, t in docs for i, x in enumerate(t.split("\n"))]
    want = {}
    for at, words in places:
        first = min(p for p, w in places if w == words)
        near = any(p < first and len(w) >= lines.MIN_WORDS and len(words) >= lines.MIN_WORDS and distance_at_most_one(words, w) for p, w in places)
        if at > first or near:
            want[at] = "exact" if at > first else "near"
    got = {(r["doc_id"], r["line"]): r["why"] for r in lines.dropped(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == want and len(set(want.values())) == 2 and len(want) < len(places)


def test_word_distance(spark):
    words = [list(x) for n in range(4) for x in itertools.product("ab", repeat=n)]
    pairs = spark.createDataFrame([(a, b) for a in words for b in words], "a array<string>, b array<string>")
    for r in pairs.select("a", "b", lines.within_one("a", "b").alias("near")).collect():
        assert r["near"] == distance_at_most_one(r["a"], r["b"])


def test_cleaned_text(spark):
    df = spark.createDataFrame([(1, "one two three four five six\nshort\n\nshort"), (2, "One  two three four five SEVEN\nfresh words"), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in lines.drop_lines(df).collect()}
    assert got == {1: "one two three four five six\nshort\n", 2: "fresh words", 3: None}


def survivors(rows, order):
    """Brute force: the lines that stay of every row, rows standing in the order of (doc_id, order, place in the list)."""
    places = [((r[0] if r[0] is not None else -1, order[i], i, k), x.lower().split()) for i, r in enumerate(rows) if r[1] is not None for k, x in enumerate(r[1].split("\n"))]
    out = []
    for i, r in enumerate(rows):
        mine = [(p, w) for p, w in places if p[2] == i]
        gone = {p[3] for p, w in mine if w and any(q < p and (v == w or (min(len(v), len(w)) >= lines.MIN_WORDS and distance_at_most_one(v, w))) for q, v in places if v)}
        out.append((r[0], None if r[1] is None else "\n".join(x for k, x in enumerate(r[1].split("\n")) if k not in gone)))
    return out


def test_repeated_and_null_ids_lose_nothing(spark):
    """Rows that share a doc_id, or have none, are documents of their own."""
    x = "this is the line that both of them have here"
    rows = [(4, x), (5, f"{x}\nkeep me one"), (5, "a quite different line of some six words\nkeep me two"), (None, f"first of none\n{x}"), (None, "second of none\nown words"), (7, None), (5, f"{x}\nkeep me one"), (None, None), (8, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    codes = [r[0] for r in df.selectExpr("xxhash64(text)").collect()]
    want = sorted(survivors(rows, codes), key=str)
    assert sorted(((r["doc_id"], r["text"]) for r in lines.drop_lines(df).collect()), key=str) == want
    assert (5, "a quite different line of some six words\nkeep me two") in want and (None, "second of none\nown words") in want
    counts = sorted(((r["doc_id"], r["n_lines"], r["n_lines"] - len(r["dropped_lines"])) for r in lines.summary(df).collect()), key=str)
    assert counts == sorted(((a[0], len([x for x in (b[1] or "").split("\n") if x.strip()]), len([x for x in (a[1] or "").split("\n") if x.strip()])) for a, b in zip(survivors(rows, codes), rows, strict=True)), key=str)

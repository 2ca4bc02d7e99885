from __future__ import annotations

import collections
import re

import pytest
from parity import SF

from lakesearch.llm import quality as Q


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = collections.defaultdict(list)
    for i in range(len(words) - 4):
        windows[tuple(words[i : i + 5])].append(i)
    repeated = {j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 10 or 100 * len(repeated) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeated), failed


def check(spark, df):
    for r in Q.quality(df).collect():
        q = r["quality"]
        assert brute(r["text"]) == (q["n_words"], q["word_chars"], q["n_symbols"], q["n_dup_lines"], q["n_repeat_words"], q["base_failed"])
        assert not (q["kept"] and q["base_failed"])


def test_counts(spark):
    check(spark, spark.read.parquet(f"{SF}/documents.parquet"))


def test_odd(spark, odd):
    check(spark, odd)


GOOD = "A sentence with enough words to be one, and it ends well.\nAnother line of ordinary prose follows the first one here."
GOOD += "".join(f"\nLine {i} tells of {i * 7} things, then of thing {i * 13}, and closes with number {i * 29}." for i in range(9))


@pytest.mark.parametrize(("line", "stays"), [
    ("A heading", True), ("Home | About | Contact | Help | More", False), ("we*** have### many$$$ signs%%%", False), ("THIS LINE SHOUTS AT ITS READERS ALL THE TIME", False),
    ("Accept cookies to go on.", False), ("for for for for for for for for for for for for for", False), ("an ordinary line, which has no full stop but many words in it", True),
])
def test_line_rules(spark, line, stays):
    r = Q.quality(spark.createDataFrame([(1, f"{GOOD}\n{line}")], "doc_id long, text string")).first()["quality"]
    assert (line in r["clean_text"]) is stays and r["kept"]


def test_labels(spark):
    """Of the labelled documents nearly all of the good stay that the base rules let pass, and nearly all of the bad go."""
    labels = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/labels.parquet")
    docs = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")
    rows = Q.quality(docs, with_text=False).join(labels.withColumnRenamed("quality", "good"), "doc_id").select("good", "quality.kept", "quality.base_failed").collect()
    good = [r["kept"] for r in rows if r["good"] and not r["base_failed"]]
    bad = [r["kept"] for r in rows if not r["good"]]
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.05 * len(bad)

"""Every operator on odd rows and on no rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lakesearch.llm import ctw, decontaminate, dedup, html, langid, licenses, lines, mixing, quality, sharding


def bench(spark):
    return spark.createDataFrame([(1, "a plain sentence of a clean document that says something new and here is another one"), (2, None), (3, ""), (None, "word1 is here word2 is here word3 is here")], "item_id long, text string")


OPERATORS = {
    "quality": lambda d: quality.quality(d), "keep_clean": quality.keep_clean, "near_duplicates": dedup.near_duplicates, "keep_one": dedup.keep_one,
    "leaks": lambda d: decontaminate.leaks(d, bench(d.sparkSession)), "remove_leaks": lambda d: decontaminate.remove_leaks(d, bench(d.sparkSession)),
    "mix": mixing.mix, "realise": mixing.realise, "realise_once": lambda d: mixing.realise(d, max_repeats=1.0, budget_share=None), "shard": sharding.shard, "summary": lines.summary, "drop_lines": lines.drop_lines, "scan": licenses.scan,
    "score": lambda d: ctw.score(d, F.lit(True)), "predict": lambda d: langid.predict(d, langid.learn(d, F.lit(True), per_label=20)),
    "html": lambda d: html.main_text(d.withColumnRenamed("text", "html"), html.train(html.labelled_pages(20))),
}
ALL_ROWS = {"quality", "summary", "near_duplicates", "mix", "shard", "scan", "score", "predict", "html"}
SAME_COLUMNS = {"keep_clean", "keep_one", "remove_leaks", "realise", "realise_once", "drop_lines"}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(odd, name):
    got = OPERATORS[name](odd)
    rows = got.collect()
    if name in ALL_ROWS:
        assert len(rows) == odd.count()
    if name in SAME_COLUMNS:
        assert got.dtypes == odd.dtypes
    else:
        assert rows


@pytest.mark.parametrize("name", OPERATORS)
def test_no_rows(empty, name):
    assert OPERATORS[name](empty).collect() == []


def test_no_benchmark(odd, spark):
    assert decontaminate.leaks(odd, bench(spark).limit(0)).count() == 0
    assert decontaminate.remove_leaks(odd, bench(spark).limit(0)).count() == odd.count()

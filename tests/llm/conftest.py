from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = "_row string, _copies long, _tokens long, _source string, quality string, label long, score double, kept boolean, shard int, _shard int, node long, bucket long, row string, _id long, place string, norm string, h1 long, _text string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns whose names clash."""
    long = " ".join(f"word{i % 997} is here" for i in range(30_000))
    para = "This is a plain sentence of a clean document that says something new.\nAnd here is another one, which ends as it should."
    texts = [None, "", " \n\t ", "x", "***", long, para, para, para.replace("new", "old"), "Ä ö 汉字 😀\n\n\nÄ ö 汉字 😀", "a\x0bb\x0cc\rd", "!!! ???", "1 2 3 4 5", "\n".join(["same line again and again here"] * 50)]
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 2}" if i % 5 else None, len(t) if t else None) for i, t in enumerate(texts)]
    rows += [rows[6], rows[6], (None, para, None, None, None), (None, None, None, None, None)]
    names = CLASH.split(", ")
    return spark.createDataFrame([(*r, *([None] * len(names))) for r in rows], f"{SCHEMA}, {CLASH}")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)

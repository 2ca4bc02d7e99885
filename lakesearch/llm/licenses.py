"""Licence scans by diagonal voting, in DataFrame functions only.

Words are runs of ASCII letters and digits and of anything beyond ASCII, in lower
case (A-Z).  All rolling hashes of `K` words of every document are joined with the
positions they have in the templates, a fixed table of some thousand rows that is
broadcast.  A hit at word i of the document and word j of the template votes for
the diagonal i - j.  Diagonals at most `GAP` apart, as a word more or less leaves
them, are merged, so a merged group is one span of the document.  A span holds if
its hits cover `COVER` of the template's words, all of them where it has `WHOLE` or
fewer, and lie within as many words of the document as the template has plus `SLACK`
of that.

Base labels come from three phrases, counted wherever their words stand one after
the other; the method's labels are added to them, never taken away.

Texts are cut into words once.  Of a word's row only hits, phrases and one row for
each text leave the scan, and they are added up before the shuffle, which goes by
doc_id and a hash of the text: rows that repeat a doc_id keep their own results, and
equal rows, however many, meet as one sum.

Null text counts as empty: no words, no labels, score 0.  A null doc_id is kept as it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

K = 3
GAP = 2
COVER = 0.7
WHOLE = 8
SLACK = 0.5
#: Equal rows are written out again in blocks of this many.
BLOCK = 1 << 12
SEPARATOR = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Phrases with their base labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Labels and how a declared identifier of theirs begins, in words.
IDENTIFIERS = {
    "mit": "mit", "apache": "apache 2 0", "gpl": "gpl", "lgpl": "lgpl", "agpl": "agpl", "bsd": "bsd", "isc": "isc", "mpl": "mpl", "epl": "epl", "bsl": "bsl 1 0", "zlib": "zlib",
    "unlicense": "unlicense", "wtfpl": "wtfpl", "cc0": "cc0", "cc-by": "cc by 4", "cc-by-sa": "cc by sa", "cc-by-nc": "cc by nc 4", "cc-by-nc-nd": "cc by nc nd", "cc-by-nc-sa": "cc by nc sa",
}

#: Fixed values: (label, words) of names, notices and terms of common licences.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache", "subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license"),
    ("gpl", "licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "gnu lesser general public license"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl", "gnu affero general public license"),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "mozilla public license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("epl", "eclipse public license"),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("bsl", "boost software license"),
    ("bsl", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software"),
    ("zlib", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("wtfpl", "do what the fuck you want to public license"),
    ("cc0", "cc0 1 0 universal"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-nc-nd", "licensed under cc by nc nd 4 0"),
    ("cc-by-nc-sa", "licensed under cc by nc sa 4 0"),
    *((label, f"spdx license identifier {x}") for label, x in IDENTIFIERS.items()),
)

def pieces(text: Column) -> Column:
    """The words of a text, with an empty string before or after them where it begins or ends with other characters.

    Lower case by `lower`, which is one pass over ASCII: the Kelvin sign is the one other character that it turns
    into a letter of A-Z, so it gives way to another letter beyond ASCII first.
    """
    return F.split(F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\u00e5"))), SEPARATOR)


def template_grams(spark: SparkSession) -> DataFrame:
    """hash and the places (template, label, length, position) of each run of K words of the templates."""
    rows = [(i, label, len(w), j, *w[j : j + K]) for i, (label, text) in enumerate(TEMPLATES) for w in [text.split()] for j in range(len(w) - K + 1)]
    names = [f"w{i}" for i in range(K)]
    grams = spark.createDataFrame(rows, "template int, label string, length int, pos int, " + ", ".join(f"{x} string" for x in names))
    return grams.groupBy(F.xxhash64(*names).alias("hash")).agg(F.collect_list(F.struct("template", "label", "length", "pos")).alias("places"))


def _phrase(following: list[Column]) -> Column:
    """The base label of the phrase that begins with the first of these words."""
    found = F.lit(None).cast("string")
    for phrase, label in PHRASES.items():
        same = F.lit(True)
        for mine, word in zip(following, phrase.split(), strict=False):
            same = same & (mine == word)
        found = F.when(same, label).otherwise(found)
    return found


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of every row of `docs`."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("doc_id"), F.xxhash64(text).alias("_text"), pieces(F.col(text)).alias("_words"))
    # the outer form, as the plain one would cut the text into words once more to test for an empty array
    every = rows.select("doc_id", "_text", "_words", F.posexplode_outer("_words").alias("piece", "word"))
    following = [F.col("word"), *(F.get("_words", F.col("piece") + k) for k in range(1, max(K, *(len(p.split()) for p in PHRASES))))]
    empty = lambda i: (F.get("_words", i) == "").cast("int")
    before, many = empty(F.lit(0)), F.size("_words")
    every = every.select("doc_id", "_text", (F.col("piece") - before).alias("at"), F.xxhash64(*following[:K]).alias("hash"), _phrase(following).alias("phrase"), F.when(F.col("piece") == 0, many - before - F.when(many > 1, empty(many - 1)).otherwise(0)).alias("n_words"))

    # each row that stays votes: a template's place for its diagonal, a phrase for template -1, a text for template -2
    kept = every.join(F.broadcast(template_grams(spark)), "hash", "left").where("places is not null or phrase is not null or n_words is not null")
    vote = "struct<template:int,label:string,length:int,pos:int>"
    single = lambda template, label, length: F.struct(F.lit(template), label, length, F.lit(None)).cast(vote)
    nothing = F.array().cast(f"array<{vote}>")
    votes = F.concat(
        F.coalesce(F.col("places").cast(f"array<{vote}>"), nothing),
        F.when(F.col("phrase").isNotNull(), F.array(single(-1, F.col("phrase"), F.lit(None)))).otherwise(nothing),
        F.when(F.col("n_words").isNotNull(), F.array(single(-2, F.lit(None), F.col("n_words")))).otherwise(nothing),
    )
    kept = kept.select("doc_id", "_text", "at", F.inline(votes)).withColumn("diagonal", F.col("at") - F.col("pos"))
    votes = kept.groupBy("doc_id", "_text", "template", "label", "length", "diagonal").agg(F.collect_set("pos").alias("positions"), F.min("at").alias("first"), F.max("at").alias("last"), F.count("*").alias("n"))

    order = Window.partitionBy("doc_id", "_text", "template").orderBy("diagonal")
    apart = (F.col("diagonal") - F.lag("diagonal").over(order) > GAP).cast("int")
    spans = votes.withColumn("apart", F.coalesce(apart, F.lit(0))).withColumn("span", F.sum("apart").over(order))
    spans = spans.groupBy("doc_id", "_text", "template", "label", "length", "span").agg(F.flatten(F.collect_list("positions")).alias("positions"), F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("positions", lambda p: F.sequence(p, p + (K - 1))))))
    enough = F.when(F.col("length") <= WHOLE, 1.0).otherwise(COVER)
    spans = spans.withColumn("cover", F.when(F.col("template") >= 0, covered / F.col("length")))
    spans = spans.where((F.col("template") < 0) | ((F.col("cover") >= enough) & (F.col("last") + K - F.col("first") <= F.col("length") * (1 + SLACK))))

    of = lambda test, value: F.when(test, F.col(value))
    one, phrase, method = F.col("template") == -2, F.col("template") == -1, F.col("template") >= 0
    done = spans.groupBy("doc_id", "_text").agg(
        F.max(of(one, "n")).alias("copies"), F.max(of(one, "length")).cast("long").alias("n_words"), F.coalesce(F.sum(of(phrase, "n")), F.lit(0)).alias("places"), F.min(of(phrase, "first")).cast("long").alias("first_word"), F.max(of(phrase, "last")).cast("long").alias("last_word"),
        F.collect_set(of(phrase, "label")).alias("_base"), F.collect_set(of(method, "label")).alias("_found"), F.max("cover").alias("_cover"),
    )
    done = done.withColumn("n_base", F.expr("places div copies")).withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(copies - 1) div {BLOCK}"))))
    done = done.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(BLOCK).cast("long"), F.col("copies") - F.col("_block") * BLOCK))))
    score = F.greatest(F.coalesce("_cover", F.lit(0.0)), F.when(F.col("n_base") > 0, 0.5).otherwise(0.0))
    return done.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join(F.array_sort("_base"), ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union("_base", "_found")), ",").alias("labels"), score.alias("score"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(C.documents(spark, sf_dir))


def oracle_sql() -> str:
    values = ", ".join(f"({i}, '{label}', string_split('{text}', ' '))" for i, (label, text) in enumerate(TEMPLATES))
    gram = lambda w, i: "||' '||".join(f"{w}[{i}{f' + {k}' if k else ''}]" for k in range(K))
    cases = " ".join(f"when {' and '.join(f'w[i + {k}] = {x!r}' for k, x in enumerate(p.split()))} then '{label}'" for p, label in PHRASES.items())
    return f"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') as w from documents),
t(template, label, tw) as (values {values}),
tg as (select template, label, len(tw) as length, j, {gram("tw", "j")} as g from t, lateral (select unnest(range(1, len(tw) - {K - 2})) as j) x),
dg as (select doc_id, i, {gram("w", "i")} as g from d, lateral (select unnest(range(1, len(w) - {K - 2})) as i) x),
hits as (select doc_id, template, label, length, i, j, i - j as diagonal from dg join tg using (g)),
marked as (select *, case when diagonal - lag(diagonal) over (partition by doc_id, template order by diagonal, i) > {GAP} then 1 else 0 end as apart from hits),
spans as (select *, sum(apart) over (partition by doc_id, template order by diagonal, i rows unbounded preceding) as span from marked),
covered as (select doc_id, template, label, length, span, min(i) as first, max(i) as last, len(list_distinct(flatten(list(range(j, j + {K}))))) / length as cover from spans group by doc_id, template, label, length, span),
found as (select doc_id, list(label) as found, max(cover) as cover from covered where cover >= case when length <= {WHOLE} then 1 else {COVER} end and last + {K} - first <= length * {1 + SLACK} group by doc_id),
places as (select doc_id, i - 1 as pos, label from (select doc_id, i, case {cases} end as label from d, lateral (select unnest(range(1, len(w) + 1)) as i) x) where label is not null),
base as (select doc_id, count(*) as n_base, min(pos) as first_word, max(pos) as last_word, list(distinct label) as base from places group by doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word, last_word::bigint as last_word,
  coalesce(array_to_string(list_sort(base), ','), '') as base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(found, [])))), ','), '') as labels,
  greatest(coalesce(cover, 0), case when n_base > 0 then 0.5 else 0 end)::double as score
from d left join found using (doc_id) left join base using (doc_id)"""

from __future__ import annotations

import pytest

from lakesearch import api, settings


def test_merge():
    s = settings.load({"search": {"limit": 5, "evidence": {"max_results": 4}}})
    assert s.search.limit == 5 and s.search.evidence.max_results == 4 and s.search.max_sites == 20
    for bad in ({"x": 1}, {"__class__": 1}, {"search": 3}, {"search": {"limit": "5"}}, {"search": {"evidence": {"default_max_results": 9}}}, {"ranking_mode": "best"}):
        with pytest.raises(settings.InvalidArgument):
            settings.load(bad)


@pytest.mark.parametrize("bad", [
    {"sites": ["a.com"], "include_domains": ["b.com"]}, {"max_evidence_results": 1}, {"sites": ["co.uk"]}, {"sites": ["https://a.com"]}, {"sites": ["127.0.0.1"]}, {"sites": ["a.example.com"], "exclude_domains": ["example.com"]},
    {"evidence_mode": "extract", "max_evidence_results": 9}, {"sites": [f"s{i}.com" for i in range(21)]},
])
def test_resolve_refuses(bad):
    with pytest.raises(settings.InvalidArgument):
        api.resolve(settings.load(), **bad)


def hits(spark):
    rows = [
        (1, 1, 0, 1, "https://example.com/a?utm_source=x", "Spark joins", "All about joins", ["e1"]), (1, 1, 0, 2, "https://other.org/b", "Spark", "Outside", ["e1"]), (1, 1, 0, 3, "https://docs.example.com/c", "Streaming state", "state stores", ["e2"]),
        (1, 2, 0, 1, "https://example.com/a#frag", "Again", "the same page", ["e3"]), (1, 2, 0, 2, "https://example.com/d", "Joins and more joins", "joins", ["e1"]), (1, 3, 0, 1, "https://example.com/late", "Beyond the pages", "", ["e1"]),
    ]
    return spark.createDataFrame(rows, "pool long, page long, branch long, pos long, url string, title string, snippet string, engines array<string>")


def test_search(spark):
    cfg = settings.load()
    queries = spark.createDataFrame([(1, "spark joins")], "pool long, text string")
    spec = api.resolve(cfg, sites=["example.com"], limit=5)
    got = api.websearch(spec, cfg, queries, hits(spark)).orderBy("rank").collect()
    assert [r["url"] for r in got] == ["https://example.com/a", "https://docs.example.com/c", "https://example.com/d"]
    assert got[0]["providers"] == ["e1", "e3"] and got[0]["relevance"]["score"] == 1.0 and got[0]["removed_count"] == 1 and got[0]["evidence_status"] == "not_requested"
    ranked = api.websearch(api.resolve(cfg, sites=["example.com"], ranking_mode="bm25_mmr", limit=2), cfg, queries, hits(spark)).orderBy("rank").collect()
    assert [r["url"] for r in ranked][0] == "https://example.com/a" and len(ranked) == 2 and ranked[0]["corpus_size"] == 3
    second = api.websearch(api.resolve(cfg, sites=["example.com"], limit=2, offset=2), cfg, queries, hits(spark)).collect()
    assert [r["rank"] for r in second] == [3]


def test_search_with_evidence(spark):
    cfg = settings.load()
    queries = spark.createDataFrame([(1, "spark joins")], "pool long, text string")
    pages = spark.createDataFrame([("https://example.com/a", "Intro text.\n\nSpark joins two tables by key.\n\nThe end of it."), ("https://docs.example.com/c", "Nothing of that kind.")], "url string, text string")
    spec = api.resolve(cfg, sites=["example.com"], evidence_mode="extract", max_evidence_results=2)
    got = {r["url"]: r for r in api.websearch(spec, cfg, queries, hits(spark), pages).collect()}
    assert got["https://example.com/a"]["evidence_status"] == "verified" and "Spark joins two tables" in got["https://example.com/a"]["quotes"][0]["quote"]
    assert got["https://docs.example.com/c"]["evidence_status"] == "no_match" and got["https://example.com/d"]["evidence_status"] == "skipped_budget"


def test_fetch(spark):
    text = "one\n\ntwo 😀\n\nthree"
    got = api.webfetch(settings.load(), spark.createDataFrame([("https://example.com/a", text)], "url string, text string"), 7).orderBy("page").collect()
    assert "".join(r["content"] for r in got) == text and [r["truncated"] for r in got] == [True, True, False]
    assert [(s["id"], s["start_char"], s["end_char"]) for s in got[0]["segments"]] == [("segment_1", 0, 5), ("segment_2", 5, 7)]
    with pytest.raises(settings.InvalidArgument):
        api.webfetch(settings.load(), spark.createDataFrame([("u", "t")], "url string, text string"), 60_000)


def test_refusals_of_rows(spark):
    rows = [(1, ["a.example.com"], None, None), (1, ["a.example.com"], ["b.example.com"], None), (None, None, None, 3), (4, ["nohost"], None, None), (5, [], None, None)]
    df = spark.createDataFrame(rows, "id long, sites array<string>, include_domains array<string>, max_evidence_results int")
    got = sorted(map(tuple, api.refusals(df, "id").collect()), key=str)
    assert got == sorted([(1, None), (1, "use sites or include_domains, not both"), (None, "max_evidence_results and fetch_engine need evidence_mode extract"), (4, "'nohost' is no registrable host name"), (5, None)], key=str)
    assert api.refusals(df.limit(0), "id").collect() == []


def test_patches_of_rows(spark):
    df = spark.createDataFrame([(1, None), (2, '{"fetch":{"max_chars":7}}'), (3, "[]"), (4, "{"), (5, '{"ranking_mode":"x"}')], "id long, patch string")
    got = {r["id"]: (r["refused"], r["settings"]) for r in settings.patched(df, "id").collect()}
    assert got[1][0] is None and '"max_chars":12000' in got[1][1] and got[2][0] is None and '"max_chars":7,' in got[2][1]
    assert got[3] == ("a patch is an object", None) and got[4][0] and got[4][1] is None and got[5] == ("no ranking mode x", None)
    assert settings.patched(df.limit(0), "id").collect() == []

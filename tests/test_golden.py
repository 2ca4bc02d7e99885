"""Small cases with known answers."""

from __future__ import annotations

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lakesearch.functions import text as X
from lakesearch.functions import urls as U
from lakesearch.operators import evaluation as E
from lakesearch.operators import evidence as EV
from lakesearch.operators import health as H
from lakesearch.operators import passages as P
from lakesearch.operators import ranking as R
from lakesearch.operators import redaction as RD
from lakesearch.operators import segments as S
from lakesearch.operators import traces as TR
from lakesearch.operators.cache import Replay
from lakesearch.sources import html_pages as HP


def one(spark, column, **values):
    rows = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'long'}" for k, v in values.items()))
    return rows.select(column).first()[0]


@pytest.mark.parametrize(("query", "text", "score", "method"), [
    ("ｆｕｌｌｗｉｄｔｈ MCP tools site:example.com", "MCP protocol", 1 / 3, "lexical_coverage_v1"), ("mcp tools", "MCP protocol", 0.5, "lexical_coverage_v1"),
    ("site:example.com", "text", None, "none"), ("a", "", None, "none"), ("a", "b", 0.0, "lexical_coverage_v1"),
])
def test_coverage(spark, query, text, score, method):
    got = one(spark, X.coverage(F.col("q"), F.col("t")), q=query, t=text)
    assert got["method"] == method and (got["score"] is None if score is None else math.isclose(got["score"], score))


def test_tokens(spark):
    assert one(spark, X.tokens(F.col("t")), t="Été 2024, x_y 搜索ab引擎") == ["été", "2024", "x", "y", "搜", "索", "ab", "引", "擎"]


def test_nfkc_tokens(spark):
    assert one(spark, X.nfkc_tokens(F.col("t")), t="ＭＣＰ Ünï１") == ["mcp", "ünï1"]


@pytest.mark.parametrize(("text", "heading"), [("Title", True), ("A sentence.", False), ("问题？", False), ("  ", False), ("x" * 101, False)])
def test_heading(spark, text, heading):
    assert one(spark, X.is_heading(F.col("t")), t=text) is heading


@pytest.mark.parametrize(("text", "yes"), [("If so", True), ("Iffy", False), ("You must go", True), ("如果这样", True), ("这里不能用", True), ("plain", False), ("mustard", False)])
def test_qualifier(spark, text, yes):
    assert one(spark, X.qualifies_context(F.col("t")), t=text) is yes


def test_bm25_order(spark):
    q = spark.createDataFrame([(1, 0, "rare common")], "query long, pool int, text string")
    docs = spark.createDataFrame([(0, 0, "common words here"), (0, 1, "rare common"), (0, 2, "common common")], "pool int, id long, text string")
    got = R.top(R.bm25(q, docs), 5).orderBy("rank").collect()
    assert [r["id"] for r in got] == [1, 2, 0]


def test_mmr_prefers_new_terms():
    sets = [frozenset("ab"), frozenset("ab"), frozenset("cd")]
    assert R.mmr_order([1.0, 0.95, 0.9], sets) == [0, 2, 1]
    assert R.mmr_order([0.0, 0.0], sets[:2]) == [0, 1]


def test_rank_fusion(spark):
    lists = spark.createDataFrame([(1, 0, "a", 1), (1, 0, "b", 2), (1, 0, "a", 3), (1, 1, "b", 1), (1, 1, "c", 2)], "query long, list long, id string, pos long")
    got = {r["id"]: r["score"] for r in R.reciprocal_rank_fusion(lists).collect()}
    assert math.isclose(got["a"], 1 / 61) and math.isclose(got["b"], 1 / 62 + 1 / 61) and math.isclose(got["c"], 1 / 62)
    with pytest.raises(ValueError, match="positive"):
        R.reciprocal_rank_fusion(lists, 0)


def test_metrics(spark):
    ranking = spark.createDataFrame([(1, "c", 1), (1, "b", 2), (1, "a", 3), (2, "x", 1)], "query long, id string, rank long")
    judged = spark.createDataFrame([(1, "a", 2), (1, "b", 1), (1, "c", 0), (2, "x", 0)], "query long, id string, grade long")
    got = {r["query"]: r for r in E.metrics(ranking, judged, 2).collect()}
    assert math.isclose(got[1]["ndcg"], (1 / math.log2(3)) / (3 + 1 / math.log2(3))) and got[1]["mrr"] == 0.5 and got[1]["recall"] == 0.5
    assert got[2]["ndcg"] is None and got[2]["mrr"] is None and got[2]["recall"] is None
    assert E.mismatches(ranking, judged).count() == 0
    assert E.mismatches(ranking.union(spark.createDataFrame([(1, "c", 4)], ranking.schema)), judged.where("id <> 'b'")).count() == 2


@pytest.mark.parametrize(("url", "inside"), [
    ("https://docs.example.com/a", True), ("https://evil-example.com/", False), ("https://example.com.evil.net/", False), ("https://a.private.example.com/", False), ("https://u@example.com/", False), ("ftp://example.com", False), ("https://EXAMPLE.com./x", True),
])
def test_scope(spark, url, inside):
    assert one(spark, U.in_scope(F.col("u"), ["example.com"], ["private.example.com"]), u=url) is inside


@pytest.mark.parametrize(("url", "canonical"), [
    ("HTTPS://Example.com:443?utm_source=x&b=2&UTM_ID=1&a=1&b=2#f", "https://example.com/?b=2&a=1&b=2"), ("http://example.com/a?gclid=1", "http://example.com/a"), ("http://u:p@example.com/", None), ("nonsense", None), ("http://example.com:8080/?", "http://example.com:8080/"),
])
def test_canonical(spark, url, canonical):
    assert one(spark, U.canonical(F.col("u")), u=url) == canonical


@pytest.mark.parametrize(("name", "domain"), [("Example.COM.", "example.com"), ("co.uk", None), ("a.co.uk", "a.co.uk"), ("127.0.0.1", None), ("0x7f.1", None), ("com", None), ("a b.com", None), ("-a.com", None)])
def test_domain(spark, name, domain):
    assert one(spark, U.normal_domain(F.col("n")), n=name) == domain


@pytest.mark.parametrize(("address", "public"), [("8.8.8.8", True), ("10.0.0.1", False), ("::1", False), ("2001:4860:4860::8888", True), ("169.254.1.1", False), ("x", False)])
def test_public_address(spark, address, public):
    assert one(spark, U.is_public_address(F.col("a")), a=address) is public


@pytest.mark.parametrize(("value", "date"), [("2024-02-30", None), ("2024-02-29", "2024-02-29 00:00:00"), ("2024-03-01T10:00:00+02:00", "2024-03-01 08:00:00"), ("March 1", None), ("2024-03-01T10:00:00", None)])
def test_strict_date(spark, value, date):
    assert one(spark, X.strict_date(F.col("d")).cast("string"), d=value) == date


@pytest.mark.parametrize("text", ["", "a", "a\n\nb", "\n\n\na\nb\n\n\n\nc\n", "😀é\n\n汉字", "\n"])
def test_segments_cover_text(spark, text):
    docs = spark.createDataFrame([(1, text, "https://example.com/x")], "doc_id long, text string, url string")
    found = S.segments(docs).orderBy("n").collect()
    assert "".join(r["text"] for r in found) == text
    assert all(text[r["start_char"] : r["end_char"]] == r["text"] for r in found)
    snaps = S.snapshot(docs)
    assert S.integrity_violations(snaps).count() == 0
    assert {r["rule"] for r in S.integrity_violations(snaps.withColumn("content", F.lit("other\n\n\n"))).collect()} >= {"hash"}


def test_pages_round_trip(spark):
    text = "a😀" * 700
    got = S.pages(spark.createDataFrame([(1, text), (2, "")], "doc_id long, text string"), 500).orderBy("doc_id", "page").collect()
    assert "".join(r["content"] for r in got if r["doc_id"] == 1) == text
    assert [r["next_offset"] for r in got] == [500, 1000, None, None]


def test_long_sentence_is_left_out():
    text = "needle " * 100
    assert P.select(text, [(0, len(text))], "needle", 5, 50) == []


def test_heading_alone_is_no_evidence():
    text = "Needle\n\nnothing here to see at all.\n\n"
    spans = [(0, 8), (8, len(text))]
    got = P.select(text, spans, "needle", 5, 200)
    assert [(p["start_char"], p["end_char"]) for p in got] == [(0, len(text))]
    assert P.select("Needle\n\n", [(0, 8)], "needle", 5, 200) == []


def test_han_passages():
    text = "标题\n\n如果使用搜索引擎。\n\n别的内容在这里。"
    got = P.select(text, [(0, 4), (4, 15), (15, len(text))], "搜索", 3, 200)
    assert got and "搜索引擎" in got[0]["quote"] and got[0]["coverage"] == 1.0


def test_choice_against_sorting_anew():
    """The heap chooses what sorting all that is left before each pick chooses."""
    rng = random.Random(7)
    for _ in range(200):
        terms = list("abcdef")
        candidates = []
        for _ in range(rng.randint(0, 12)):
            a = rng.randint(0, 60)
            candidates.append(P.Passage(a, a + rng.randint(1, 12), sorted(rng.sample(terms, rng.randint(0, 4)))))
        frequency = Counter({t: rng.randint(1, 5) for t in terms})
        want, known, left = [], set(), list(candidates)
        while left and len(want) < 4:
            best = min(left, key=lambda p: (-sum((2 - (t in known)) / frequency[t] for t in p.terms), -len(p.terms), p.start))
            left.remove(best)
            if all(best.end <= p.start or p.end <= best.start for p in want):
                want.append(best)
                known |= set(best.terms)
        assert [(p.start, len(p.terms)) for p in P.choose(candidates, frequency, 4)] == [(p.start, len(p.terms)) for p in want]


def test_rare_terms_first():
    parts = ["alpha one two three four five six.\n\n", "alpha seven eight nine ten words.\n\n", "beta once only stands in this one.\n\n"]
    text, spans, at = "".join(parts), [], 0
    for p in parts:
        spans.append((at, at + len(p)))
        at += len(p)
    got = P.select(text, spans, "alpha beta", 3, 40)
    assert [p["quote"].split()[0] for p in got] == ["beta", "alpha", "alpha"]


def test_evidence_page_stops_at_first_overflow(spark):
    rows = spark.createDataFrame([(1, 1, 50, "x" * 40), (1, 2, 0, "y" * 100), (1, 3, 20, "z" * 10)], "id long, priority long, start_char long, quote string")
    got = EV.first_page(rows, 3, 100, ["id"]).collect()
    assert [r["priority"] for r in got] == [1]


def test_one_probe_at_a_time(spark):
    none = None
    rows = [
        ("p", 0, 2, 1, ["a", "b"], none, none, False), ("p", 10, 0, 1, none, "a", "TIMEOUT", False), ("p", 10, 0, 1, none, "b", "UPSTREAM_BLOCKED", False), ("p", 10, 1, 1, none, none, none, False),
        ("p", 20, 2, 2, ["a", "b"], none, none, False),  # both rest
        ("p", 30_010, 2, 3, ["a", "b"], none, none, False), ("p", 30_011, 2, 4, ["a", "b"], none, none, False),  # the first probes a
        ("p", 30_020, 0, 4, none, "a", none, True),  # an answer nobody asked for
        ("p", 30_030, 0, 3, none, "a", none, True), ("p", 30_030, 1, 3, none, none, none, False), ("p", 30_040, 2, 5, ["a", "b"], none, none, False), ("q", 5, 2, 6, ["a"], none, none, False),
        ("p", 300_010, 2, 7, ["a", "b"], none, none, False), ("p", 300_020, 1, 7, none, none, none, False), ("p", 300_030, 2, 8, ["b"], none, none, False),  # a probe that ended without an answer
    ]
    df = spark.createDataFrame([(*r, False, True) for r in rows], "pool string, at long, kind int, request long, sources array<string>, source string, code string, succeeded boolean, suspended boolean, complete boolean")
    got = {r["request"]: (r["asked"], r["skipped"], r["probes"], r["error"], r["retry_ms"]) for r in H.admissions(df).collect()}
    assert got == {
        1: (["a", "b"], [], [], none, none), 2: ([], ["a", "b"], [], "UPSTREAM_BLOCKED", 29_990), 3: (["a"], ["b"], ["a"], none, none), 4: ([], ["a", "b"], [], "UPSTREAM_BLOCKED", 0),
        5: (["a"], ["b"], [], none, none), 6: (["a"], [], [], none, none), 7: (["a", "b"], [], ["b"], none, none), 8: (["b"], [], ["b"], none, none),
    }


def test_breaker():
    s = H.State()
    s.observe(1, 0, "TIMEOUT", None, False, True)
    assert s.cooldown_until == 30_000 and s.status(10) == "cooling_down" and s.status(30_000) == "half_open"
    s.observe(2, 40_000, "UPSTREAM_BLOCKED", None, False, True)
    assert s.cooldown_until == 40_000 + 600_000
    s.observe(1, 50_000, None, None, True, True)
    assert s.consecutive == 2  # late: ignored
    s.observe(3, 60_000, None, None, False, False)
    assert s.consecutive == 2  # says nothing: unchanged
    s.observe(4, 70_000, None, None, True, True)
    assert s.status(70_000) == "healthy" and s.consecutive == 0
    for k in range(40):
        s.observe(5 + k, 0, "TIMEOUT", None, False, True)
    assert s.cooldown_until == 1_800_000


def test_cache_replay():
    c = Replay(ttl=100, entries=2, size=1000)
    assert [c.request("a", 0, 10, False), c.request("a", 50, 10, False), c.request("a", 100, 10, False)] == [False, True, False]
    assert c.request("b", 110, 10, True) is False and c.request("b", 111, 10, False) is False  # failures are not kept
    c.request("c", 112, 10, False)
    assert set(c.held) == {"b", "c"}
    assert c.request("big", 113, 5000, False) is False and "big" not in c.held


def test_span_depths(spark):
    rows = [(1, "a", None), (1, "b", "a"), (1, "c", "b"), (1, "lost", "gone"), (1, "m", "lost"), (1, "x", "y"), (1, "y", "x")]
    rows += [(2, str(i), str(i - 1) if i else None) for i in range(12)]
    got = {(r["run"], r["span"]): r["depth"] for r in TR.depths(spark.createDataFrame(rows, "run long, span string, parent string"), ("span",)).collect()}
    assert got[1, "c"] == 2 and got[1, "lost"] == 0 and got[1, "m"] == 1 and got[1, "x"] == 0 and got[1, "y"] == 1 and got[2, "11"] == 6 and got[2, "3"] == 3


def test_redaction_bounds():
    wide = RD.redact({f"status{i}": i for i in range(40)}, True)
    assert "status23" in wide and "status24" not in wide
    assert RD.redact([1.5, float("inf"), None, True], True) == '[1.5,"[non-finite]",null,true]'
    assert RD.redact({"site_url": "ftp://a/b", "link": "HTTPS://u@Host.org:8080/p?q", "uri": "no address"}, True) == '{"site_url":"[redacted URL]","link":"https://host.org:8080/p","uri":"[invalid URL]"}'
    assert len(RD.redact(["\"\\" * 400] * 30, True)) <= 2000 and RD.redact("x" * 3000, True).endswith('…"')
    assert RD.redact({"a": [{"note": "Bearer x"}]}, True) == '{"a":[{"note":{"redacted":true,"chars":8}}]}'


def test_redaction():
    got = RD.redact({"api_key": "x", "status": "ok", "note": "private", "url": "https://u:p@example.com/a?b#c", "message": {"a": 1}, "deep": {"a": {"b": {"c": {"d": {"e": {"f": 1}}}}}}})
    assert got.startswith('{"api_key":"[redacted]","status":"ok","note":{"redacted":true,"chars":7},"url":"https://example.com","message":{"redacted":true}')
    assert "[truncated]" in got
    assert len(RD.redact({f"status{i}": ["x" * 80] * 30 for i in range(24)})) <= 2000


PAGE = """<html lang=en><head><title>A &amp; B</title><meta property="og:site_name" content="Site"></head><body><nav><a href=/x>menu</a></nav><article><h1>Head</h1><p>First paragraph, with a <a href="/rel">link</a> and enough text to read.</p>
<script>var x='<p>no</p>'</script><ul><li>one<li>two</ul><table><tr><td>a</td><td>b</td></tr></table><pre><code>x = 1</code></pre></article><footer>foot</footer></body></html>"""


def test_extract():
    got = HP.extract(PAGE, "https://example.com/p")
    assert got["title"] == "A & B" and got["error"] is None
    assert "menu" not in got["text"] and "foot" not in got["text"] and "var x" not in got["text"] and got["text"].startswith("Head\n")
    assert "# Head" in got["markdown"] and "[link](https://example.com/rel)" in got["markdown"] and "```\nx = 1\n```" in got["markdown"] and "| a | b |" in got["markdown"]
    assert HP.extract("<p>short</p>", "https://example.com")["error"] == "EXTRACTION_FAILED"
    assert HP.extract("<div>" * 600, "https://example.com")["error"] == "EXTRACTION_FAILED"
    assert HP.extract(None, "https://example.com")["error"] == "EXTRACTION_FAILED"


def test_json_ld_logo_order():
    def page(*objects):
        return "".join(f'<script type="application/ld+json">{o}</script>' for o in objects)

    org, site = '{"@type":"Organization","logo":"/org.png"}', '{"@type":"WebSite","logo":{"url":"https://example.com/site.png"}}'
    assert HP.json_ld_logo(page(org, site), "https://example.com/a") == "https://example.com/site.png"
    assert HP.json_ld_logo(page("nonsense", org), "https://example.com/a") == "https://example.com/org.png"
    assert HP.json_ld_logo(page('{"@type":"Organization","url":"https://other.org","logo":"/o.png"}'), "https://example.com/a") is None
    assert HP.json_ld_logo(page('{"mentions":{"@type":"Organization","logo":"/o.png"}}'), "https://example.com/a") is None


def test_single_flight_and_pacing(spark):
    from lakesearch.operators import flow as FL

    rows = [("p", 1, "a", 0, 10), ("p", 2, "a", 5, 10), ("p", 3, "a", 10, 10), ("p", 4, "b", 12, 1), ("p", 5, "a", 19, 1), ("q", 6, "a", 1, 5)]
    r = spark.createDataFrame(rows, "pool string, seq long, key string, at long, duration long")
    assert {x["seq"]: x["call"] for x in FL.single_flight(r).collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 3, 6: 6}
    assert {x["seq"]: x["starts"] for x in FL.paced(r, 2, 2).collect()} == {1: 0, 2: 5, 3: 10, 4: 15, 5: 19, 6: 1}
    assert {x["seq"]: x["starts"] for x in FL.spaced(r, 6).collect()} == {1: 0, 2: 6, 3: 12, 4: 18, 5: 24, 6: 1}
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 5)], "parent long, node long")
    assert sorted(x["node"] for x in FL.reachable(edges, spark.createDataFrame([(2,)], "node long")).collect()) == [1, 2, 3]
    chain = spark.range(1, 200).selectExpr("id - 1 as parent", "id as node")
    assert sorted(x["node"] for x in FL.reachable(chain, spark.createDataFrame([(90,), (500,)], "node long")).collect()) == [*range(90, 200), 500]
    net = chain.union(spark.createDataFrame([(3, 9), (199, 0)], "parent long, node long")).where("node < 20 or parent = 199")
    assert sorted(x["node"] for x in FL.reachable(net, spark.createDataFrame([(2,)], "node long")).collect()) == list(range(2, 20))


def test_bodies():
    import zlib

    from lakesearch.sources.bodies import decode

    gz = zlib.compressobj(9, zlib.DEFLATED, 31)
    bomb = gz.compress(b"x" * 1_000_000) + gz.flush()
    assert decode(bomb, "gzip", most_out=1000) == (None, "RESPONSE_TOO_LARGE") and decode(bomb, "gzip", most_out=2_000_000)[0] == b"x" * 1_000_000
    raw = zlib.compressobj(9, zlib.DEFLATED, -15)
    assert decode(raw.compress(b"abc") + raw.flush(), "deflate") == (b"abc", None)
    assert decode(b"abc", "br")[1] == "UNSUPPORTED_ENCODING" and decode(b"abc", "gzip")[1] == "HTTP_ERROR" and decode(bomb[:20], "gzip")[1] == "HTTP_ERROR" and decode(None, None)[1] == "HTTP_ERROR"

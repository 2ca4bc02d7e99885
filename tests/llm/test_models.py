"""Trained models: language identification, context-tree weighting, page extraction."""

from __future__ import annotations

import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from parity import SF
from pyspark.sql import functions as F

from lakesearch.llm import common as C
from lakesearch.llm import ctw, html, langid
from lakesearch.llm.queries import QUERIES

SF01 = SF.replace("0.001", "0.01")


def test_language_held_out(spark):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF01}/documents.parquet").collect()}
    rows = QUERIES["op2_language_id"](spark, SF01).collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows) and len(rows) == len(docs)
    assert sum(r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_network_tables_against_direct_sums():
    net = langid.train([b"the cat and the dog ", b"der hund und die katze "], ["en", "de"], steps=30)
    texts = ["the cat", "", "x" * 700, "katze " * 100]
    data, bounds = C.text_bytes(pa.array(texts))
    got = langid.probabilities(net, net.tables(), data, bounds)
    for text, p in zip(texts, got):
        raw, stride = text.lower().encode(), langid.LENGTH - max(langid.WIDTHS) + 1
        total, at = np.zeros(2), 0
        while True:
            window = raw[at : at + langid.LENGTH]
            x = np.frombuffer(window.ljust(langid.LENGTH, b"\0"), np.uint8)
            pooled = np.concatenate([np.max([sum(f[i][x[j + i]] for i in range(w)) for j in range(langid.LENGTH - w + 1)], axis=0) for w, f in zip(langid.WIDTHS, net.filters)])
            z = np.maximum(pooled + net.bias, 0) @ net.out + net.out_bias
            e = np.exp(z - z.max())
            total += e / e.sum() * max(len(window), 1)
            at += stride
            if at + max(langid.WIDTHS) - 1 >= len(raw):
                break
        assert np.allclose(p, total / total.sum(), atol=1e-4)


def test_undetermined(spark):
    df = spark.createDataFrame([(1, None, "en"), (2, "12 34 !?", "en"), (3, "", "en"), (4, "hello there", "en"), (5, "汉", None)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(df, langid.train([b"hello"], ["en"], steps=2)).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[4][0] == "en" and got[5][0] == "en"


def test_labelled_null_text_is_not_learned(spark, monkeypatch):
    drawn = []
    monkeypatch.setattr(langid, "train", lambda texts, labels: drawn.extend(zip(texts, labels, strict=True)))
    df = spark.createDataFrame([(1, None, "en"), (2, "", "en"), (3, "Hello there", "en"), (4, "der hund", "de"), (5, None, "fr")], "doc_id long, text string, lang string")
    langid.learn(df, df.doc_id > 0)
    assert drawn == [(b"hello there", "en"), (b"der hund", "de")]


def _kt(a, b):
    return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)


def _log_weighted(counts, lo, mid, hi):
    """log P_w of one decision's context tree from counts of (context, symbol), by plain recursion over the contexts seen."""

    def weigh(depth, pairs):
        a = sum(n for (_, x), n in pairs.items() if lo <= x < mid)
        b = sum(n for (_, x), n in pairs.items() if mid <= x < hi)
        own = _kt(a, b)
        if depth == ctw.DEPTH:
            return own
        below = 0.0
        for c in {c[depth] for (c, _) in pairs}:
            below += weigh(depth + 1, {k: n for k, n in pairs.items() if k[0][depth] == c})
        return np.logaddexp(own, below) - math.log(2)

    return weigh(0, counts)


def _split(code):
    """(context, nearest first; symbol) of a code."""
    raw = int(code).to_bytes(8, "big")
    return tuple(raw[1:7]), raw[7]


def _values(code):
    keys, n = np.unique(code, return_counts=True)
    upper = ctw.Upper(*ctw.upper_sums(keys, n))
    return dict(zip(*(x.tolist() for x in ctw.log10s(upper, keys, n)), strict=True))


def test_pairs_against_recursion():
    """The probability of a symbol is the ratio of weighted probabilities with and without it."""
    text = "abracadabra, a barbarian abracadabra; brababra été".encode()
    code, _ = ctw.codes(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    counts, got = Counter(map(_split, code.tolist())), _values(code)
    for c in code[::4].tolist():
        want, lo, hi, (context, x) = 0.0, 0, 256, _split(c)
        more = counts.copy()
        more[context, x] += 1
        while hi - lo > 1:
            mid = (lo + hi) // 2
            want += _log_weighted(more, lo, mid, hi) - _log_weighted(counts, lo, mid, hi)
            lo, hi = (lo, mid) if x < mid else (mid, hi)
        assert math.isclose(got[c], want / math.log(10), rel_tol=1e-7, abs_tol=1e-9)


def test_blocks_and_unseen_pairs():
    """Blocks of pairs weighted apart give what one block gives, and all symbols of a context, seen or not, sum to one."""
    rng = random.Random(4)
    text = " ".join(rng.choice(["the", "then", "другой", "汉字", "a"]) for _ in range(400)).encode()
    code, _ = ctw.codes(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    keys, n = np.unique(code, return_counts=True)
    asked = np.concatenate([(int(c) >> 8 << 8) + np.arange(256) for c in (code[50], code[200], 0x00FFFFFFFFFFFF00, int(code[99]) ^ (7 << 8))])
    more = np.setdiff1d(asked, keys)
    keys, n = np.concatenate([keys, more]), np.concatenate([n, np.zeros(len(more), np.int64)])
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    whole = dict(zip(*ctw.log10s(ctw.Upper(*ctw.upper_sums(keys, n)), keys, n), strict=True))
    cuts = [0, *(np.flatnonzero(np.diff(keys >> 32)) + 1)[::5].tolist(), len(keys)]
    parts = [ctw.upper_sums(keys[i:j], n[i:j]) for i, j in zip(cuts, cuts[1:])]
    name, back = np.unique(np.concatenate([x[0] for x in parts]), return_inverse=True)
    upper = ctw.Upper(name, *(np.bincount(back, np.concatenate([x[k] for x in parts]), len(name)) for k in (1, 2, 3)))
    for i, j in zip(cuts, cuts[1:]):
        for key, value in zip(*ctw.log10s(upper, keys[i:j], n[i:j]), strict=True):
            assert math.isclose(value, whole[key], rel_tol=1e-7, abs_tol=1e-9)
    for i in range(0, len(asked), 256):
        assert math.isclose(sum(10 ** whole[c] for c in asked[i : i + 256]), 1, rel_tol=1e-6)


@pytest.mark.parametrize("words", ["это слова русского языка которые стоят друг за другом без всякого порядка и смысла", "αυτές είναι λέξεις της ελληνικής γλώσσας χωρίς καμία σειρά και νόημα", "的一是在不了有和人这中大为上个国我以要他", "these are words of a language that stand here in no order at all"])
def test_held_out_texts_of_all_scripts(spark, words):
    """Words in no order, for which the word model is the best there is: within 5 % of it, and few bits a byte.
    A text without spaces is one unknown word to the word model, so for it only the bits a byte tell."""
    rng = random.Random(8)
    some = words.split() if " " in words else list(words)
    rows = [(i, (" " if " " in words else "").join(rng.choices(some, k=30))) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    held = ctw.score(df, F.col("doc_id") % 10 != 0).where("held_out").selectExpr("sum(score)", "sum(base_score)", "avg(bits_per_byte)").first()
    assert held[2] < 1.6 and (" " not in words or held[0] > 1.05 * held[1])


def test_scores(spark):
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = {d: [*re.findall(r"[^\x20\x09-\x0D]+", t.translate(low)), None] for d, t in text.items()}
    c = Counter(w for d in text if zlib.crc32(str(d).encode()) % 10 for w in tokens[d])
    n, v = sum(c.values()), len(c)
    rows = QUERIES["op5_lm_scoring"](spark, SF).collect()
    assert len(rows) == len(text)
    for r in rows:
        own = tokens[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(c[w] > 0 for w in own), n)
        assert math.isclose(r["base_score"], sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own), rel_tol=1e-9) and r["score"] < 0


def test_rare_words_meet_their_counts(spark, monkeypatch):
    """With hardly any word or pair broadcast the scores are the same."""
    want = {r["doc_id"]: (r["base_score"], r["score"]) for r in QUERIES["op5_lm_scoring"](spark, SF).collect()}
    monkeypatch.setattr(ctw, "FREQUENT", 50)
    monkeypatch.setattr(ctw, "PAIRS", 1000)
    monkeypatch.setattr(ctw, "HELD", 1000)
    got = {r["doc_id"]: (r["base_score"], r["score"]) for r in QUERIES["op5_lm_scoring"](spark, SF).collect()}
    assert all(math.isclose(a, b, rel_tol=1e-7) for d in want for a, b in zip(want[d], got[d], strict=True))


@pytest.fixture(scope="module")
def model():
    return html.standard()


def test_held_out_pages(model):
    total = wrong = 0
    for page in map(html.parse, html.labelled_pages(200, seed=4)):
        odds = html.messages(page, model, html.features(page), html.kinds(page))[2]
        for i in {n for n, _, t, _ in page.runs if t.strip()}:
            total += 1
            wrong += (odds[i] >= 0) != bool(page.labels[i])
    assert wrong <= 0.01 * total


def test_messages_against_enumeration(model):
    page = html.parse("<body><nav>a b</nav><div class=content><p>Some words here.<p>x<aside>ad</aside></div></body>")
    feats, kind = html.features(page), html.kinds(page)
    n = len(page.tags)
    own = [sum(model.node.get(f, 0.0) for f in x) for x in feats]
    mass, ones = 0.0, [0.0] * n
    for bits in range(1 << n):
        y = [(bits >> i) & 1 for i in range(n)]
        score = sum(o for o, v in zip(own, y) if v) + sum(model.edge.get(kind[i], [0.0] * 4)[2 * y[page.parent[i]] + y[i]] for i in range(1, n))
        p = math.exp(score)
        mass += p
        for i in range(n):
            ones[i] += p * y[i]
    odds = html.messages(page, model, feats, kind)[2]
    assert all(math.isclose(1 / (1 + math.exp(-o)), x / mass, abs_tol=1e-9) for o, x in zip(odds, ones))


def test_pages(spark, model):
    """Against the article element's text, its blocks joined."""
    for r in spark.read.parquet(f"{SF01}/pages.parquet").collect():
        inner = re.search(r"<article[^>]*>(.*?)</article>", r["html"], re.DOTALL)[1]
        blocks = re.split(r"</?(?:p|h1|br|article)\b[^>]*>", inner)
        import html as entities

        want = " ".join(x for x in (" ".join(entities.unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in blocks) if x)
        assert html.extract(r["html"], model) == want


@pytest.mark.parametrize(("page", "text"), [
    (None, ""), ("", ""), ("plain &amp; simple\n text", "plain & simple text"),
    ('<html><body><header><h1>Site</h1></header><div id="content"><h1>Title</h1><p>One&nbsp;two,\n three.<p>Four <b>fi</b>ve.<br>Six.</div><div id="comments"><p>Great post, thanks.</p></div><footer>(c)</footer></body></html>', "Title One two, three. Four five. Six."),
    ('<body><nav><a href=/>Home</a></nav><main><article><p>Body text goes here &lt;b&gt;.</p><form><input><label>Mail</label></form><script>var a="</p>";</script></article></main><aside class="sidebar"><p>Related things.</p></aside></body>', "Body text goes here <b>."),
])
def test_small_pages(model, page, text):
    assert html.extract(page, model) == text


BODY = "<h1>The title</h1><p>A first sentence of the article stands here, with some words. And then a second one follows.</p>"
TEXT = "The title A first sentence of the article stands here, with some words. And then a second one follows."


@pytest.mark.parametrize("page", [
    f"<body class='has-sidebar'><article>{BODY}</article></body>", f"<body><div id='page' class='no-sidebar'><div class='post'>{BODY}</div></div></body>",
    f"<body><article class='post tag-news'>{BODY}</article></body>", f"<body><div class='site-header-fixed'><main>{BODY}</main></div></body>",
    f"<body><article class='social-media story'>{BODY}</article></body>", f"<body><main id='content' class='left-side'>{BODY}</main></body>",
    f"<body><div class='body has-comments'><article>{BODY}</article></div></body>", f"<body><main><div class='text more'>{BODY}</div></main></body>",
    f"<body><article><svg class=x/>{BODY}</article></body>", f"<body><article><svg class=x><title>icon</title><g/></svg>{BODY}</article></body>",
    f"<body><article><video src=x>{BODY}</article></body>", f"<body><article><object data=x>{BODY}</article></body>", f"<body><article><iframe src=x>{BODY}</article></body>",
    f"<body><nav><a href=/>Home</a> <a href=/b>News</a></nav><article><audio controls>No sound here</audio>{BODY}</article><script>if (a < b) x()</script><footer>Rights</footer></body>",
])
def test_names_and_left_open_elements_lose_nothing(model, page):
    assert html.extract(page, model) == TEXT


@pytest.mark.parametrize("page", [
    '<a "' * 100_000, '<a ">" ' * 50_000 + "'", "<div>" * 100_000 + "</p></i>" * 100_000, "<b>" * 50_000 + "<div></div></i>" * 50_000, "<li>" + "<ul><div><li></li>" * 50_000,
    "<svg>" * 100_000, "<svg>" + "<svg " * 100_000, "<video></b" * 100_000, "</a" * 100_000, "<!--" * 100_000, "&#" + "9" * 100_000 + ";", "<script>" * 100_000, "<p><b>" * 50_000,
])
def test_hostile_pages_take_linear_time(page):
    began = time.perf_counter()
    html.parse(page)
    assert time.perf_counter() - began < 4


def test_repeated_ids_leave_a_sample(spark, monkeypatch):
    """However often a doc_id repeats, each language is drawn from, and equal rows are drawn once."""
    drawn = []
    monkeypatch.setattr(langid, "train", lambda texts, labels: drawn.append(Counter(labels)))
    for key in range(5):
        df = spark.range(400).selectExpr(f"{key}L as doc_id", "case when id < 390 then 'the same text' else concat('der hund ', id) end as text", "case when id < 390 then 'en' else 'de' end as lang")
        langid.learn(df, df.doc_id >= 0, per_label=3)
    assert all(x["en"] == 1 and 1 <= x["de"] <= 10 for x in drawn) and len(drawn) == 5


def held_out_layout(rng):
    """(page, main text) in layouts of publishing systems that the training generator does not make: other class names,
    wrappers in wrappers, unquoted attributes, upper-case tags, tables as frames, lists of teasers and footnotes."""
    word = lambda n: " ".join("".join(rng.choices("bcdfghklmnprstv", k=2)) + rng.choice("aeiou") for _ in range(n))
    sentence = lambda: word(rng.randint(6, 16)).capitalize() + "."
    blocks = [word(rng.randint(2, 6)).capitalize(), *(" ".join(sentence() for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(2, 6)))]
    article = f"<h1>{blocks[0]}</h1>" + "".join(f"<p>{b}</p>" for b in blocks[1:])
    links = "".join(f'<li class="menu-item menu-item-{i}"><a href="/{i}">{word(2)}</a></li>' for i in range(rng.randint(3, 7)))
    kind = rng.randrange(7)
    if kind == 0:
        page = f'<body class="home blog logged-in admin-bar has-sidebar"><div id="page" class="hfeed site"><header id="masthead" class="site-header" role="banner"><div class="site-branding"><p class="site-title">{word(2)}</p></div><nav id="site-navigation" class="main-navigation"><ul>{links}</ul></nav></header><div id="content" class="site-content"><div id="primary" class="content-area"><main id="main" class="site-main" role="main"><article id="post-12" class="post-12 post type-post status-publish format-standard hentry category-news tag-menu"><div class="entry-content">{article}</div></article></main></div><div id="secondary" class="widget-area sidebar" role="complementary"><section class="widget widget_recent_entries"><h2 class="widget-title">{word(2)}</h2><ul>{links}</ul></section></div></div><footer id="colophon" class="site-footer"><div class="site-info">{word(4)}</div></footer></div></body>'
    elif kind == 1:
        page = f'<body><div class="mw-page-container"><div class="vector-header-container"><header class="vector-header mw-header"><form class="search-form"><input name=q><button>{word(1)}</button></form></header></div><main id="content" class="mw-body"><div id="bodyContent" class="vector-body">{article}</div></main><div class="mw-footer-container"><footer class="mw-footer"><ul id="footer-info"><li>{sentence()}</li></ul></footer></div></div></body>'
    elif kind == 2:
        page = f"<BODY><TABLE WIDTH=100%><TR><TD><DIV CLASS=navbar><A HREF=/>{word(1)}</A> <A HREF=/b>{word(1)}</A></DIV></TD></TR><TR><TD><DIV CLASS=main>{article.replace('</p>', '')}</DIV></TD></TR><TR><TD><DIV CLASS=footer>{word(5)}</DIV></TD></TR></TABLE></BODY>"
    elif kind == 3:
        page = f'<body class="article-page no-js"><div class="cookie-consent-overlay" role="dialog"><p>{sentence()}</p><button>{word(1)}</button></div><div class="layout layout--two-column"><section class="article__body js-share-target">{article}</section><aside class="article__aside"><h3>{word(2)}</h3><p>{sentence()}</p></aside></div><div class="newsletter-signup-box"><p>{sentence()}</p></div></body>'
    elif kind == 4:
        notes = "".join(f'<li id="comment-{i}" class="comment depth-1"><div class="comment-author">{word(2)}</div><div class="comment-content"><p>{sentence()}</p></div></li>' for i in range(rng.randint(1, 4)))
        page = f'<body><nav class="navbar navbar-expand-lg fixed-top"><ul class="navbar-nav">{links}</ul></nav><div class="container"><div class="row"><div class="col-md-8 blog-main"><div class="blog-post">{article}</div><div id="comments" class="comments-area"><h2 class="comments-title">{word(3)}</h2><ol class="comment-list">{notes}</ol></div></div></div></div></body>'
    elif kind == 5:
        page = f'<body><div id="app"><div class="header-wrapper"><div class="logo">{word(1)}</div></div><div role="main"><div class="prose markdown-body">{article}</div></div><div class="page-footer"><p>{word(6)}</p></div></div><script>var x = "<p>{word(2)}</p>";</script></body>'
    else:
        page = f'<body><header class="c-header"><nav class="c-nav"><ul>{links}</ul></nav></header><article class="c-article"><svg class="icon" viewBox="0 0 1 1"/>{article}<div class="social-share-buttons"><a href=/s>{word(1)}</a></div></article><section class="related-posts"><h2>{word(2)}</h2><ul>{links}</ul></section></body>'
    return kind, page, " ".join(blocks)


def test_layouts_the_generator_does_not_make(model):
    rng = random.Random(21)
    right = Counter()
    for _ in range(350):
        kind, page, text = held_out_layout(rng)
        right[kind, html.extract(page, model) == text] += 1
    print({k: (right[k, True], right[k, False]) for k in range(7)})
    assert sum(n for (_, ok), n in right.items() if ok) >= 0.9 * 350

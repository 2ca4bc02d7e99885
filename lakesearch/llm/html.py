"""Main-text extraction by a tree-structured graphical model over the DOM.

Every block element, and every inline element that carries a telling class, id or
role, is a binary variable: content or not.  Its own potential is a linear function
of features of the element and its own text; an edge to its parent has a 2 x 2
potential that depends on the kind of the child.  One upward and one downward pass
of sum-product messages give exact marginals, and a node's own text is content if
its marginal is at least one half.

Potentials are trained here, by the gradient of the exact likelihood, on labelled
pages that `labelled_pages` composes: semantic and div-only layouts, menus, headers,
footers, sidebars, notices, adverts, forms, reader comments, unclosed tags.

Classes, ids and roles are read token by token; a token's last word that tells
of furniture speaks for it, or else one that tells of content, and tokens of the page (`has-sidebar`, `tag-news`) or on
`html` and `body` say nothing.  What an element is called gives way to what it holds:
where a telling name stands on or above a marked article with half of the page's
words outside links, the name is not a feature, and the element counts as its box.

White space is what Python's str.split splits at, the no-break space included.  A
`br` and the start and the end of a block element end a block.  Scripts, styles,
templates, titles, drawings, fallbacks, comments and markup are never text; such an
element ends at its own end tag, and one that has none is empty, but for `script`,
`style`, `title` and `textarea`, which run to the end of the page unless they close
themselves.  Null and empty html give an empty text; html without tags is one block.
Other tags that never close end with their parent, and end tags without a start are
ignored.  A `<` after which no `>` comes is text.  Parsing takes time in proportion to
the page, whatever is nested or left open in it: after `QUOTES` tags whose quotes do
not pair, the rest of the tags end at the next `>`.
"""

from __future__ import annotations

import html as entities
import math
import random
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

_OPEN = re.compile(r"[a-zA-Z][^\s/>]*")
_MARK = re.compile(r"[>\"']")
_HUGE = re.compile(r"&#(?:[0-9]{8,}|[xX][0-9a-fA-F]{7,});?")
QUOTES = 16
_ATTR = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_NAME = re.compile(r"[a-z]+")

# Fixed values of HTML: element kinds.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
TO_END = frozenset("script style title textarea".split())
FALLBACK = frozenset("template svg canvas object audio video".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option", "thead": "thead tbody tfoot", "tbody": "thead tbody tfoot", "tfoot": "thead tbody tfoot"}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}, "thead": {"table"}, "tbody": {"table"}, "tfoot": {"table"}}

#: Words of class, id and role that tell something, by group.
GROUPS = {
    "menu": "nav navbar navigation menu topbar breadcrumb breadcrumbs pagination pager toc skip tabs toolbar dropdown",
    "head": "header masthead banner logo branding hero sitehead",
    "foot": "footer colophon copyright legal foot bottom contentinfo",
    "side": "sidebar side aside widget rail related recommended recommendations trending popular complementary more",
    "ad": "ad ads advert adverts advertisement sponsor sponsored promo promotion promoted dfp adsense adslot outbrain taboola",
    "note": "cookie cookies consent gdpr notice alert popup modal overlay disclaimer announcement warning dialog toast",
    "form": "form search login signup signin subscribe subscription newsletter register input",
    "talk": "comment comments respond reply replies discussion disqus thread responses feedback reader",
    "share": "share sharing social follow tags tag meta byline author print tools",
    "main": "article content main post entry hentry story body text page prose maintext articlebody",
}
_GROUP = {w: g for g, words in GROUPS.items() for w in words.split()}
_TELLING = frozenset({"menu", "head", "foot", "side", "ad", "note", "form", "talk", "share"})


@dataclass
class Page:
    """Nodes in page order, parents before children; runs of text as (node, block, text)."""

    parent: list[int] = field(default_factory=lambda: [-1])
    tags: list[str] = field(default_factory=lambda: ["#root"])
    groups: list[frozenset[str]] = field(default_factory=lambda: [frozenset()])
    labels: list[int] = field(default_factory=lambda: [0])
    runs: list[tuple[int, int, str, bool]] = field(default_factory=list)


#: First words of a token that tells of the page or of a topic, and last words that tell of a shape.
_ASIDE = frozenset("has no not with without is js supports tag category cat type status format".split())
_SHAPE = frozenset("fixed sticky wrapper wrap container inner outer".split())


def _groups(attrs: str) -> tuple[frozenset[str], int | None]:
    found, label = set(), None
    for name, *values in _ATTR.findall(attrs):
        name, value = name.lower(), next((v for v in values if v), "")
        if name in ("class", "id", "role"):
            for token in value.split():
                words = _NAME.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", token).lower())
                if len(words) > 1 and words[0] in _ASIDE:
                    continue
                telling = [_GROUP[w] for w in words if w in _GROUP and (len(words) == 1 or w not in _SHAPE)]
                if telling:  # the content of a comment is comment, whatever its last word says
                    found.add(next((g for g in reversed(telling) if g != "main"), "main"))
        elif name in ("hidden", "aria-hidden") and value != "false" or name == "style" and "display:none" in value.replace(" ", "").lower():
            found.add("hidden")
        elif name == "data-y":
            label = int(value)
    return frozenset(found), label


def _plain(piece: str) -> str:
    """Text without character references; a number beyond all characters stands for none."""
    return entities.unescape(_HUGE.sub("\ufffd", piece)) if "&" in piece else piece


class _Ends:
    """Where the elements end that are skipped whole; each kind's tags are looked for once a page."""

    def __init__(self, html: str):
        self.html, self.none, self.pairs = html, set(), {}

    def raw(self, name: str, start: int) -> int | None:
        """After the next end tag of `name`."""
        if name in self.none:
            return None
        close = re.compile(rf"</{name}(?=[\s/>])[^<>]*>", re.IGNORECASE).search(self.html, start)
        if close is None:
            self.none.add(name)
            return None
        return close.end()

    def nested(self, name: str, tag: int) -> int | None:
        """After the end tag that belongs to the start tag of `name` at `tag`."""
        if name not in self.pairs:
            found, left = {}, []
            for m in re.finditer(rf"<(/?){name}(?=[\s/>])[^<>]*>", self.html, re.IGNORECASE):
                if not m[1]:
                    left += [] if m[0].endswith("/>") else [m.start()]
                elif left:
                    found[left.pop()] = m.end()
            self.pairs[name] = found
        return self.pairs[name].get(tag)


def _tag_end(html: str, at: int) -> int:
    """Where the next `>` outside quotes is, or -1."""
    while (m := _MARK.search(html, at)) and m[0] != ">":
        at = html.find(m[0], m.end()) + 1
        if not at:
            return -1
    return m.start() if m else -1


def parse(html: str) -> Page:
    """The page's nodes and text runs, in one pass over the tags."""
    page, ends = Page(), _Ends(html)
    stack: list[tuple[str, int]] = [("#root", 0)]  # open elements with their node
    open_at: dict[str, list[int]] = {}  # by name, where open elements stand in the stack
    boxes = [0]  # where those that are no inline elements stand
    block = at = end = links = 0
    n, tries = len(html), QUOTES

    def text(upto: int) -> None:
        if upto > at:
            page.runs.append((stack[-1][1], block, _plain(html[at:upto]), links > 0))

    def pop_to(depth: int) -> None:
        nonlocal links
        while len(stack) > depth:
            name, _ = stack.pop()
            open_at[name].pop()
            links -= name == "a"
            if boxes[-1] == len(stack):
                boxes.pop()

    def innermost(names: Iterable[str]) -> int:
        return max((open_at[x][-1] for x in names if open_at.get(x)), default=0)

    while True:
        tag = html.find("<", end)
        if tag < 0:
            break
        if html.startswith("<!--", tag):
            close = html.find("-->", tag + 2)
            text(tag)
            at = end = close + 3 if close >= 0 else n
            continue
        sign = html[tag + 1 : tag + 2]
        m = _OPEN.match(html, tag + 1 + (sign == "/"))
        if m is None and (not sign or sign not in "!?"):
            end = tag + 1
            continue
        first = m.end() if m else tag + 1
        close = _tag_end(html, first) if m and sign != "/" and tries else -1
        if close < 0:
            tries -= m is not None and sign != "/" and tries > 0
            close = html.find(">", first)
            if close < 0:
                break
        text(tag)
        at = end = close + 1
        if m is None:
            continue
        name = m[0].lower()
        if sign == "/":
            inline = name in INLINE
            block += not inline
            depth = innermost((name,))
            if depth and (not inline or depth > boxes[-1]):  # an inline end tag does not close boxes
                pop_to(depth)
            continue
        attrs = html[first:close]
        if name in VOID:
            block += name not in ("wbr", "img", "input", "embed")
            continue
        if name in RAW or name in FALLBACK:
            empty = attrs.endswith("/")
            stop = ends.raw(name, at) if name in RAW else None if empty else ends.nested(name, tag)
            if stop is None and name in TO_END and not empty:
                stop = n
            at = end = max(end, stop or 0)
            block += name not in ("script", "style", "template")
            continue
        groups, label = _groups(attrs) if "=" in attrs or "hidden" in attrs else (frozenset(), None)
        if name in ("html", "body"):
            groups = frozenset()
        inline = name in INLINE
        if not inline:
            block += 1
            if name in CLOSES_P and stack[boxes[-1]][0] == "p":
                pop_to(boxes[-1])
            if name in SIBLINGS:
                siblings, scope = SIBLINGS[name].split(), innermost(SCOPE[name])
                while (depth := innermost(siblings)) > scope:
                    pop_to(depth)
        node = stack[-1][1]
        if not inline or groups & _TELLING or "hidden" in groups:
            page.parent.append(node)
            page.tags.append(name)
            page.groups.append(groups)
            page.labels.append(page.labels[node] if label is None else label)
            node = len(page.tags) - 1
        links += name == "a"
        if not inline:
            boxes.append(len(stack))
        open_at.setdefault(name, []).append(len(stack))
        stack.append((name, node))
    text(n)
    return page


def outer(page: Page) -> list[bool]:
    """Which nodes' telling names give way: on or above a marked article, with half of the page's words outside links."""
    words = [0] * len(page.tags)
    for node, _, text, link in page.runs:
        words[node] += 0 if link else len(text.split())
    marked = [tag == "main" or (tag == "article" or "main" in groups) for tag, groups in zip(page.tags, page.groups, strict=True)]
    plain = [m and not groups & _TELLING for m, groups in zip(marked, page.groups, strict=True)]
    plain = [x or tag == "main" for x, tag in zip(plain, page.tags, strict=True)]
    holds = [False] * len(words)
    for i in range(len(words) - 1, 0, -1):
        words[page.parent[i]] += words[i]
        holds[page.parent[i]] |= holds[i] or plain[i]
    return [2 * w >= words[0] > 0 and (m or h) and "hidden" not in g for w, m, h, g in zip(words, marked, holds, page.groups, strict=True)]


def features(page: Page) -> list[list[str]]:
    """Names of each node's features: tag, groups, its text's length, links and closing punctuation, its place."""
    words, linked, last = [0] * len(page.tags), [0] * len(page.tags), [""] * len(page.tags)
    for node, _, text, link in page.runs:
        k = len(text.split())
        words[node] += k
        linked[node] += k * link
        if k:
            last[node] = text.rstrip()[-1]
    out, free = [], outer(page)
    for i, tag in enumerate(page.tags):
        groups = page.groups[i] - _TELLING if free[i] else page.groups[i]
        own = ["bias", f"t:{tag if tag in _KNOWN else 'other'}", *(f"g:{g}" for g in groups)]
        if page.parent[i] >= 0 and page.tags[page.parent[i]] == "body":
            own.append("top")
        if w := words[i]:
            own.append(f"w:{min(6, w.bit_length())}")
            own.append(f"l:{3 * linked[i] // w}")
            own.append("closed" if last[i] in ".!?:;\"'”’»…。！？" else "open")
        else:
            own.append("w:0")
        out.append(own)
    return out


_KNOWN = frozenset("#root html head body main article section div header footer nav aside p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tr td th pre blockquote figure figcaption form fieldset label button select option dialog noscript svg address details summary span a menu center".split())


def kinds(page: Page) -> list[str]:
    """What an edge's potential depends on: the child's telling group or main marks, or its tag, and whether what stands above tells."""
    out: list[str] = []
    for tag, groups, parent, free in zip(page.tags, page.groups, page.parent, outer(page), strict=True):
        above = out[parent] if parent >= 0 else ""
        under = "<" if above[-1:] == "<" or above[:7] == "telling" or above in _FURNITURE else ""
        out.append(_kind(tag, groups - _TELLING if free else groups) + under)
    return out


_FURNITURE = ("nav", "aside", "footer", "form")


def _kind(tag: str, groups: frozenset[str]) -> str:
    if "hidden" in groups or groups & _TELLING:
        return "telling-main" if "main" in groups else "telling"
    if tag in ("nav", "aside", "footer", "header", "form", "dialog", "button", "select", "noscript", "svg", "head", "menu"):
        return tag
    if tag in ("article", "main") or "main" in groups:
        return "main"
    return "box" if tag in ("div", "section", "body", "html", "table", "center") else "plain"


@dataclass
class Model:
    node: dict[str, float]
    edge: dict[str, list[float]]  # by kind: log potentials of (parent, child) 00, 01, 10, 11


def _log_ratio(a: float, b: float, c: float, d: float, s: float) -> float:
    """log((e**a + e**(b + s)) / (e**c + e**(d + s)))."""
    x, y, u, v = a, b + s, c, d + s
    return (x + math.log1p(math.exp(y - x)) if x > y else y + math.log1p(math.exp(x - y))) - (u + math.log1p(math.exp(v - u)) if u > v else v + math.log1p(math.exp(u - v)))


def messages(page: Page, model: Model, feats: list[list[str]], kind: list[str]) -> tuple[list[float], list[float], list[float]]:
    """Log-odds: of each node with all below it, of its message to its parent, and its marginal."""
    weight = model.node
    below = [sum(weight.get(f, 0.0) for f in own) for own in feats]
    up = [0.0] * len(below)
    for i in range(len(below) - 1, 0, -1):
        e = model.edge.get(kind[i]) or _NEUTRAL
        up[i] = _log_ratio(e[2], e[3], e[0], e[1], below[i])
        below[page.parent[i]] += up[i]
    total = below[:]
    for i in range(1, len(below)):
        e = model.edge.get(kind[i]) or _NEUTRAL
        total[i] = below[i] + _log_ratio(e[1], e[3], e[0], e[2], total[page.parent[i]] - up[i])
    return below, up, total


_NEUTRAL = [0.0, 0.0, 0.0, 0.0]


def extract(html: str | None, model: Model) -> str:
    """The main text of a page."""
    if not html:
        return ""
    page = parse(html)
    if len(page.tags) == 1:
        return " ".join("".join(t for _, _, t, _ in page.runs).split())
    total = messages(page, model, features(page), kinds(page))[2]
    blocks: dict[int, list[str]] = {}
    for node, block, text, _ in page.runs:
        if total[node] >= 0:
            blocks.setdefault(block, []).append(text)
    return " ".join(x for x in (" ".join("".join(parts).split()) for parts in blocks.values()) if x)


def train(pages: list[str], epochs: int = 12, rate: float = 0.3, decay: float = 1e-4) -> Model:
    """Gradient ascent (AdaGrad) on the exact log-likelihood of the labels, page by page."""
    model = Model({}, {})
    ready = []
    for html in pages:
        page = parse(html)
        ready.append((page, features(page), kinds(page)))
        for own in ready[-1][1]:
            for f in own:
                model.node.setdefault(f, 0.0)
        for k in ready[-1][2]:
            model.edge.setdefault(k, [0.5, -0.5, -0.5, 0.5])
    square: dict = {}
    rng = random.Random(5)

    def step(key: object, grad: float, old: float) -> float:
        grad -= decay * old
        square[key] = square.get(key, 1e-6) + grad * grad
        return old + rate * grad / math.sqrt(square[key])

    for _ in range(epochs):
        rng.shuffle(ready)
        for page, feats, kind in ready:
            below, up, total = messages(page, model, feats, kind)
            node: dict[str, float] = {}
            edge: dict[str, list[float]] = {}
            for i, own in enumerate(feats):
                y = page.labels[i]
                g = y - 1 / (1 + math.exp(-max(-40.0, min(40.0, total[i]))))
                for f in own:
                    node[f] = node.get(f, 0.0) + g
                if i:
                    e, t = model.edge[kind[i]], total[page.parent[i]] - up[i]
                    logs = [e[0], e[1] + below[i], e[2] + t, e[3] + t + below[i]]
                    top = max(logs)
                    p = [math.exp(x - top) for x in logs]
                    z = sum(p)
                    got = edge.setdefault(kind[i], [0.0] * 4)
                    for c in range(4):
                        got[c] -= p[c] / z
                    got[2 * page.labels[page.parent[i]] + y] += 1
            for f, g in node.items():
                model.node[f] = step(f, g, model.node[f])
            for k, gs in edge.items():
                model.edge[k] = [step((k, c), g, model.edge[k][c]) for c, g in enumerate(gs)]
    return model


# Labelled pages

_SYLLABLES = "ka lo mi ten sur pa vel do rin esh ul gra bo ni sta fer ion el mar ti qua ver so lu den".split()


def labelled_pages(n: int, seed: int = 0) -> list[str]:
    """Pages of many layouts; `data-y` holds each element's label, which children inherit."""
    return [_page(random.Random(seed * 1_000_003 + i)) for i in range(n)]


def _words(rng: random.Random, lo: int, hi: int) -> str:
    return " ".join("".join(rng.choices(_SYLLABLES, k=rng.randint(1, 4))) for _ in range(rng.randint(lo, hi)))


def _sentences(rng: random.Random, lo: int, hi: int) -> str:
    out = []
    for _ in range(rng.randint(lo, hi)):
        s = _words(rng, 1, 18)
        roll = rng.random()
        if roll < 0.1:
            s = s.replace(" ", f' <a href="/x">{_words(rng, 1, 2)}</a> ', 1)
        elif roll < 0.2:
            s = f"<{(t := rng.choice(['b', 'em', 'i', 'strong', 'code', 'span']))}>{s}</{t}>"
        elif roll < 0.25:
            s = s.upper() + "!!"
        out.append(s.capitalize() + rng.choice([".", ".", ".", "?", "!", " &amp;", ""]))
    return " ".join(out)


def _links(rng: random.Random, lo: int = 3, hi: int = 8) -> str:
    items = [f'<a href="/{i}">{_words(rng, 1, 3)}</a>' for i in range(rng.randint(lo, hi))]
    return rng.choice([f"<ul>{''.join(f'<li>{x}</li>' for x in items)}</ul>", " | ".join(items), " ".join(items), "<ul>" + "".join(f"<li>{x}" for x in items) + "</ul>"])


def _box(rng: random.Random, tag: str, names: list[str], inner: str, y: int, bare: float = 0.3) -> str:
    """An element, or a div whose class or id says what it is."""
    name = rng.choice(names)
    mark = rng.choice([f'class="{name}"', f'id="{name}"', f'class="{name} x{rng.randint(0, 9)}"', f'class="c-{name}"'])
    if tag != "div" and rng.random() < 0.6:
        return f'<{tag}{"" if rng.random() < bare + 0.3 else " " + mark} data-y="{y}">{inner}</{tag}>'
    kind = rng.choice(["div", "div", "section"])
    return f'<{kind} {mark} data-y="{y}">{inner}</{kind}>'


def _junk(rng: random.Random, kind: str) -> str:
    s = lambda lo=1, hi=3: _sentences(rng, lo, hi)
    if kind == "menu":
        return _box(rng, "nav", ["nav", "menu", "navbar", "breadcrumbs", "pagination", "main-nav", "site-nav"], _links(rng), 0)
    if kind == "head":
        return _box(rng, "header", ["header", "site-header", "masthead", "banner", "page-header"], rng.choice([f"<h1>{_words(rng, 1, 4)}</h1>", f"<div class=\"logo\">{_words(rng, 1, 3)}</div>", f"<p>{s()}</p>"]) + rng.choice(["", _links(rng), f"<p>{s()}</p>"]), 0)
    if kind == "foot":
        return _box(rng, "footer", ["footer", "site-footer", "colophon", "page-footer"], rng.choice([f"&copy; {_words(rng, 1, 3)} &middot; {s()}", f"<p>{s()}</p>", f"<p>&copy; {_words(rng, 1, 2)}</p>" + _links(rng)]), 0)
    if kind == "side":
        return _box(rng, "aside", ["sidebar", "widget", "related", "aside", "recommended", "right-rail"], f"<h{rng.randint(2, 4)}>{_words(rng, 1, 4)}</h3>" * rng.randint(0, 1) + rng.choice([_links(rng), f"<p>{s()}</p>", f"<p>{s(2, 6)}</p><p>{s()}</p>", s()]), 0)
    if kind == "ad":
        return _box(rng, "div", ["ad", "ads", "advert", "ad-slot", "sponsored", "promo", "advertisement"], rng.choice([s(), f"<p>{s()}</p>", f'<a href="/b">{s(1, 2)}</a>']), 0)
    if kind == "note":
        return _box(rng, rng.choice(["div", "div", "aside", "dialog"]), ["cookie-banner", "notice", "consent", "alert", "popup", "announcement", "cookie-notice"], rng.choice([s(), f"<p>{s()}</p><button>{_words(rng, 1, 2)}</button>"]), 0)
    if kind == "form":
        return rng.choice([f'<form data-y="0"><label>{_words(rng, 1, 3)}</label><input name="q"><button>{_words(rng, 1, 2)}</button><p>{s()}</p></form>', _box(rng, "div", ["newsletter", "search", "login", "signup"], f"<p>{s()}</p><form><input><select><option>{_words(rng, 1, 1)}<option>{_words(rng, 1, 1)}</select></form>", 0)])
    if kind == "share":
        return _box(rng, "div", ["share", "social", "share-tools", "tags"], _links(rng, 2, 4), 0)
    n = rng.randint(1, 5)
    one = lambda: f'<{(t := rng.choice(["div", "li", "article", "div"]))}{rng.choice([" class=comment", " class=reply", ""])}>' + rng.choice(["", f"<b>{_words(rng, 1, 2)}</b> ", f"<h4>{_words(rng, 1, 2)}</h4>", f"<cite>{_words(rng, 1, 2)}</cite>"]) + rng.choice([f"<p>{s(1, 5)}</p>", s(1, 5), f"<div class={rng.choice(['comment-content', 'comment-body', 'content', 'text', 'body'])}><p>{s(1, 5)}</p></div>"]) + f"</{t}>"
    return _box(rng, "section" if rng.random() < 0.5 else "div", ["comments", "comment-list", "respond", "discussion", "reader-comments", "responses"], rng.choice(["", f"<h3>{_words(rng, 1, 3)}</h3>"]) + "".join(one() for _ in range(n)), 0, bare=-1)


def _article(rng: random.Random) -> str:
    out = []
    if rng.random() < 0.8:
        head = f"<h1>{_words(rng, 1, 12)}</h1>"
        out.append(f"<header>{head}{rng.choice(['', f'<p>{_sentences(rng, 1, 2)}</p>'])}</header>" if rng.random() < 0.15 else head)
    for _ in range(rng.choice([1, 2, 3, 5, 8, 12])):
        r, s = rng.random(), _sentences(rng, 1, 7)
        if r < 0.66:
            out.append(rng.choice([f"<p>{s}</p>", f"<p>{s}", f"<p><b>{s}<br><p>{_sentences(rng, 1, 4)}</p>", f"<p>{s}<br>{_words(rng, 1, 9)}.</p>", f"<div>{s}</div>", f"<p>{_words(rng, 1, 2)}.</p>"]))
        elif r < 0.74:
            out.append(f"<h{(h := rng.randint(2, 4))}>{_words(rng, 1, 7)}</h{h}>")
        elif r < 0.82:
            out.append(f"<{(t := rng.choice(['ul', 'ol']))}>" + "".join(f"<li>{_sentences(rng, 1, 2)}</li>" for _ in range(rng.randint(1, 5))) + f"</{t}>")
        elif r < 0.87:
            out.append(f"<blockquote>{rng.choice([s, f'<p>{s}</p>'])}</blockquote>")
        elif r < 0.91:
            out.append("<table>" + "".join(f"<tr><td>{_words(rng, 1, 3)}</td><td>{_words(rng, 1, 3)}</td></tr>" for _ in range(rng.randint(1, 4))) + "</table>")
        elif r < 0.95:
            out.append(f"<pre><code>{_words(rng, 2, 20)}</code></pre>")
        else:
            out.append(f"<figure><img src=x><figcaption>{_words(rng, 2, 10)}</figcaption></figure>")
        if rng.random() < 0.08:
            out.append(_junk(rng, rng.choice(["ad", "side", "share", "note", "form"])))
    return "".join(out)


def _brief(rng: random.Random) -> str:
    """An article of a paragraph or two, with or without a heading."""
    return f"<h1>{_words(rng, 1, 6)}</h1>" * rng.randint(0, 1) + "".join(f"<p>{_words(rng, 1, 9)}{rng.choice(['.', '.', ''])}</p>" for _ in range(rng.randint(1, 2)))


def _page(rng: random.Random) -> str:
    inner = _article(rng) if rng.random() < 0.85 else _brief(rng)
    if rng.random() < 0.12:
        inner += _junk(rng, rng.choice(["talk", "share", "foot"]))
    roll = rng.random()
    if rng.random() < 0.12:  # names that elsewhere stand on furniture
        name = rng.choice(["post tag-news", "hentry category-social", "social-media story", "text more", "post with-sidebar", "story print", "entry related-topic"])
        main = f'<{(t := rng.choice(["article", "article", "div"]))} class="{name}" data-y="1">{inner}</{t}>'
    elif roll < 0.5:
        main = f'<article data-y="1"{rng.choice(["", " class=post", " id=article"])}>{inner}</article>'
    elif roll < 0.6:
        main = f'<main data-y="1">{inner}</main>'
    elif roll < 0.7:
        main = f'<main{rng.choice(["", " id=main"])} data-y="1"><article>{inner}</article></main>'
    elif roll < 0.78:
        main = f'<div{rng.choice(["", " class=wrap", " id=x1", " class=inner", " class=col"])} data-y="1">{inner}</div>'
    else:
        main = f'<div {rng.choice(["class", "id"])}="{rng.choice(["content", "post-content", "entry-content", "story-body", "article-body", "main", "main-content", "text"])}" data-y="1">{inner}</div>'
    before = [_junk(rng, k) for k in ("menu", "head", "ad", "note", "form", "side") if rng.random() < 0.4]
    after = [_junk(rng, k) for k in ("side", "ad", "talk", "share", "note", "form", "foot") if rng.random() < 0.4]
    rng.shuffle(before)
    beside = ""
    if rng.random() < 0.3:
        beside, main = "", rng.choice([f'<div class="wrapper">{main}{_junk(rng, "side")}</div>', f'<div class="container"><div class="row">{_junk(rng, "side")}{main}</div></div>', f"<main>{main}{_junk(rng, 'talk')}</main>", f"<div>{main}</div>"])
    if rng.random() < 0.12:
        main = f'<div class="{rng.choice(["site-header-fixed", "no-sidebar", "left-side", "body has-comments", "page-share", "widget-area main"])}" data-y="0">{main}</div>'
    body = "".join(before) + "<!-- x -->" + main + beside + "".join(after)
    mark = rng.choice(["", "", "", ' class="has-sidebar"', ' class="single menu-open with-comments"', ' id="page"'])
    return f"<!DOCTYPE html><html><head><title>{_words(rng, 1, 5)}</title><style>p{{}}</style></head><body{mark}>{body}</body></html>"


@lru_cache
def standard() -> Model:
    """The model of 1500 composed pages; trained once a process."""
    return train(labelled_pages(1500))


def main_text(pages: DataFrame, model: Model | None = None, html: str = "html") -> DataFrame:
    """`pages` with `text`, the main text, instead of the html column.  One pass, no shuffle."""
    C.small_batches(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(model or standard())
    rest = [f for f in pages.schema.fields if f.name not in (html, "text")]
    schema = T.StructType([*rest, T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            source = batch.column(batch.schema.get_field_index(html))
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                texts = pa.array([extract(x, known) for x in source.slice(lo, 64).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(f.name)) for f in rest), texts], names=[*(f.name for f in rest), "text"])

    return pages.mapInArrow(run, schema)


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return main_text(pages).withColumn("n_chars", F.length("text").cast("long"))

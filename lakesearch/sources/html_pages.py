"""HTML pages: readable text and Markdown, declared metadata, JSON-LD logos.  Arrow batches over the standard library's parser."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DROPPED = frozenset("script style noscript iframe object embed form input button svg canvas".split())
FURNITURE = frozenset("nav header footer aside menu dialog".split())
BLOCKS = frozenset("p div section article h1 h2 h3 h4 h5 h6 li pre tr blockquote".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
MOST_ELEMENTS, MOST_DEPTH, LEAST_TEXT = 50_000, 512, 40
_NOISE = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|sidebar|menu|nav\w*|footer|header|comments?|share|social|cookie|banner|popup)(?:$|[\s_-])", re.IGNORECASE)


@dataclass
class Node:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    children: list["Node | str"] = field(default_factory=list)


class TooLarge(ValueError):
    """A page beyond the element or depth limit."""


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("#root")
        self.stack = [self.root]
        self.elements = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.elements += 1
        if self.elements > MOST_ELEMENTS or len(self.stack) > MOST_DEPTH:
            raise TooLarge(tag)
        if tag in BLOCKS and any(n.tag == "p" for n in self.stack[-3:]):
            while self.stack[-1].tag != "p" and len(self.stack) > 1:
                self.stack.pop()
            self.stack.pop()
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.stack[-1].children.append(node)
        if tag not in VOID:
            self.stack.append(node)

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                del self.stack[i:]
                return

    def handle_data(self, data: str) -> None:
        self.stack[-1].children.append(data)


def tree(html: str) -> Node:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


def _prune(node: Node, base: str) -> None:
    keep: list[Node | str] = []
    for child in node.children:
        if isinstance(child, Node):
            if child.tag in DROPPED:
                continue
            for name in ("href", "src"):
                if value := child.attrs.get(name):
                    target = urlsplit(urljoin(base, value))
                    if target.scheme in ("http", "https") and not target.username:
                        child.attrs[name] = target.geturl()
                    else:
                        del child.attrs[name]
            _prune(child, base)
        keep.append(child)
    node.children = keep


def _find(node: Node, tag: str) -> Iterator[Node]:
    for child in node.children:
        if isinstance(child, Node):
            if child.tag == tag:
                yield child
            yield from _find(child, tag)


def _flat(node: Node) -> str:
    return "".join(c if isinstance(c, str) else _flat(c) for c in node.children)


def _weight(node: Node) -> float:
    text = _flat(node)
    links = sum(len(_flat(a)) for a in _find(node, "a"))
    return max(0, len(text) - 2 * links) + 25 * text.count(",")


def article_of(root: Node) -> Node | None:
    """The readable part: an article or main element, else the block whose paragraphs weigh most."""
    for tag in ("article", "main"):
        found = max(_find(root, tag), key=_weight, default=None)
        if found is not None and len(_flat(found).strip()) >= LEAST_TEXT:
            return found
    scored = [(sum(_weight(c) for c in n.children if isinstance(c, Node) and c.tag in ("p", "pre", "blockquote", "li")), n) for tag in ("div", "section", "td", "body") for n in _find(root, tag)]
    best = max(scored, key=lambda x: x[0], default=(0, None))
    return best[1] if best[0] > 0 else next(_find(root, "body"), root)


def _is_noise(node: Node) -> bool:
    return node.tag in FURNITURE or bool(_NOISE.search(f"{node.attrs.get('class', '')} {node.attrs.get('id', '')}"))


def text_of(node: Node) -> str:
    """Text with a line break around blocks and at br, a tab after table cells, then cleaned."""
    out: list[str] = []

    def walk(n: Node) -> None:
        for c in n.children:
            if isinstance(c, str):
                out.append(c)
            elif not _is_noise(c):
                edge = "\n" if c.tag in BLOCKS or c.tag == "br" else ""
                out.append(edge)
                walk(c)
                out.append("\t" if c.tag in ("td", "th") else edge if c.tag != "br" else "")

    walk(node)
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[\t ]+\n", "\n", "".join(out))).strip()


def markdown_of(node: Node) -> str:
    """ATX headings, fenced code, dashes for bullets, pipe tables."""

    def inline(n: Node) -> str:
        parts = []
        for c in n.children:
            if isinstance(c, str):
                parts.append(re.sub(r"\s+", " ", c))
            elif c.tag in ("b", "strong"):
                parts.append(f"**{inline(c).strip()}**")
            elif c.tag in ("i", "em"):
                parts.append(f"_{inline(c).strip()}_")
            elif c.tag == "code":
                parts.append(f"`{_flat(c)}`")
            elif c.tag == "br":
                parts.append("  \n")
            elif c.tag == "a" and c.attrs.get("href"):
                parts.append(f"[{inline(c).strip()}]({c.attrs['href']})")
            elif c.tag == "img":
                parts.append(f"![{c.attrs.get('alt', '')}]({c.attrs.get('src', '')})")
            else:
                parts.append(inline(c))
        return "".join(parts)

    def block(n: Node, out: list[str]) -> None:
        run: list[Node | str] = []

        def flush() -> None:
            if (s := inline(Node("#run", {}, list(run))).strip()):
                out.append(s)
            run.clear()

        for c in n.children:
            if isinstance(c, str) or c.tag not in BLOCKS | {"ul", "ol", "table", "main", "body", "html", "hr"}:
                run.append(c)
                continue
            flush()
            if _is_noise(c):
                continue
            if re.fullmatch("h[1-6]", c.tag):
                out.append("#" * int(c.tag[1]) + " " + inline(c).strip())
            elif c.tag == "pre":
                out.append(f"```\n{_flat(c).strip(chr(10))}\n```")
            elif c.tag in ("ul", "ol"):
                items = [x for x in c.children if isinstance(x, Node) and x.tag == "li"]
                out.append("\n".join((f"{i + 1}. " if c.tag == "ol" else "- ") + inline(x).strip() for i, x in enumerate(items)))
            elif c.tag == "blockquote":
                inner: list[str] = []
                block(c, inner)
                out.append("\n".join("> " + x for x in "\n\n".join(inner).split("\n")))
            elif c.tag == "table":
                rows = [[inline(x).strip() for x in r.children if isinstance(x, Node) and x.tag in ("td", "th")] for r in _find(c, "tr")]
                lines = ["| " + " | ".join(r) + " |" for r in rows if r]
                out.append("\n".join(lines[:1] + ["|" + " --- |" * len(rows[0])] + lines[1:]) if lines else "")
            elif c.tag == "hr":
                out.append("* * *")
            else:
                block(c, out)
        flush()

    out: list[str] = []
    block(node, out)
    return "\n\n".join(x for x in out if x).strip()


def extract(html: str | None, url: str) -> dict[str, str | None]:
    """title, text, markdown and error of a page."""
    try:
        root = tree(html or "")
    except TooLarge:
        return {"title": None, "text": None, "markdown": None, "error": "EXTRACTION_FAILED"}
    title = next((re.sub(r"\s+", " ", _flat(t)).strip() for t in _find(root, "title")), "")
    _prune(root, url)
    article = article_of(root)
    text = text_of(article) if article else ""
    if len(text) < LEAST_TEXT:
        return {"title": title, "text": None, "markdown": None, "error": "EXTRACTION_FAILED"}
    return {"title": title, "text": text, "markdown": markdown_of(article), "error": None}


# JSON-LD

PAGE_TYPES = frozenset(("Article", "NewsArticle", "BlogPosting", "WebPage", "WebSite"))


def _types(obj: dict) -> set[str]:
    kinds = obj.get("@type")
    return {re.sub(r"^(?:https?://)?schema\.org/", "", k) for k in (kinds if isinstance(kinds, list) else [kinds]) if isinstance(k, str)}


def _origin(url: str) -> tuple[str, str | None, int | None]:
    u = urlsplit(url)
    return u.scheme, u.hostname, u.port


def _own(obj: dict, page: str) -> bool:
    return all(k not in obj or (isinstance(obj[k], str) and _origin(urljoin(page, obj[k])) == _origin(page)) for k in ("url", "@id"))


def _logo(obj: dict, page: str) -> str | None:
    logo = obj.get("logo")
    if isinstance(logo, dict):
        logo = next((logo[k] for k in ("contentUrl", "url", "@id") if logo.get(k) is not None), None)
    target = urljoin(page, logo) if isinstance(logo, str) and logo else ""
    return target if urlsplit(target).scheme in ("http", "https") and "." in (urlsplit(target).hostname or "") else None


def json_ld_logo(html: str | None, page: str) -> str | None:
    """The declared logo: a site's own before its publisher's before an organisation's; bounded in scripts, size, nodes and depth."""
    best: list[str | None] = [None, None, None]
    chars, nodes = 256_000, 2000
    scripts = re.findall(r"<script[^>]*type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>", html or "", re.DOTALL | re.IGNORECASE)[:20]
    for raw in scripts:
        if len(raw) > min(64_000, chars):
            continue
        chars -= len(raw)
        try:
            todo = [(json.loads(raw), 0)]
        except ValueError:
            continue
        while todo and nodes > 0:
            value, depth = todo.pop()
            nodes -= 1
            if depth > 16 or not isinstance(value, dict | list):
                continue
            inner = value if isinstance(value, list) else value.get("@graph")
            if isinstance(value, dict) and _own(value, page):
                kinds, publisher = _types(value), value.get("publisher")
                if "WebSite" in kinds:
                    best[0] = best[0] or _logo(value, page)
                if kinds & PAGE_TYPES and isinstance(publisher, dict) and _own(publisher, page) and ("@type" not in publisher or _types(publisher) & {"Organization", "WebSite"}):
                    best[1] = best[1] or _logo(publisher, page)
                if "Organization" in kinds:
                    best[2] = best[2] or _logo(value, page)
            if isinstance(inner, list):
                todo += [(x, depth + 1) for x in reversed(inner[: max(0, nodes - len(todo))])]
    return next((x for x in best if x), None)


def readable(pages: DataFrame, key: str = "page_id", html: str = "html", url: str = "url") -> DataFrame:
    """key, title, text, markdown, error of every page."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [{key: k, **extract(h, u)} for k, h, u in zip(part[key], part[html], part[url], strict=True)]
            yield pd.DataFrame(rows, columns=[key, "title", "text", "markdown", "error"])

    return pages.select(key, html, url).mapInPandas(run, f"{key} long, title string, text string, markdown string, error string")


def logos(pages: DataFrame, key: str = "page_id", html: str = "html", url: str = "url") -> DataFrame:
    """key and logo_url of every page."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({key: part[key], "logo_url": [json_ld_logo(h, u) for h, u in zip(part[html], part[url], strict=True)]})

    return pages.select(key, html, url).mapInPandas(run, f"{key} long, logo_url string")


def declared(html: str = "html") -> dict[str, object]:
    """Metadata a page declares, as columns, by regular expressions: title, language, canonical, description, site name, dates."""
    h = F.col(html)

    def meta(*names: str) -> object:
        found = [F.nullif(F.coalesce(F.regexp_extract(h, rf"(?is)<meta\s[^>]*(?:name|property)\s*=\s*[\"']{re.escape(n)}[\"'][^>]*\scontent\s*=\s*[\"']([^\"']*)[\"']", 1), F.lit("")), F.lit("")) for n in names]
        return F.coalesce(*found)

    attr = lambda pattern: F.nullif(F.regexp_extract(h, pattern, 1), F.lit(""))
    return {
        "title": attr(r"(?is)<title[^>]*>(.*?)</title>"), "language": F.coalesce(attr(r"(?is)<html[^>]*\slang\s*=\s*[\"']([^\"']*)[\"']"), meta("og:locale")), "canonical_url": attr(r"(?is)<link\s[^>]*rel\s*=\s*[\"']canonical[\"'][^>]*\shref\s*=\s*[\"']([^\"']*)[\"']"),
        "site_name": meta("og:site_name", "application-name"), "description": meta("og:description", "description"), "image_url": meta("og:image"), "published": meta("article:published_time", "datepublished", "date"), "modified": meta("article:modified_time", "datemodified", "last-modified"),
    }

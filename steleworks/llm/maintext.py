"""Main text of web pages: boosted trees over DOM nodes, decoded along the hierarchy.

Block elements are the nodes. Gradient-boosted trees give each one's log odds of
belonging to the article, from its subtree's density, its attribute tokens, depth,
siblings and place. Decoding keeps the set of nodes with the largest sum of log odds
in which a node is kept only together with its parent: no descendant of a dropped
node is kept, and a container that holds the article is.

The trees are trained on pages that `sample_page` generates from labelled parts;
TRAINING pages bound the training, whatever the size of the input.
"""

from __future__ import annotations

import html as htmllib
import random
import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import boosting
from .common import slices, table

TRAINING, SEED = 700, 11

# Element names of the HTML standard, by what this parser does with them.
BLOCKS = frozenset("html body div p article main section nav header footer aside ul ol li dl dt dd table thead tbody tfoot tr td th caption h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption form fieldset details summary address hgroup dialog center menu".split())
SKIPPED = frozenset("script style title template noscript svg math iframe object select button textarea canvas audio video".split())
CLOSES_P = BLOCKS - {"html", "body", "li", "dt", "dd", "td", "th", "tr", "thead", "tbody", "tfoot", "caption", "summary", "figcaption"}
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
# Words in class, id and role attributes that speak for or against the article.
GOOD = frozenset("article body content entry main post story text blog page prose maincontent".split())
BAD = frozenset("ad ads advert advertisement aside banner breadcrumb breadcrumbs comment comments cookie consent copyright disqus footer form header login menu meta nav navbar navigation newsletter notice pagination pager popup promo promoted recommended related reply search share sharing sidebar signup social sponsor sponsored subscribe tags teaser toolbar top widget links alert modal topbar masthead respond".split())

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""", re.S)
_NAMES = re.compile(r"""(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_WORDS = re.compile(r"[a-z]+")


class Page:
    """The block elements of a page, in order of their start, and the pieces of text between their tags."""

    def __init__(self, source: str | None):
        self.tags: list[str] = ["#root"]
        self.parents: list[int] = [-1]
        self.marks: list[list[str]] = [[]]
        self.pieces: list[list] = []  # [node, text, characters in links]
        self._read(source or "")

    def _read(self, source: str) -> None:
        stack, at, link, fresh = [0], 0, False, True
        tags, parents, marks, pieces = self.tags, self.parents, self.marks, self.pieces
        n = len(source)

        def enclose() -> None:
            """What stands outside of all elements belongs to the body, which is implied where it has no tag."""
            if len(stack) > 1:
                return
            for name in ("html", "body"):
                if name in tags:
                    stack.append(tags.index(name))
                elif name == "body" or "body" not in tags:
                    tags.append(name)
                    parents.append(stack[-1])
                    marks.append([])
                    stack.append(len(tags) - 1)

        def put(raw: str) -> None:
            nonlocal fresh
            if "&" in raw:
                raw = htmllib.unescape(raw)
            if fresh and not raw.strip():
                return
            if fresh:
                enclose()
                pieces.append([stack[-1], raw, len(raw) if link else 0])
                fresh = False
            else:
                pieces[-1][1] += raw
                pieces[-1][2] += len(raw) if link else 0

        while at < n:
            found = _TOKEN.search(source, at)
            if not found:
                put(source[at:])
                break
            if found.start() > at:
                put(source[at : found.start()])
            at = found.end()
            if not (name := found.group(2)):
                continue
            name, closing = name.lower(), found.group(1)
            if name in SKIPPED:
                if not closing and not found.group(3).endswith("/"):
                    end = re.compile(rf"</{name}\s*>", re.I).search(source, at)
                    if end:
                        at = end.end()
                    elif name in ("script", "style"):
                        break
                if name in ("button", "select", "textarea", "iframe"):
                    put(" ")
                continue
            if name == "a":
                link = not closing
                continue
            if name in ("br", "hr", "img"):
                put(" ")
                if name == "hr":
                    fresh = True
                continue
            if name not in BLOCKS:
                continue
            fresh = True
            if closing:
                for k in range(len(stack) - 1, 0, -1):
                    if tags[stack[k]] == name:
                        del stack[k:]
                        link = False
                        break
                continue
            link = False
            if name in ("html", "body"):
                if name in tags:
                    continue
            else:
                enclose()
            if name in CLOSES_P:
                for k in range(len(stack) - 1, 0, -1):
                    if tags[stack[k]] == "p":
                        del stack[k:]
                        break
                    if tags[stack[k]] in ("td", "th", "table"):
                        break
            elif name in SIBLINGS:
                own, bound = SIBLINGS[name]
                for k in range(len(stack) - 1, 0, -1):
                    if tags[stack[k]] in bound:
                        break
                    if tags[stack[k]] in own:
                        del stack[k:]
                        break
            tags.append(name)
            parents.append(stack[-1])
            raw = found.group(3)
            marks.append(_WORDS.findall(" ".join(a or b or c for a, b, c in _NAMES.findall(raw)).lower()) if "=" in raw else [])
            stack.append(len(tags) - 1)


_KIND = {t: k for k, group in enumerate((["p", "blockquote", "pre", "figcaption"], ["h1", "h2", "h3", "h4", "h5", "h6"], ["li", "dt", "dd"], ["ul", "ol", "dl", "menu"], ["div", "section", "center"], ["article", "main"], ["nav", "aside", "footer", "header", "form", "dialog", "address"], ["table", "tr", "td", "th", "tbody", "thead"]), 1) for t in group}

FEATURES = 25


def features(page: Page) -> np.ndarray:
    """A row of FEATURES numbers for each node."""
    tags, parents, n = page.tags, page.parents, len(page.tags)
    text, links, commas, words, first = [0] * n, [0] * n, [0] * n, [0] * n, [-1] * n
    blocks, own = [1] * n, [0] * n
    total = 0
    for node, raw, linked in page.pieces:
        size = len(raw)
        own[node] += size
        text[node] += size
        links[node] += linked
        commas[node] += raw.count(",") + raw.count(".") + raw.count("，") + raw.count("。")
        words[node] += raw.count(" ") + 1
        if first[node] < 0:
            first[node] = total
        total += size
    paragraphs = [int(t == "p") for t in tags]
    for i in range(n - 1, 0, -1):
        p = parents[i]
        text[p] += text[i]
        links[p] += links[i]
        commas[p] += commas[i]
        words[p] += words[i]
        blocks[p] += blocks[i]
        paragraphs[p] += paragraphs[i]
        if first[i] >= 0:
            first[p] = first[i] if first[p] < 0 else min(first[p], first[i])
    out = np.zeros((n, FEATURES))
    depth, good, bad, chrome, art = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
    children, order = [0] * n, [0] * n
    good_, bad_ = GOOD.intersection, BAD.intersection
    for i in range(1, n):
        p = parents[i]
        depth[i] = depth[p] + 1
        order[i] = children[p]
        children[p] += 1
        m = page.marks[i]
        g, b = (len(good_(m)), len(bad_(m))) if m else (0, 0)
        kind = _KIND.get(tags[i], 0)
        chrome[i] = chrome[p] + (kind == 7 and not (tags[i] == "header" and art[p]))
        art[i] = art[p] + (kind == 6)
        good[i], bad[i] = good[p] + g, bad[p] + b
        t = text[i]
        out[i] = (
            kind, g, b, good[p], bad[p], chrome[i], art[i], depth[i], np.log1p(t), np.log1p(own[i]), links[i] / (t + 1), t / (blocks[i] * 40 + t + 1), commas[i] / (words[i] + 1), np.log1p(words[i]),
            np.log1p(paragraphs[i]), order[i], 0, first[i] / (total + 1) if first[i] >= 0 else 0, t / (total + 1), t / (text[p] + 1), links[p] / (text[p] + 1), _KIND.get(tags[p], 0), int(tags[i] == "h1"), blocks[i], int(tags[i] in ("header", "footer")),
        )
    out[1:, 16] = [children[p] for p in parents[1:]]
    return out


def decode(parents: list[int], odds: list[float]) -> list[bool]:
    """The nodes with the largest sum of log odds among the sets that hold every member's parent; node 0 is kept."""
    n = len(parents)
    best = list(odds)
    for i in range(n - 1, 0, -1):
        if best[i] > 0:
            best[parents[i]] += best[i]
    keep = [True] + [False] * (n - 1)
    for i in range(1, n):
        keep[i] = keep[parents[i]] and best[i] > 0
    return keep


def joined(page: Page, keep: list[bool]) -> str:
    """The text of kept nodes, a line for each piece between block tags."""
    lines = [" ".join(raw.split()) for node, raw, _ in page.pieces if node and keep[node]]
    return "\n".join([x for x in lines if x])


def _prose(r: random.Random, least: int, most: int) -> str:
    words = ["".join(r.choice(["an", "ti", "the", "on", "re", "es", "de", "la", "er", "in", "ou", "st"]) for _ in range(r.randint(1, 4))) for _ in range(r.randint(least, most))]
    return " ".join(w + ("," if r.random() < 0.07 else "." if r.random() < 0.08 else "") for w in words).capitalize() + "."


def sample_page(r: random.Random) -> str:
    """A generated page; elements of the article carry data-y, which the parser doesn't look at."""

    def pick(*xs: str) -> str:
        return r.choice(xs)

    def box(names: str, inner: str, tag: str = "") -> str:
        tag = tag or pick("div", "div", "section", "aside")
        attr = pick("class", "class", "id")
        return f'<{tag} {attr}="{names}">{inner}</{tag}>'

    def menu(k: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/x">{_prose(r, 1, 3)}</a></li>' for _ in range(k)) + "</ul>"

    y = ' data-y="1"'
    body = []
    for _ in range(r.randint(1, 14)):
        kind = r.random()
        if kind < 0.1:
            body.append(f"<h2{y}>{_prose(r, 1, 7)}</h2>")
        elif kind < 0.17:
            body.append(f"<{(t := pick('ul', 'ol'))}{y}>" + "".join(f"<li{y}>{_prose(r, 2, 25)}</li>" for _ in range(r.randint(2, 6))) + f"</{t}>")
        elif kind < 0.22:
            body.append(f"<blockquote{y}><p{y}>{_prose(r, 5, 40)}</p></blockquote>")
        elif kind < 0.26:
            body.append(f"<table{y}>" + "".join(f"<tr{y}><td{y}>{_prose(r, 1, 5)}</td><td{y}>{_prose(r, 1, 5)}</td></tr>" for _ in range(3)) + "</table>")
        elif kind < 0.32:
            body.append(box(pick("ad", "ads banner", "promo", "share social", "related", "newsletter signup"), pick(_prose(r, 2, 14), menu(3), f"<p>{_prose(r, 4, 30)}</p>"), "div"))
        else:
            link = f' <a href="/y">{_prose(r, 1, 4)}</a>' if r.random() < 0.3 else ""
            body.append(f"<p{y}>{_prose(r, 1, pick(3, 40, 160))}{link}</p>")
    if r.random() < 0.3:
        body = [f"<div{y}>{''.join(body)}</div>"]
    title = pick(f"<h1{y}>{_prose(r, 2, 12)}</h1>", f"<header{y}><h1{y}>{_prose(r, 2, 12)}</h1></header>", "")
    wrap = pick("article", "article", "main", 'div class="content"', 'div id="main"', 'div class="post-body entry"', 'section class="story"', "div")
    art = f"<{wrap}{y}>{title}{''.join(body)}</{wrap.split()[0]}>"
    if r.random() < 0.3:
        art = f"<{(w := pick('main', 'div'))}{y}>{art}</{w}>"
    before, after = [], []
    if r.random() < 0.8:
        before.append(pick(f"<nav>{menu(r.randint(2, 9))}</nav>", box("menu nav", menu(5), "div"), f"<header><h1>{_prose(r, 1, 3)}</h1><nav>{menu(4)}</nav></header>", f"<header><p>{_prose(r, 1, 5)}</p></header>"))
    if r.random() < 0.6:
        before.append(box(pick("ad", "ads", "advert", "banner", "sponsored"), pick(_prose(r, 1, 20), f"<p>{_prose(r, 2, 25)}</p>"), "div"))
    if r.random() < 0.3:
        before.append(box(pick("cookie-notice", "notice", "alert", "cookie consent"), f"<p>{_prose(r, 4, 30)}</p>", "div"))
    if r.random() < 0.3:
        before.append(box("breadcrumbs", menu(3)))
    if r.random() < 0.5:
        pick_ = [before, after][r.random() < 0.7]
        pick_.append(pick(f"<aside><h3>{_prose(r, 1, 4)}</h3>{menu(5)}</aside>", box("sidebar widget", f"<h3>{_prose(r, 1, 3)}</h3><p>{_prose(r, 4, 40)}</p>"), f"<aside><p>{_prose(r, 5, 50)}</p></aside>"))
    if r.random() < 0.4:
        after.append(box(pick("comments", "comment-list", "disqus comments", "reader-comments"), "".join(box("comment", f"<p>{_prose(r, 2, 70)}</p>", "div") for _ in range(r.randint(1, 6))), pick("div", "section")))
    if r.random() < 0.3:
        after.append(f"<form><p>{_prose(r, 2, 9)}</p><div>{_prose(r, 1, 4)}</div></form>")
    if r.random() < 0.8:
        after.append(pick(f"<footer>{_prose(r, 2, 14)}</footer>", box("footer", f"<p>{_prose(r, 3, 20)}</p>", "div"), f"<footer><p>&copy; {_prose(r, 2, 12)}</p>{menu(3)}</footer>"))
    return f"<html><body{y}>{''.join(before)}{art}{''.join(after)}</body></html>"


@cache
def model(pages: int = TRAINING, seed: int = SEED) -> boosting.Trees:
    """Trees fitted to the nodes of generated pages; html and body count as parts of the article."""
    r, xs, ys = random.Random(seed), [], []
    for _ in range(pages):
        source = sample_page(r)
        page = Page(source)
        xs.append(features(page)[1:])
        labels = [1 if m.group(2) == "html" or "data-y" in m.group(3) else 0 for m in _TOKEN.finditer(source) if m.group(2) and not m.group(1) and m.group(2) in BLOCKS]
        ys.append(np.array(labels))
    return boosting.fit(np.concatenate(xs), np.concatenate(ys).astype(float))


def extract(trees: boosting.Trees, sources: list[str | None]) -> list[str]:
    """The main text of each page; of a null or empty one, the empty text."""
    pages = [Page(s) for s in sources]
    if not pages:
        return []
    odds = boosting.log_odds(trees, np.concatenate([features(p) for p in pages]))
    out, at = [], 0
    for p in pages:
        own = odds[at : at + len(p.tags)].tolist()
        at += len(p.tags)
        out.append(joined(p, decode(p.parents, own)))
    return out


def main_text(pages: DataFrame, trees: boosting.Trees | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of each page (page_id, url, html), repeated rows included; other columns are not looked at."""
    trees = trees or model()

    def run(batches):
        for b in slices(batches, 128):
            got = extract(trees, b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(got, pa.string()), pa.array(list(map(len, got)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op7_main_text(spark, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))

"""Main-text extraction: gradient-boosted trees over DOM-node features with hierarchical decoding.

A tolerant parser turns a page into block nodes and text segments. Each node gets features of its subtree (text, link and tag
density), attribute tokens, depth and siblings; boosted trees give it log-odds of belonging to the article. Decoding then keeps or
drops whole subtrees, or splits a node into its children, whichever fits the odds best: no kept node has a dropped ancestor whose
subtree was dropped, and none dropped lies in a kept one. The trees are trained here, on generated pages with known articles.
"""

from __future__ import annotations

import html
import json
import random
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import log1p
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Elements whose text is never part of a page's text; of these, those whose text holds no tags, and code.
RAW = frozenset("script style noscript template iframe object canvas audio video textarea select title".split())
_PLAIN, _CODE = frozenset("script style noscript iframe textarea title".split()), frozenset(("script", "style"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split()
)
#: Elements that a new start tag of the same kind (or of the listed ones) closes.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
    "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"},
}
_HOLDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "thead": {"table"}, "tbody": {"table"}, "tfoot": {"table"}, "option": set()}
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_STOP = re.compile("[>\"']")
_COMMENT_END = re.compile("--!?>")
_ATTR = re.compile(r"""(?:^|[\s"'/])(class|id|role|itemprop|aria-label|hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: Attribute tokens that speak for and against an article, by theme.
GOOD = frozenset("article content contents main body post entry story text prose page blog news detail copy markdown".split())
BAD = {
    "menu": frozenset("nav navigation navbar menu breadcrumb breadcrumbs pagination pager toc skip links".split()),
    "edge": frozenset("header masthead footer foot copyright legal bottom top site".split()),
    "side": frozenset("sidebar side aside widget rail related recommended recommendations more popular trending tags tag share social sharing".split()),
    "notice": frozenset("cookie cookies consent notice alert banner popup modal overlay gdpr newsletter subscribe subscription signup message disclaimer".split()),
    "advert": frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion promoted".split()),
    "form": frozenset("form search login register contact".split()),
    "comment": frozenset("comment comments reply replies respond discussion disqus feedback reviews thread".split()),
    "hidden": frozenset("hidden none".split()),
}
_TAGS = ["div", "p", "article", "main", "section", "nav", "header", "footer", "aside", "form", "ul", "li", "table", "h1", "h2", "body", "blockquote", "pre", "figure", "button", "dialog", "address", "figcaption"]
_TAG_ID = {t: i for i, t in enumerate(_TAGS)}


@dataclass
class Page:
    """Block nodes in page order (parents before children) and text segments in page order."""

    tags: list[str] = field(default_factory=list)
    parents: list[int] = field(default_factory=list)
    attrs: list[frozenset[str]] = field(default_factory=list)
    links: list[int] = field(default_factory=list)  # characters inside links, own segments
    chars: list[int] = field(default_factory=list)
    n_tags: list[int] = field(default_factory=list)
    segments: list[tuple[int, str]] = field(default_factory=list)

    def add(self, tag: str, parent: int, attrs: frozenset[str]) -> int:
        self.tags.append(tag)
        self.parents.append(parent)
        self.attrs.append(attrs)
        self.links.append(0)
        self.chars.append(0)
        self.n_tags.append(0)
        return len(self.tags) - 1


def _tokens(attrs: str) -> frozenset[str]:
    found: set[str] = set()
    for name, value in _ATTR.findall(attrs):
        if name.lower() == "hidden":
            found.add("hidden")
        elif name.lower() == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                found.add("hidden")
        else:
            found.update(p.lower() for p in _PART.findall(value))
    return frozenset(found)


class _Scanner:
    """Tags of a page from left to right, each character looked at a bounded number of times whatever the page holds."""

    def __init__(self, source: str) -> None:
        self.source, self.at = source, 0
        self.last = source.rfind(">")
        self._last_end: dict[str, int] = {}

    def _tag_end(self, at: int) -> int:
        """Where the tag that begins before ``at`` has its ``>``, quoted ones passed over; the next one if a quote never ends."""
        look = at
        while True:
            stop = _STOP.search(self.source, look)
            if stop[0] == ">":
                return stop.start()
            shut = self.source.find(stop[0], stop.end())
            if not 0 <= shut < self.last:
                return self.source.find(">", at)
            look = shut + 1

    def tokens(self) -> Iterator[tuple[str, bool, str, str]]:
        """(text before, whether an end tag, tag or "" at the end or for a comment, attributes)."""
        source, begun = self.source, 0
        while True:
            start = source.find("<", self.at)
            if start < 0:
                yield source[begun:], False, "", ""
                return
            ahead = source[start + 1 : start + 2]
            if source.startswith("<!--", start):
                shut = _COMMENT_END.search(source, start + 4)
                stop = shut.end() if shut else len(source)
                name, attrs, ending = "", "", False
            elif start > self.last or not (ahead in ("!", "?") or (found := _NAME.match(source, start))):
                self.at = start + 1  # no tag: text
                continue
            elif ahead in ("!", "?"):
                stop, name, attrs, ending = source.find(">", start) + 1, "", "", False
            else:
                shut = self._tag_end(found.end())
                stop, name, attrs, ending = shut + 1, found[1].lower(), source[found.end() : shut], ahead == "/"
            text, self.at, begun = source[begun:start], stop, stop
            yield text, ending, name, attrs
            begun = self.at  # the reader may have passed over a raw element

    def skip(self, tag: str) -> None:
        """Pass over a raw element up to its end tag. One that has none holds nothing, but code lasts up to the next tag."""
        if tag not in self._last_end:
            self._last_end[tag] = max((m.start() for m in re.finditer(rf"</{tag}(?=[\s/>])", self.source, re.I)), default=-1)
        if self._last_end[tag] < self.at:
            self.at = max(self.source.find("<", self.at), self.at) if tag in _CODE else self.at
            return
        stop = self._last_end[tag]
        depth = 1
        for found in re.compile(rf"<(/?){tag}(?=[\s/>])", re.I).finditer(self.source, self.at):
            depth += (-1 if found[1] else 1) if tag not in _PLAIN or found[1] else 0
            if not depth:
                stop = found.start()
                break
        stop = self.source.find(">", stop)
        self.at = stop + 1 if stop >= 0 else len(self.source)


def parse(source: str) -> Page:
    """The blocks of a page. Unclosed, misnested and unknown tags are tolerated; nothing is dropped but RAW elements' text.

    Time is linear in the page: open elements are found by name, never by going through what is open.
    """
    page = Page()
    stack = [page.add("#root", -1, frozenset())]
    where: dict[str, list[int]] = defaultdict(list)  # places in the stack of the open elements of a name
    buffer: list[str] = []
    in_link = 0
    scanner = _Scanner(source)

    def flush() -> None:
        if buffer:
            joined = " ".join("".join(buffer).split())
            buffer.clear()
            if joined:
                page.segments.append((stack[-1], joined))
                page.chars[stack[-1]] += len(joined)

    def close(index: int) -> None:
        flush()
        for node in reversed(stack[index:]):
            where[page.tags[node]].pop()
        del stack[index:]

    def nearest(names: frozenset[str] | set[str]) -> int:
        """The highest place of an open element of these names, 0 for none."""
        return max((where[n][-1] for n in names if where[n]), default=0)

    for text, ending, tag, attrs in scanner.tokens():
        if text:
            text = html.unescape(text) if "&" in text else text
            buffer.append(text)
            if in_link:
                page.links[stack[-1]] += len(text)
        if not tag:
            continue
        if tag in INLINE:
            if tag == "br":
                buffer.append(" ")
            elif tag == "a":
                in_link = 0 if ending else 1
            page.n_tags[stack[-1]] += not ending
        elif ending:
            if where[tag]:
                in_link = 0
                close(where[tag][-1])
            elif tag == "p":  # an empty paragraph
                flush()
        elif tag in RAW:
            scanner.skip(tag)  # a slash before the > does not close it
            if tag in ("textarea", "select", "iframe", "object", "canvas", "video", "audio"):
                page.n_tags[stack[-1]] += 1
        elif tag in VOID:
            page.n_tags[stack[-1]] += 1
            if tag == "hr":
                flush()
        elif tag not in ("html", "body", "head") or not where[tag]:
            if page.tags[stack[-1]] == "head" and tag != "head":
                close(len(stack) - 1)
            if tag in _HOLDS:  # implied end tags
                while (shut := nearest(CLOSES[tag])) > max(nearest(_HOLDS[tag]), nearest({"p"})):
                    close(shut)
                if where["p"] and where["p"][-1] > nearest(_HOLDS[tag]):
                    close(where["p"][-1])
            elif page.tags[stack[-1]] == "p":
                close(len(stack) - 1)
            flush()
            stack.append(page.add(tag, stack[-1], _tokens(attrs) if attrs else frozenset()))
            where[tag].append(len(stack) - 1)
    flush()
    return page


FEATURES = 32 + len(BAD) * 2


#: For each set of attribute tokens: whether it speaks for an article, and a bit for each theme against.
_judged: dict[frozenset[str], tuple[int, int]] = {}
_OUTER = frozenset(("nav", "footer", "aside", "form", "header", "dialog"))
_NEVER = frozenset(("nav", "footer", "aside", "form", "dialog", "button"))


def _judge(attrs: frozenset[str]) -> tuple[int, int]:
    found = _judged.get(attrs)
    if found is None:
        if len(_judged) > 50_000:
            _judged.clear()
        bad = sum(1 << j for j, theme in enumerate(BAD.values()) if not theme.isdisjoint(attrs))
        found = _judged[attrs] = (int(not GOOD.isdisjoint(attrs)), bad)
    return found


def node_features(pages: list[Page]) -> np.ndarray:
    """[nodes of all pages, FEATURES]: own and subtree text, links, tags and punctuation, attribute tokens, depth, siblings, ancestors."""
    names = "chars own links tags stops own_stops words own_words start depth nth kids paras segs good above_good above_tag near own_tags bad above_bad total".split()
    held: dict[str, list[int]] = {c: [] for c in names}
    for page in pages:
        n, parents, tag_of = len(page.tags), page.parents, page.tags
        chars, links, tags = list(page.chars), list(page.links), [t + 1 for t in page.n_tags]
        stops, words, segs, start, seen = [0] * n, [0] * n, [0] * n, [0] * n, [False] * n
        before = 0
        for node, text in page.segments:
            stops[node] += text.count(".") + text.count(",") + text.count("!") + text.count("?")
            words[node] += text.count(" ") + 1
            segs[node] += 1
            at = node
            while at >= 0 and not seen[at]:
                seen[at], start[at] = True, before
                at = parents[at]
            before += len(text)
        own_stops, own_words = list(stops), list(words)
        kids, paras, depth, nth = [0] * n, [0] * n, [0] * n, [0] * n
        good, bad, above_good, above_tag, above_bad = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
        near = [0] * n  # what the nearest telling node at or above says: 1 against, -1 for an article
        for i in range(n):
            if page.attrs[i]:
                good[i], bad[i] = _judge(page.attrs[i])
            p = parents[i]
            if p >= 0:
                depth[i], nth[i] = depth[p] + 1, kids[p]
                kids[p] += 1
                above_good[i] = int(above_good[p] or good[p] or tag_of[p] in ("article", "main"))
                above_tag[i] = int(above_tag[p] or tag_of[p] in _OUTER)
                above_bad[i] = above_bad[p] | bad[p]
                near[i] = near[p]
            if bad[i] or tag_of[i] in _NEVER:
                near[i] = 1
            elif good[i] or tag_of[i] in ("article", "main"):
                near[i] = -1
        for i in range(n - 1, 0, -1):
            p = parents[i]
            paras[p] += paras[i] + (tag_of[i] == "p")
            chars[p] += chars[i]
            links[p] += links[i]
            tags[p] += tags[i]
            stops[p] += stops[i]
            words[p] += words[i]
            segs[p] += segs[i]
        total = [max(1, chars[0])] * n
        for c, v in zip(names, (chars, page.chars, links, tags, stops, own_stops, words, own_words, start, depth, nth, kids, paras, segs, good, above_good, above_tag, near, page.n_tags, bad, above_bad, total), strict=True):
            held[c] += v
    v = {c: np.array(x, dtype=np.float32) for c, x in held.items()}
    first = np.cumsum([0, *(len(p.tags) for p in pages)])
    up = np.concatenate([np.array(p.parents) + a for p, a in zip(pages, first[:-1], strict=True)]) if pages else np.zeros(0, dtype=np.int64)
    root = np.zeros(len(up), dtype=bool)
    root[first[:-1]] = True
    up[first[:-1]] = first[:-1]
    around = np.where(root, 0, v["chars"][up])
    beside = np.where(root, 0, v["chars"][up] - v["chars"])
    tag = np.array([_TAG_ID.get(x, -1) for p in pages for x in p.tags])
    outer = np.array([x in _NEVER for p in pages for x in p.tags])
    heading = np.array([x[:1] == "h" and x[1:].isdigit() for p in pages for x in p.tags])
    bad, above_bad = np.array(held["bad"], dtype=np.int64), np.array(held["above_bad"], dtype=np.int64)
    c, w = v["chars"], v["words"]
    cols = [
        np.log1p(c), np.log1p(v["own"]), v["links"] / np.maximum(c, 1), c / v["tags"], v["stops"] / np.maximum(w, 1), v["own_stops"] / np.maximum(v["own_words"], 1), c / np.maximum(w, 1),
        np.log1p(w), np.log1p(v["own_words"]), c / v["total"], v["start"] / v["total"], v["depth"], v["nth"], v["kids"], v["paras"], np.log1p(beside),
        c / np.maximum(c + beside, 1), v["segs"], w / np.maximum(v["segs"], 1), v["good"], v["above_good"], v["above_tag"], v["near"], outer, v["own_tags"],
        tag, np.where(root, -1, tag[up]), v["tags"], around / v["total"], np.where(root, 0, v["paras"][up]), heading, (tag == _TAG_ID["article"]) | (tag == _TAG_ID["main"]),
        *((bad >> j) & 1 for j in range(len(BAD))), *((above_bad >> j) & 1 for j in range(len(BAD))),
    ]
    out = np.zeros((len(up), FEATURES), dtype=np.float32)
    for j, col in enumerate(cols):
        out[:, j] = col
    return out


@dataclass
class Trees:
    """Complete binary trees of one depth: split features, thresholds (go right if greater), leaf values."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    base: float

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        depth = int(np.log2(self.leaf.shape[1]))
        for f, t, v in zip(self.feature, self.threshold, self.leaf, strict=True):
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            out += v[at - (len(v) - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32) -> Trees:
    """Logistic gradient boosting with histogram splits, second-order gains and complete trees."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    p0 = np.clip((y * weight).sum() / weight.sum(), 1e-3, 1 - 1e-3)
    base = float(np.log(p0 / (1 - p0)))
    score = np.full(len(y), base)
    inner = 2**depth - 1
    out = Trees(np.zeros((rounds, inner), np.int64), np.full((rounds, inner), np.inf, np.float32), np.zeros((rounds, inner + 1)), base)
    for r in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = (p - y) * weight, np.maximum(p * (1 - p), 1e-6) * weight
        at = np.zeros(len(y), dtype=np.int64)
        for level in range(depth):
            low, n = 2**level - 1, 2**level
            local = at - low
            gain = np.zeros((x.shape[1], n, bins))
            for j in range(x.shape[1]):
                key = local * bins + binned[:, j]
                gs = np.bincount(key, weights=g, minlength=n * bins).reshape(n, bins)
                hs = np.bincount(key, weights=h, minlength=n * bins).reshape(n, bins)
                gl, hl = gs.cumsum(axis=1), hs.cumsum(axis=1)
                gt, ht = gl[:, -1:], hl[:, -1:]
                ok = (hl > 1) & (ht - hl > 1)
                gain[j] = np.where(ok, gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1), 0)
            for i in range(n):
                j, b = np.unravel_index(gain[:, i, :].argmax(), (x.shape[1], bins))
                if gain[j, i, b] > 1e-6 and b < len(edges[j]):
                    out.feature[r, low + i], out.threshold[r, low + i] = j, edges[j][b]
            f, t = out.feature[r][at], out.threshold[r][at]
            at = 2 * at + 1 + (x[np.arange(len(y)), f] > t)
        leaf = at - inner
        gs, hs = np.bincount(leaf, weights=g, minlength=inner + 1), np.bincount(leaf, weights=h, minlength=inner + 1)
        out.leaf[r] = -rate * gs / (hs + 1)
        score += out.leaf[r][leaf]
    return out


#: What a split of a node into its children costs in decoding.
SPLIT_COST = 0.5


def decode(page: Page, odds: np.ndarray) -> list[bool]:
    """Whether each node's own text is kept: the best labelling in which whole subtrees are kept, dropped or split.

    A kept or dropped subtree counts every node's log-odds, weighed by its own text, for or against; a split node adds its
    children's best and its own text's.
    """
    n = len(page.tags)
    value = [max(-5.0, min(5.0, o)) * (log1p(c) + 0.5) / 2 for o, c in zip(odds.tolist(), page.chars, strict=True)]
    whole = list(value)
    apart = [abs(v) if c else 0.0 for v, c in zip(value, page.chars, strict=True)]
    best = [0.0] * n
    for i in range(n - 1, -1, -1):
        best[i] = max(whole[i], -whole[i], apart[i] - SPLIT_COST)
        if i:
            whole[page.parents[i]] += whole[i]
            apart[page.parents[i]] += best[i]
    kept = [False] * n
    state = [0] * n  # 1: whole subtree kept, -1: dropped, 0: split
    for i in range(n):
        above = state[page.parents[i]] if i else 0
        if above:
            state[i] = above
        elif best[i] == -whole[i]:
            state[i] = -1
        elif best[i] == whole[i]:
            state[i] = 1
        kept[i] = state[i] > 0 or (state[i] == 0 and value[i] > 0)
    return kept


def extract_text(page: Page, odds: np.ndarray) -> str:
    """Kept segments in page order, joined by one space."""
    kept = decode(page, odds)
    return " ".join(text for node, text in page.segments if kept[node])


# ---- generated training pages -----------------------------------------------------------------------------------------------


class _Maker:
    """Random pages with marked articles, over many layouts."""

    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)
        self.out: list[str] = []

    def words(self, low: int, high: int) -> str:
        r = self.r
        made = ["".join(r.choice(("an", "the", "or", "in", "es", "ti", "on", "re", "la", "mo", "ve", "qu")) for _ in range(r.randint(1, 4))) for _ in range(r.randint(low, high))]
        return " ".join(w + (r.choice((",", ".", ".", ";")) if r.random() < 0.12 else "") for w in made).capitalize()

    def attrs(self, *names: str) -> str:
        name = self.r.choice(names)
        if not name:
            return ""
        return f' {self.r.choice(("class", "class", "id"))}="{name}"'

    def links(self, low: int, high: int) -> str:
        item = self.r.choice(("<li><a href='/x'>{}</a></li>", "<a href='/x'>{}</a> | ", "<li><a href='/x'>{}</a>"))
        body = "".join(item.format(self.words(1, 4)) for _ in range(self.r.randint(low, high)))
        return f"<ul>{body}</ul>" if "<li>" in item else body

    def junk(self) -> str:
        """One block that is not the article."""
        r = self.r
        kind = r.choice(("menu", "menu", "ad", "ad", "notice", "side", "form", "comments", "related", "header", "crumbs", "share"))
        if kind == "menu":
            return r.choice((f"<nav>{self.links(3, 12)}</nav>", f"<div{self.attrs('menu', 'main-nav', 'navigation', 'topMenu', '')}>{self.links(4, 12)}</div>"))
        if kind == "ad":
            tag = r.choice(("div", "div", "aside", "section"))
            return f"<{tag}{self.attrs('ad', 'ads', 'advert', 'sponsored', 'promo-box', 'ad-slot')}>{r.choice(('', '<p>'))}{self.words(4, 40)}</{tag}>"
        if kind == "notice":
            tag = r.choice(("div", "div", "section", "dialog"))
            return f"<{tag}{self.attrs('cookie-notice', 'cookie-banner', 'notice', 'gdpr', 'newsletter', 'alert', 'popup')}>{r.choice(('', '<p>'))}{self.words(6, 40)}<button>{self.words(1, 2)}</button></{tag}>"
        if kind == "side":
            inner = r.choice((f"<h3>{self.words(1, 4)}</h3>{self.links(2, 8)}", f"<p>{self.words(5, 60)}</p>", self.words(1, 12), f"<h3>{self.words(1, 4)}</h3><p>{self.words(3, 30)}</p>"))
            return r.choice((f"<aside>{inner}</aside>", f"<aside{self.attrs('sidebar', 'widget', '')}>{inner}</aside>", f"<div{self.attrs('sidebar', 'side-rail', 'widget')}>{inner}</div>"))
        if kind == "form":
            return f"<form{self.attrs('search', 'login', 'signup', '')}>{r.choice(('', '<p>', '<label>'))}{self.words(1, 12)}<input name=q><button>{self.words(1, 2)}</button></form>"
        if kind == "comments":
            tag = r.choice(("div", "section", "section", "ol"))
            own = "".join(f"<{r.choice(('div', 'li', 'article'))}{self.attrs('comment', 'reply', 'comment-body')}><p>{self.words(5, 60)}</p>" + r.choice(("</div>", "</li>", "</article>")) for _ in range(r.randint(1, 5)))
            return f"<{tag}{self.attrs('comments', 'comment-list', 'discussion', 'replies')}>{r.choice(('', f'<h2>{self.words(1, 3)}</h2>'))}{own}</{tag}>"
        if kind == "related":
            return f"<{r.choice(('div', 'section'))}{self.attrs('related', 'recommended', 'more-stories')}><h3>{self.words(2, 4)}</h3>{self.links(3, 8)}</div></section>"
        if kind == "header":
            return f"<header{self.attrs('site-header', 'masthead', '')}>{r.choice(('', '<h1>', '<h2>'))}{self.words(1, 10)}{r.choice(('', self.links(2, 5)))}</header>"
        if kind == "crumbs":
            return f"<div{self.attrs('breadcrumb', 'breadcrumbs')}>{self.links(2, 4)}</div>"
        return f"<div{self.attrs('share', 'social', 'tags')}>{self.links(2, 5)}</div>"

    def article(self) -> str:
        r = self.r
        tag, attrs = r.choice((("article", ""), ("article", ""), ("article", self.attrs("post", "entry", "story")), ("main", ""), ("div", self.attrs("content", "post-content", "article-body", "entry", "main-text")), ("section", self.attrs("content", "story-body", "post")), ("div", "")))
        parts = [f"<{r.choice(('h1', 'h1', 'h2'))}>{self.words(2, 12)}</h1></h2>"] if r.random() < 0.85 else []
        if parts and r.random() < 0.25:
            parts = [r.choice((f"<header>{parts[0]}</header>", f"<div class='entry-header'>{parts[0]}</div>", f"<header>{parts[0]}<p>{self.words(2, 9)}</p></header>"))]
        for _ in range(r.choice((1, 1, 2, 3, 4, 6, 9, 14))):
            kind = r.random()
            close = r.choice(("</p>", "</p>", ""))
            body = self.words(1, 90)
            if kind < 0.7:
                parts.append(f"<p>{r.choice(('', '', '<b>', '<em>'))}{body}{r.choice(('', '', '<br>'))}{close}")
            elif kind < 0.8:
                parts.append("<ul>" + "".join(f"<li>{self.words(3, 20)}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
            elif kind < 0.86:
                parts.append(f"<blockquote>{r.choice(('', '<p>'))}{body}</blockquote>")
            elif kind < 0.92:
                parts.append(f"<h2>{self.words(2, 7)}</h2><p>{body}</p>")
            elif kind < 0.96:
                parts.append(f"<p>{self.words(5, 40)} <a href='/y'>{self.words(1, 5)}</a> {self.words(5, 30)}</p>")
            else:
                parts.append(f"<table><tr><td>{self.words(1, 6)}<td>{self.words(1, 6)}</table>")
        for _ in range(r.choice((0, 0, 0, 1, 1, 2))):  # something that is not the article inside it
            parts.insert(r.randint(1, len(parts)) if parts else 0, "\x02" + self.junk() + "\x03")
        return f"\x01<{tag}{attrs}>" + "".join(parts) + f"</{tag}>\x04"

    def page(self) -> str:
        r = self.r
        body = [self.junk() for _ in range(r.randint(0, 4))] + [self.article()] + [self.junk() for _ in range(r.randint(0, 4))]
        if r.random() < 0.7:
            inner = self.words(2, 25) if r.random() < 0.6 else f"<p>{self.words(2, 25)}</p>{self.links(1, 4)}"
            body.append(r.choice((f"<footer>&copy; {inner}</footer>", f"<div{self.attrs('footer', 'site-footer', 'copyright')}>{inner}</div>")))
        text = "".join(body)
        for _ in range(r.randint(0, 2)):
            text = f"<div{self.attrs('wrapper', 'container', 'page', 'layout', '')}>{text}</div>"
        return f"<!DOCTYPE html><html><head><title>{self.words(2, 9)}</title></head><body>{text}</body></html>"


_MARKS = re.compile("[\x01-\x04]")
_SIGN = "\ue000"


def training_nodes(pages: int = 900, seed: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, labels, weights) of the nodes of generated pages: a node is the article's if most of its subtree's text is."""
    xs, ys, ws = [], [], []
    for i in range(pages):
        marked = _Maker(seed * 1_000_003 + i).page()
        # Marks ride along as inline elements, so that the parser sees the page it will see in use.
        page = parse(_MARKS.sub("", marked))
        inside = _article_chars(marked)
        n = len(page.tags)
        good, total, at = np.zeros(n), np.zeros(n), 0
        for node, text in page.segments:
            size = len(text.replace(" ", ""))
            total[node] += size
            good[node] += sum(inside[at : at + size])
            at += size
        own = total > 0
        y_own = np.divide(good, total, out=np.zeros(n), where=own)
        for j in range(n - 1, 0, -1):
            good[page.parents[j]] += good[j]
            total[page.parents[j]] += total[j]
        y_all = np.divide(good, total, out=np.zeros(n), where=total > 0)
        xs.append(node_features([page]))
        ys.append(np.where(own, y_own, y_all) > 0.5)
        ws.append(np.where(own, 1.0, np.where(total > 0, 0.5, 0.05)))
    return np.concatenate(xs), np.concatenate(ys).astype(np.float64), np.concatenate(ws)


def _article_chars(marked: str) -> list[bool]:
    """For each non-space text character of a marked page whether it is the article's, in page order."""
    page = parse(re.sub("[\x01-\x04]", lambda m: f"{_SIGN}{ord(m[0])}", marked))
    out, now, hold = [], False, False
    for _, text in page.segments:
        i = 0
        while i < len(text):
            if text[i] == _SIGN:
                code = int(text[i + 1])
                now, hold = (True, False) if code == 1 else (False, False) if code == 4 else (now, code == 2)
                i += 2
                continue
            if text[i] != " ":
                out.append(now and not hold)
            i += 1
    return out


#: The fitted trees: what fit() made of 900 generated pages; ``python -m stratalog.llm.html_extract`` writes it anew.
TREES_FILE = Path(__file__).with_name("html_trees.json")


def fit() -> Trees:
    """Trees trained on 900 generated pages (a fixed seed)."""
    return boost(*training_nodes())


def store(trees: Trees, path: Path = TREES_FILE) -> None:
    """Write trees as JSON: a line a tree."""
    rows = [json.dumps([f.tolist(), [None if np.isinf(x) else float(x) for x in t], [round(float(x), 6) for x in v]]) for f, t, v in zip(trees.feature, trees.threshold, trees.leaf, strict=True)]
    path.write_text(json.dumps(trees.base) + "\n" + "\n".join(rows) + "\n")


def model() -> Trees:
    """The stored trees."""
    base, *rows = (json.loads(line) for line in TREES_FILE.read_text().splitlines())
    feature, threshold, leaf = zip(*rows, strict=True)
    return Trees(np.array(feature, np.int64), np.array([[np.inf if x is None else x for x in t] for t in threshold], np.float32), np.array(leaf), base)


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars: the article of every page, whole.

    Blocks have white space runs turned into one space and are joined by one; null and empty html give the empty text. One row
    per input row, repeated ones too, none for an empty table, in a map without shuffle and in time linear in the page, however long;
    null ids and urls are passed on; other columns are ignored.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model())
    kinds = dict(pages.dtypes)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shared.value
        for whole in batches:
            for start in range(0, whole.num_rows, 200):
                batch = whole.slice(start, 200)
                parsed = [parse(h or "") for h in batch.column("html").to_pylist()]
                odds = trees.log_odds(node_features(parsed))
                at = np.cumsum([0, *(len(p.tags) for p in parsed)])
                texts = [extract_text(p, odds[a:b]) for p, a, b in zip(parsed, at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(extract, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint")


if __name__ == "__main__":
    store(fit())

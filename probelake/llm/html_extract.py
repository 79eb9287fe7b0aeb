"""Main-text extraction with a tree-structured graphical model.

Block elements of a page are the variables of a tree: content or not. Each has a
potential from its own features (tag, words of its class, id and role, text and link
amounts), each parent-child pair a learned 2 x 2 potential by the kind of child.
Sum-product messages upward and downward give exact marginals; blocks whose marginal
exceeds one half are the article. The weights are fitted by maximum likelihood
(exact gradients from the same messages) on labelled pages, which a seeded generator
lays out in many ways.

Pages are parsed leniently: unclosed and stray tags, raw-text elements, comments and
doctypes as browsers treat them. Character references are decoded; white space inside
a block becomes one space; blocks are trimmed and joined by one line feed. Parsing looks
at each character a bounded number of times: open elements are found by tag, never by
going through the stack, and a search that fails once is not repeated.

Defined results: null or empty html gives the empty text; a marginal of exactly one half
is not content; very long and malformed pages are read whole, in time in proportion;
after the first tag whose quotes do not close, quotes no longer hide a ``>`` in that page;
repeated rows give repeated results; null ids and urls stay null; further columns,
whatever their names, are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import html
import math
import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from probelake.llm.common import once_in_worker, text_runs

_NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
_QUOTE_OR_END = re.compile(r"[\"'>]")
_ATTR = re.compile(r"(?<![^\s/\"'])([^\s=/>\"']++)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is never page text.
_SILENT = set(
    "script style head title noscript template svg math iframe object button select option textarea canvas audio video datalist".split()
)
_RAW = set("script style title textarea noscript iframe template".split())
_BLOCK = set(
    "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption "
    "nav header footer aside form fieldset address details summary hr center dialog menu".split()
)
_ENDS_P = _BLOCK - {"html", "body", "tr", "td", "th", "tbody", "thead", "tfoot", "caption"}
_SAME_END = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}
}
_SCOPE = {
    "li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr", "table"},
    "th": {"tr", "table"}
}

_TAG_GROUPS = [
    set(g.split()) for g in (
        "article main", "section", "div center", "p", "h1", "h2 h3 h4 h5 h6", "ul ol dl menu", "li dt dd",
        "table thead tbody tfoot tr td th caption", "blockquote pre figure figcaption", "nav", "header", "footer address",
        "aside", "form fieldset dialog details summary", "html body"
    )
]
_GROUP_OF = {tag: i for i, group in enumerate(_TAG_GROUPS) for tag in group}
_WORDS = [
    re.compile(p)
    for p in (
        r"article|content|post|entry|story|main|prose|(?:^|[-_ ])(?:text|body)",
        r"nav|menu|breadcrumb|pagination|pager|toolbar|tabs|skip",
        r"(?:^|[-_ ])ads?(?:$|[-_ ])|advert|promo|sponsor|banner|dfp|outbrain|taboola",
        r"comment|repl(?:y|ies)|disqus|discussion|respon[ds]|feedback",
        r"cookie|notice|consent|gdpr|alert|popup|modal|overlay|warning|notification",
        r"sidebar|side-|related|widget|recommend|trending|popular|more-|rail",
        r"header|masthead|(?:^|[-_ ])top(?:$|[-_ ])|logo|branding",
        r"footer|copyright|legal|imprint|colophon|bottom",
        r"form|newsletter|subscri|login|signup|search|register",
        r"share|social|follow|byline|tags?(?:$|[-_ ])|meta(?:$|[-_ ])|author-box",
    )
]
N_FEATURES = len(_TAG_GROUPS) + len(_WORDS) + 8
_EDGE_KINDS = 3  # children with telling words or tags, children named content, the rest
_TELLING = set("nav header footer aside form dialog".split())


@dataclass
class Page:
    """Block elements in page order and text segments (element, text)."""

    tags: list[str] = field(default_factory=list)
    parents: list[int] = field(default_factory=list)
    names: list[str] = field(default_factory=list)
    marks: list[str | None] = field(default_factory=list)
    hidden: list[bool] = field(default_factory=list)
    segments: list[tuple[int, str]] = field(default_factory=list)
    own: list[int] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)


class _Scanner:
    """Tags of a source in order, as (text before, name, attributes, whether it closes)."""

    def __init__(self, source: str):
        self.source, self.at = source, 0
        self.no_more: set[str] = set()
        self.quotes = True
        self.ends: dict[str, re.Pattern] = {}

    def _find(self, what: str, start: int) -> int:
        """Like ``str.find``, but what was not found once is not looked for again."""
        if what in self.no_more:
            return -1
        i = self.source.find(what, start)
        if i < 0:
            self.no_more.add(what)
        return i

    def _end_of_tag(self, start: int) -> int:
        """The place of the ``>`` that ends a tag, or -1."""
        at = start
        while self.quotes:
            m = _QUOTE_OR_END.search(self.source, at)
            if m is not None and m.group() == ">":
                return m.start()
            close = self._find(m.group(), m.end()) if m is not None else -1
            if close < 0:
                self.quotes = False
            at = close + 1
        return self._find(">", start)

    def skip_raw(self, tag: str) -> None:
        """Go past the end tag of a raw-text element, or to the end of the page."""
        end = self.ends.setdefault(tag, re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I))
        m = end.search(self.source, self.at)
        self.at = m.end() if m else len(self.source)

    def __iter__(self) -> Iterator[tuple[str, str, str, bool]]:
        source, n, text = self.source, len(self.source), []
        while True:
            i = source.find("<", self.at)
            if i < 0 or ">" in self.no_more:
                yield "".join([*text, source[self.at :]]), "", "", False
                return
            text.append(source[self.at : i])
            self.at = i
            if source.startswith("<!--", i):
                end = self._find("-->", i + 4)
                self.at = end + 3 if end >= 0 else n
                continue
            if source.startswith("<![CDATA[", i) and (end := self._find("]]>", i + 9)) >= 0:
                text.append(source[i + 9 : end].replace("&", "&amp;"))
                self.at = end + 3
                continue
            if source[i + 1 : i + 2] in ("!", "?") and source[i + 1 : i + 2]:
                end = self._find(">", i)
                if end >= 0:
                    self.at = end + 1
                    continue
            closing = source[i + 1 : i + 2] == "/"
            name = _NAME.match(source, i + 1 + closing)
            end = self._end_of_tag(name.end()) if name else -1
            if end < 0:
                text.append("<")
                self.at = i + 1
                continue
            self.at = end + 1
            yield "".join(text), name.group().lower(), source[name.end() : end], closing
            text = []


class _Tree:
    """Open elements of a page, found by tag."""

    def __init__(self, page: Page):
        self.page = page
        self.stack: list[tuple[str, int]] = []  # tag and its block, -1 for others
        self.open: dict[str, list[int]] = {}  # depths of the open elements of a tag
        self.blocks: list[int] = []  # depths of the open blocks
        self.held: list[str] = []
        self.silent = self.links = 0

    def block(self) -> int:
        return self.stack[self.blocks[-1]][1]

    def last(self, tags) -> int:
        """The depth of the innermost open element of some tags, or -1."""
        return max((self.open[t][-1] for t in tags if self.open.get(t)), default=-1)

    def flush(self) -> None:
        text = " ".join("".join(self.held).split())
        self.held.clear()
        if text:
            self.page.segments.append((self.block(), text))
            self.page.own[self.block()] += len(text)

    def add(self, text: str) -> None:
        if text and not self.silent:
            text = html.unescape(text) if "&" in text else text
            self.held.append(text)
            if self.links:
                self.page.linked[self.block()] += len(text.strip())

    def push(self, tag: str, attrs: str) -> None:
        block = -1
        if tag in _BLOCK:
            self.flush()
            block = self._open_block(tag, attrs)
            self.blocks.append(len(self.stack))
        self.open.setdefault(tag, []).append(len(self.stack))
        self.stack.append((tag, block))
        self.silent += tag in _SILENT
        self.links += tag == "a"

    def pop_to(self, depth: int) -> None:
        while len(self.stack) > depth:
            tag, block = self.stack[-1]
            if block >= 0:
                self.flush()
                self.blocks.pop()
            self.stack.pop()
            self.open[tag].pop()
            self.silent -= tag in _SILENT
            self.links -= tag == "a"

    def _open_block(self, tag: str, attrs: str) -> int:
        page, found = self.page, {}
        if attrs:
            found = {m[0].lower(): html.unescape(m[1] or m[2] or m[3]) for m in _ATTR.findall(attrs)}
        page.tags.append(tag)
        page.parents.append(self.block() if self.blocks else -1)
        page.names.append(" ".join(found.get(k, "") for k in ("class", "id", "role", "aria-label")).lower())
        page.marks.append(found.get("data-y"))
        page.hidden.append(
            bool(
                re.search(r"(?:^|\s)hidden(?:\s|=|$)", attrs)
            ) or "display:none" in found.get("style", "").replace(" ", "").lower()
        )
        page.own.append(0)
        page.linked.append(0)
        return len(page.tags) - 1

    def close(self, tag: str) -> None:
        depth = self.last((tag,))
        # an inline element ends inside its block only
        inside = tag in _BLOCK or tag in _SILENT or depth > self.blocks[-1]
        if depth > 0 and inside:
            self.pop_to(depth)
        elif depth <= 0 and tag == "p":  # browsers put an empty paragraph here
            self.flush()

    def make_room(self, tag: str) -> None:
        """Close what a new element of this tag ends."""
        if tag in _ENDS_P:
            if self.open.get("head"):
                self.pop_to(self.open["head"][0])
            if self.stack[self.blocks[-1]][0] == "p":
                self.pop_to(self.blocks[-1])
        if tag in _SAME_END:
            while (depth := self.last(_SAME_END[tag])) > self.last(_SCOPE[tag]):
                self.pop_to(depth)
                if tag != "tr":
                    break


def parse(source: str) -> Page:
    """Block tree and text segments of a page."""
    page, scanner = Page(), _Scanner(source)
    tree = _Tree(page)
    tree.push("html", "")
    for text, tag, attrs, closing in scanner:
        tree.add(text)
        if tag in ("", "html"):
            continue
        if closing:
            if tag != "body":
                tree.close(tag)
            continue
        if tag == "body":  # the head ends here, closed or not
            tree.pop_to(1)
        if tag in _VOID:
            if tag == "br":
                tree.held.append(" ")
            elif tag == "hr":
                tree.flush()
        elif tag in _RAW:
            scanner.skip_raw(tag)
        else:
            tree.make_room(tag)
            tree.push(tag, attrs)
    tree.pop_to(1)
    tree.flush()
    return page


def features(page: Page) -> tuple[np.ndarray, np.ndarray]:
    """Features of each block, and the kind of the edge to its parent."""
    n = len(page.tags)
    x = np.zeros((n, N_FEATURES))
    below, linked_below, ends = list(map(float, page.own)), list(map(float, page.linked)), np.zeros(n)
    for b, text in page.segments:
        ends[b] = text[-1] in ".!?…\"'”»"
    for i in range(n - 1, 0, -1):
        below[page.parents[i]] += below[i]
        linked_below[page.parents[i]] += linked_below[i]
    below, linked_below = np.array(below), np.array(linked_below)
    base, words = len(_TAG_GROUPS), len(_TAG_GROUPS) + len(_WORDS)
    group = np.array([_GROUP_OF.get(t, -1) for t in page.tags])
    x[np.flatnonzero(group >= 0), group[group >= 0]] = 1.0
    kinds = [0 if t in _TELLING else 1 if t in ("article", "main") else 2 for t in page.tags]
    for i, names in enumerate(page.names):
        if not names.strip():
            continue
        found = [k for k, word in enumerate(_WORDS) if word.search(names)]
        x[i, [base + k for k in found]] = 1.0
        if any(found):  # any other than the first, which names content
            kinds[i] = 0
        elif found and kinds[i]:
            kinds[i] = 1
    kind = np.array(kinds, np.int64)
    own = np.array(page.own, float)
    x[:, words] = 1.0
    x[:, words + 1] = np.log1p(own) / 5.0
    x[:, words + 2] = np.minimum(1.0, np.array(page.linked) / np.maximum(own, 1.0))
    x[:, words + 3] = np.log1p(below) / 5.0
    x[:, words + 4] = np.minimum(1.0, linked_below / np.maximum(below, 1.0))
    x[:, words + 5] = below / max(1.0, below[0])
    x[:, words + 6] = ends
    x[:, words + 7] = np.array(page.hidden, float)
    return x, kind


@dataclass
class Forest:
    """Blocks of many pages, as arrays."""

    x: np.ndarray
    kind: np.ndarray
    parent: np.ndarray
    depth: np.ndarray

    @classmethod
    def of(cls, pages: list[Page]) -> Forest:
        xs, kinds, parents, depths, at = [], [], [], [], 0
        for p in pages:
            x, kind = features(p)
            depth = [0] * len(p.tags)
            for i in range(1, len(depth)):
                depth[i] = depth[p.parents[i]] + 1
            parents.append(np.array(p.parents) + at)
            parents[-1][0] = -1
            xs.append(x)
            kinds.append(kind)
            depths.append(np.array(depth, np.int64))
            at += len(depth)
        return cls(np.concatenate(xs), np.concatenate(kinds), np.concatenate(parents), np.concatenate(depths))


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


def _log_add(x: float, y: float) -> float:
    return max(x, y) + math.log1p(math.exp(-abs(x - y)))


@dataclass
class TreeModel:
    """Node weights and edge potentials [kind, parent's state, child's state]."""

    w: np.ndarray
    edge: np.ndarray

    def marginals(self, f: Forest) -> tuple[np.ndarray, np.ndarray]:
        """P(content) of each block and P(parent's state, own state) of each edge, by sum-product."""
        n = len(f.x)
        belief = np.zeros((n, 2))
        belief[:, 1] = f.x @ self.w
        up = np.zeros((n, 2))
        # one sort gives the levels of all trees
        order = np.argsort(f.depth, kind="stable")
        levels = np.split(order, np.flatnonzero(np.diff(f.depth[order])) + 1)
        for at in reversed(levels[1:]):  # upward
            if len(at) == 1:
                self._up_one(int(at[0]), f, belief, up)
                continue
            up[at] = _log_sum(self.edge[f.kind[at]] + belief[at][:, None, :], 2)
            np.add.at(belief, f.parent[at], up[at])
        total, pair = belief.copy(), np.zeros((n, 2, 2))
        for at in levels[1:]:  # downward
            if len(at) == 1:
                self._down_one(int(at[0]), f, belief, up, total, pair)
                continue
            joint = (total[f.parent[at]] - up[at])[:, :, None] + self.edge[f.kind[at]]
            total[at] = belief[at] + _log_sum(joint, 1)
            joint = joint + belief[at][:, None, :]
            joint -= joint.max(axis=(1, 2), keepdims=True)
            e = np.exp(joint)
            pair[at] = e / e.sum(axis=(1, 2), keepdims=True)
        return 1.0 / (1.0 + np.exp(np.clip(total[:, 0] - total[:, 1], -700, 700))), pair

    def _up_one(self, i: int, f: Forest, belief: np.ndarray, up: np.ndarray) -> None:
        """The message of a block that is alone on its level, as chains of nested blocks are."""
        (a, b), (c, d) = self.edge[f.kind[i]].tolist()
        no, yes = belief[i].tolist()
        up[i] = message = (_log_add(a + no, b + yes), _log_add(c + no, d + yes))
        belief[f.parent[i]] += message

    def _down_one(self, i: int, f: Forest, belief: np.ndarray, up: np.ndarray, total: np.ndarray, pair: np.ndarray) -> None:
        (a, b), (c, d) = self.edge[f.kind[i]].tolist()
        no, yes = (total[f.parent[i]] - up[i]).tolist()
        a, b, c, d = a + no, b + no, c + yes, d + yes
        own_no, own_yes = belief[i].tolist()
        total[i] = (own_no + _log_add(a, c), own_yes + _log_add(b, d))
        a, b, c, d = a + own_no, b + own_yes, c + own_no, d + own_yes
        top = max(a, b, c, d)
        e = [math.exp(x - top) for x in (a, b, c, d)]
        pair[i] = np.array(e).reshape(2, 2) / sum(e)


def fit(f: Forest, y: np.ndarray, steps: int = 120, shrink: float = 5e-4) -> TreeModel:
    """Maximum likelihood by Adam with exact gradients."""
    model = TreeModel(np.zeros(N_FEATURES), np.zeros((_EDGE_KINDS, 2, 2)))
    child = np.flatnonzero(f.depth > 0)
    seen = np.zeros((_EDGE_KINDS, 2, 2))
    np.add.at(seen, (f.kind[child], y[f.parent[child]], y[child]), 1.0)
    m1, m2 = [0.0, 0.0], [0.0, 0.0]
    for k in range(1, steps + 1):
        p, pair = model.marginals(f)
        expected = np.stack([pair[child][f.kind[child] == e].sum(0) for e in range(_EDGE_KINDS)])
        grads = [f.x.T @ (p - y) / len(y) + shrink * model.w, (expected - seen) / len(y) + shrink * model.edge]
        for i, (name, g) in enumerate(zip(("w", "edge"), grads, strict=True)):
            m1[i] = 0.9 * m1[i] + 0.1 * g
            m2[i] = 0.99 * m2[i] + 0.01 * g * g
            setattr(model, name, getattr(model, name) - 0.15 * (m1[i] / (1 - 0.9**k)) / (np.sqrt(m2[i] / (1 - 0.99**k)) + 1e-8))
    return model


def labelled_page(rng: random.Random) -> str:
    """A laid-out page; every block carries its label in ``data-y``."""
    syllables = "ta re mo li ne so ka du vi per lon gra tis en or al ber schi".split()

    def text(lo: int, hi: int) -> str:
        size = rng.randint(lo, hi)
        w = ["".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(size)]
        return " ".join(w).capitalize() + rng.choice([".", ".", ".", "", "!"])

    def links(k: int) -> str:
        return "".join(f'<li data-y="0"><a href="/x">{text(1, 3)}</a></li>' for _ in range(k))

    def named(options: str) -> str:
        return rng.choice(["class", "class", "id"]) + f'="{rng.choice(options.split())}"'

    def nav() -> str:
        inner = f'<ul data-y="0">{links(rng.randint(2, 9))}</ul>'
        return rng.choice(
            [
                f'<nav data-y="0">{inner}</nav>',
                f'<div data-y="0" {named("menu nav navbar main-menu breadcrumbs topnav")}>{inner}</div>'
            ]
        )

    def ad() -> str:
        return f'<div data-y="0" {named("ad ads advert ad-slot promo sponsored banner advertisement")}>{text(2, 30)}</div>'

    def notice() -> str:
        return f'<div data-y="0" {named("cookie notice cookie-banner consent alert popup gdpr")}><p data-y="0">{text(4, 30)}</p></div>'

    def side() -> str:
        inner = f'<h3 data-y="0">{text(1, 4)}</h3><ul data-y="0">{links(rng.randint(1, 6))}</ul><p data-y="0">{text(3, 40)}</p>'
        return rng.choice(
            [
                f'<aside data-y="0">{inner}</aside>',
                f'<div data-y="0" {named("sidebar related widget recommended trending")}>{inner}</div>'
            ]
        )

    def form() -> str:
        inner = f'<p data-y="0">{text(2, 14)}</p><label>{text(1, 3)}</label><input name="q"><button>{text(1, 2)}</button>'
        return rng.choice(
            [
                f'<form data-y="0">{inner}</form>',
                f'<div data-y="0" {named("newsletter subscribe search-box login")}>{inner}</div>'
            ]
        )

    def comments() -> str:
        one = lambda: f'<div data-y="0" class="{rng.choice(["comment", "reply", "item"])}"><p data-y="0">{text(3, 60)}</p></div>'
        return f'<{(t := rng.choice(["section", "div"]))} data-y="0" {named("comments comment-list replies discussion responses")}>' + "".join(
            one() for _ in range(rng.randint(1, 5))
        ) + f"</{t}>"

    def inside() -> str:
        return rng.choice([
            f'<p data-y="1">{text(1, 120)}</p>', f'<p data-y="1">{text(10, 120)}</p>',
            f'<p data-y="1">{text(1, 120)}<br>{text(1, 40)}</p>', f'<h2 data-y="1">{text(1, 8)}</h2>',
            f'<ul data-y="1">' + "".join(f'<li data-y="1">{text(2, 20)}</li>' for _ in range(rng.randint(1, 6))) + "</ul>",
            f'<blockquote data-y="1"><p data-y="1">{text(4, 40)}</p></blockquote>', f'<pre data-y="1">{text(3, 40)}</pre>',
            f'<div data-y="1"><p data-y="1">{text(3, 90)}</p></div>', f'<div data-y="1">{text(3, 90)}</div>',
            f'<section data-y="1"><h3 data-y="1">{text(1, 7)}</h3><p data-y="1">{text(4, 80)}</p></section>',
            f'<table data-y="1"><tr data-y="1"><td data-y="1">{text(1, 6)}</td><td data-y="1">{text(1, 6)}</td></tr></table>',
            f'<figure data-y="1"><figcaption data-y="1">{text(2, 16)}</figcaption></figure>',
            f'<p data-y="1">{text(2, 30)} <a href="/y">{text(1, 6)}</a> {text(2, 30)}</p>',
            f'<p data-y="1"><a href="/y">{text(1, 6)}</a></p>',
        ])

    parts = [f'<h1 data-y="1">{text(1, 10)}</h1>'] if rng.random() < 0.8 else []
    parts += [text(2, 60)] if rng.random() < 0.1 else []
    for _ in range(rng.randint(0, 9)):
        parts.append(inside())
        if rng.random() < 0.12:
            parts.append(rng.choice([ad, side, form, notice])())
    if rng.random() < 0.25:
        parts.append(comments())
    body = "".join(parts)
    wrap = rng.random()
    if wrap < 0.55:
        body = f'<article data-y="1">{body}</article>'
    elif wrap < 0.7:
        body = f'<main data-y="1">{body}</main>'
    else:
        body = f'<div data-y="1" {named("content post entry article-body story main-content post-content")}>{body}</div>'
    if rng.random() < 0.3:
        body = f'<div data-y="0" {named("wrap page container layout row")}>{body}{side() if rng.random() < 0.5 else ""}</div>'
    pieces = [nav(), *[f() for f in (ad, notice, side, form) if rng.random() < 0.3]]
    rng.shuffle(pieces)
    if rng.random() < 0.5:
        pieces.insert(
            0,
            rng.choice(
                [
                    f'<header data-y="0"><h1 data-y="0">{text(1, 5)}</h1>{nav()}</header>',
                    f'<div data-y="0" {named("header masthead site-header top")}><p data-y="0">{text(1, 9)}</p></div>'
                ]
            )
        )
    after = [f() for f in (ad, side, form, comments, nav) if rng.random() < 0.25]
    foot = f"&copy; {text(1, 4)} {text(2, 25)}"
    after.append(
        rng.choice(
            [
                f'<footer data-y="0">{foot}</footer>',
                f'<div data-y="0" {named("footer copyright site-footer legal bottom")}>{foot}</div>',
                f'<footer data-y="0"><p data-y="0">{foot}</p><ul data-y="0">{links(3)}</ul></footer>'
            ]
        )
    )
    return f'<!DOCTYPE html><html><head><title>{text(1, 6)}</title></head><body data-y="0">{"".join(pieces)}{body}{"".join(after)}</body></html>'


_TRAINED: dict[tuple[int, int], TreeModel] = {}


def train(pages: int = 300, seed: int = 1) -> TreeModel:
    """The model fitted on ``pages`` generated labelled pages (once in a process)."""
    if (pages, seed) not in _TRAINED:
        rng = random.Random(seed)
        parsed = [parse(labelled_page(rng)) for _ in range(pages)]
        y = np.array([int(m or 0) for p in parsed for m in p.marks])
        _TRAINED[pages, seed] = fit(Forest.of(parsed), y)
    return _TRAINED[pages, seed]


def extract(model: TreeModel, sources: list[str | None]) -> list[str]:
    """Main text of each page."""
    pages = [parse(s or "") for s in sources]
    if not pages:
        return []
    p, _ = model.marginals(Forest.of(pages))
    out, at = [], 0
    for page in pages:
        out.append("\n".join(text for b, text in page.segments if p[at + b] > 0.5))
        at += len(page.tags)
    return out


def extract_pages(
    pages: DataFrame, model: TreeModel | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """id, url, text and n_chars (code points) of each page."""
    model = model or train()

    held, name = pages.sparkSession.sparkContext.broadcast(model), f"tree {zlib.crc32(model.edge.tobytes(), zlib.crc32(model.w.tobytes()))}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = once_in_worker(name, lambda: held.value)
        for batch in batches:
            for a, sources in text_runs(batch, 2):
                texts = extract(model, sources)
                of = [c.slice(a, len(sources)) for c in batch.columns[:2]]
                yield pa.RecordBatch.from_arrays(
                    [*of, pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                    names=[id_col, url_col, "text", "n_chars"]
                )

    kind = dict(pages.dtypes)
    return pages.select(id_col, url_col, html_col).mapInArrow(
        run, f"`{id_col}` {kind[id_col]}, `{url_col}` {kind[url_col]}, text string, n_chars long"
    )

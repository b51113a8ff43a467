r"""Main text of web pages by minimum-cut labelling of their blocks.

A page is cut into blocks of text at block-level tags. A classifier over a block's text, its neighbours and its ancestors
(names, classes, ids and roles) gives the log odds that it is content. These become terminal capacities: positive odds
join the block to the source, negative ones to the sink. Neighbours in page order and blocks of one parent are joined
by smoothness edges. The minimum cut is the labelling of least cost; blocks on the source side are the text.

The classifier is a logistic regression, fitted in the driver on pages that ``html_samples`` makes together with their labels
(pages carry none of their own to learn from). Names that tell chrome from text are features among others, and odds are
bounded by ``MOST``, about what a block's edges can carry, so that a block among text needs more than a name to go.

Before the flow runs, blocks whose own cost exceeds all of their edges are settled and their edges folded into their
neighbours' costs, which never changes the cut; augmenting paths then solve what is left.

The scanner reads a page once. What it does for a tag doesn't depend on how many tags are open or never closed.
"""

from __future__ import annotations

import html
import re
from collections import deque
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import html_samples
from .common import OWN

_BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their text is none of the page's: scripts, styles, what is never shown, and the controls of forms.
_DROPPED = frozenset("script style template title iframe noframes textarea select button datalist".split())
#: Their content holds no tags.
_RAW = frozenset("script style textarea title iframe noframes".split())
#: An opening tag closes an open element of these names, up to the nearest scope.
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SCOPE = frozenset("ul ol dl table body html article section div nav aside main".split())
_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_ATTR = re.compile(r"[\s/]*([^\s/>=][^\s/>=]*|=[^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
_END = re.compile(r"[\s/]*>")
_COMMENT = re.compile(r"--!?>")
_PIECES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: What an element may be by its name or by the names of its classes, its id or role.
_CHROME = frozenset("nav aside menu dialog search noscript".split())
_AD = frozenset("ad ads adv advert advertisement adsense banner promo promotion sponsor sponsored cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup share sharing social related recommended recommendations widget widgets".split())
_FRAME = frozenset("nav navbar navigation menu footer sidebar aside breadcrumb breadcrumbs pagination pager login search copyright legal toolbar complementary contentinfo".split())
_HEAD = frozenset("header masthead".split())
_TALK = frozenset("comment comments disqus reply replies respond discussion".split())
#: A class name with one of these says what a page or an element has, and not what it is: has-sidebar, comments-open.
_STATE = frozenset("has with without no is open opened closed enabled disabled".split())
_GOOD = frozenset("article content main post entry story body text articlebody".split())
FEATURES = ("bias", "words", "few words", "sentence", "linked", "paragraph", "heading", "item", "in article", "named good", "chrome", "header", "footer", "form", "hidden", "ad", "frame", "head", "talk", "chrome inside", "frame inside", "head inside", "words before", "words behind", "linked around")
_AT = {name: k for k, name in enumerate(FEATURES)}
_REST = [0.0] * (len(FEATURES) - _AT["chrome"])
_PROSE, _ITEMS = ("p", "pre", "blockquote"), ("li", "dt", "dd", "td", "th", "figcaption")
WORDS = 40
#: Log odds are between ``-MOST`` and ``MOST``.
MOST = 3.0
#: Smoothness: neighbours with one parent, other neighbours, and the last block before of the same parent.
NEAR, FAR, SIBLING = 0.6, 0.15, 0.4
PAGES_TO_LEARN = 240


class Element:
    """An open element. ``marks`` are the kinds of chrome that its name and attributes speak of."""

    __slots__ = ("name", "up", "depth", "block", "scope", "inside", "good", "links", "dropped", "marks", "size", "holds", "kinds")

    def __init__(self, name: str, up: Element | None):
        self.name, self.up = name, up
        self.depth = up.depth + 1 if up else 0
        self.block = self if name in _BLOCKS or not up else up.block
        self.scope = self if name in _SCOPE or not up else up.scope
        self.inside = name in ("article", "main") or bool(up and up.inside)
        self.links = name == "a" or bool(up and up.links)
        self.dropped = name in _DROPPED or bool(up and up.dropped)
        self.good = bool(up and up.good)
        self.marks: set[str] | None = None
        self.size, self.holds, self.kinds = 0, False, frozenset()


def marks_of(name: str, attrs: list[tuple[str, str]], inside: bool) -> tuple[set[str], bool]:
    """The kinds of chrome that an element is by itself, and whether it is named like content."""
    marks, good, words = set(), False, set()
    if name in _CHROME:
        marks.add("chrome inside" if inside else "chrome")
    elif name in ("header", "footer") and not inside:
        marks.add(name)
    elif name == "footer":
        marks.add("chrome inside")
    elif name == "form":
        marks.add("form")
    for key, value in attrs:
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and "none" in value.replace(" ", "").partition("display:")[2][:4]:
            marks.add("hidden")
        elif key in ("class", "id", "role", "itemprop"):
            for token in value.split():
                pieces = {x.lower() for x in _PIECES.findall(token)}
                if not pieces & _STATE:
                    words |= pieces
    if words & _TALK:
        marks.add("talk")
    if words & _GOOD:
        good = not marks
    else:
        marks |= {kind for kind, found in (("ad", _AD), ("frame inside" if inside else "frame", _FRAME), ("head inside" if inside else "head", _HEAD)) if words & found}
    return marks, good


class Block:
    __slots__ = ("text", "linked", "parent", "words")

    def __init__(self, text: str, linked: int, parent: Element):
        self.text, self.linked, self.parent, self.words = text, linked / len(text), parent, text.count(" ") + 1


def tag_at(page: str, at: int) -> tuple[str, list[tuple[str, str]], int] | None:
    """Name, attributes and end of the tag whose name begins at ``at``; None if the page ends before it does."""
    m = _NAME.match(page, at)
    name, at, attrs = m[0].lower(), m.end(), []
    while not (end := _END.match(page, at)):
        m = _ATTR.match(page, at)
        if not m:
            return None
        if m[1][0] != "=":
            attrs.append((m[1].lower(), m[2] or m[3] or m[4] or ""))
        at = m.end()
    return name, attrs, end.end()


class _Page:
    """Reads a page into blocks. Anything may be unclosed, unopened or wrongly nested."""

    def __init__(self):
        self.blocks: list[Block] = []
        self.elements = [Element("html", None)]
        self.stack = [self.elements[0]]
        self.open: dict[str, list[Element]] = {}
        self.parts: list[str] = []
        self.linked = 0

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.blocks.append(Block(text, min(self.linked, len(text)), self.stack[-1].block))
            self.parts.clear()
            self.linked = 0

    def put(self, text: str) -> None:
        if text and not self.stack[-1].dropped:
            self.parts.append(html.unescape(text))
            if self.stack[-1].links:
                self.linked += len(text)

    def push(self, name: str) -> Element:
        e = Element(name, self.stack[-1])
        self.stack.append(e)
        self.elements.append(e)
        self.open.setdefault(name, []).append(e)
        return e

    def close(self, names, scoped: bool) -> None:
        """Closes the innermost open element of these names; not over a scope's edge if ``scoped``."""
        depth = max((self.open[n][-1].depth for n in names if self.open.get(n)), default=0)
        if depth and not (scoped and self.stack[-1].scope.depth > depth):
            while len(self.stack) > depth:
                e = self.stack.pop()
                self.open[e.name].pop()

    def read(self, page: str) -> None:
        at, n, articles = 0, len(page), []
        while at < n:
            k = page.find("<", at)
            if k < 0 or k == n - 1:
                self.put(page[at:])
                break
            self.put(page[at:k])
            sign = page[k + 1]
            shut = sign == "/" and k + 2 < n and page[k + 2].isascii() and page[k + 2].isalpha()
            if sign in "!?" or sign == "/" and not shut:
                comment = page.startswith("!--", k + 1)
                m = _COMMENT.search(page, k + 4) if comment else None
                if comment and page.startswith((">", "->"), k + 4):
                    end = page.index(">", k + 4)
                else:
                    end = m.end() - 1 if m else -1 if comment else page.find(">", k)
                at = end + 1 if end >= 0 else n
                continue
            if not shut and not (sign.isascii() and sign.isalpha()):
                self.put("<")
                at = k + 1
                continue
            found = tag_at(page, k + 1 + shut)
            if not found:  # no tag ends from here on
                self.put(page[k:])
                break
            name, attrs, at = found
            if shut:
                if name in _BLOCKS:
                    self.flush()
                if name not in _VOID:
                    self.close((name,), name not in _BLOCKS)
                continue
            if name in _BLOCKS:
                self.flush()
                here = self.stack[-1]
                if here.block.name == "p" and here.block.up:
                    self.close(("p",), False)
                if name in _CLOSES:
                    self.close(_CLOSES[name], True)
            elif name in ("br", "img"):
                if not self.stack[-1].dropped:
                    self.parts.append(" ")
            if name in _VOID or page[at - 2] == "/" and name in ("svg", "math", "path"):
                continue
            if name in _RAW:
                stop = re.compile(rf"</{name}(?![^\s/>])[^>]*>", re.I).search(page, at)
                at = stop.end() if stop else n
                continue
            e = self.push(name)
            if name not in ("body", "html"):
                e.marks, good = marks_of(name, attrs, e.up.inside)
                e.good |= good
            if name == "main":
                e.holds = True
            elif name == "article":
                articles.append(e)
        self.flush()
        if len(articles) == 1:
            articles[0].holds = True

    def settle(self) -> None:
        """The kinds of chrome that hold for each element: its own and its ancestors'. A mark is void on what holds the page's main
        element or only article, and, but for readers' comments, on what holds more than half of its text."""
        for b in self.blocks:
            b.parent.size += len(b.text)
        for e in reversed(self.elements):
            if e.up:
                e.up.size += e.size
                e.up.holds |= e.holds
        for e in self.elements[1:]:
            e.kinds = e.up.kinds
            if e.marks:
                own = set() if e.holds else e.marks & {"talk"} if 2 * e.size > self.elements[0].size else e.marks
                if not own <= e.kinds:
                    e.kinds = e.kinds | own


def blocks_of(page: str) -> list[Block]:
    """The blocks of a page in order, their elements' kinds settled."""
    p = _Page()
    p.read(page)
    p.settle()
    return p.blocks


def features(blocks: list[Block]) -> np.ndarray:
    """A row of ``FEATURES`` for each block."""
    rows, ends = [], ".!?:;\"'”»…"
    for b in blocks:
        tag, e = b.parent.name, b.parent
        row = [1.0, min(b.words, WORDS) / WORDS, b.words < 4, b.text[-1] in ends, b.linked, tag in _PROSE, tag[0] == "h" and tag[1:].isdigit(), tag in _ITEMS, e.inside, e.good, *_REST]
        for kind in e.kinds:
            row[_AT[kind]] = 1.0
        rows.append(row)
    x = np.array(rows, float).reshape(-1, len(FEATURES))
    w, near = x[:, _AT["words"]], x[:, _AT["linked"]]
    x[1:, _AT["words before"]], x[:-1, _AT["words behind"]] = w[:-1], w[1:]
    x[1:, _AT["linked around"]] += near[:-1] / 2
    x[:-1, _AT["linked around"]] += near[1:] / 2
    return x


def fit(x: np.ndarray, y: np.ndarray, penalty: float = 0.3, rounds: int = 30) -> np.ndarray:
    """Weights of a logistic regression with a squared penalty, by Newton's method."""
    w = np.zeros(x.shape[1])
    ridge = penalty * np.eye(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


@lru_cache(maxsize=1)
def weights(pages: int = PAGES_TO_LEARN) -> np.ndarray:
    """The classifier, from the blocks of ``pages`` made pages and whether each is text."""
    xs, ys = [], []
    for page, text in html_samples.pages(pages, seed=11):
        blocks, wanted = blocks_of(page), set(text)
        xs.append(features(blocks))
        ys += [b.text in wanted for b in blocks]
    return fit(np.concatenate(xs), np.array(ys, float))


def edges_of(blocks: list[Block]) -> dict[tuple[int, int], float]:
    """Smoothness between blocks ``i < j``."""
    edges: dict[tuple[int, int], float] = {}
    last: dict[int, int] = {}
    for j, b in enumerate(blocks):
        up = id(b.parent.up)
        if j:
            edges[j - 1, j] = NEAR if id(blocks[j - 1].parent.up) == up else FAR
        if (i := last.get(up)) is not None:
            edges[i, j] = edges.get((i, j), 0.0) + SIBLING
        last[up] = j
    return edges


def min_cut(odds: list[float], edges: dict[tuple[int, int], float]) -> list[bool]:
    """True for the nodes on the source side of a minimum cut (the smallest source side among minimum cuts)."""
    n = len(odds)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for (i, j), w in edges.items():
        if w > 0:
            near[i][j] = near[i].get(j, 0.0) + w
            near[j][i] = near[j].get(i, 0.0) + w
    cost, label = list(odds), [None] * n
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if label[i] is None and abs(cost[i]) > sum(near[i].values()):
            label[i] = cost[i] > 0
            for j, w in near[i].items():
                del near[j][i]
                cost[j] += w if label[i] else -w
                if label[j] is None:
                    todo.append(j)
            near[i] = {}
    open_ = [i for i in range(n) if label[i] is None]
    if open_:
        side = max_flow(open_, cost, near)
        for i in open_:
            label[i] = i in side
    return label  # type: ignore[return-value]


def max_flow(nodes: list[int], cost: list[float], near: list[dict[int, float]]) -> set[int]:
    """Shortest augmenting paths; gives the nodes that the source still reaches."""
    left = {i: dict(near[i]) for i in nodes}
    gain, loss = {i: max(cost[i], 0.0) for i in nodes}, {i: max(-cost[i], 0.0) for i in nodes}
    tiny = 1e-12
    while True:
        came: dict[int, int] = {i: -1 for i in nodes if gain[i] > tiny}
        queue, goal = deque(came), None
        while queue and goal is None:
            i = queue.popleft()
            if loss[i] > tiny:
                goal = i
                break
            for j, w in left[i].items():
                if w > tiny and j not in came:
                    came[j] = i
                    queue.append(j)
        if goal is None:
            return set(came)
        path = [goal]
        while came[path[-1]] >= 0:
            path.append(came[path[-1]])
        push = min([gain[path[-1]], loss[goal], *(left[b][a] for a, b in zip(path, path[1:], strict=False))])
        gain[path[-1]] -= push
        loss[goal] -= push
        for a, b in zip(path, path[1:], strict=False):
            left[b][a] -= push
            left[a][b] += push


def main_text(page: str, w: np.ndarray | None = None) -> str:
    """The main text of a page; empty if it has none."""
    blocks = blocks_of(page)
    if not blocks:
        return ""
    odds = np.clip(features(blocks) @ (weights() if w is None else w), -MOST, MOST)
    keep = min_cut(odds.tolist(), edges_of(blocks))
    return "\n".join(b.text for b, ok in zip(blocks, keep, strict=True) if ok)


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` with ``__gs_text``: the text of each page, blocks in page order joined by line feeds.

    A null or empty page gives the empty text. Repeated rows give repeated results. Whole pages are read, of any size; a
    page's blocks are held by one task at a time. Other columns stay as they are. An empty table gives an empty result.
    """
    w = weights()

    @F.arrow_udf("string")
    def text(column: pa.Array) -> pa.Array:
        return pa.array([main_text(x, w) if x else "" for x in column.to_pylist()], pa.string())

    return pages.withColumn(f"{OWN}text", text(F.col(html_col)))


def report(pages: DataFrame) -> DataFrame:
    """The result that the query returns: ``page_id, url, text, n_chars``."""
    return extract(pages.select("page_id", "url", "html")).select("page_id", "url", F.col(f"{OWN}text").alias("text"), F.length(f"{OWN}text").cast("long").alias("n_chars"))

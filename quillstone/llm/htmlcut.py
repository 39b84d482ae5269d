"""HTML main-text extraction as a minimum cut.

The page is cut into blocks of text.  A linear classifier gives the cost of calling a block content
or boilerplate, the capacities to the terminals: log-odds learnt from the block's words and links
with no regard to markup, and bounded log-odds for the elements that
hold it.  Neighbours in the page and in the DOM are joined by smoothness edges.  The minimum cut is
the labelling of least cost: a short line amid paragraphs goes with them whatever it scores alone.
Blocks whose terminal outweighs all their edges are settled beforehand, which changes no optimum;
all others go through maximum flow.
"""

from __future__ import annotations

import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbuf as tb

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?:svg|math)(?:\s[^>]*)?/>"
    r"|<(script|style|noscript|template|svg|math|iframe|object|textarea|select|title|canvas|audio|video)(?=[\s/>])[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>"
    r"|</?[a-zA-Z][^>]*(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_ATTRS = frozenset("class id role style hidden aria-hidden itemprop".split())
_BLOCK = frozenset(
    "address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "legend li link main menu meta nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul button input label".split()
)
_VOID = frozenset("br hr img input link meta area base col embed source track wbr param".split())
_ENDS_P = _BLOCK - frozenset(("br", "input", "label", "button", "link", "meta", "option"))
_OUT = frozenset("nav footer aside form button select menu dialog fieldset label option legend search head input".split())
_BAD = re.compile(
    r"(?:ads?|adv|adverts?|advertisements?|advertising|adbox|adslot|banners?|sponsor\w*|promos?|promotion\w*|sidebar\w*|side|rail|menus?|nav|navbar|navigation|breadcrumbs?|footers?|foot|masthead|topbar|"
    r"comments?|commentlist|respond|replies|reply|discussion|disqus|cookies?|consent|gdpr|notices?|alerts?|warning|popups?|modal|overlay|toast|shar(?:e|ing)|social|related|recommend\w*|more-?(?:news|stories)|"
    r"widgets?|login|signin|signup|subscribe|subscription|newsletter|search|toolbar|pager|pagination|tags?|tagcloud|copyright|legal|disclaimer|skip\w*|hidden|sr-only|byline|meta)",
    re.I,
)
#: Parts that may stand beside a bad one in a name: "site-footer" is one, "tag-politics", "has-sidebar" and "overflow-hidden" are not.
_PLAIN = re.compile(
    r"\d*|site|page|main|post|posts|entry|article|global|top|bottom|left|right|primary|secondary|upper|lower|first|last|visually|"
    r"list|box|bar|block|section|area|zone|slot|unit|wrap|wrapper|container|inner|outer|content|body|item|items|links?|buttons?|icons?|group|panel|row|col|column|form|title|header|head|text|thread|author|cloud|data|info|policy",
    re.I,
)
#: Names of things that often are marked up as articles themselves.
_CARD = re.compile(r"ads?|adv|adverts?|advertisements?|sponsor\w*|promos?|comments?|commentlist|reply|replies|discussion|related|recommend\w*", re.I)
_HEADER = re.compile(r"(?:^|[\W_])(?:header|head|site-title|logo|brand)(?:$|[\W_])", re.I)
_GOOD = re.compile(r"(?:^|[\W_])(?:article\w*|content|contents|entry|post|posts|story|text|body|main|hentry|prose)(?:$|[\W_])", re.I)
_ROLES_OUT = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
_SPACE = re.compile(r"\s+")


#: What the classifier sees of a block: nothing of its markup.
FEATURES = ("words", "links", "sentence", "stop")


@dataclass(frozen=True)
class CutConfig:
    """Log-odds of content that elements add, weights of the smoothness edges, and how the classifier is fitted.

    ``weights``, ``bias``: what the classifier is drawn to, as if ``strength`` times the blocks at hand had shown it.
    ``most``: bound of its log-odds.  ``sample``: it is fitted on at most so many different pages.
    """

    outside: float = -7.0
    named: float = -6.0
    header: float = -6.0
    article: float = 0.5
    good_name: float = 0.5
    heading: float = 0.8
    weights: tuple[float, ...] = (0.5, -4.0, 0.7, 0.5)
    bias: float = -1.5
    most: float = 3.0
    strength: float = 0.5
    sample: int = 4000
    adjacent: float = 1.0
    sibling: float = 0.6
    decay: float = 0.15
    reach: int = 14


class _Node:
    """``named``: what its name adds unless it holds all articles of the page; ``aside``: no article of the page is in it."""

    __slots__ = ("tag", "parent", "prior", "depth", "good", "named", "aside", "held", "mains")

    def __init__(self, tag: str, parent: _Node | None, prior: float, good: bool, named: float = 0.0, aside: bool = False):
        self.tag, self.parent, self.prior, self.good, self.named = tag, parent, prior, good, named
        self.depth = parent.depth + 1 if parent else 0
        self.aside = aside or (parent is not None and parent.aside)
        self.held, self.mains = 0, parent.mains + (parent.tag == "main" and not parent.aside) if parent else 0


def _bad_name(value: str) -> tuple[bool, bool]:
    """Whether a class or id names boilerplate, and whether such as is marked up as articles."""
    bad = card = False
    for token in value.split():
        parts = [p for p in re.split(r"[-_]+", token) if p]
        hits = [p for p in parts if _BAD.fullmatch(p)]
        if _BAD.fullmatch(token) or (hits and all(p in hits or _PLAIN.fullmatch(p) for p in parts)):
            bad = True
            card = card or any(_CARD.fullmatch(p) for p in parts)
    return bad, card


def _prior(tag: str, attrs: str, parent: _Node, cfg: CutConfig) -> tuple[float, bool, float, bool]:
    """What an element adds to the log-odds of all text within it, whether it marks an article, ``named`` and ``aside``."""
    x, good = 0.0, tag in ("article", "main")
    article, named, aside = good, 0.0, False
    if tag in _OUT:
        x += cfg.outside
    elif tag == "header":
        x += 0.0 if parent.good and parent.tag in ("article", "main", "section") else cfg.header
    if attrs and tag not in ("body", "html"):
        for m in _ATTR.finditer(attrs):
            key, v = m[1].lower(), (m[2] or "").strip("\"'")
            if key not in _ATTRS:
                continue
            if key in ("class", "id"):
                bad, card = _bad_name(v)
                if card:
                    x += cfg.named
                    aside = True
                elif bad and not article:
                    named += cfg.named
                elif _GOOD.search(v):
                    good = True
                elif _HEADER.search(v) and not parent.good:
                    x += cfg.header
            elif key == "role":
                if v.lower() in _ROLES_OUT:
                    x += cfg.outside
                good = good or v.lower() in ("main", "article")
            elif key == "itemprop":
                good = good or v.lower() == "articlebody"
                x += cfg.named if v.lower() == "comment" else 0.0
            elif key == "style":
                if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", v, re.I):
                    x += cfg.outside
            elif (key == "hidden" and v.lower() != "until-found") or (key == "aria-hidden" and v.lower() == "true"):
                x += cfg.outside
    if good and not parent.good:
        x += cfg.article if tag in ("article", "main") else cfg.good_name
    return x, good or parent.good, named, aside or x <= cfg.outside


def blocks(html: str, cfg: CutConfig = CutConfig()) -> list[tuple[str, int, _Node]]:
    """(text, characters in links, element) of each block in page order."""
    root = _Node("#root", None, 0.0, False)
    stack = [root]
    out: list[tuple[str, int, _Node]] = []
    parts: list[str] = []
    links: list[str] = []
    anchor = 0
    home: list[_Node] = [root]
    elements: list[_Node] = []
    opened: Counter[str] = Counter()
    articles = 0

    def flush() -> None:
        nonlocal parts, links
        if parts:
            text = _SPACE.sub(" ", unescape("".join(parts))).strip()
            if text:
                linked = len(_SPACE.sub(" ", unescape("".join(links))).strip())
                out.append((text, min(linked, len(text)), home[0]))
            parts, links = [], []

    def add(text: str) -> None:
        if text:
            if not parts:
                home[0] = stack[-1]
            parts.append(text)
            if anchor:
                links.append(text)

    at = 0
    for m in _TOKEN.finditer(html):
        add(html[at : m.start()])
        at = m.end()
        tag = m[3]
        if not tag:
            if m[1] and m[1].lower() in ("textarea", "select", "title"):
                flush()
            continue
        tag = tag.lower()
        if m[2]:  # an end tag
            if tag == "a":
                anchor = max(0, anchor - 1)
            if tag in _BLOCK:
                flush()
            if tag == "br" or not opened[tag]:
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    opened.subtract(x.tag for x in stack[i:])
                    del stack[i:]
                    break
                if tag not in _BLOCK and stack[i].tag in _BLOCK:
                    break  # an inline end tag does not close blocks
            continue
        if tag == "a":
            anchor += 1
        if tag in _BLOCK:
            flush()
            if tag in _ENDS_P:
                anchor = anchor if tag == "a" else 0
                while len(stack) > 1 and (stack[-1].tag not in _BLOCK or (stack[-1].tag == "p") or (tag == "li" and stack[-1].tag == "li") or (tag in ("td", "th") and stack[-1].tag in ("td", "th"))):
                    opened[stack.pop().tag] -= 1
        if tag in _VOID or (m[4] or "").endswith("/"):
            continue
        if tag in _BLOCK or m[4]:
            stack.append(_Node(tag, stack[-1], *_prior(tag, m[4], stack[-1], cfg)))
            elements.append(stack[-1])
            opened[tag] += 1
            if tag in ("article", "main") and not stack[-1].aside:
                articles += 1
                for p in stack:
                    p.held += 1
    add(html[at:])
    flush()
    for p in elements:  # parents come first
        p.prior += p.parent.prior + (0.0 if p.held and p.held + p.mains == articles else p.named)
    return out


_SENTENCE, _STOP = re.compile(r"[.!?:;,。！？，]"), re.compile(r"[.!?…。！？][\"'”’»)\]]*$")


def features(found: list[tuple[str, int, _Node]]) -> np.ndarray:
    """One line of ``FEATURES`` per block."""
    n = len(found)
    x = np.zeros((n, len(FEATURES)))
    for i, (text, linked, _) in enumerate(found):
        words = text.count(" ") + 1
        # whole sentences in a link tell less than a word or two
        x[i, 0], x[i, 1], x[i, 2], x[i, 3] = np.log2(1 + words), linked / len(text) * min(1.0, 12 / words), words > 2 and _SENTENCE.search(text) is not None, _STOP.search(text) is not None
    return x


@dataclass(frozen=True)
class TextModel:
    """Weights by feature and bias of the classifier of blocks."""

    weights: tuple[float, ...]
    bias: float

    @classmethod
    def default(cls, cfg: CutConfig = CutConfig()) -> TextModel:
        return cls(cfg.weights, cfg.bias)


def scores(found: list[tuple[str, int, _Node]], model: TextModel, cfg: CutConfig = CutConfig()) -> list[float]:
    """Log-odds that each block is content."""
    out = np.clip(features(found) @ np.array(model.weights) + model.bias, -cfg.most, cfg.most).tolist()
    for i, (_, _, node) in enumerate(found):
        out[i] += node.prior
        p = node
        while p is not None and p.tag not in _BLOCK:
            p = p.parent
        if p is not None and p.tag in ("h1", "h2", "h3", "h4", "h5", "h6") and p.good:
            out[i] += cfg.heading
    return out


def edges(found: list[tuple[str, int, _Node]], cfg: CutConfig = CutConfig()) -> list[tuple[int, int, float]]:
    """Smoothness edges: next blocks of the page by DOM distance, and next blocks under one parent.

    Blocks further apart in the DOM than ``cfg.reach`` steps are not joined, so deep pages cost no more.
    """
    out = []
    last: dict[int, int] = {}
    for i, (_, _, node) in enumerate(found):
        if i:
            a, b, d = found[i - 1][2], node, 0
            while a is not b and d <= cfg.reach:
                if a.depth >= b.depth:
                    a = a.parent
                else:
                    b = b.parent
                d += 1
            if a is b:
                out.append((i - 1, i, cfg.adjacent * cfg.decay ** max(0, d - 2)))
        key = id(node.parent)
        if key in last and last[key] != i - 1:
            out.append((last[key], i, cfg.sibling))
        last[key] = i
    return out


def minimum_cut(scores: list[float], links: list[tuple[int, int, float]]) -> list[bool]:
    """Labels (True: content) of least cost: max(0, -score) for content, max(0, score) else, plus cut edges.

    A score of exactly 0 that no edge decides is boilerplate.
    """
    n = len(scores)
    around: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in links:
        if a != b and w > 0:
            around[a][b] = around[a].get(b, 0.0) + w
            around[b][a] = around[b].get(a, 0.0) + w
    x = list(scores)
    # a terminal that outweighs all edges settles its block
    label = [s > 0 if abs(s) > sum(e.values()) or not e else None for s, e in zip(scores, around)]
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        for i in rest:
            for j, w in list(around[i].items()):
                if label[j] is not None:
                    x[i] += w if label[j] else -w
                    del around[i][j]
        side = _max_flow(rest, x, around)
        for i in rest:
            label[i] = i in side
    return label


def _max_flow(nodes: list[int], x: list[float], around: list[dict[int, float]]) -> set[int]:
    """The source's side of a minimum cut: blocking flows along shortest paths, level by level."""
    cap = {i: dict(around[i]) for i in nodes}
    out = {i: max(0.0, -x[i]) for i in nodes}  # left to the sink
    supply = {i: x[i] for i in nodes if x[i] > 1e-12}  # left from the source
    while True:
        level = dict.fromkeys(supply, 0)
        q, near = deque(supply), None
        while q:
            u = q.popleft()
            if near is not None and level[u] >= near:
                continue
            if out[u] > 1e-12:
                near = level[u]
                continue
            for v, c in cap[u].items():
                if c > 1e-12 and v not in level:
                    level[v] = level[u] + 1
                    q.append(v)
        if near is None:
            return set(level)
        ways = {u: list(cap[u]) for u in level}
        for s in list(supply):
            path = [s]
            while path and supply.get(s, 0.0) > 1e-12:
                u = path[-1]
                if out[u] > 1e-12:
                    push = min(supply[s], out[u], *(cap[a][b] for a, b in zip(path, path[1:])))
                    supply[s] -= push
                    out[u] -= push
                    for a, b in zip(path, path[1:]):
                        cap[a][b] -= push
                        cap[b][a] = cap[b].get(a, 0.0) + push
                    path = [s]
                elif ways[u]:
                    v = ways[u][-1]
                    if cap[u].get(v, 0.0) > 1e-12 and level.get(v) == level[u] + 1 and level[v] <= near:
                        path.append(v)
                    else:
                        ways[u].pop()
                else:
                    path.pop()
                    if path:
                        ways[path[-1]].pop()
            if supply.get(s, 0.0) <= 1e-12:
                supply.pop(s, None)


def main_text(html: str | None, model: TextModel | None = None, cfg: CutConfig = CutConfig()) -> str:
    """Text of the content blocks in page order, joined by single spaces; empty if there are none."""
    found = blocks(html, cfg) if html else []
    if not found:
        return ""
    keep = minimum_cut(scores(found, model or TextModel.default(cfg), cfg), edges(found, cfg))
    return " ".join(b[0] for b, k in zip(found, keep) if k)


def _taught(found: list[tuple[str, int, _Node]]) -> list[int | None]:
    """What the markup says beyond doubt: 1 within an article, 0 within an element or name of boilerplate."""
    out: list[int | None] = []
    for _, _, node in found:
        p, inside = node, False
        while p is not None and not inside:
            inside = p.tag in ("article", "main") and not p.aside
            p = p.parent
        out.append(0 if node.prior <= -5 else 1 if inside and node.prior >= 0 else None)
    return out


#: Steps of the grid on which blocks are counted for the fit, by feature: the table stays small however many blocks there are.
_GRID = np.array([2.0, 10.0, 1.0, 1.0])


def train(pages: DataFrame, html: str = "html", cfg: CutConfig = CutConfig()) -> TextModel:
    """Fit the classifier on what ``article``, ``main``, ``nav`` and the like say of the blocks they hold.

    It reads those ``cfg.sample`` pages, at most, whose text has the least hash, each different page
    once; both labels weigh alike.  Pages without such elements teach nothing, and without both labels
    (as for an empty table) the weights of ``cfg`` stay.
    """
    h = pages.where(F.col(html).isNotNull()).select(F.xxhash64(html).alias("h"), F.col(html).alias("html"))
    last = h.select("h").distinct().orderBy("h").limit(cfg.sample).agg(F.max("h")).first()[0]
    if last is None:
        return TextModel.default(cfg)
    chosen = h.where(F.col("h") <= last).dropDuplicates(["h"]).select("html")
    names = [f"f{i}" for i in range(len(FEATURES))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            seen: Counter[tuple[int, ...]] = Counter()
            for page in t.column(0).to_pylist():
                found = blocks(page, cfg)
                if found:
                    grid = np.rint(features(found) * _GRID).astype(int).tolist()
                    seen.update((y, *g) for y, g in zip(_taught(found), grid) if y is not None)
            cols = list(zip(*[(*k, n) for k, n in seen.items()])) or [()] * (len(names) + 2)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()) for c in cols], names=["y", *names, "n"])

    counted = chosen.mapInArrow(run, "y int, " + ", ".join(f"{c} int" for c in names) + ", n int")
    got = counted.groupBy("y", *names).agg(F.sum("n").alias("n")).toArrow()  # cells of the grid
    y, n = got.column("y").to_numpy().astype(float), got.column("n").to_numpy().astype(float)
    x = np.column_stack([got.column(c).to_numpy() for c in names]) / _GRID
    order = np.lexsort((*x.T, y))
    return fit(x[order], y[order], n[order], cfg)


def fit(x: np.ndarray, y: np.ndarray, n: np.ndarray, cfg: CutConfig = CutConfig()) -> TextModel:
    """Logistic regression of ``n`` blocks a line by Newton steps, drawn to the weights of ``cfg``."""
    one, all_ = float(n[y > 0.5].sum()) if len(y) else 0.0, float(n.sum())
    if not 0 < one < all_:
        return TextModel.default(cfg)
    weight = n * np.where(y > 0.5, 0.5 / one, 0.5 / (all_ - one)) * all_
    z, start = np.column_stack([x, np.ones(len(x))]), np.array([*cfg.weights, cfg.bias])
    w, pull = start.copy(), cfg.strength * all_
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (weight * (p * (1 - p) + 1e-9))[:, None]).T @ z + pull * np.eye(len(w)), z.T @ (weight * (p - y)) + pull * (w - start))
        w = w - step * min(1.0, 2.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-9:
            break
    return TextModel(tuple(np.round(w[:-1], 6).tolist()), round(float(w[-1]), 6))


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", model: TextModel | None = None, cfg: CutConfig = CutConfig()) -> DataFrame:
    """``(page_id, url, text, n_chars)`` per row, by a fitted ``model`` or the weights of ``cfg``.

    Null and empty pages, and pages without content, give an empty text; repeated rows are judged
    alike; a page of any length or depth is read whole; an empty table gives no rows; other columns
    play no part, whatever their names.
    """
    kinds = [pages.schema[c].dataType.simpleString() for c in (page_id, url)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            for a, z in tb.row_slices(t.column(2)):
                texts = [main_text(h, model, cfg) for h in t.column(2).slice(a, z - a).to_pylist()]
                yield pa.RecordBatch.from_arrays([t.column(0).slice(a, z - a), t.column(1).slice(a, z - a), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html")).mapInArrow(run, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars bigint")

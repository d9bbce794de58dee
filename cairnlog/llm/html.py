"""Main text of web pages: boosted trees over DOM nodes, decoded so that choices agree along the tree.

A node is an element that starts a block.  Trees give each node the log-odds that
main text is in it, from what it holds, how it is named, and where it stands.
The kept nodes are the best set in which every kept node's parent is kept, so
nothing is kept inside what was dropped.
"""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_names, least_hashes, slices, text_or_empty, with_fields
from .trees import Boosted, boost

# fixed values: elements of HTML by how they are laid out or closed
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th"
    " thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Never text of the page.
SILENT = frozenset("script style noscript template head title svg math iframe object canvas select textarea button audio video".split())
#: Their content is not markup.
RAW = frozenset("script style textarea title iframe noscript".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose start closes an open element of the same kind.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "thead": {"tr", "td", "th"}, "tbody": {"tr", "td", "th", "thead"}, "tfoot": {"tr", "td", "th", "tbody"},
}
SCOPES = frozenset("table td th ul ol dl div article section main body nav aside header footer form blockquote".split())
_NAMES = re.compile(r"""(?:class|id|role|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)""", re.I)
_TOKEN = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_LETTERS = re.compile(r"[a-zA-Z][^\s/>]*")

#: Attribute tokens as features, by what they begin with.
TOKENS = (
    "nav", "menu", "head", "foot", "side", "ad", "spons", "promo", "banner", "comment", "repl", "notice", "cookie", "consent", "alert",
    "form", "news", "subscri", "search", "share", "social", "relat", "widget", "bread", "copy", "modal", "popup", "meta", "tag",
    "content", "article", "main", "post", "entry", "story", "body", "text",
)
TAGS = ("article", "main", "section", "div", "p", "li", "ul", "ol", "nav", "header", "footer", "aside", "form", "table", "td", "blockquote", "pre", "figure")
_STEMS = re.compile("(" + "|".join(sorted(TOKENS, key=len, reverse=True)) + ")")
_STEM_AT = {t: i for i, t in enumerate(TOKENS)}
_TAG_AT = {t: i for i, t in enumerate(TAGS)}


@dataclass
class Page:
    """Block elements in page order (parents first) and the texts directly in them."""

    tags: list[str] = field(default_factory=list)
    parents: list[int] = field(default_factory=list)
    names: list[str] = field(default_factory=list)
    inline: list[int] = field(default_factory=list)  # inline elements in a node
    links: list[int] = field(default_factory=list)  # characters of its text inside links
    pieces: list[tuple[int, int, str]] = field(default_factory=list)  # node, block, text

    def add(self, tag: str, parent: int, names: str) -> int:
        for values, value in ((self.tags, tag), (self.parents, parent), (self.names, names), (self.inline, 0), (self.links, 0)):
            values.append(value)
        return len(self.tags) - 1


def parse(page: str) -> Page:
    """Read a page as browsers do, more or less: unclosed and misplaced tags are mended, comments left out.

    Every character is looked at a bounded number of times, also in pages that
    never close a tag or a quote.
    """
    out = Page()
    root = out.add("html", -1, "")
    stack: list[tuple[str, int]] = [("html", root)]
    block, at, n, linked, silent = 0, 0, len(page), 0, 0
    ends = True  # whether a > may still come

    def text(start: int, end: int) -> None:
        if end > start and not silent:
            piece = page[start:end]
            if "&" in piece:
                piece = references.unescape(piece)
            out.pieces.append((stack[-1][1], block, piece))
            if linked:
                out.links[stack[-1][1]] += len(piece)

    def pop() -> None:
        nonlocal block, linked, silent
        tag, _ = stack.pop()
        block += tag in BLOCKS
        linked -= tag == "a"
        silent -= tag in SILENT

    while at < n:
        less = page.find("<", at)
        if less < 0 or not ends:
            text(at, n)
            break
        follow = page[less + 1 : less + 2]
        if not (follow.isalpha() and follow.isascii()) and follow not in ("/", "!", "?"):
            text(at, less + 1)
            at = less + 1
            continue
        text(at, less)
        if page.startswith("<!--", less):
            end = page.find("-->", less + 4)
            at = n if end < 0 else end + 3
            continue
        more = page.find(">", less)
        if more < 0:
            ends = False
            text(less, n)
            break
        tag_text = page[less + 1 : more]
        for quote in ('"', "'"):
            if follow.isalpha() and tag_text.count(quote) % 2 and (close := page.find(quote, more)) >= 0 and (later := page.find(">", close)) >= 0:
                more = later
                tag_text = page[less + 1 : more]
                break
        at = more + 1
        if follow in ("!", "?"):
            continue
        if follow == "/":
            name = tag_text[1:].strip().lower()
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == name:
                    while len(stack) > i:
                        pop()
                    break
                if stack[i][0] in SCOPES and name not in SCOPES:
                    break  # an inline end tag closes nothing outside of its box
            else:
                block += name in BLOCKS
            continue
        name = _LETTERS.match(tag_text)[0].lower()
        if name == "br":
            text_at = stack[-1][1]
            if not silent:
                out.pieces.append((text_at, block, " "))
            continue
        if name in BLOCKS:
            for i in range(len(stack) - 1, 0, -1):  # an open paragraph ends where a block begins
                if stack[i][0] == "p" or stack[i][0] in HEADINGS and name in HEADINGS:
                    while len(stack) > i:
                        pop()
                    break
                if stack[i][0] in SCOPES:
                    break
            if name in CLOSES:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] in CLOSES[name]:
                        while len(stack) > i:
                            pop()
                    elif stack[i][0] in ("ul", "ol", "dl", "table", "div", "article", "section", "main"):
                        break
            block += 1
            if name == "html":
                continue
            if name not in VOID:
                found = _NAMES.findall(tag_text) if "=" in tag_text else []
                names = " ".join(_TOKEN.findall(" ".join(_CAMEL.sub(" ", v) for v in found).lower()))
                stack.append((name, out.add(name, stack[-1][1], names)))
            continue
        if name in VOID or tag_text.endswith("/"):
            continue
        if name in RAW:
            end = re.compile("</" + name, re.I).search(page, at)
            if end is None:
                break
            close = page.find(">", end.end())
            at = n if close < 0 else close + 1
            continue
        out.inline[stack[-1][1]] += 1
        linked += name == "a"
        silent += name in SILENT
        stack.append((name, stack[-1][1]))
    return out


N_FEATURES = len(TAGS) + 2 * len(TOKENS) + 21


def node_features(page: Page) -> np.ndarray:
    """One row a node: kind, attribute tokens (own and of ancestors), depth, siblings, and densities of its subtree."""
    n = len(page.tags)
    own = np.zeros((n, 6))  # characters, words, sentence marks, characters in links, inline elements, blocks
    before = np.zeros(n)
    total = 0
    for node, _, piece in page.pieces:
        length = len(piece)
        row = own[node]
        if not row[0]:
            before[node] = total
        row[0] += length
        row[1] += piece.count(" ") + 1
        row[2] += piece.count(".") + piece.count(",") + piece.count("!") + piece.count("?")
        total += length
    own[:, 3], own[:, 4] = page.links, page.inline
    own[:, 5] = own[:, 0] > 0
    tree = own.copy()
    nodes, paragraphs, headings, items = np.ones(n), np.zeros(n), np.zeros(n), np.zeros(n)
    parents = page.parents
    depth, children = np.zeros(n), np.zeros(n)
    order = np.zeros(n)
    for i in range(1, n):
        depth[i] = depth[parents[i]] + 1
        order[i] = children[parents[i]]
        children[parents[i]] += 1
    starts = before.copy()
    for i in range(n - 1, 0, -1):
        parent, tag = parents[i], page.tags[i]
        paragraphs[i] += tag == "p"
        headings[i] += tag in HEADINGS
        items[i] += tag == "li"
        tree[parent] += tree[i]
        nodes[parent] += nodes[i]
        paragraphs[parent] += paragraphs[i]
        headings[parent] += headings[i]
        items[parent] += items[i]
    kind = np.zeros((n, len(TAGS)))
    names = np.zeros((n, len(TOKENS)))
    above = np.zeros((n, len(TOKENS)))
    outer = np.zeros((n, 5))
    for i, (tag, attributes) in enumerate(zip(page.tags, page.names, strict=True)):
        if tag in _TAG_AT:
            kind[i, _TAG_AT[tag]] = 1
        for word in attributes.split():
            if m := _STEMS.match(word):
                names[i, _STEM_AT[m[0]]] = 1
        if i:
            parent = parents[i]
            above[i] = np.maximum(above[parent], names[parent])
            outer[i] = outer[parent]
            mark = page.tags[parent]
            outer[i, 0] += mark in ("nav", "menu")
            outer[i, 1] += mark in ("footer", "header")
            outer[i, 2] += mark in ("aside", "form")
            outer[i, 3] += mark in ("article", "main")
            outer[i, 4] += mark == "li"
    chars = np.maximum(tree[:, 0], 1)
    parent_index = np.maximum(parents, 0)
    siblings = children[parent_index]
    numbers = np.stack(
        [
            np.log1p(tree[:, 0]), np.log1p(own[:, 0]), tree[:, 3] / chars, tree[:, 1] / nodes, tree[:, 2] / np.maximum(tree[:, 1], 1),
            tree[:, 0] / nodes, (nodes + tree[:, 4]) / chars, tree[:, 0] / max(total, 1), starts / max(total, 1), depth, order,
            siblings, tree[:, 0] / np.maximum(tree[parent_index, 0], 1), tree[parent_index, 0] / np.maximum(siblings, 1) / 100,
            np.log1p(paragraphs), headings,
        ],
        axis=1,
    )
    return np.concatenate((kind, names, above, numbers, outer), axis=1)


@dataclass
class Model:
    """Two rounds of trees: the second also sees what the first thinks of a node's surroundings."""

    first: Boosted
    second: Boosted

    def log_odds(self, pages: list[Page], rows: list[np.ndarray]) -> list[np.ndarray]:
        ends = np.cumsum([len(r) for r in rows])[:-1]
        before = np.split(self.first.log_odds(np.concatenate(rows)), ends)
        full = [np.concatenate((r, surroundings(p, o)), axis=1) for p, r, o in zip(pages, rows, before, strict=True)]
        return np.split(self.second.log_odds(np.concatenate(full)), ends)


def surroundings(page: Page, odds: np.ndarray) -> np.ndarray:
    """First odds of the node, its parent, the worst of its ancestors, and the siblings before and after."""
    n = len(odds)
    odds = np.clip(odds, -8, 8)
    out = np.stack([odds, odds, odds, np.zeros(n), np.zeros(n)], axis=1)
    last: dict[int, int] = {}
    for i in range(1, n):
        parent = page.parents[i]
        out[i, 1] = odds[parent]
        out[i, 2] = min(out[parent, 2] if parent else odds[parent], odds[parent])
        if parent in last:
            out[i, 3] = odds[last[parent]]
            out[last[parent], 4] = odds[i]
        last[parent] = i
    return out


def kept(page: Page, odds: np.ndarray) -> np.ndarray:
    """The ancestor-closed set of nodes with the greatest sum of log-odds."""
    best = odds.astype(float).copy()
    for i in range(len(best) - 1, 0, -1):
        if best[i] > 0:
            best[page.parents[i]] += best[i]
    keep = best > 0
    for i in range(1, len(best)):
        keep[i] &= keep[page.parents[i]]
    return keep


def main_text(page: Page, keep: np.ndarray) -> str:
    """Texts of the kept nodes: a line a block, white space inside as one space, empty blocks left out."""
    lines: list[str] = []
    held: list[str] = []
    last = None
    for node, block, piece in page.pieces:
        if (node, block) != last:
            if line := " ".join("".join(held).split()):
                lines.append(line)
            held, last = [], (node, block)
        if keep[node]:
            held.append(piece)
    if line := " ".join("".join(held).split()):
        lines.append(line)
    return "\n".join(lines)


def extract(df: DataFrame, model: Model, html: str = "html") -> DataFrame:
    """``df`` without ``html``, plus ``text``: the main text of the whole page.

    Null and empty pages have an empty text; repeated rows stay; an input column
    named ``text`` is replaced.
    """
    names = [n for n in fresh_names(df, ["text"]) if n != html]
    source = df.select(*[F.col(f"`{n}`") for n in names], text_or_empty(html).alias("__llm_html"))
    shared = df.sparkSession.sparkContext.broadcast(model)  # some ten thousand numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages = batch.column(len(names))
            for first, last in slices(pages, 4_000_000):
                part = batch.slice(first, last - first)
                texts = extracted(pages.slice(first, last - first).to_pylist(), shared.value)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], pa.array(texts, pa.string())], names=[*names, "text"])

    return source.mapInArrow(run, with_fields(df, names, "text string"))


def extracted(pages: list[str], model: Model) -> list[str]:
    parsed = [parse(p) for p in pages]
    rows = [node_features(p) for p in parsed]
    odds = model.log_odds(parsed, rows) if rows else []
    return [main_text(page, kept(page, own)) for page, own in zip(parsed, odds, strict=True)]


def learn(df: DataFrame, key: str = "page_id", html: str = "html", sample: int = 200) -> Model:
    """Train on at most ``sample`` pages, picked by a hash of the key, that mark their article.

    Pages with one article or main element tell what is main text.  Each is also
    laid out anew, with its own texts, in the ways other sites name and nest
    things, so that the trees don't hang on one site's marks.  Without such pages
    a single made-up one stands in.
    """
    source = df.select(F.xxhash64(F.col(f"`{key}`")).alias("h"), text_or_empty(html).alias("t"))
    marked = source.where(F.col("t").rlike("(?i)<(article|main)[\\s>]"))
    rows = least_hashes(marked, "h", F.xxhash64("t"), sample, marked.count())
    return fit(list(dict.fromkeys(r["t"] for r in rows)))


def fit(pages: list[str], layouts: int = 3) -> Model:
    rng = np.random.default_rng(23)
    known: list[Page] = []
    labels: list[np.ndarray] = []
    texts = []
    for source in pages:
        page = parse(source)
        y = _labels(page, lambda p, i: p.tags[i] in ("article", "main"))
        if y.any():
            known += [page] * 3  # real pages weigh as much as their layouts
            labels += [y] * 3
            texts.append((_blocks(page, y > 0), _blocks(page, y == 0)))
    texts = [t for t in texts if t[0]] or [([("p", "A sentence, and another one.")] * 3, [("p", "Home")])]
    for good, bad in texts:
        for _ in range(layouts):
            other = texts[int(rng.integers(len(texts)))][0]
            page = parse(_laid_out(good, bad, other, rng))
            known.append(page)
            labels.append(_labels(page, lambda p, i: "qqmain" in p.names[i].split()))
    rows = [node_features(p) for p in known]
    half = rng.random(len(rows)) < 0.5
    half[:1] = True
    first = boost(np.concatenate([r for r, h in zip(rows, half, strict=True) if h]), np.concatenate([y for y, h in zip(labels, half, strict=True) if h]))
    full = [np.concatenate((r, surroundings(p, first.log_odds(r))), axis=1) for p, r in zip(known, rows, strict=True)]
    return Model(first, boost(np.concatenate(full), np.concatenate(labels)))


def _labels(page: Page, is_main) -> np.ndarray:
    """1 for main elements, what is in them but for marked asides, and what they are in."""
    y = np.zeros(len(page.tags))
    for i, parent in enumerate(page.parents):
        if is_main(page, i):
            y[i] = 1
            up = parent
            while up >= 0 and y[up] == 0:
                y[up] = 2
                up = page.parents[up]
        elif parent >= 0 and y[parent] == 1:
            aside = page.tags[i] in ("nav", "aside", "footer", "form") or "qqaside" in page.names[i].split()
            y[i] = 0 if aside else 1
    return (y > 0).astype(float)


def _blocks(page: Page, wanted: np.ndarray) -> list[tuple[str, str]]:
    held: dict[tuple[int, int], list[str]] = {}
    for node, block, piece in page.pieces:
        if wanted[node]:
            held.setdefault((node, block), []).append(piece)
    out = [(page.tags[node], " ".join("".join(p).split())) for (node, _), p in held.items()]
    return [(tag, line) for tag, line in out if line]


#: Names that sites give to boxes, for layouts to train on.
BOXES = {
    "nav": ("nav", "menu", "navbar", "main-menu", "topnav", "breadcrumbs", "site-nav", "navigation"),
    "header": ("header", "site-header", "masthead head", "page-header", "top-bar header"),
    "footer": ("footer", "site-footer", "foot", "page-footer", "copyright"),
    "aside": ("sidebar", "side", "widget", "related", "related-posts", "side-column", "right sidebar", "newsletter", "widget-area"),
    "ad": ("ad", "ads", "advert", "advertisement", "ad-slot", "sponsored", "promo", "banner", "adsense"),
    "notice": ("notice", "cookie-notice", "cookie-banner", "consent", "alert", "popup", "modal notice", "gdpr cookie"),
    "comments": ("comments", "comment-list", "comment-section", "replies", "respond", "user-comments"),
    "share": ("share", "social", "share-buttons", "social-links", "post-meta", "tags"),
    "main": ("content", "article", "post", "entry-content", "story", "main-content", "post-body", "article-text", "body-text", "main"),
    "wrap": ("wrapper", "container", "page", "layout", "site", "row", "grid", "outer"),
}


def _laid_out(good: list[tuple[str, str]], bad: list[tuple[str, str]], other: list[tuple[str, str]], rng: np.random.Generator) -> str:
    """A page of the given main blocks among boxes of other text."""
    pick = lambda values: values[int(rng.integers(len(values)))]
    chance = lambda p: rng.random() < p
    safe = references.escape

    def box(kind: str, inner: str, tags: tuple[str, ...] = ("div",), mark: str = "", named: float = 0.8) -> str:
        tag = pick(tags)
        name = pick(BOXES[kind]) if chance(named) or tag == "div" and kind not in ("wrap", "main") and chance(0.7) else ""
        name = f"{name} {mark}".strip()
        return f'<{tag}{" " + pick(("class", "class", "id")) + chr(61) + chr(34) + name + chr(34) if name else ""}>{inner}</{tag}>'

    lines = [line for _, line in bad] or ["Home"]
    words = [w for line in lines for w in line.split()] or ["Home"]
    short = lambda: safe(" ".join(pick(words) for _ in range(int(rng.integers(1, 4)))))
    sentence = lambda: safe(pick(other)[1][: int(rng.integers(30, 400))] if chance(0.6) else pick(lines))
    paragraphs = lambda a, b: "".join(f"<p>{sentence()}</p>" for _ in range(int(rng.integers(a, b))))
    items = lambda a, b: "<ul>" + "".join(f'<li><a href="/">{short()}</a></li>' for _ in range(int(rng.integers(a, b)))) + "</ul>"
    body = []
    for tag, line in good:
        tag = tag if tag in HEADINGS or tag in ("p", "li", "blockquote", "pre", "td") else "p"
        if tag in HEADINGS and chance(0.5):
            line = " ".join(line.split()[: int(rng.integers(1, 6))])
        if body and chance(0.06):
            body.append(f"<h{rng.integers(2, 5)}>{short()}</h{rng.integers(2, 5)}>")
        body.append(f"<{tag}>{safe(line)}</{tag}>")
        if chance(0.04):
            body.append(box("ad", sentence(), ("div", "aside"), "qqaside"))
        if chance(0.03):
            body.append(box("aside", items(2, 5) if chance(0.5) else paragraphs(1, 3), ("aside", "div"), "qqaside"))
    if chance(0.3):
        body.insert(0, box("share", short(), ("div",), "qqaside"))
    if chance(0.3):
        body.append(box("share", items(2, 5), ("div", "footer"), "qqaside"))
    if chance(0.25):
        remarks = "".join(box("comments", f"<p>{sentence()}</p>", ("div", "article", "li"), "", 0.6) for _ in range(int(rng.integers(1, 6))))
        body.append(box("comments", remarks, ("section", "div", "ol"), "qqaside"))
    if chance(0.12):  # nothing but the text
        return f'<html><body class="qqmain">{"".join(body[: int(rng.integers(1, len(body) + 1))])}</body></html>'
    main = box("main", "".join(body), ("article", "div", "div", "main", "section"), "qqmain", 0.75)
    for _ in range(int(rng.integers(0, 3))):
        main = box("wrap", main, ("div", "main", "section"), "", 0.5)
    top, bottom = [], []
    if chance(0.6):
        top.append(box("header", f"<h1>{short()}</h1>" + (f"<p>{sentence()}</p>" if chance(0.3) else ""), ("header", "div")))
    if chance(0.8):
        top.append(box("nav", items(3, 10), ("nav", "div")))
    if chance(0.4):
        top.append(box("notice", paragraphs(1, 3), ("div", "section", "aside")))
    if chance(0.5):
        top.append(box("ad", f"<p>{sentence()}</p>" if chance(0.5) else sentence()))
    side = box("aside", (f"<h3>{short()}</h3>" if chance(0.5) else "") + (items(2, 8) if chance(0.6) else paragraphs(1, 5)), ("aside", "div"))
    if chance(0.6):
        (bottom if chance(0.7) else top).append(side)
    if chance(0.4):
        remarks = "".join(box("comments", f"<p>{sentence()}</p>", ("div", "li", "article"), "", 0.6) for _ in range(int(rng.integers(1, 8))))
        bottom.append(box("comments", f"<h2>{short()}</h2>" + remarks, ("section", "div", "ol")))
    if chance(0.4):
        bottom.append(f'<form><label>{short()}</label><input name="q"><p>{sentence()}</p></form>')
    if chance(0.4):
        bottom.append(box("notice", sentence(), ("div", "section")))
    bottom.append(box("footer", f"<p>&copy; {sentence()}</p>" if chance(0.5) else f"&copy; {short()} &middot; {sentence()}", ("footer", "div")))
    return f"<!DOCTYPE html><html><head><title>{short()}</title></head><body>{''.join(top)}{main}{''.join(bottom)}</body></html>"

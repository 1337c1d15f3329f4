"""Main text of web pages by gradient-boosted trees over DOM nodes.

Each node gets features of its subtree (text, links, punctuation, density), its tag and attribute tokens, its depth and
its siblings; the trees give the probability that it holds main text. Decoding maximises the likelihood of all choices
of a page under the rule that nothing is kept below a dropped node.

Pages carry no labels. The trees are fitted on pages of the table that say themselves what their article is, and on
layouts that are put together from the texts of these pages, where it is known what is article and what is not.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratawork.llm.text import steps

#: Pages that the trees are fitted on, the first by a hash of their ids among those up to MOST_CHARS long.
SAMPLE, MOST_CHARS = 150, 30_000
#: Layouts that are put together for the fit.
LAYOUTS = 450
TREES, DEPTH, RATE, BINS = 60, 4, 0.2, 32

#: Attributes of a tag; a quote stands for itself unless it follows an equals sign.
_ATTRIBUTES = r"""(?:[^=>]|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+"""
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(script|style)(?=[\s/>]){_ATTRIBUTES}>.*?(?:</\1(?=[\s/>])[^>]*>|\Z)"
    rf"|<(title|textarea|iframe)(?=[\s/>]){_ATTRIBUTES}>[^<]*+(?:<(?!/?\2[\s/>])[^<]*+)*+</\2\s*+>"
    rf"|<(/?)([a-zA-Z][^\s/>]*+)({_ATTRIBUTES})>|</?[a-zA-Z!?][^>]*>",
    re.S | re.I,
)
#: Elements whose text is left out. One without an end tag ends with its parent, or where a block begins or ends.
_RAW = frozenset("noscript template title textarea select button iframe object svg canvas audio video".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike"
    " strong sub sup time tt u var".split()
)
#: An opening tag closes an open element of its group, as far as no container lies between.
_SAME = {tag: frozenset(group.split()) for group in ("li", "dt dd", "tr", "td th", "option") for tag in group.split()}
_CONTAINER = frozenset("ul ol dl table tbody thead tfoot body div section article main aside nav header footer form".split())
_TAGS = {
    t: k
    for k, group in enumerate(
        ["article main", "section div", "p", "h1 h2 h3 h4 h5 h6", "ul ol dl", "li dt dd", "nav menu", "header", "footer",
         "aside", "form fieldset input", "table tbody thead tr td th", "figure figcaption blockquote pre", "body html"], 1
    )
    for t in group.split()
}
_TOKENS = [
    frozenset(x.split())
    for x in (
        "article content post entry main body story text prose articlebody maincontent",
        "ad ads advert adverts advertisement advertising sponsor sponsored promo promoted promotion adsense dfp",
        "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc skip tabs",
        "header masthead top topbar logo branding banner",
        "footer foot bottom copyright contentinfo legal colophon",
        "sidebar aside side rail widget widgets related recommended recommendations complementary trending popular more teaser",
        "comment comments commentlist reply replies respond discussion disqus thread",
        "cookie cookies notice consent gdpr popup modal overlay alert newsletter subscribe subscription paywall toast",
        "form login search signup register contact",
        "share sharing social follow like tweet facebook twitter",
    )
]
_CLASSES = re.compile(r"""(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden|aria-hidden\s*=\s*.?true|(?:^|\s)hidden(?:\s|=|/|$)", re.I)
_WORD = re.compile(r"[a-z]+|[A-Z](?:[a-z]+|[A-Z]*(?![a-z]))")


#: Set on the main elements of layouts for the fit; no feature looks at it.
_MARK = 1 << (len(_TOKENS) + 1)


def _attribute_flags(attributes: str) -> int:
    """Bits for the groups of attribute tokens, and one for hidden elements."""
    tokens = {w.lower() for m in _CLASSES.findall(attributes) for w in _WORD.findall("".join(m))}
    flags = sum(1 << k for k, group in enumerate(_TOKENS) if not tokens.isdisjoint(group))
    flags |= 1 << len(_TOKENS) if _HIDDEN.search(attributes) else 0
    return flags | (_MARK if "data-main" in attributes else 0)


def _empty(tag: str, attributes: str) -> bool:
    return tag == "svg" and attributes.endswith("/")


def _closed(tokens: list[re.Match]) -> set[int]:
    """Places of the start tags of _RAW elements that have an end tag of their own."""
    open_at: dict[str, list[int]] = {}
    found: set[int] = set()
    for k, token in enumerate(tokens):
        if token[4] and (tag := token[4].lower()) in _RAW:
            if not token[3]:
                if not _empty(tag, token[5]):
                    open_at.setdefault(tag, []).append(k)
            elif open_at.get(tag):
                found.add(open_at[tag].pop())
    return found


class Nodes(NamedTuple):
    """Nodes of many pages in document order, parents first, and their pieces of text."""

    rows: list[list[int]]  # page, parent, depth, tag, attribute flags, child number, own words, characters, link characters, stops
    pieces: list[tuple[int, int, str]]  # node, block, text


def parse(pages: list[str]) -> Nodes:
    """Nodes and texts of pages; tags that are left open or never opened are put up with."""
    rows: list[list[int]] = []
    pieces: list[tuple[int, int, str]] = []
    flags_of: dict[str, int] = {}
    children: list[int] = []
    block = 0
    for page, source in enumerate(pages):
        stack: list[tuple[str, int]] = []  # tag, node; inline elements without a role of their own have their parent's node
        links = 0
        skipped = 0  # place in the stack of the element whose text is left out, if any
        tokens = list(_TOKEN.finditer(source))
        closed = _closed(tokens)
        ends = True  # whether that element has an end tag

        def opened(tag: str, attributes: str) -> None:
            parent = stack[-1][1] if stack else -1
            flags = flags_of.get(attributes)
            if flags is None:
                flags = flags_of[attributes] = _attribute_flags(attributes) if attributes.strip(" /") else 0
            if tag in _INLINE and not flags:
                stack.append((tag, parent))
                return
            if parent >= 0:
                children[parent] += 1
            depth = rows[parent][2] + 1 if parent >= 0 else 0
            rows.append([page, parent, depth, _TAGS.get(tag, 0), flags, children[parent] if parent >= 0 else 0, 0, 0, 0, 0])
            children.append(0)
            stack.append((tag, len(rows) - 1))

        opened("body", "")
        at = 0
        for place, token in enumerate(tokens):
            if skipped:
                pass
            elif (a := token.start()) > at and not (text := source[at:a]).isspace():
                if "&" in text:
                    text = html.unescape(text)
                pieces.append((stack[-1][1], block, text))
                own = rows[stack[-1][1]]
                own[6] += text.count(" ") + 1
                own[7] += len(text)
                own[8] += len(text) if links else 0
                own[9] += text.count(".") + text.count(",") + text.count("!") + text.count("?")
            elif a > at:
                pieces.append((stack[-1][1], block, " "))
            at = token.end()
            tag = token[4]
            if tag is None:
                continue
            tag = tag.lower()
            inline = tag in _INLINE
            if skipped and not ends and (tag in _TAGS or tag in ("html", "head", "body")) and tag != "input":
                links -= sum(t == "a" for t, _ in stack[skipped:])
                del stack[skipped:]
                skipped = 0
            if skipped:
                # Only what ends the element, or one around it, counts here.
                if token[3]:
                    for k in range(len(stack) - 1, 0, -1):
                        if stack[k][0] == tag:
                            if k < skipped and not inline:
                                block += 1
                            links -= sum(t == "a" for t, _ in stack[k:])
                            del stack[k:]
                            skipped = skipped if k > skipped else 0
                            break
                        if inline and k != skipped and stack[k][0] not in _INLINE:
                            break
                elif tag not in _VOID and not token[5].endswith("/"):
                    stack.append((tag, stack[-1][1]))
                    links += tag == "a"
                continue
            if tag in _RAW:
                if not token[3] and not _empty(tag, token[5]):
                    skipped, ends = len(stack), place in closed
                    stack.append((tag, stack[-1][1]))
                continue
            if not inline and tag not in _VOID:
                block += 1
            if token[3]:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == tag:
                        links -= sum(t == "a" for t, _ in stack[k:])
                        del stack[k:]
                        break
                    if inline and stack[k][0] not in _INLINE:
                        break
            elif tag in _VOID:
                if tag in ("br", "hr"):
                    pieces.append((stack[-1][1], block, " "))
            elif tag not in ("html", "body", "head"):
                if not inline:
                    same = _SAME.get(tag, frozenset())
                    for k in range(len(stack) - 1, 0, -1):
                        above = stack[k][0]
                        if above == "p" or above in same:
                            links -= sum(t == "a" for t, _ in stack[k:])
                            del stack[k:]
                            break
                        if above in _CONTAINER:
                            break
                opened(tag, token[5] or "")
                links += tag == "a"
        if at < len(source) and not skipped:
            text = html.unescape(source[at:])
            pieces.append((stack[-1][1], block, text))
            rows[stack[-1][1]][6] += text.count(" ") + 1
            rows[stack[-1][1]][7] += len(text)
        block += 1
    return Nodes(rows, pieces)


def _by_depth(depth: np.ndarray) -> list[np.ndarray]:
    order = np.argsort(depth, kind="stable")
    return np.split(order, np.cumsum(np.bincount(depth))[:-1])


def features(nodes: Nodes) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """One row of features for each node, the parents, and the nodes of each depth."""
    raw = np.array(nodes.rows, np.int64).reshape(-1, 10)
    page, parent, depth, tag, flags, number = raw[:, :6].T
    levels = _by_depth(depth) if len(raw) else []
    total = np.column_stack([raw[:, 6:], np.ones(len(raw), np.int64), tag == 2, tag == 3, tag == 6, tag == 5]).astype(float)
    above = np.zeros((len(raw), 2), np.int64)  # attribute flags and tags of all ancestors
    for level in levels[:0:-1]:
        np.add.at(total, parent[level], total[level])
    for level in levels[1:]:
        above[level, 0] = above[parent[level], 0] | flags[parent[level]]
        above[level, 1] = above[parent[level], 1] | (1 << tag[parent[level]])
    words, chars, linked, stops, elements, boxes, paragraphs, items, lists = total.T
    siblings = np.bincount(parent[parent >= 0], minlength=len(raw))
    within = np.maximum(parent, 0)
    root = np.array([level for level in levels[:1]]).ravel() if levels else np.empty(0, np.int64)
    whole = np.zeros(int(page.max(initial=-1)) + 1)
    whole[page[root]] = words[root]
    bit = lambda x, k: ((x >> k) & 1).astype(float)
    groups = range(len(_TOKENS) + 1)
    columns = [
        np.log1p(words), np.log1p(chars), linked / np.maximum(chars, 1), stops / np.maximum(words, 1), words / elements,
        np.log1p(paragraphs), np.log1p(items), np.log1p(lists), np.log1p(elements), words / np.maximum(whole[page], 1),
        words / np.maximum(words[within], 1), np.log1p(raw[:, 6]), depth, number, siblings[within], number / np.maximum(siblings[within], 1),
        *(tag == k for k in range(1, 15)), *(bit(flags, k) for k in groups), *(bit(above[:, 0], k) for k in groups),
        *(bit(above[:, 1], k) for k in (1, 6, 7, 8, 9, 10, 11, 12)),
    ]
    return np.column_stack([np.asarray(c, float) for c in columns]) if len(raw) else np.empty((0, 0)), parent, levels


def boosted(x: np.ndarray, y: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Trees of depth DEPTH for the log odds of y: features and thresholds of the inner nodes, values of the leaves."""
    edges = [np.unique(np.quantile(column, np.linspace(0, 1, BINS)[1:-1])) for column in x.T]
    binned = np.column_stack([np.searchsorted(e, column, "left") for e, column in zip(edges, x.T)])
    n, width = binned.shape
    odds, trees = np.zeros(n), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-odds))
        slope, bend = y - p, p * (1 - p)
        place = np.zeros(n, np.int64)
        split_on, split_at = np.zeros(2**DEPTH - 1, np.int64), np.full(2**DEPTH - 1, np.inf)
        for level in range(DEPTH):
            first, size = 2**level - 1, 2**level
            cell = ((place[:, None] * width + np.arange(width)) * BINS + binned).ravel()
            shape = (size, width, BINS)
            g = np.bincount(cell, np.repeat(slope, width), size * width * BINS).reshape(shape).cumsum(2)
            h = np.bincount(cell, np.repeat(bend, width), size * width * BINS).reshape(shape).cumsum(2)
            all_g, all_h = g[:, :, -1:], h[:, :, -1:]
            gain = g**2 / (h + 1) + (all_g - g) ** 2 / (all_h - h + 1) - all_g**2 / (all_h + 1)
            gain[(h < 1) | (all_h - h < 1)] = 0
            best = gain.reshape(size, -1).argmax(1)
            on, at = best // BINS, best % BINS
            for k in range(size):
                if gain[k, on[k], at[k]] > 1e-6 and at[k] < len(edges[on[k]]):
                    split_on[first + k], split_at[first + k] = on[k], edges[on[k]][at[k]]
            place = 2 * place + (x[np.arange(n), split_on[first + place]] > split_at[first + place])
        leaf = RATE * np.bincount(place, slope, 2**DEPTH) / (np.bincount(place, bend, 2**DEPTH) + 1)
        odds += leaf[place]
        trees.append((split_on, split_at, leaf))
    return trees


def _odds(trees, x: np.ndarray) -> np.ndarray:
    odds, rows = np.zeros(len(x)), np.arange(len(x))
    for split_on, split_at, leaf in trees:
        place = np.zeros(len(x), np.int64)
        for level in range(DEPTH):
            node = 2**level - 1 + place
            place = 2 * place + (x[rows, split_on[node]] > split_at[node])
        odds += leaf[place]
    return odds


def decoded(odds: np.ndarray, parent: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Which nodes are kept: the likeliest choice for each page that keeps nothing below a dropped node; roots are kept."""
    keep = -np.logaddexp(0, -odds)
    drop = -np.logaddexp(0, odds)
    for level in levels[:0:-1]:
        np.add.at(drop, parent[level], drop[level])
        np.add.at(keep, parent[level], np.maximum(keep[level], drop[level]))
    kept = np.ones(len(odds), bool)
    for level in levels[1:]:
        kept[level] = kept[parent[level]] & (keep[level] > drop[level])
    return kept


def _texts(nodes: Nodes, kept: np.ndarray, pages: int) -> list[str]:
    """Kept text of each page: white space is one space within a block, blocks are two line ends apart."""
    blocks: list[list[str]] = [[] for _ in range(pages)]
    last, current = -1, []
    owner = -1

    def close() -> None:
        if current and (text := " ".join("".join(current).split())):
            blocks[owner].append(text)

    for node, block, text in nodes.pieces:
        if not kept[node]:
            continue
        if block != last:
            close()
            last, current, owner = block, [], nodes.rows[node][0]
        current.append(text)
    close()
    return ["\n\n".join(b) for b in blocks]


# Layouts for the fit: names are fixed values, combinations are drawn.
_DROPPED = {
    "nav": ["nav", "div class=menu", "div id=navigation", "ul class=nav", "div class=breadcrumbs", "div class=navbar", "div class=pagination"],
    "header": ["header", "div class=header", "div id=masthead", "div class=site-header", "div class=top-bar", "header role=banner"],
    "footer": ["footer", "div class=footer", "div id=footer", "div class=copyright", "footer role=contentinfo", "div class=bottom"],
    "ad": ["div class=ad", "div class=ads", "div class=advertisement", "div id=ad-top", "div class=sponsored", "aside class=promo", "p class=ad",
           "div class=ad-banner", "ins class=adsense", "section class=promo"],
    "sidebar": ["aside", "div class=sidebar", "div id=sidebar", "div class=widget", "div class=related", "section class=recommended", "aside class=related-posts",
                "div class=side-rail"],
    "comments": ["section id=comments", "div class=comments", "ol class=comment-list", "div id=disqus_thread", "section class=discussion", "div class=replies",
                 "section class=reader-comments"],
    "notice": ["div class=notice", "div class=cookie-banner", "div id=cookie-consent", "div class=alert", "div class=newsletter", "section class=gdpr",
               "aside class=notice", "p class=notice", "div role=alert"],
    "form": ["form", "form class=search", "div class=login", "form id=signup", "div class=subscribe-form"],
    "share": ["div class=share", "ul class=social", "div class=social-links"],
}
_KEPT = ["article", "main", "div id=content", "div class=post", "div class=entry-content", "div class=article-body", "section", "div", "main role=main",
         "div class=story", "div id=main", "article class=post", "section class=content"]


def _layout(draw: np.random.Generator, long: list[str], short: list[str]) -> str:
    """A page whose main text is marked by the attribute data-main on its elements."""
    pick = lambda xs: xs[int(draw.integers(len(xs)))]
    chance = lambda p: draw.random() < p

    def element(name: str, inner: str, main: bool = False) -> str:
        tag, _, attribute = name.partition(" ")
        key, _, value = attribute.partition("=")
        return f"<{tag}{f' {key}="{value}"' if key else ''}{' data-main' if main else ''}>{inner}</{tag}>"

    def links(n: int) -> str:
        inner = "".join(f'<li><a href="/x">{pick(short)}</a></li>' for _ in range(n))
        return f"<ul>{inner}</ul>" if chance(0.7) else " ".join(f'<a href="/x">{pick(short)}</a>' for _ in range(n))

    def dropped(kind: str) -> str:
        name = pick(_DROPPED[kind])
        if kind in ("nav", "share"):
            inner = links(int(draw.integers(2, 9)))
        elif kind == "header":
            inner = f"<h1>{pick(short)}</h1>" * chance(0.5) + f"<p>{pick(short)}</p>" * chance(0.5) + dropped("nav") * chance(0.6)
            inner = inner or pick(short)
        elif kind == "comments":
            one = pick(["div class=comment", "li class=comment", "article class=comment", "p", "div", "li"])
            body = lambda: pick(long) if one == "p" or chance(0.2) else f"<p>{pick(long)}</p>"
            inner = f"<h3>{pick(short)}</h3>" * chance(0.6) + "".join(element(one, body()) for _ in range(int(draw.integers(1, 7))))
        elif kind == "sidebar":
            inner = f"<h3>{pick(short)}</h3>" * chance(0.6) + (links(int(draw.integers(2, 6))) if chance(0.5) else f"<p>{pick(long)}</p>")
        elif kind == "form":
            inner = f"<label>{pick(short)}</label><input><p>{pick(short)}</p>" if chance(0.6) else f"<p>{pick(long)}</p><input>"
        elif kind == "footer":
            inner = f"<p>&copy; {pick(short)}</p>" if chance(0.5) else f"&copy; {pick(long)}" if chance(0.7) else links(3)
        else:
            inner = pick(long) if chance(0.5) else f"<p>{pick(long)}</p>" if chance(0.7) else pick(short)
        return element(name, inner)

    parts = [element("h1", pick(short), True)] if chance(0.8) else []
    for _ in range(int(draw.integers(1, 14))):
        kind = draw.random()
        if kind < 0.7:
            inner = pick(long) if chance(0.85) else pick(short)
            parts.append(element("p", f"<b>{inner}</b>" if chance(0.1) else inner, True))
        elif kind < 0.78:
            parts.append(element(pick(["h2", "h3"]), pick(short), True))
        elif kind < 0.84:
            items = "".join(element("li", pick(long) if chance(0.5) else pick(short), True) for _ in range(int(draw.integers(2, 6))))
            parts.append(element(pick(["ul", "ol"]), items, True))
        elif kind < 0.88:
            parts.append(element(pick(["blockquote", "pre", "div"]), pick(long), True))
        elif kind < 0.9:
            parts.append(element("table", f"<tr data-main><td data-main>{pick(short)}</td><td data-main>{pick(long)}</td></tr>", True))
        else:
            parts.append(dropped(pick(["ad", "share", "notice", "sidebar", "form"])))
    article = element(pick(_KEPT), "".join(parts), True)
    if chance(0.1):
        article = "".join(parts)
    if chance(0.35):
        article = element(pick(_KEPT), article + (dropped("comments") if chance(0.3) else ""), True)
    before = [dropped(k) for k, p in (("notice", 0.3), ("header", 0.5), ("nav", 0.6), ("ad", 0.4), ("sidebar", 0.25), ("form", 0.15)) if chance(p)]
    after = [dropped(k) for k, p in (("share", 0.2), ("ad", 0.3), ("comments", 0.5), ("sidebar", 0.35), ("form", 0.2), ("notice", 0.2), ("footer", 0.8)) if chance(p)]
    body = "".join(before) + article + "".join(after)
    if chance(0.3):
        body = element(pick(["div id=page", "div class=wrapper", "div"]), body, True)
    return f"<html><head><title>{pick(short)}</title></head><body>{body}</body></html>"


def fit(sample: list[str]):
    """Trees from pages that name their article, and from layouts made of their texts."""
    named, long, short = [], [], []
    for source in sample:
        nodes = parse([source])
        raw = nodes.rows
        inside = np.zeros(len(raw), bool)
        other = np.zeros(len(raw), bool)
        for k, (_, parent, _, tag, flags, *_) in enumerate(raw):
            up = parent >= 0
            inside[k] = tag == 1 or (up and inside[parent])
            other[k] = (up and other[parent]) or tag in (7, 8, 9, 10, 11) or bool(flags >> 1)
        said = inside & ~other
        for text in _texts(nodes, np.ones(len(raw), bool), 1)[0].split("\n\n"):
            (long if len(text) > 60 else short).append(html.escape(text, quote=False))
        if said.any():
            for k in range(len(raw) - 1, 0, -1):
                said[raw[k][1]] |= said[k]
            named.append((source, said))
    long, short = long or ["Some longer text of a page, with a few words, that ends here."], short or ["A few words"]
    draw = np.random.default_rng(11)
    xs, ys = [], []
    for source, said in named:
        xs.append(features(parse([source]))[0])
        ys.append(said)
    for _ in range(LAYOUTS):
        nodes = parse([_layout(draw, long, short)])
        truth = np.array([bool(row[4] & _MARK) for row in nodes.rows])
        for k in range(len(truth) - 1, 0, -1):
            truth[nodes.rows[k][1]] |= truth[k]
        xs.append(features(nodes)[0])
        ys.append(truth)
    return boosted(np.concatenate(xs), np.concatenate(ys).astype(float))


def train(pages: DataFrame):
    """Fit the trees on a bounded sample of pages."""
    usable = pages.select("page_id", "html").filter(F.length("html").between(1, MOST_CHARS))
    rows = usable.orderBy(F.xxhash64("page_id"), "html").limit(SAMPLE).toArrow()
    return fit(rows.column("html").to_pylist())


def main_texts(pages: DataFrame, trees) -> DataFrame:
    """The main text of every page: page_id, url, text, n_chars.

    Character references are decoded; white space within a block is one space; blocks follow in page order, two line
    ends apart. Null and empty pages, and pages without main text, have an empty text. Scripts, styles, titles, buttons,
    selections and embedded media are never text. Text without any markup is main text. Every row is extracted, null and
    repeated ids too. Extra columns are ignored.
    """
    shared = pages.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shared.value
        for batch in steps(batches, "html"):
            sources = [source or "" for source in batch.column("html").to_pylist()]
            nodes = parse(sources)
            x, parent, levels = features(nodes)
            texts = _texts(nodes, decoded(_odds(trees, x), parent, levels), len(sources))
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(
        run, "page_id long, url string, text string, n_chars long"
    )

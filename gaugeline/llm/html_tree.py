"""Main text of web pages from a tree-structured graphical model over their elements.

Each element is content or not. Its own potential comes from its tag, class words, having
text and its share of link text, not from length, so short texts are not lost; parent and child are tied by potentials that depend on the
kind of the child. Sum-product messages go up the tree and down again and give every
element's exact marginal; text is kept where the marginal of its element is at least one
half. Potentials are fitted by likelihood gradients (observed less expected counts) on
labelled pages: those given, or pages composed here from labelled parts.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeline.llm.support import batches_by_bytes, ship

LABELLED_PAGES = 360
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>|<!--", re.S)
_NAMED = re.compile(r"\b(class|id|role|data-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"\bhidden\b|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_WORD = re.compile(r"[a-z]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title template".split())
# These stand in the run of text where they are found; svg and math hold elements of their own.
FLOW = frozenset("svg math object noscript iframe".split())
FOREIGN = frozenset(("svg", "math"))
_HTML_INSIDE = frozenset("foreignobject desc annotation-xml".split())
_TEXT_INSIDE = frozenset("mi mn mo ms mtext title".split())
# Found in svg or math, these show that it was never closed.
_BREAKS_OUT = frozenset("body blockquote center dd div dl dt h1 h2 h3 h4 h5 h6 head hr li menu ol p pre table ul article aside main nav header footer section form figure".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
SECTION = frozenset("html head body div section article main aside nav header footer form ul ol dl table tbody thead tfoot tr figure fieldset details dialog menu".split())
# An opening tag closes an open element of these kinds, up to the given bounds.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table", "tbody", "thead", "tfoot"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}


@dataclass
class Tree:
    """Elements of one page in order of their opening tags, and pieces of text with element and block."""

    parent: list[int]
    depth: list[int]
    tag: list[str]
    words: list[tuple[str, ...]]
    label: list[int | None]
    text: list[tuple[int, int, str]]
    inline: list[bool]


def parse(page: str) -> Tree:
    tree = Tree([-1], [0], ["#page"], [()], [None], [], [False])
    # Of each element: the svg or math it is in, or 0.
    stack, foreign, block, at = [0], [0], 0, 0

    def say(piece):
        if piece:
            tree.text.append((stack[-1], block, piece))

    while True:
        found = _TAG.search(page, at)
        if not found:
            say(page[at:])
            return tree
        say(page[at : found.start()])
        at = found.end()
        closing, name = found.group(1), found.group(2)
        if name is None:
            continue
        name = name.lower()
        if closing:
            for k in range(len(stack) - 1, 0, -1):
                open_tag = tree.tag[stack[k]]
                if open_tag == name:
                    runs = tree.inline[stack[k]]
                    del stack[k:]
                    break
                if name in INLINE and not tree.inline[stack[k]]:
                    runs = True
                    break
            else:
                runs = name in INLINE or name in FLOW or foreign[stack[-1]] > 0
            if not runs:
                block += 1
            continue
        if name == "br":
            say(" ")
            continue
        root, closed = foreign[stack[-1]], found.group(3).rstrip().endswith("/")
        if root and name in _BREAKS_OUT and tree.tag[stack[-1]] not in _TEXT_INSIDE:
            del stack[stack.index(root) :]
            root = foreign[stack[-1]]
        runs = name in INLINE or name in FLOW or root > 0
        if not runs:
            block += 1
            # A block ends an open paragraph.
            for k in range(len(stack) - 1, 0, -1):
                open_tag = tree.tag[stack[k]]
                if open_tag == "p":
                    del stack[k:]
                    break
                if not tree.inline[stack[k]]:
                    break
            ends, bounds = _ENDS.get(name, ((), ()))
            for k in range(len(stack) - 1, 0, -1) if ends else ():
                if tree.tag[stack[k]] in bounds:
                    break
                if tree.tag[stack[k]] in ends:
                    del stack[k:]
                    break
        if name in VOID and not root:
            continue
        if name in RAW and not (root and (closed or name not in ("script", "style"))):
            end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        attributes = found.group(3)
        words, label = [], None
        if attributes:
            for key, *values in _NAMED.findall(attributes):
                value = "".join(values).lower()
                if key.lower() == "data-label":
                    label = int(value == "content")
                else:
                    words += _WORD.findall(value)
            if _HIDDEN.search(attributes):
                words.append("hidden")
        tree.parent.append(stack[-1])
        tree.depth.append(tree.depth[stack[-1]] + 1)
        tree.tag.append(name)
        tree.words.append(tuple(words))
        tree.label.append(label if label is not None else tree.label[stack[-1]])
        tree.inline.append(runs)
        element = len(tree.tag) - 1
        foreign.append(element if name in FOREIGN else 0 if name in _HTML_INSIDE else root)
        if name == "xmp":
            # Its text is as written, tags and references included.
            end = re.compile(r"</xmp\b[^>]*>", re.I).search(page, at)
            stack.append(element)
            say(page[at : end.start() if end else len(page)].replace("&", "&amp;"))
            stack.pop()
            at, block = end.end() if end else len(page), block + 1
        elif not closed or not (root or name in FOREIGN) and (name in SECTION or name in FLOW or name == "p"):
            stack.append(element)


class Forest:
    """The elements of several pages, with features and levels."""

    def __init__(self, trees: list[Tree]):
        size = np.array([len(t.parent) for t in trees])
        self.first = np.concatenate([[0], np.cumsum(size)])
        shift = np.repeat(self.first[:-1], size)
        parent = np.concatenate([np.array(t.parent) for t in trees])
        self.root = parent < 0
        self.parent = np.where(self.root, -1, parent + shift)
        depth = np.concatenate([np.array(t.depth) for t in trees])
        order = np.argsort(depth, kind="stable")
        self.levels = np.split(order, np.flatnonzero(np.diff(depth[order])) + 1)
        self.tags = [x for t in trees for x in t.tag]
        self.words = [x for t in trees for x in t.words]
        own, linked = np.zeros(len(parent)), np.zeros(len(parent))
        for k, t in enumerate(trees):
            for node, _, piece in t.text:
                own[self.first[k] + node] += len(piece.strip())
        link = np.array([x == "a" for x in self.tags])
        below = own.copy()
        for level in self.levels:  # links hand down
            has = self.parent[level] >= 0
            link[level[has]] |= link[self.parent[level[has]]]
        linked[link] = own[link]
        for level in self.levels[:0:-1]:
            np.add.at(below, self.parent[level], below[level])
            np.add.at(linked, self.parent[level], linked[level])
        self.own, self.below, self.link_share = own, below, linked / np.maximum(below, 1)
        self.kind = np.array([0 if run else 2 if x in SECTION else 1 for t in trees for run, x in zip(t.inline, t.tag)])

    def features(self) -> tuple[np.ndarray, list[str]]:
        """(element, feature) pairs as element numbers and names."""
        at, names = [], []
        own, below = (self.own > 0).tolist(), (self.below > 0).tolist()
        share = (self.link_share * 4).astype(int).tolist()
        for i, (tag, words) in enumerate(zip(self.tags, self.words)):
            mine = ["always", f"tag {tag}", f"text {own[i]} {below[i]}", f"links {share[i]}"]
            for w in words:
                mine += (f"word {w}", f"start {w[:4]}")
            names += mine
            at += [i] * len(mine)
        return np.array(at), names


def _log_add(a, axis):
    top = a.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(a - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def marginals(forest: Forest, unary: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact marginals of the elements and of (parent, child) states, by messages up and down.

    ``unary`` are log potentials (elements, 2), ``pair`` log potentials (kinds, parent, child).
    """
    up, belief = np.zeros_like(unary), unary.copy()
    for level in forest.levels[:0:-1]:
        up[level] = _log_add(pair[forest.kind[level]] + belief[level][:, None, :], 2)
        np.add.at(belief, forest.parent[level], up[level])
    edges = np.zeros((len(unary), 2, 2))
    for level in forest.levels:
        inner = level[~forest.root[level]]
        if len(inner):
            without = belief[forest.parent[inner]] - up[inner]
            joint = without[:, :, None] + pair[forest.kind[inner]] + belief[inner][:, None, :]
            joint -= joint.max(axis=(1, 2), keepdims=True)
            joint = np.exp(joint)
            edges[inner] = joint / joint.sum(axis=(1, 2), keepdims=True)
            belief[inner] += _log_add(without[:, :, None] + pair[forest.kind[inner]], 1)
        belief[level] -= belief[level].max(axis=1, keepdims=True)
    p = np.exp(belief)
    return p / p.sum(axis=1, keepdims=True), edges


class TreeModel:
    def __init__(self):
        self.weights: dict[str, float] = {}
        self.pair = np.zeros((3, 2, 2))

    def unary(self, forest: Forest) -> np.ndarray:
        at, names = forest.features()
        get = self.weights.get
        total = np.bincount(at, [get(n, 0.0) for n in names], len(forest.tags))
        return np.stack([np.zeros(len(total)), total], axis=1)

    def fit(self, pages: list[str], rounds: int = 200, rate: float = 0.15, shrink: float = 0.0002) -> None:
        """Adam on the likelihood of labelled pages (elements carry or inherit ``data-label``)."""
        trees = [parse(p) for p in pages]
        forest = Forest(trees)
        label = np.array([x or 0 for t in trees for x in t.label])
        at, names = forest.features()
        numbers: dict[str, int] = {}
        column = np.array([numbers.setdefault(n, len(numbers)) for n in names])
        weights, pair = np.zeros(len(numbers)), np.zeros((3, 2, 2))
        inner = np.flatnonzero(~forest.root)
        seen_pair = np.zeros((3, 2, 2))
        np.add.at(seen_pair, (forest.kind[inner], label[forest.parent[inner]], label[inner]), 1)
        moments = [[np.zeros_like(x), np.zeros_like(x)] for x in (weights, pair)]
        for step in range(1, rounds + 1):
            total = np.bincount(at, weights[column], len(label))
            p, edges = marginals(forest, np.stack([np.zeros(len(total)), total], axis=1), pair)
            expected = np.zeros((3, 2, 2))
            np.add.at(expected, forest.kind[inner], edges[inner])
            grads = (np.bincount(column, (label - p[:, 1])[at], len(weights)) / len(trees) - shrink * weights, (seen_pair - expected) / len(trees) - shrink * pair)
            for value, grad, (m, v) in zip((weights, pair), grads, moments):
                m += 0.1 * (grad - m)
                v += 0.01 * (grad * grad - v)
                value += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
        self.weights, self.pair = dict(zip(numbers, weights.tolist())), pair

    def main_texts(self, pages: list[str]) -> list[str]:
        trees = [parse(p) for p in pages]
        if not trees:
            return []
        forest = Forest(trees)
        content = marginals(forest, self.unary(forest), self.pair)[0][:, 1] >= 0.5
        out = []
        for k, t in enumerate(trees):
            # Markup without any element is all text.
            plain = len(t.tag) == 1
            blocks: dict[int, list[str]] = {}
            for node, block, piece in t.text:
                if plain or content[forest.first[k] + node]:
                    blocks.setdefault(block, []).append(html.unescape(piece))
            lines = (" ".join("".join(b).split()) for b in blocks.values())
            out.append("\n".join(x for x in lines if x))
        return out


_SYLLABLES = "ba de lo mi nu ra se ti vo ka en ul or is".split()
# Parts that pages are composed of: tag, class words, and what they hold.
_OTHER_PARTS = (
    ("nav", "", "links"), ("nav", "menu main-nav", "links"), ("ul", "menu", "links"), ("div", "nav navbar", "links"), ("ol", "breadcrumb breadcrumbs", "links"),
    ("header", "", "links"), ("header", "", "title"), ("header", "site-header", "title"), ("div", "header masthead", "text"), ("footer", "", "text"), ("footer", "site-footer", "links"), ("div", "footer copyright", "text"),
    ("aside", "", "long"), ("aside", "sidebar", "links"), ("div", "sidebar widget", "long"), ("div", "related recommended", "links"), ("div", "ad", "long"), ("div", "ad ads banner", "text"),
    ("div", "advert advertisement", "long"), ("aside", "promo sponsored", "text"), ("div", "cookie notice consent", "long"), ("div", "notice alert", "text"), ("section", "notice", "long"), ("div", "newsletter subscribe popup modal", "form"),
    ("form", "", "form"), ("form", "", "form"), ("form", "search", "form"), ("div", "login form", "form"), ("section", "comments", "comments"), ("div", "comments comment-list", "comments"), ("ol", "comment-list", "comments"), ("div", "comment", "long"),
    ("div", "share social", "links"), ("div", "pagination pager", "links"), ("div", "tags meta", "links"), ("p", "notice", "text"), ("p", "ad", "text"), ("div", "disclaimer", "long"),
)
_FORMS = tuple(p for p in _OTHER_PARTS if p[2] == "form")
_CONTENT_ROOTS = (("article", ""), ("article", ""), ("article", ""), ("article", "post"), ("main", ""), ("main", ""), ("main", "content"), ("div", "content"), ("div", "article-body"), ("div", "post entry-content"), ("section", "article story"), ("div", "text body"), ("div", "main"))


def composed_pages(n: int = LABELLED_PAGES, seed: int = 23) -> list[str]:
    """Labelled pages: a content root among other parts, some of which stand inside it."""
    rng = random.Random(seed)

    def words(low, high):
        return " ".join("".join(rng.choice(_SYLLABLES) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(low, high)))

    def inside(kind):
        if kind == "links":
            item = "<li><a href='/x'>{}</a></li>" if rng.random() < 0.6 else "<a href='/x'>{}</a> "
            return ("<ul>{}</ul>" if "<li>" in item and rng.random() < 0.7 else "{}").format("".join(item.format(words(1, 3)) for _ in range(rng.randint(2, 7))))
        if kind == "form":
            return f"<label>{words(1, 3)}</label><input><p>{words(2, 8)}</p><button>{words(1, 2)}</button>"
        if kind == "comments":
            return "".join(f"<div class='comment'><b>{words(1, 2)}</b><p>{words(5, 40)}</p></div>" if rng.random() < 0.7 else f"<li><p>{words(5, 40)}.</p></li>" for _ in range(rng.randint(1, 4)))
        if kind == "title":
            return f"<h1>{words(1, 4)}</h1>" + (f"<p>{words(2, 8)}</p>" if rng.random() < 0.5 else "")
        if kind == "long":
            return rng.choice(("<p>{}.</p>", "{}.", "<div>{}</div>", "<h3>Ti</h3><p>{}</p>")).format(words(8, 60))
        return rng.choice(("<p>{}</p>", "{}", "<span>{}</span>", "&copy; {} &middot;")).format(words(1, 14))

    def other(parts=_OTHER_PARTS):
        tag, names, kind = rng.choice(parts)
        names = rng.choice(names.split()) if names and rng.random() < 0.7 else names
        label = f" {rng.choice(('class', 'id'))}='{names}'" if names else ""
        return f"<{tag}{label} data-label='other'>{inside(kind)}</{tag}>"

    def block():
        kind = rng.random()
        if kind < 0.6:
            text = words(1, 90)
            if rng.random() < 0.3:
                tag = rng.choice(("b", "i", "em", "strong", "a href='/y'", "span", "code"))
                text += f" <{tag}>{words(1, 6)}</{tag.split()[0]}> {words(0, 20)}."
            return f"<p>{text}" + rng.choice(("</p>", "</p>", "", "<br>"))
        if kind < 0.7:
            tag = rng.choice(("h1", "h2", "h3"))
            return f"<{tag}>{words(1, 9)}</{tag}>"
        if kind < 0.8:
            tag = rng.choice(("ul", "ol"))
            return f"<{tag}>" + "".join(f"<li>{words(1, 25)}</li>" for _ in range(rng.randint(1, 5))) + f"</{tag}>"
        if kind < 0.86:
            return f"<blockquote><p>{words(5, 40)}</p></blockquote>"
        if kind < 0.9:
            return f"<table><tr><td>{words(1, 5)}</td><td>{words(1, 5)}</td></tr></table>"
        if kind < 0.93:
            return f"<pre>{words(3, 20)}</pre>"
        return rng.choice(("<div>{}</div>", "<section><h2>Ra</h2>{}</section>", "<figure><figcaption>{}</figcaption></figure>")).format(f"<p>{words(3, 50)}</p>" if rng.random() < 0.5 else words(3, 30))

    pages = []
    for _ in range(n):
        parts = ["<h1>" + words(1, 9) + "</h1>"] if rng.random() < 0.7 else []
        for _ in range(rng.choice((1, 1, 2, 3, 5, 8, 14))):
            parts.append(block())
            if rng.random() < 0.2:
                parts.append(other(rng.choice((_OTHER_PARTS, _FORMS))))
        tag, names = rng.choice(_CONTENT_ROOTS)
        root = f"<{tag}{f" class='{names}'" if names else ''} data-label='content'>{''.join(parts)}</{tag}>"
        around = [other() for _ in range(rng.randint(0, 4))] + [root] + [other() for _ in range(rng.randint(0, 4))]
        if rng.random() < 0.08:
            around = [f"<p data-label='content'>{words(10, 80)}</p>" for _ in range(rng.randint(1, 5))] + [other()]
        middle = "".join(around)
        if rng.random() < 0.3:
            middle = f"<div class='{rng.choice(('page', 'wrapper container', 'layout'))}'>{middle}</div>"
        pages.append(f"<html><head><title>x</title></head><body data-label='other'>{middle}</body></html>")
    return pages


def train(labelled: list[str] | None = None) -> TreeModel:
    model = TreeModel()
    model.fit(composed_pages() if labelled is None else labelled)
    return model


def extract_text(pages: DataFrame, model: TreeModel | None = None, markup: str = "html") -> DataFrame:
    """Add ``text`` and ``n_chars`` (code points) to every row, from its whole markup.

    Character references are decoded, white space within a block becomes one space, blocks
    are trimmed and joined in page order by one line feed; empty blocks vanish. Null or
    empty markup, or a page without content, gives empty text. Broken markup is read as far
    as tags can be told. Repeated rows give the same text; an empty table gives no rows.
    Columns named like the new ones are replaced.
    """
    spark = pages.sparkSession
    ship(spark)
    names = [c for c in pages.columns if c not in ("text", "n_chars", markup)]
    sent = spark.sparkContext.broadcast(model or train())

    def extract(batches: Iterator[pa.RecordBatch]):
        for batch in batches_by_bytes(batches, "_markup", 1 << 20):
            texts = sent.value.main_texts(batch.column("_markup").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*names, "text", "n_chars"]
            )

    schema = pages.select(*names).withColumns({"text": F.lit("").cast("string"), "n_chars": F.lit(0).cast("long")}).schema
    return pages.select(*names, F.coalesce(markup, F.lit("")).alias("_markup")).mapInArrow(extract, schema)

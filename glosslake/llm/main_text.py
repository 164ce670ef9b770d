"""HTML extraction by a tree-structured graphical model.

A page's block elements and text leaves form a tree.  Each node is content,
boilerplate, or (elements only) a mixture.  Node potentials are weights of the
tag, of words of class, id and role, and of a leaf's length and link share;
edge potentials are weights of a parent's and its child's states.  Sum-product messages go up the tree and down again, for all pages of a batch
at once by depth, and give each leaf's exact marginal; leaves that are more
likely content than not are the main text.

The weights are fitted to labelled pages (html and its main text) by gradient
steps on the likelihood, whose expectations the same messages give.  The sample
is bounded by ``PAGES``: ``labelled_pages`` writes them from random layouts, or
``model_from`` takes them from a table.

Defined cases: null or empty html has an empty text; broken markup is read as
browsers do in the common cases (implied ends, unclosed elements); very long or
deep pages are read whole; repeated rows are read one by one; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import random
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, table
from .dom import Tree, parse
from .words import chunks

CONTENT, BOILER, MIXED = range(3)
#: Labelled pages that the default model is trained on.
PAGES = 400
STEPS, RATE, L2 = 120, 0.1, 0.5
#: Features are kept up to this many, and if they were seen this often; class words come from an open vocabulary.
MAX_FEATURES, RARE = 50_000, 3
THRESHOLD = 0.5


def node_features(tree: Tree, i: int) -> list[str]:
    text = tree.text[i]
    if text is None:
        return [f"tag:{tree.tag[i]}", *(f"word:{w}" for w in tree.words[i])]
    n = text.count(" ") + 1
    link = tree.link[i]
    return [
        f"length:{min(n.bit_length(), 7)}",
        f"link:{0 if link == 0 else 1 if link < 0.5 else 2}",
        f"stop:{text[-1] in '.!?…'}",
        f"mark:{text[0] in '©®' or '©' in text[:40]}",
    ]


class Forest:
    """The trees of a batch as arrays: nodes in page order, levels by depth, features in a row."""

    def __init__(self, trees: list[Tree], index: dict[str, int]):
        first = np.cumsum([0, *(len(t.parent) for t in trees)])
        self.cuts, self.roots = first[1:-1], first[:-1]
        self.parent = np.concatenate([np.array(t.parent) + f for t, f in zip(trees, first, strict=False)])
        self.parent[self.roots] = -1
        self.leaf = np.array([x is not None for t in trees for x in t.text])
        depth = [0] * len(self.parent)
        for i, p in enumerate(self.parent.tolist()):
            if p >= 0:
                depth[i] = depth[p] + 1
        order = np.argsort(depth, kind="stable")
        at = np.searchsorted(np.array(depth)[order], np.arange(max(depth) + 2))
        self.levels = [order[a:b] for a, b in zip(at, at[1:], strict=False)]
        each = [[index.get(f, len(index)) for f in node_features(t, i)] for t in trees for i in range(len(t.parent))]
        self.feature = np.array([f for x in each for f in x])
        size = np.array([len(x) for x in each])
        self.start, self.of = np.cumsum(size) - size, np.repeat(np.arange(len(each)), size)


@dataclass
class Model:
    index: dict[str, int]
    node: np.ndarray  # features (the last: unknown, zero) x the three states
    edge: np.ndarray  # for elements and for leaves: parent's state x child's state
    root: np.ndarray

    def pass_messages(self, forest: Forest) -> tuple[np.ndarray, np.ndarray]:
        """Log-beliefs of nodes, and of (parent's, child's) states, both normalised."""
        up = np.add.reduceat(self.node[forest.feature], forest.start, axis=0)
        up[forest.leaf, MIXED] = -np.inf
        edges = self.edge[forest.leaf.astype(int)]
        message, down = np.zeros_like(up), np.zeros_like(up)
        for level in forest.levels[:0:-1]:
            message[level] = _log_sum(edges[level] + up[level][:, None, :], 2)
            np.add.at(up, forest.parent[level], message[level])
        down[forest.roots] = self.root
        pair = np.full((len(up), 3, 3), -np.inf)
        for level in forest.levels[1:]:
            p = forest.parent[level]
            rest = up[p] + down[p] - message[level]  # the parent without what this child said
            both = edges[level] + rest[:, :, None]
            down[level] = _log_sum(both, 1)
            both = both + up[level][:, None, :]
            pair[level] = both - _log_sum(both.reshape(-1, 9), 1)[:, None, None]
        belief = up + down
        return belief - _log_sum(belief, 1)[:, None], pair

    def marginals(self, trees: list[Tree]) -> list[np.ndarray]:
        """Probability of content for every node of every tree."""
        forest = Forest(trees, self.index)
        belief, _ = self.pass_messages(forest)
        return np.split(np.exp(belief[:, CONTENT]), forest.cuts)


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + np.squeeze(top, axis)


def states(tree: Tree, main_text: str | None) -> list[int]:
    """Labels: a leaf is content if it is one of the main text's blocks; an element is what all its leaves are."""
    blocks = Counter((main_text or "").split("\n\n"))
    has = [[0, 0] for _ in tree.parent]
    out = [MIXED] * len(tree.parent)
    for i in range(len(tree.parent) - 1, -1, -1):
        if tree.text[i] is not None:
            out[i] = CONTENT if blocks[tree.text[i]] > 0 else BOILER
            has[i][out[i]] = 1
        elif sum(has[i]) == 1:
            out[i] = CONTENT if has[i][CONTENT] else BOILER
        if tree.parent[i] >= 0:
            for s in (CONTENT, BOILER):
                has[tree.parent[i]][s] |= has[i][s]
    return out


def train(labelled: list[tuple[str, str]], steps: int = STEPS) -> Model:
    """Fit the potentials to labelled (html, main text) pages: a bounded sample.

    The likelihood's gradient is what the labels count minus what the messages
    expect, for each feature and each pair of states; steps are Adam's.
    """
    trees = [parse(html) for html, _ in labelled]
    label = np.array([s for t, (_, main) in zip(trees, labelled, strict=True) for s in states(t, main)])
    seen = Counter(f for t in trees for i in range(len(t.parent)) for f in node_features(t, i))
    index = {f: k for k, f in enumerate(f for f, n in seen.most_common(MAX_FEATURES) if n >= RARE)}
    forest = Forest(trees, index)
    child = np.flatnonzero(forest.parent >= 0)
    said = np.eye(3)[label]
    pairs = np.zeros((2, 3, 3))
    np.add.at(pairs, (forest.leaf[child].astype(int), label[forest.parent[child]], label[child]), 1)
    model = Model(index, np.zeros((len(index) + 1, 3)), np.zeros((2, 3, 3)), np.zeros(3))
    values = [model.node, model.edge, model.root]
    mean, square = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
    for step in range(1, steps + 1):
        belief, pair = model.pass_messages(forest)
        off = said - np.exp(belief)
        node = np.stack([np.bincount(forest.feature, off[forest.of, s], len(index) + 1) for s in range(3)], axis=1)
        node[-1] = 0
        expected = np.exp(pair[child])
        edge = pairs - np.stack([expected[forest.leaf[child] == k].sum(axis=0) for k in (False, True)])
        for v, g, m, q in zip(values, (node, edge, off[forest.roots].sum(axis=0)), mean, square, strict=True):
            g = g - L2 * v
            m += 0.1 * (g - m)
            q += 0.01 * (g * g - q)
            v += RATE * (m / (1 - 0.9**step)) / (np.sqrt(q / (1 - 0.99**step)) + 1e-8)
    return model


def labelled_pages(n: int = PAGES, seed: int = 7) -> Iterator[tuple[str, str]]:
    """(html, main text) of random layouts: every kind of boilerplate around and inside of an article."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abdefgilmnoprstu") for _ in range(r.randint(2, 9)))

    def sentence(low: int = 1, high: int = 16) -> str:
        return " ".join(word() for _ in range(r.randint(low, high))).capitalize() + r.choice("....!?")

    def prose(low: int = 1, high: int = 6) -> str:
        return " ".join(sentence() for _ in range(r.randint(low, high)))

    def label(high: int = 5) -> str:
        return " ".join(word() for _ in range(r.randint(1, high))).capitalize()

    def named(tags: list[str], names: list[str], inner: str) -> str:
        tag = r.choice(tags)
        attr = "" if tag not in ("div", "section", "ul", "p", "span") and r.random() < 0.5 else f' {r.choice(["class", "id"])}="{r.choice(names)}"'
        return f"<{tag}{attr}>{inner}</{tag}>"

    def links(k: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{word()}">{label(3)}</a></li>' for _ in range(k)) + "</ul>"

    def menu() -> str:
        return named(["nav", "div", "ul"], ["menu", "nav", "navbar", "navigation", "main-nav", "breadcrumbs", "toc"], links(r.randint(2, 8)))

    def header() -> str:
        return named(["header", "div"], ["header", "site-header", "masthead", "top-bar", "branding"], f'<a href="/">{label(3)}</a>' + r.choice(["", f"<p>{sentence()}</p>", f"<h1>{label()}</h1>", menu()]))

    def notice() -> str:
        return named(["div", "section"], ["cookie-notice", "cookie-banner", "notice", "alert", "consent", "gdpr", "warning", "banner", "popup"], f"<p>{prose(1, 3)}</p>" + r.choice(["", "<button>Ok</button>"]))

    def advert() -> str:
        return named(["div", "aside", "section"], ["ad", "ads", "advert", "advertisement", "sponsored", "sponsor", "promo", "promotion", "ad-slot"], r.choice([prose(1, 3), f"<p>{prose(1, 3)}</p>", f'<a href="/x">{sentence()}</a>']))

    def sidebar() -> str:
        inner = f"<h3>{label()}</h3>" + r.choice([links(r.randint(2, 6)), "".join(f"<p>{prose(1, 3)}</p>" for _ in range(r.randint(1, 3)))])
        return named(["aside", "div"], ["sidebar", "side", "related", "widget", "trending", "recommended", "share", "social", "tags"], inner)

    def form() -> str:
        return named(["form"], ["newsletter", "subscribe", "search", "login", "signup", "contact"], f"<p>{sentence()}</p><label>{label()}</label><input name=x><button>{label(2)}</button>" + r.choice(["", f"<select><option>{label(1)}<option>{label(1)}</select>"]))

    def comments() -> str:
        one = lambda: named(["div", "li", "article", "section"], ["comment", "reply", "response"], f"<p>{prose(1, 5)}</p>") if r.random() < 0.7 else f"<p>{prose(1, 5)}</p>"
        return named(["section", "div", "ol"], ["comments", "discussion", "responses", "replies", "comment-list", "disqus", "reader-comments", "comments-area"], f"<h3>{label()}</h3>" + "".join(one() for _ in range(r.randint(1, 5))))

    def footer() -> str:
        return named(["footer", "div"], ["footer", "site-footer", "copyright", "colophon", "legal"], r.choice([f"© {label()} · {sentence()}", f"<p>&copy; {label()}</p>" + links(2), sentence()]))

    for _ in range(n):
        main: list[str] = []

        def keep(text: str) -> str:
            main.append(text)
            return text

        def paragraph() -> str:
            text = keep(prose())
            if r.random() < 0.15:
                cut = text.split(" ")
                k = r.randrange(len(cut))
                cut[k] = f'<a href="/y">{cut[k]}</a>'
                text = " ".join(cut)
            if r.random() < 0.2:
                text = f"<b>{text}" + r.choice(["</b>", "<br>", ""])
            return f"<p>{text}" + r.choice(["</p>", "</p>", "</p>", ""])

        def part() -> str:
            k = r.random()
            if k < 0.72:
                return paragraph()
            if k < 0.82:
                return f"<h2>{keep(label(8))}</h2>"
            if k < 0.87:
                return "<ul>" + "".join(f"<li>{keep(prose(1, 2))}</li>" for _ in range(r.randint(2, 5))) + "</ul>"
            if k < 0.91:
                return f"<blockquote>{paragraph()}</blockquote>"
            if k < 0.94:
                return "<table>" + "".join(f"<tr><td>{keep(label())}</td><td>{keep(label())}</td></tr>" for _ in range(2)) + "</table>"
            if k < 0.96:
                return f"<figure><img src=x><figcaption>{keep(sentence())}</figcaption></figure>"
            return r.choice([advert, sidebar, form])()

        heading = f"<h1>{keep(label(10))}</h1>"
        if r.random() < 0.15:
            heading = f"<header>{heading}</header>"
        body = heading + "".join(part() for _ in range(r.randint(1, 12)))
        if r.random() < 0.12:
            body += comments()
        wrap = r.random()
        if wrap < 0.45:
            body = f"<article>{body}</article>"
        elif wrap < 0.6:
            body = f"<main>{r.choice(['', menu()])}<article>{body}</article>{r.choice(['', sidebar()])}</main>"
        elif wrap < 0.9:
            body = f'<{(t := r.choice(["div", "section", "main"]))} {r.choice(["class", "id"])}="{r.choice(["article", "post", "content", "entry-content", "story", "post-body", "main-content", "article-body", "text"])}">{body}</{t}>'
        before = "".join(f() for f in r.sample([header, menu, notice, advert, form, sidebar], r.randint(1, 4)))
        after = "".join(f() for f in r.sample([comments, sidebar, advert, form, footer, notice, menu], r.randint(0, 4))) + r.choice([footer(), ""])
        if r.random() < 0.3:
            before = f'<div class="{r.choice(["wrapper", "container", "page"])}">{before}'
            after += "</div>"
        end = r.choice(["</body></html>", ""])
        yield f"<!DOCTYPE html><html><head><title>{main[0]}</title><style>p{{}}</style></head><body>{before}{body}{after}{end}", "\n\n".join(main)


@cache
def default_model(pages: int = PAGES) -> Model:
    return train(list(labelled_pages(pages)))


def model_from(labelled: DataFrame, pages: int = PAGES) -> Model:
    """A model of the first ``pages`` labelled pages (html, main_text) in the order of their hashes."""
    sample = labelled.select("html", "main_text").orderBy(F.xxhash64("html"), "html").limit(pages)
    return train([tuple(r) for r in sample.collect()])


def main_blocks(tree: Tree, content: np.ndarray) -> list[str]:
    return [t for t, p in zip(tree.text, content, strict=True) if t is not None and p > THRESHOLD]


def extract(pages: DataFrame, model: Model) -> DataFrame:
    """page_id, url, text, blocks of every page."""
    sent = pages.sparkSession.sparkContext.broadcast(model)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            html = batch.column("html").to_pylist()
            for lo, hi in chunks(html):
                trees = [parse(h) for h in html[lo:hi]]
                blocks = [main_blocks(t, p) for t, p in zip(trees, own.marginals(trees), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("page_id").slice(lo, hi - lo), batch.column("url").slice(lo, hi - lo), pa.array(["\n\n".join(b) for b in blocks], pa.string()), pa.array(map(len, blocks), pa.int64())],
                    names=["page_id", "url", "text", "n_blocks"],
                )

    shape = f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_blocks long"
    return map_batches(pages.select("page_id", "url", "html"), read, shape)


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract(table(spark, sf_dir, "pages"), default_model())
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_blocks")

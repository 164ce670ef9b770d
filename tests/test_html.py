from __future__ import annotations

import time
from html.parser import HTMLParser

import pytest

from glosslake.sources.html import _Reader
from glosslake.sources.tags import attributes


def texts(html):
    return [(t["text"].strip(), t["parent_tag"]) for t in _Reader(html).texts]


def test_shadow_roots_come_first():
    page = "<div>one<p>two</p><template shadowrootmode=open>in<b>ner</b><section>x<template shadowrootmode='OPEN'>deep</template></section></template>three</div><p>end"
    assert texts(page) == [("in", None), ("ner", "B"), ("deep", None), ("x", "SECTION"), ("one", "DIV"), ("two", "P"), ("three", "DIV"), ("end", "P")]
    assert [t["node_ord"] for t in _Reader(page).texts] == list(range(8))


def test_other_templates_are_no_part_of_the_page():
    assert texts("<div>a<template>b</template><template shadowrootmode=closed>c</template></div>") == [("a", "DIV")]
    assert texts("<div><template shadowrootmode=open>1</template><template shadowrootmode=open>2</template>3</div>") == [("1", None), ("3", "DIV")]
    assert texts("<a>x<template shadowrootmode=open>1</template></a><my-el>y<template shadowrootmode=open>2</template></my-el>") == [("x", "A"), ("2", None), ("y", "MY-EL")]
    assert [e["tag"] for e in _Reader("<template><a href=x>1</a></template><a href=y>2</a>").elements] == ["A"]


def test_elements_of_shadow_roots_in_tree_order():
    page = "<article itemscope><a href=1>a</a><i itemprop=doi>10.1/x</i><template shadowrootmode=open><section itemscope itemtype=T><a href=2>b</a><i itemprop=doi>10.2/y</i></section></template></article><a href=3>c</a>"
    rows = _Reader(page).elements
    assert [(r["tag"], dict(r["attrs"]).get("href"), r["text_content"]) for r in rows] == [("ARTICLE", None, None), ("SECTION", None, None), ("A", "2", None), ("I", None, "10.2/y"), ("A", "1", None), ("I", None, "10.1/x"), ("A", "3", None)]
    assert [r["el_ord"] for r in rows] == sorted(r["el_ord"] for r in rows)
    article, section, inner, outer = rows[0], rows[1], rows[3], rows[5]
    assert [s["el_ord"] for s in inner["scopes"]] == [article["el_ord"], section["el_ord"]] and [s["el_ord"] for s in outer["scopes"]] == [article["el_ord"]]
    assert article["el_ord"] < section["el_ord"] < inner["el_ord"] <= section["subtree_end"] < outer["el_ord"] <= article["subtree_end"] < rows[6]["el_ord"]


def test_runs_heads_and_raw_text():
    assert texts("a<!-- x -->b</i>c<br>d") == [("a", None), ("bc", None), ("d", None)]
    assert texts("<head><title>t</title><meta name=x><p>in body") == [("t", "TITLE"), ("in body", "P")]
    assert [t["in_body"] for t in _Reader("<head><title>t</title><meta name=x><p>in body").texts] == [False, True]
    assert texts("<script>a < b && '<p>' </scripty> x</SCRIPT >&amp;<style>q") == [("&", None)]
    assert attributes("A=1 a=2 b='x &amp; y' c = \"q>\" d / e=f/g h") == {"a": "1", "b": "x & y", "c": "q>", "d": "", "e": "f/g", "h": ""}


HOSTILE = {
    "quotes": '<a b="' * 40_000, "single": "<a b='x" * 40_000, "open": "<" * 200_000, "tags": "<a " * 100_000, "comments": "<!--" * 60_000, "bogus": "</ " * 60_000, "cdata": "<![CDATA[" * 30_000,
    "scripts": "<script>" * 30_000, "unclosed": "<script></scrip" * 20_000, "spaces": "<a" + " " * 300_000 + "b", "equals": "<a " + "=" * 200_000 + ">", "entities": "&amp" * 100_000, "nested": "<div itemscope>" * 20_000 + "<i itemprop=doi>x" * 20_000,
    "props": "<i itemprop=doi>text " * 20_000, "closing": "</div>" * 60_000, "templates": "<div>x<template shadowrootmode=open>" * 10_000, "attributes": "<a " + "x=1 " * 100_000 + ">",
}


@pytest.mark.parametrize("name", sorted(HOSTILE))
def test_hostile_pages_take_linear_time(name):
    began = time.time()
    _Reader(HOSTILE[name])
    assert time.time() - began < 6, name


class _Plain(HTMLParser):
    """Text runs of well-formed markup, by the standard library."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.stack, self.run = [], [], ""

    def flush(self):
        if self.run.strip() and (not self.stack or self.stack[-1] not in ("script", "style")):
            self.out.append((self.run.strip(), self.stack[-1].upper() if self.stack else None))
        self.run = ""

    def handle_starttag(self, tag, attrs):
        self.flush()
        if tag not in ("br", "img", "meta", "link"):
            self.stack.append(tag)

    def handle_endtag(self, tag):
        if tag in self.stack:
            self.flush()
            while self.stack.pop() != tag:
                pass

    def handle_data(self, data):
        self.run += data


def test_agrees_with_the_standard_parser(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("html").collect()
    for r in rows:
        plain = _Plain()
        plain.feed(r["html"])
        plain.close()
        plain.flush()
        got = texts(r["html"])
        joined = lambda x: "".join("".join(t for t, _ in x).split())
        assert joined(got) == joined(plain.out) and len(got) >= len(plain.out)

from __future__ import annotations

import random
import time

from pyspark.sql import functions as F

from glosslake.operators.render import render, unwrapped
from glosslake.operators.spans import nest, nested


def check_tree(spans, pieces):
    for k, p in enumerate(pieces):
        assert p.start < p.end
        if p.parent is None:
            assert p.depth == 0
        else:
            q = pieces[p.parent]
            assert p.parent < k and q.depth == p.depth - 1 and q.start <= p.start and p.end <= q.end and spans[q.span][2] <= spans[p.span][2]
        for q in pieces[:k]:  # any two are apart or one is inside the other
            assert q.end <= p.start or p.end <= q.start or p.start >= q.start and p.end <= q.end or q.start >= p.start and q.end <= p.end
    for i, (start, end, _) in enumerate(spans):
        own = sorted((p.start, p.end, p.part) for p in pieces if p.span == i)
        assert [x[2] for x in own] == list(range(len(own)))
        if start < end:
            assert own[0][0] == start and own[-1][1] == end and all(a[1] == b[0] for a, b in zip(own, own[1:], strict=False))
        else:
            assert not own


def test_nesting_of_random_spans():
    r = random.Random(1)
    for _ in range(400):
        spans = [(a := r.randrange(20), a + r.randrange(9), r.randrange(3)) for _ in range(r.randrange(9))]
        check_tree(spans, nest(spans))


def test_nesting_of_known_spans():
    assert [tuple(p) for p in nest([(0, 10, 1), (5, 15, 2), (15, 20, 1)])] == [(0, 0, 0, 10, 0, None), (1, 0, 5, 10, 1, 0), (1, 1, 10, 15, 0, None), (2, 0, 15, 20, 0, None)]
    assert [tuple(p)[:5] for p in nest([(2, 9, 2), (4, 7, 1)])] == [(0, 0, 2, 4, 0), (1, 0, 4, 7, 0), (0, 1, 4, 7, 1), (0, 2, 7, 9, 0)]
    assert [tuple(p)[:5] for p in nest([(0, 5, 2), (0, 5, 1)])] == [(1, 0, 0, 5, 0), (0, 0, 0, 5, 1)]


def test_nested_over_texts(spark):
    rows = [("a", 0, 10, 1, 7), ("a", 5, 15, 2, 8), (None, 1, 2, 1, 9), ("b", 3, 3, 1, 5)]
    got = nested(spark.createDataFrame(rows, "k string, start int, end int, rank int, span int").repartition(3), ["k"])
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, [("a", 0, 7, 0, 0, 10, 0, None), ("a", 1, 8, 0, 5, 10, 1, 0), ("a", 2, 8, 1, 10, 15, 0, None), (None, 0, 9, 0, 1, 2, 0, None)]))


def test_render(spark):
    text = 'A "CO2" & more. <B> is p53. End'
    docs = spark.createDataFrame([(1, text), (2, "none"), (3, None)], "k long, text string")
    found = spark.createDataFrame([(1, 3, 6, "chemistry", "F", "CO2", "text"), (1, 23, 28, "biology", 'P"', "p53. ", "text"), (1, 0, 1, "cs", "x", "A", "meta"), (9, 0, 1, "cs", "x", "A", "text")], "k long, start int, end int, category string, label string, text string, source string")
    sent = spark.createDataFrame([(1, 0, 15), (1, 16, 26)], "k long, start int, end int")
    html = {r["k"]: r["html"] for r in render(docs, ["k"], found, sent).collect()}
    assert html == {1: '<mark class="gl-sentence">A &quot;<span class="gl-highlight gl-highlight-chemistry" title="F: CO2">CO2</span>&quot; &amp; more.</mark> <mark class="gl-sentence">&lt;B&gt; is <span class="gl-highlight gl-highlight-biology" title="P&quot;: p53. ">p53</span></mark><span class="gl-highlight gl-highlight-biology" title="P&quot;: p53. ">. </span>End'}
    plain = render(docs, ["k"], found, sent, show_keywords=False)
    assert plain.first()["html"] == '<mark class="gl-sentence">A &quot;CO2&quot; &amp; more.</mark> <mark class="gl-sentence">&lt;B&gt; is p53</mark>. End'
    both = render(docs, ["k"], found, sent).select("k", unwrapped(F.col("html")).alias("t")).join(docs, "k")
    assert both.where("t = text").count() == 1


def test_rendering_a_long_text_takes_linear_time(spark):
    n = 60_000
    docs = spark.createDataFrame([(1, "Of CO2 é. " * n)], "k long, text string")
    found = spark.range(n).selectExpr("1L AS k", "int(id * 10 + 3) AS start", "int(id * 10 + 6) AS end", "'chemistry' AS category", "'F' AS label", "'CO2' AS text")
    sent = spark.range(n).selectExpr("1L AS k", "int(id * 10) AS start", "int(id * 10 + 9) AS end")
    began = time.time()
    assert render(docs, ["k"], found, sent).select(unwrapped(F.col("html")).alias("t"), F.length("html").alias("n")).where(F.col("t") == "Of CO2 é. " * n).count() == 1
    assert time.time() - began < 40

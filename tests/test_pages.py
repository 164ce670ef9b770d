from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from glosslake.functions import links, text, vectors
from glosslake.operators import dedupe, search
from glosslake.plans.pages import analyze_pages, report
from glosslake.sources import files, html, scanners

PAGE = """<!DOCTYPE html><head><title>BRCA1</title><meta name="Citation_DOI" content=" 10.1/x "><meta name="dc.identifier" content="10.2/y"><meta name="citation_title" content="t">
<meta name=citation_doi_url content="https://doi.org/10.1038/abc"><link rel=CANONICAL href="/abs/2401.00001v2"><meta property="OG:url" content="x 10.5555/og?a">
<script type="application/ld+json">[{"identifier": ["10.1234/a", {"value": "7654321"}, {"doi": "arXiv: 2302.00002"}], "doi": {"value": "10.1234/b"}, "sameAs": {"url": "10.1234/c"}, "name": "10.1234/no"}]</script>
<script type="application/ld+json">{bad</script></head><body><p>TP53 and <b>p53 &amp; CO2</b><p>O(n) <code>arXiv:2401.12345</code><h2>TP53</h2><style>BRCA1</style>
<div itemscope><section itemscope itemtype="http://schema.org/Article"><i itemprop="doi">10.1234/m</i></section><a itemprop=url content="" href="10.1234/n">t</a></div>
<div itemscope itemtype="Person"><i itemprop="doi">10.1234/p</i></div>
<a href=" https://pubmed.ncbi.nlm.nih.gov/123456 ">1</a><a href="https://pubmed.ncbi.nlm.nih.gov/123456">2</a><a href="https://www.ncbi.nlm.nih.gov/pmc/articles/PMC1">3</a><a href="https://www.biorxiv.org/content/10.1101/9">4</a>"""


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(1, "https://arxiv.org/x", PAGE), (2, None, None), (3, "u", ""), (4, "u", "<p>no <b>end")], "page_id long, url string, html string")


def found(df):
    return [(r["pattern_id"], r["text"]) for r in df.orderBy("src_ord", "at").collect()]


def test_scanners(pages):
    e = html.elements(html.parse_pages(pages)).cache()
    assert found(scanners.scan_meta(e)) == [("doi", "10.1/x"), ("dc.identifier", "10.2/y"), ("doi.url", "10.1038/abc")]
    assert found(scanners.scan_canonical(e)) == [("arxiv.id", "2401.00001v2")]
    assert found(scanners.scan_jsonld(e)) == [("doi", "10.1234/a"), ("arxiv.id", "2302.00002"), ("doi", "10.1234/b"), ("doi", "10.1234/c")]
    assert found(scanners.scan_opengraph(e)) == [("doi", "10.5555/og")]
    assert found(scanners.scan_microdata(e)) == [("doi", "10.1234/m"), ("doi", "10.1234/m")]
    assert found(scanners.scan_anchors(e)) == [("pmid", "123456"), ("pmcid", "PMC1"), ("doi", "10.1101/9")]
    assert scanners.scan_sources(e).count() == 14


def test_text_nodes(pages):
    nodes = html.text_nodes(html.parse_pages(pages))
    own = [(r["text"].strip(), r["parent_tag"]) for r in nodes.where("page_id = 1").orderBy("node_ord").collect()]
    assert own[:4] == [("TP53 and", "P"), ("p53 & CO2", "B"), ("O(n)", "P"), ("arXiv:2401.12345", "CODE")]
    assert all("BRCA1" not in t for t, _ in own)


def test_page_pipeline(pages):
    rows = analyze_pages(pages)
    got = {(r["pattern_id"], r["text"]) for r in rows.where("source = 'text'").collect()}
    assert got == {("bio.gene", "TP53"), ("bio.protein", "p53"), ("chem.formula", "CO2"), ("math.bigO", "O(n)"), ("doi", "10.1234/m"), ("doi", "10.1234/p")}
    shown = report(rows).where("page_id = 1").orderBy("group_ord").collect()
    assert [r["group_ord"] for r in shown] == list(range(1, len(shown) + 1))
    by_text = {r["text"]: r for r in shown}
    assert by_text["TP53"]["mentions"] == 1 and by_text["TP53"]["reason"].startswith("text-body")
    assert by_text["10.1/x"]["open_url"] == "https://doi.org/10.1/x" and by_text["10.1/x"]["filename"] == "10.1_x"


def test_dedupe(spark):
    rows = [
        (1, 1, "citation", "arxiv.id", "2401.00001v1", "text", 0.7, 9), (1, 2, "citation", "arxiv.id", " 2401.00001V2", "meta", 1.0, 0),
        (1, 3, "citation", "arxiv.id", "2401.00001", "anchor", None, 0), (1, 4, "cs", "cs.model", "BERT", "text", 0.7, 3), (2, 5, "cs", "cs.model", "bert", "text", 0.7, 3),
    ]
    df = spark.createDataFrame(rows, "page_id long, seq long, category string, pattern_id string, text string, source string, confidence double, start int")
    groups = dedupe.dedupe(df).orderBy("page_id", "group_ord").collect()
    assert [(g["norm_text"], g["mention_count"], g["representative"]["seq"], [m["seq"] for m in g["mentions"]]) for g in groups] == [
        ("2401.00001", 3, 2, [1, 3]), ("bert", 1, 4, []), ("bert", 1, 5, []),
    ]
    assert {(r["page_id"], r["category"], r["n_groups"]) for r in dedupe.category_chips(df).collect()} == {(1, "citation", 1), (1, "cs", 1), (2, "cs", 1)}
    assert {r["label"] for r in dedupe.unique_vs_mentions(df).collect()} == {"unique · 4 mentions", "unique"}


def test_links(spark):
    rows = [
        ("arxiv.id", "2401.00001v2", "meta", 1.0, "2401.00001v2", "pdf"), ("arxiv.id", "x2401", "meta", 1.0, None, None), ("doi", "10.1/a<b>//c", "canonical", 0.9, "10.1_a_b_c", "html"),
        ("doi", "10.1/a", "text", 1.0, None, None), ("doi", "10.1/a", "opengraph", 0.85, "10.1_a", "html"), ("doi", "10.1/a", "anchor", 0.6, None, None), ("doi", "10.1/a", "meta", None, None, None),
        ("pmid", " 1234567 ", "meta", 1.0, "pmid-1234567", "html"), ("pmid", "12", "meta", 1.0, None, None), ("pdf_url", "HTTPS://h/a/b.PDF", "meta", 1.0, "b", "pdf"), ("pdf_url", "ftp://h/b.pdf", "meta", 1.0, None, None),
        ("dc.identifier", "doi: 10.1234/z", "meta", 1.0, "10.1234_z", "html"), ("dc.identifier", "arXiv:2401.00001", "meta", 1.0, "2401.00001", "pdf"), ("github", "u", "meta", 1.0, None, None),
        ("biorxiv", "10.1101/1", "meta", 1.0, "10.1101_1", "pdf"),
    ]
    df = spark.createDataFrame([(*r[:4],) for r in rows], "pattern_id string, text string, source string, confidence double").withColumn("n", F.monotonically_increasing_id())
    got = links.with_save_plan(df).orderBy("n").collect()
    assert [(g["save"] and g["save"]["filename"], g["save"] and g["save"]["format"]) for g in got] == [r[4:] for r in rows]
    assert {g["status"] for g in got} == {"planned", "skipped"} and got[3]["reason"].startswith("text-body") and "not downloadable" in got[5]["reason"]


def test_small_text_functions(spark):
    df = spark.createDataFrame([("A  b 2401.1V3", "x" * 90)], "t string, long string")
    row = df.select(text.normalised(F.col("t")), text.shortened(F.col("long")), text.display_id(F.lit("cs"), F.lit("cs.model")), text.safe_name(F.lit("é/a b.c"))).first()
    assert tuple(row) == ("a b 2401.1", "x" * 77 + "…", "cs.model", "é_a_b_c")


def test_vectors(spark):
    rows = [("a", [3.0, 4.0], [3.0, 4.0], 1.0), ("b", [0.0, 0.0], [1.0, 1.0], 0.0), ("c", [1.0], [1.0, 2.0], 0.0), ("d", [], [], 0.0), ("e", [1.0, 0.0], [-2.0, 0.0], -1.0)]
    df = spark.createDataFrame([r[:3] for r in rows], "k string, a array<float>, b array<float>")
    got = {r["k"]: r for r in df.select("k", vectors.cosine(F.col("a"), F.col("b")).alias("c"), vectors.dot(F.col("a"), F.col("b")).alias("d"), vectors.l2_normalize(F.col("a")).alias("u")).collect()}
    assert all(abs(got[k]["c"] - c) < 1e-9 for k, _, _, c in rows)
    assert got["c"]["d"] == 1.0 and got["b"]["u"] == [0.0, 0.0] and got["a"]["u"] == pytest.approx([0.6, 0.8])
    index = spark.createDataFrame([(i, f"k{i}", v) for i, v in enumerate([[1.0, 0.0], [1.0, 0.1], [0.0, 1.0], [2.0, 0.0]])], "ord long, keyword string, vector array<float>")
    assert [r["keyword"] for r in search.find_similar(index, [1.0, 0.0], 3).collect()] == ["k0", "k3", "k1"]
    assert search.find_similar(index, [1.0, 0.0], 0).count() == 0 and search.find_similar(index, [1.0, 0.0], 99).count() == 4
    many = search.find_similar_each(index, spark.createDataFrame([(7, [1.0, 0.0])], "query_id long, q array<float>"), 2)
    assert [(r["rank"], r["ord"]) for r in many.orderBy("rank").collect()] == [(1, 0), (2, 3)]
    pooled = search.mean_pool(spark.createDataFrame([(1, 1, [2.0, 0.0]), (1, 1, [0.0, 2.0]), (1, 0, [9.0, 9.0])], "k long, mask int, v array<float>"), "k")
    assert pooled.first()["vector"] == pytest.approx([2**-0.5, 2**-0.5])
    vec = search.embed(spark.createDataFrame([("ab",), (None,)], "text string"), lambda: lambda ts: [[float(len(t))] for t in ts])
    assert [r["vector"] for r in vec.collect()] == [[2.0], [0.0]]


def test_files(spark, tmp_path):
    (tmp_path / "in.json").write_text('{"items": [{"text": "uses BERT"}, {"text": 5}, {}, {"text": "TP53 and BERT"}]}')
    items = files.read_batch(spark, str(tmp_path / "in.json"))
    from glosslake.operators.scan import scan_text

    out = files.batch_results(items, scan_text(items, ["item"])).orderBy("item").collect()
    assert [[f["text"] for f in r["findings"]] for r in out] == [["BERT"], [], [], ["TP53", "BERT"]]
    assert files.results_json(files.batch_results(items, scan_text(items, ["item"]))).where("item = 1").first()["json"] == '{"findings":[]}'
    (tmp_path / "bad.json").write_text('{"items": 3}')
    with pytest.raises(Exception, match="list of items"):
        files.read_batch(spark, str(tmp_path / "bad.json"))
    (tmp_path / "gold.jsonl").write_text('# note\n\n{"pattern": "doi", "text": "t", "expect": null}\n  # x\n{"pattern": "pmid", "text": "u", "expect_null": true}\n')
    assert [(r["pattern"], r["expect_null"]) for r in files.read_gold(spark, str(tmp_path / "gold.jsonl")).orderBy("example").collect()] == [("doi", None), ("pmid", True)]
    (tmp_path / "index.json").write_text('{"model": "m", "dimensions": 2, "items": [{"keyword": "a", "vector": [1, 2]}]}')
    assert files.read_vectors(spark, str(tmp_path / "index.json")).first()["vector"] == [1.0, 2.0]
    for name, size in (("citation/a.pdf", 2000), ("citation/b.pdf", 10), ("cs/c.html", 0)):
        (tmp_path / "papers" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "papers" / name).write_bytes(b"x" * size)
    papers = files.read_papers(spark, str(tmp_path))
    assert [r["filename"] for r in papers.collect()] == ["a.pdf", "b.pdf"]
    plan = spark.createDataFrame([("u1", "citation", "a", "pdf"), ("u2", "citation", "b", "pdf"), ("u3", "a/b", "x", "pdf"), ("u4", "citation", ".x", "pdf"), ("u5", "citation", "y", "exe")], "url string, category string, filename string, format string")
    todo = files.pending_downloads(plan, papers)
    assert [r["url"] for r in todo.collect()] == ["u2"]
    assert files.read_papers(spark, str(tmp_path / "none")).count() == 0

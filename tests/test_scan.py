from __future__ import annotations

import random

import pytest

from glosslake.functions.catalog import Catalog, Falsifier, Pattern, PatternSet, default_catalog
from glosslake.functions.text import sentences
from glosslake.operators import scan
from glosslake.operators.evaluate import confusion, failures, macro_micro, outcomes, prf

#: pattern, text, expected first finding (None: no finding).
GOLD = [
    ("arxiv.id", "Read arXiv: 2401.01234v2 first.", "2401.01234v2"),
    ("arxiv.id", "Version 2401.01234 alone is nothing.", None),
    ("arxiv.abs", "See http://ARXIV.org/pdf/1706.03762v5 now", "1706.03762v5"),
    ("doi", "as in 10.1038/nature12373.", "10.1038/nature12373"),
    ("doi", "wrong 10.5.0 and 10.1234 / 56", None),
    ("doi", "list 10.1038/a1, 10.1126/b2", "10.1126/b2"),
    ("doi.url", "at https://doi.org/10.1000/xyz<b>", "10.1000/xyz"),
    ("pmid", "PMID: 12345678.", "12345678"),
    ("pmid", "PMID 1234567890 is too long", None),
    ("pmcid", "in PMC1234567.", "PMC1234567"),
    ("pmcid", "in PMC123456789.", None),
    ("github", "code: https://github.com/org/repo.git#x", "https://github.com/org/repo"),
    ("biorxiv", "www.biorxiv.org/content/10.1101/2020.01.01.1 ok", "10.1101/2020.01.01.1"),
    ("medrxiv", "medrxiv.org/content/10.1101/2021.2 ok", "10.1101/2021.2"),
    ("math.theorem", "By Lemma 2.3 we have", "2.3"),
    ("math.definition", "Def. 4 says", "4"),
    ("math.equation", "as (eq. 12) shows", "12"),
    ("math.equation", "JAMA 2023;159(2):201", None),
    ("math.bigO", "runs in O(n log n) time", "O(n log n)"),
    ("physics.particle", "a Higgs boson decays", "Higgs boson"),
    ("physics.particle", "two muons", None),
    ("physics.detector", "at CERN-LHC today", "CERN-LHC"),
    ("physics.units", "at 125.3 GeV here", "125.3 GeV"),
    ("physics.units", "weighs 55 kg at a depth of ten", None),
    ("chem.formula", "dissolved CO2 gas", "CO2"),
    ("bio.gene", "mutated BRCA1 cells", "BRCA1"),
    ("bio.gene", "éTP53 counts", "TP53"),
    ("bio.protein", "active TGFβ here", "TGFβ"),
    ("bio.technique", "a western BLOT ran", "western BLOT"),
    ("bio.taxonomy", "grown Escherichia coli cells", "Escherichia coli"),
    ("cs.venue", "at NeurIPS 2023 and", "NeurIPS 2023"),
    ("cs.model", "a bert-base model", "bert-base"),
    ("cs.dataset", "on ImageNet only", "ImageNet"),
    ("cs.dataset", "nothing of the kind", None),
]


@pytest.fixture(scope="module")
def gold(spark):
    rows = [(i, p, t, e, e is None) for i, (p, t, e) in enumerate(GOLD)]
    return spark.createDataFrame(rows, "example long, pattern string, text string, expect string, expect_null boolean")


def test_catalog():
    patterns = default_catalog().patterns()
    assert len(patterns) == 24 == len({p.id for p in patterns})
    assert all("g" in p.flags for p in patterns)
    assert {p.id for p in default_catalog().patterns(category="math")} == {"math.theorem", "math.definition", "math.equation", "math.bigO"}
    with pytest.raises(ValueError):
        Catalog(PatternSet("x", "x", (Pattern("a", "A", "cs", "a", flags="i"),)))
    old = Catalog(PatternSet("x", "x", (Pattern("a", "A", "cs", "a", exclude_in_sentence=("no",)),))).patterns()[0]
    assert old.falsifiers == (Falsifier("context", words=("no",)),)


def test_gold(spark, gold):
    rows = outcomes(gold, scan.candidates(gold, ["example"]).withColumnRenamed("text", "text"))
    bad = [r for r in rows.collect() if r["reason"]]
    assert not bad, bad
    scores = prf(confusion(rows))
    assert {r["f1"] for r in scores.collect()} == {1.0}
    assert macro_micro(scores).first()["passed"] is True
    assert failures(rows).count() == 0


def test_native_scan_agrees(spark):
    texts = [(i, " ".join(t for _, t, _ in random.Random(i).sample(GOLD, 12))) for i in range(20)]
    df = spark.createDataFrame([*texts, (20, None), (21, "")], "doc_id long, text string")
    found = {tuple(r) for r in scan.candidates(df, ["doc_id"]).select("pattern_id", "doc_id", "text", "start", "end").collect()}
    slices = dict(texts)
    assert all(slices[d][s:e] == t for _, d, t, s, e in found)
    for p in default_catalog().patterns():
        if all(f.kind == "parent" for f in p.falsifiers):
            own = {(p.id, *r) for r in scan.scan_one(df, "doc_id", p).collect()}
            assert own == {f for f in found if f[0] == p.id}, p.id


def test_overlaps_against_a_sweep(spark):
    r = random.Random(3)
    rows = []
    for key in range(40):
        for k in range(r.randint(0, 25)):
            start = r.randint(0, 40)
            rows.append((key, k, f"p{k}", "cs", "l", "t", start, start + r.randint(1, 9), r.randint(1, 9), r.randint(0, 2)))
    df = spark.createDataFrame(rows, "k long, " + scan.FOUND_DDL)
    got = {(x["k"], x["ord"]) for x in scan.resolve_overlaps(df, ["k"]).collect()}
    want, cursor = set(), {}
    for row in sorted(rows, key=lambda x: (x[0], x[6], -x[8], -x[9], x[1])):
        if row[6] >= cursor.get(row[0], 0):
            want.add((row[0], row[1]))
            cursor[row[0]] = row[7]
    assert got == want
    assert scan.resolve_overlaps(df.limit(0), ["k"]).count() == 0


def test_falsifiers_by_kind(spark):
    def count(text, f):
        own = Catalog(PatternSet("s", "s", (Pattern("x", "X", "cs", "foo", falsifiers=(f,)),)))
        return scan.candidates(spark.createDataFrame([(1, text)], "k long, text string"), ["k"], catalog=own).count()

    assert count("a bad foo. Good foo", Falsifier("context", words=("bad",))) == 1
    assert count("a badly foo", Falsifier("context", words=("bad",))) == 1
    assert count("see NOT  foo", Falsifier("before", text="not")) == 0
    assert count("foo then stop", Falsifier("after", text="STOP")) == 0
    assert count("foo" + " " * 120 + "stop", Falsifier("after", text="stop")) == 1
    assert count("foo", Falsifier("confidence", below=0.7)) == 1
    assert count("foo", Falsifier("confidence", below=0.71)) == 0


@pytest.mark.parametrize(
    ("text", "n"),
    [
        ("One. Two! Three? four", 3), ("Dr. Smith et al. Went home.", 1), ("It is 1.25 long. Ok.", 2), ("J. K. Rowling wrote. Yes.", 2), ("e.g. this one.", 1),
        ("version 1.2.3.4 Is out. Next", 2), ("no stop here", 1), ("", 0), ("line\nbreak. Next", 2), ('He said. "Yes."', 3),
    ],
)
def test_sentences(spark, text, n):
    parts = spark.createDataFrame([(text,)], "t string").select(sentences(__import__("pyspark").sql.functions.col("t")).alias("s")).first()["s"]
    assert len(parts) == n and "".join(parts) == text


def test_sentence_spans_and_render(spark):
    from glosslake.operators.render import render, unwrapped
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, "Plain <b>. We use BERT & TP53 here.  Nothing."), (2, "none")], "k long, text string")
    found = scan.scan_text(df, ["k"])
    spans = scan.sentence_spans(df, ["k"], found)
    assert [(r["start"], r["end"]) for r in spans.collect()] == [(11, 35)]
    html = render(df, ["k"], found, spans)
    row = html.first()
    assert row["html"].startswith('Plain &lt;b&gt;. <mark class="gl-sentence">We use <span class="gl-highlight gl-highlight-cs" title="ML model family: BERT">BERT</span> &amp; ')
    assert row["html"].count("</span>") == 2 and row["html"].endswith("here.</mark>  Nothing.")
    assert html.select(unwrapped(F.col("html")).alias("t")).first()["t"] == "Plain <b>. We use BERT & TP53 here.  Nothing."


def test_context_words_are_looked_up(spark):
    """A text without a sentence's end in linear time; bounds of sentences; characters whose lower case is longer."""
    import time

    from glosslake.functions.catalog import default_catalog
    from glosslake.operators.scan import Kernel

    units = [p for p in default_catalog().patterns(category="physics") if p.id == "physics.units"]
    began = time.time()
    assert len(list(Kernel(units).find("5 kg " * 200_000))) == 200_000 and list(Kernel(units).find("5 kg " * 200_000 + "depth")) == []
    assert time.time() - began < 20
    found = lambda t: [m[4] for m in Kernel(units).find(t)]
    assert found("At depth. Of 3 kg. A depth of 4 kg. And 5 kg. Depth") == ["3 kg", "5 kg"]
    assert found("Aİİ of 3 kg. Aİ the DEPTH 4 kg. Bİ 5 kg") == ["3 kg", "5 kg"] and found("Kİlomet 3 kg depths") == ["3 kg"]


def test_sentences_meet_findings_in_one_sweep(spark):
    import time

    from pyspark.sql import functions as F

    from glosslake.operators import scan

    text = "See 10.1/a.  Then B? No. " * 25_000  # 75,000 sentences
    docs = spark.createDataFrame([(1, text), (2, " One CO2.  Two. "), (3, None), (None, "Of CO2")], "k long, text string")
    found = spark.createDataFrame([(1, i * 25 + 4, i * 25 + 10) for i in range(0, 25_000, 5)] + [(2, 5, 8), (2, 9, 9), (2, 3, 12), (None, 3, 6)], "k long, start int, end int")
    began = time.time()
    spans = scan.sentence_spans(docs, ["k"], found)
    assert spans.where("k = 1").count() == 5000 and time.time() - began < 60
    assert sorted(map(tuple, spans.where("k = 2").collect())) == [(2, 0, 1, 9), (2, 1, 11, 15)]
    met = scan.with_sentences(found, docs, ["k"]).where("k = 2").select("start", "end", F.col("sentence.sent").alias("s")).collect()
    assert sorted(map(tuple, met), key=str) == [(3, 12, None), (5, 8, 0), (9, 9, 1)]
    assert spans.where("k is null").first()[1:] == (0, 0, 6)

"""Expressions run where a match may begin, and sentences come with the scan."""

from __future__ import annotations

import random
import re

import pytest

from glosslake.functions.catalog import Pattern, PatternSet, default_catalog, python_regex
from glosslake.operators import harvest, scan

PATTERNS = default_catalog().patterns()
COMPILED = [python_regex(p.regex, p.flags) for p in PATTERNS]
KEY = tuple((rx.pattern, bool(rx.flags & re.IGNORECASE)) for rx in COMPILED)


def test_matches_at_spots_are_all_matches():
    r = random.Random(6)
    bits = ["arXiv: 2401.00001", "10.1234/x", "10.10.1234/a", "10.1234/x; 10.2345/y", "PMC12345", "PMCPMC1234", "pmc.ncbi.nlm.nih.gov/articles/PMC1234", "https://github.com/a0/b", "http://github.com/", "www.biorxiv.org/content/10.1101/1", "Lemma 1", "Def 2", "Definition 2.1",
            "O(n)", "O(O(n", "tauon", "muon", "W boson", "CERN-LHC-A", "C6H12O6", "H2O2", "TP53", "Stat3", "RT-PCR", "qRT-PCR", "Mus musculus", "Musmusculus", "Zea mays", "ICML 2020", "gpt-4o", "LLAMA 3", "MS-COCO", "SuperGLUE", "ſ", "K"]
    hits = 0
    for _ in range(4000):
        text = "".join(r.choice([*bits, " ", "x", "1", "-", ".", "\n"]) for _ in range(r.randrange(9)))
        at = harvest.spots(text, KEY)
        for k, rx in enumerate(COMPILED):
            want = [m.span() for m in rx.finditer(text)]
            hits += len(want)
            assert want == ([m.span() for m in harvest.matches(rx, text, at[k])] if at.get(k) else want if k in at else []), (PATTERNS[k].id, text)
    assert hits > 5000 and harvest.spots("aİ 10.1234/x", KEY) is None
    assert [m[4] for m in scan.Kernel(PATTERNS).find("aİ 10.1234/x")] == ["10.1234/x"]


def test_few_places_of_a_long_text_are_tried():
    text = "The mustard was pressed, and nothing of it is stated. " * 20_000 + "See 10.1234/x and BERT in PMC12345."
    at = harvest.spots(text, KEY)
    assert [PATTERNS[k].id for k in at if not at[k]] == ["math.equation", "physics.units", "bio.gene"]
    assert {PATTERNS[k].id: len(at[k]) for k in at if at[k]} == {"doi": 1, "cs.model": 1, "pmcid": 1}


def test_sentence_ends_are_the_boundaries():
    import regex

    from glosslake.functions.text import BOUNDARY

    whole, r = regex.compile(BOUNDARY.replace(r"\z", r"\Z"), regex.ASCII), random.Random(2)
    for _ in range(5000):
        text = "".join(r.choice([".", "!", "?", " ", " ", "\n", "A", "b", "1", "12", "Dr", "pp", "e", "¿", "(", "Fig", "é"]) for _ in range(r.randrange(14)))
        assert scan.sentence_ends(text) == [m.end() for m in whole.finditer(text)], text


def test_sentences_of_a_scan_are_those_of_the_sweep(spark):
    texts = [(1, " Of CO2.   Then (BERT? No. And TP53  "), (2, None), (3, ""), (4, "By 10.1/a"), (5, "Go to ATLAS. Now and CERN.  Big. O(n).BERT")]
    docs = spark.createDataFrame(texts, "k long, text string")
    catalog = default_catalog().register(PatternSet("own", "Own", (Pattern("own.cross", "Cross", "default", r"CERN\.\s+Big"),)))
    own = scan.scan_text(docs, ["k"], catalog=catalog, sentences=True)
    met = scan.with_sentences(scan.scan_text(docs, ["k"], catalog=catalog), docs, ["k"])
    key = lambda df: sorted((str(r) for r in df.select("k", "pattern_id", "start", "end", "sentence").collect()))
    assert key(own) == key(met) and own.where("sentence is null").count() == 1
    assert sorted(scan.sentence_spans(docs, ["k"], own).collect()) == sorted(scan.sentence_spans(docs, ["k"], met.drop("sentence")).collect())


@pytest.mark.parametrize(("name", "reads", "steps"), [("finding_sentences", 1, 1), ("marked_sentences", 1, 1), ("highlighted_html", 3, 2)])
def test_texts_are_scanned_once(spark, name, reads, steps):
    """One scan of the texts; the marks need the texts themselves, and once more to compare."""
    from glosslake.plans.queries import queries

    plan = queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert (plan.count("Relation "), plan.count("MapInArrow")) == (reads, steps)


def test_queries_of_one_pattern_pass_once_over_the_texts(spark):
    """No expression is left to Spark's own functions, which have no places to start from."""
    from glosslake.plans.queries import queries

    for p in PATTERNS:
        plan = queries()["scan_" + p.id.replace(".", "_").lower()](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("MapInArrow") == 1 and not any(f in plan.lower() for f in ("rlike", "regexp_extract_all", "split(")), p.id

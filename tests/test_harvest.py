from __future__ import annotations

import random
import re

import pytest

from glosslake.functions.catalog import default_catalog, python_regex
from glosslake.operators import harvest, scan


def test_places(spark):
    rows = [(1, "CO2 and H2O, (CO2) xCO2 CO2_ Z boson boson é CO2é"), (2, None), (3, ""), (None, "boson")]
    got = harvest.places(spark.createDataFrame(rows, "k long, text string"), ["k"], ["CO2", "Z boson", "boson", "H2O", "", "absent"]).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, "CO2", 0, 3), (1, "H2O", 8, 11), (1, "CO2", 14, 17), (1, "Z boson", 29, 36), (1, "boson", 31, 36), (1, "boson", 37, 42), (1, "CO2", 45, 48), (None, "boson", 0, 5)], key=str)
    assert harvest.places(spark.createDataFrame(rows, "k long, text string"), ["k"], []).count() == 0


@pytest.mark.parametrize(("regex", "ignore", "want"), [
    ("ab(?:c|d)ef", False, {"ab"}), ("(?:abc|de)f", False, {"abc", "de"}), ("(?:abc|d?)ef", False, {"ef"}), ("[ab]cd(?:x)+e", False, {"cd"}), ("a?", False, None), ("x|yz", False, None),
    ("ArX(?:iv)+:", True, {"arx"}), ("(?:ab|cd){2}", False, {"ab", "cd"}), ("(?:ab|cd){0,2}", False, None), (r"\babc\b", False, {"abc"}),
])
def test_required(regex, ignore, want):
    got = harvest.required(regex, ignore)
    assert got == (None if want is None else frozenset(want))


def test_the_gate_skips_no_match():
    """Texts made of the patterns' own examples and noise: whatever matches is possible."""
    r = random.Random(4)
    patterns = default_catalog().patterns()
    compiled = [python_regex(p.regex, p.flags) for p in patterns]
    key = tuple((rx.pattern, bool(rx.flags & re.IGNORECASE)) for rx in compiled)
    bits = ["arXiv: 2401.00001", "ARXIV.ORG/abs/2401.00001", "10.1234/x", "doi.org/10.1234/x", "PMID: 123456", "PMC1234", "https://github.com/a0/b ", "biorxiv.org/content/10.1101/1", "medrxiv.org/content/10.1101/1", "Lemma 1", "Def. 2", "(3)", "O(n)", "muon", "W boson", "CERN-LHC", "5 µm", "1.5kg", "CO2", "TP53", "Ras", "TGFα", "ELISA", "crispr/Cas9", "Mus musculus", "Zea mays", "ICML 2020", "gpt-4o", "LLAMA 3", "MS-COCO", "İ", "K", "ſ"]
    seen = set()
    for _ in range(3000):
        text = "".join(r.choice([*bits, " ", "x", "1", "-", "."]) for _ in range(r.randrange(6)))
        mask = harvest.possible(text, key)
        for k, rx in enumerate(compiled):
            if rx.search(text):
                seen.add(k)
                assert mask >> k & 1, (patterns[k].id, text)
    assert len(seen) == 24
    assert bin(harvest.possible("Nothing of note in here.", key)).count("1") <= 3


def test_scans_agree_with_and_without_the_gate(monkeypatch):
    r = random.Random(7)
    kernel = scan.Kernel(default_catalog().patterns())
    texts = [" ".join(r.choice(["Ras", "p53", "O(n)", "(4)", "the", "BRCA1", "at 5 kg", "depth.", "And", "bert", "CO2"]) for _ in range(40)) for _ in range(100)]
    gated = [list(kernel.find(t)) for t in texts]
    monkeypatch.setattr(scan, "possible", lambda text, key: -1)
    assert gated == [list(kernel.find(t)) for t in texts]

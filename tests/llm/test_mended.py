"""Recall, repeated words and shared headers of decontamination; ids beside nulls; odd comments; hand-written pages."""

from __future__ import annotations

import random
import time

import numpy as np
import pytest

from glosslake.llm import decontaminate, dom, langid, url_filter
from glosslake.llm.words import words_of


def aligned(a, b):
    return sum(x == y for x, y in zip(a, b, strict=True))


@pytest.mark.parametrize(("n", "rate"), [(12, 0.2), (12, 0.3), (20, 0.3), (40, 0.3), (40, 0.4)])
def test_recall_of_substituted_passages(n, rate):
    r = random.Random(n)
    vocab = [f"w{i}" for i in range(3000)]
    items = [[r.choice(vocab) for _ in range(n)] for _ in range(300)]
    changed = [[r.choice(vocab) if r.random() < rate else w for w in i] for i in items]
    texts = [" ".join([*r.choices(vocab, k=20), *c, *r.choices(vocab, k=20)]) for c in changed]
    hit = decontaminate.Matcher(list(range(300)), [" ".join(i) for i in items]).hits(texts)
    got = set(zip(hit["text"].tolist(), hit["item"].tolist(), strict=True))
    want = {k for k in range(300) if aligned(items[k], changed[k]) >= max(8, n / 2)}  # by brute force, on the passage's own diagonal
    assert sum((k, k) in got for k in want) >= 0.97 * len(want) and all(t == i and (t in want or aligned(items[t], changed[t]) >= 13) for t, i in got)


def test_against_all_diagonals():
    """Whatever is found has enough equal words; whatever has a seed and enough on one diagonal is found."""
    r = random.Random(9)
    vocab = [f"v{i}" for i in range(12)]
    items, texts = [r.choices(vocab, k=r.randint(0, 25)) for _ in range(40)], [r.choices(vocab, k=r.randint(0, 60)) for _ in range(40)]
    hit = decontaminate.Matcher(list(range(40)), [" ".join(i) for i in items]).hits([" ".join(t) for t in texts])
    got = {(t, i): n for t, i, n in zip(hit["text"].tolist(), hit["item"].tolist(), hit["n_matched"].tolist(), strict=True)}
    picks = [([k for k, c in enumerate(m) if c == "1"], len(m)) for m in decontaminate.MASKS]
    for t, text in enumerate(texts):
        for i, item in enumerate(items):
            need = max(8, len(item) / 2)
            best = 0
            for d in range(-len(item), len(text)):
                same = [k for k in range(len(item)) if 0 <= k + d < len(text) and item[k] == text[k + d]]
                seeded = any(all(q + k in same for k in p) and q + span <= len(item) and 0 <= q + d and q + d + span <= len(text) for p, span in picks for q in range(len(item)))
                best = max(best, len(same) if seeded else 0)
            assert len(item) < 8 and (t, i) not in got or len(item) >= 8 and (best < need or got.get((t, i), 0) >= best)


def test_repeated_words_and_shared_headers_are_fast():
    began = time.time()
    hit = decontaminate.Matcher([0], ["x " * 2000]).hits(["x " * 20_000, "y " * 20_000])
    assert hit["text"].tolist() == [0] and hit["n_matched"].tolist() == [2000]
    head = " ".join(f"h{i}" for i in range(9))
    hit = decontaminate.Matcher(list(range(3000)), [f"{head} a{i} b{i} c{i}" for i in range(3000)]).hits([f"{head} z{i}" for i in range(50)])
    assert len(hit["text"]) == 150_000 and set(hit["n_matched"].tolist()) == {9}
    assert time.time() - began < 20


def test_rows_of_equal_windows():
    w = words_of(["a a a a a b", "a a a a"])
    assert decontaminate._rows_of_equals(w.hashes, np.array([0, 1, 2, 3, 4, 5, 7, 8, 9, 10]))[1].tolist() == [5, 1, 4]


def test_ids_beside_nulls_stay_whole(spark):
    ids = [2**53 + 1, None, 2**53 + 3, -(2**62) - 1]
    rows = [(i, u, "x") for i, u in zip(ids, ["http://a.org/x", None, "", "no"], strict=True)]
    got = url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string, host string").coalesce(1)).collect()
    assert [r["page_id"] for r in got] == ids and [r["verdict"] for r in got] == ["allow"] * 4 and [r["rule"] for r in got] == ["org/", None, None, None]


@pytest.mark.parametrize(("html", "text"), [
    ("a<!-->b", "ab"), ("a<!--->b", "ab"), ("a<!--x--!>b", "ab"), ("a<!--!>x-->b", "ab"), ("a<!--x--y>z-->b", "ab"), ("a<!-- > -->b", "ab"), ("a<!--x", "a"),
    ("a</ p>b", "ab"), ("a</>b", "ab"), ("a</3>b", "ab"), ("a<3 b", "a<3 b"), ("a<!x>b", "ab"), ("a<?x?>b", "ab"), ("a<b>c</b>", "ac"),
])
def test_comments_end_where_browsers_end_them(html, text):
    scanner, at, out = dom.Scanner(html), 0, ""
    while tag := scanner.next(at):
        out += html[at : tag.start]
        at = tag.end
    assert out + html[at:] == text


def test_many_comments_in_linear_time():
    began, at, n = time.time(), 0, 0
    html = "<!--x--!>" * 40_000 + "</ x" * 40_000
    scanner = dom.Scanner(html)
    while tag := scanner.next(at):
        at, n = tag.end, n + 1
    assert n >= 40_000 and time.time() - began < 10


def test_language_of_a_long_text_in_slices(spark, monkeypatch):
    rows = [(i, t * 20, lang) for i, (t, lang) in enumerate([("the of and ", "en"), ("der die das ", "de")] * 5)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    texts = ["of the and " * 500 + "das die", None, "", "123 " * 400, "die der " * 300]
    whole = model.predict(texts)
    monkeypatch.setattr(langid, "SLICE", 700)
    cut = model.predict(texts)
    assert whole[0] == cut[0] == ["en", "und", "und", "und", "de"] and np.allclose(whole[1], cut[1], atol=1e-6)


def test_all_undominated_fillings():
    """Against all fillings by brute force, judged by the same rule written plainly; least waste first."""
    from itertools import combinations, product

    from glosslake.llm import packing

    r = np.random.default_rng(5)
    for _ in range(60):
        counts = np.zeros(31, np.int64)
        np.add.at(counts, r.integers(3, 20, r.integers(1, 9)), 1)
        room = int(r.integers(4, 31))
        lengths = [x for x in range(30, 0, -1) if counts[x] and x <= room]

        def bad(chosen, lengths=lengths, counts=counts, room=room):
            waste = room - sum(chosen)
            spare = [z for z in lengths if counts[z] > chosen.count(z)]
            return any(sum(c) <= z <= sum(c) + waste and not (len(c) == 1 and z == c[0]) for n in range(len(chosen) + 1) for c in combinations(chosen, n) for z in spare)

        everything = [tuple(x for x, k in zip(lengths, ks, strict=True) for _ in range(k)) for ks in product(*(range(int(counts[x]) + 1) for x in lengths))]
        want = {c for c in everything if sum(c) <= room and not bad(c)}
        got = [f for f in packing.fillings(counts, room) if f is not None]
        assert [sum(f) for f in got] == sorted((sum(f) for f in got), reverse=True)
        assert set(got) == want or lengths and lengths[0] == room and got == [(room,)]


def test_search_goes_on_behind_dropped_levels(monkeypatch):
    """Few kept levels give the same plan as many."""
    from glosslake.llm import packing

    r = np.random.default_rng(6)
    counts = np.zeros(101, np.int64)
    np.add.at(counts, r.integers(20, 60, 60), 1)
    whole = packing.bin_completion(counts, 100, 4000)
    monkeypatch.setattr(packing._Level, "KEPT", 2)
    assert packing.bin_completion(counts, 100, 4000) == whole


def test_shards_prune(spark):
    """Least and greatest values of a run rule most runs out for two conditions at once."""
    from glosslake.llm import sharding

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sharding.hilbert_shards(docs, 32).select("lang", "source", "size", "shard").toPandas()
    runs = rows.groupby("shard").agg(l0=("lang", "min"), l1=("lang", "max"), s0=("source", "min"), s1=("source", "max"), z0=("size", "min"), z1=("size", "max"))
    both = [((runs.l0 <= a) & (a <= runs.l1) & (runs.s0 <= b) & (b <= runs.s1)).mean() for a, b in rows[["lang", "source"]].drop_duplicates().itertuples(index=False)]
    sized = [((runs.l0 <= a) & (a <= runs.l1) & (runs.z0 <= z) & (z / 2 <= runs.z1)).mean() for a in rows.lang.unique() for z in (300, 1000, 4000)]
    assert np.mean(both) < 0.5 and np.mean(sized) < 0.5


def test_many_cuts_in_one_text(spark):
    """Thousands of cuts in linear time, and the same rows however the table's partitions fall."""
    from pyspark.sql import functions as F

    from glosslake.llm import substring

    lines = [f"line {i} of words that many share." for i in range(8000)]
    long = "\n".join(x + f"\nown {i} text stays here." for i, x in enumerate(lines))
    docs = spark.createDataFrame([(1, "\n".join(lines), "x"), (2, long, "y"), (3, None, "z"), (4, "", "w")], "doc_id long, text string, other string").repartition(3)
    began = time.time()
    got = {r["doc_id"]: r["text"] for r in substring.without_repeats(docs).collect()}
    assert time.time() - began < 60
    assert got[1] == "\n".join(lines) and got[2] == "".join(f"own {i} text stays here.\n" for i in range(8000))[:-1] and got[3] is None and got[4] == ""
    assert substring.without_repeats(docs.orderBy(F.rand(1))).where("doc_id = 2").first()["text"] == got[2]


def test_ranks_of_very_many_equal_rows(spark):
    """One key of a third of all rows is dealt over several ranges, and the ranks stay exact."""
    from pyspark.sql import functions as F

    from glosslake.llm.common import global_rank

    df = spark.range(0, 30_000, 1, 6).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("k"))
    ranked, n = global_rank(df, ["k"], "ranked")
    rows = ranked.select("k", "rank", F.spark_partition_id().alias("p")).orderBy("rank").collect()
    assert n == 30_000 and [r["rank"] for r in rows] == list(range(n)) and [r["k"] for r in rows] == sorted(r["k"] for r in rows)

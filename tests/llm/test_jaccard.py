from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest

from glosslake.llm import jaccard
from glosslake.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets, holders, up = [shingles(t) for _, t in rows], defaultdict(list), list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, s in enumerate(sets):
        for j, n in Counter(j for x in s for j in holders[x]).items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                up[root(i)] = root(j)
        for x in s:
            holders[x].append(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return [(d, len(sets[i]), least[root(i)] if sets[i] else d) for i, (d, _) in enumerate(rows)]


def documents(seed, n):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    base = [[r.choice(words) for _ in range(r.choice([3, 6, 8, 12, 20, 40, 90]))] for _ in range(max(1, n // 25))]
    common = [r.choice(words) for _ in range(14)]
    rows = []
    for i in range(n):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 1, 2, 3, 5])):
            k = r.randrange(len(w))
            w[k : k + r.choice([0, 1, 1, 2])] = [r.choice(words) for _ in range(r.choice([0, 1, 1]))]
            w = w or ["x"]
        rows.append((i, " ".join(w + common * (r.random() < 0.3))))
    return rows


def run(spark, rows):
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).drop("text_md5")
    return sorted(tuple(r) for r in got.collect())


def test_against_brute_force(spark):
    rows = documents(1, 500)
    rows += [(500, None), (501, ""), (502, " \n"), (503, "a a a a a a a a a a"), (504, "A a a a a a"), (505, "a b"), (506, "A  B"), (507, "é " * 40000)]
    assert run(spark, rows) == sorted(brute(rows))


def test_hot_groups(spark):
    r = random.Random(2)
    body = [f"h{i}" for i in range(60)]
    rows = [(i, " ".join(body)) for i in range(150)]  # exact copies
    for i in range(150, 400):  # near copies of it, often not near to each other
        w = list(body)
        for _ in range(r.choice([1, 1, 2])):
            w[r.randrange(len(w))] = f"x{i}{r.random()}"
        rows.append((i, " ".join(w)))
    line = " ".join(f"c{i}" for i in range(20))
    rows += [(i, line + " " + " ".join(f"u{i}_{k}" for k in range(30))) for i in range(400, 600)]
    assert run(spark, rows) == sorted(brute(rows))


def test_short_texts_with_a_word_in_front_or_behind(spark):
    r = random.Random(3)
    rows = []
    for g in range(400):
        body = [f"g{g}_{k}" for k in range(r.choice([8, 9]))]
        rows.append((len(rows), " ".join(body)))
        for i in range(r.choice([2, 3, 5])):
            rows.append((len(rows), " ".join([f"f{g}_{i}", *body] if r.random() < 0.5 else [*body, f"e{g}_{i}"])))
    assert run(spark, rows) == sorted(brute(rows))


def test_empty_repeated_null_and_extra_columns(spark):
    assert run(spark, []) == []
    rows = [(1, "a b c d e f", "x", 5), (1, "a b c d e f", "y", 6), (None, "a b c d e f", None, None), (None, "q r s t u v", None, None), (4, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, tokens string, n long")
    got = sorted(jaccard.jaccard_components(df).drop("text_md5").collect(), key=str)
    assert sorted(map(tuple, got), key=str) == sorted([(1, 2, 1), (1, 2, 1), (None, 2, 1), (None, 2, None), (4, 0, 4)], key=str)
    left = jaccard.one_of_each(df)
    assert left.columns == df.columns
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in left.collect()) == [(0, "q r s t u v"), (1, "a b c d e f"), (4, "")]


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (101, 100)]
    got = {tuple(r) for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {(i, 0) for i in range(41)} | {(100, 100), (101, 100)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("a,b,want", [(range(4), range(3), True), (range(4), range(2), False), (range(7), range(1, 8), True), (range(6), range(1, 7), False)])
def test_threshold_is_exact(a, b, want):
    import numpy as np

    assert jaccard.linked(np.array(a), np.array(b)) is want


@pytest.mark.parametrize("tries", [0, 1])
def test_groups_are_connected_by_one_link(spark, monkeypatch, tries):
    """Two groups of near copies that a few of their members link, by one member for each token and by all of them."""
    monkeypatch.setattr(jaccard, "TRIES", tries)
    monkeypatch.setattr(jaccard, "SUBGROUP", 3)
    monkeypatch.setattr(jaccard, "UNION_PART", 64 if tries else 4096)
    r = random.Random(8)
    rows = documents(8, 120)
    for k in range(6):  # chains: neighbours link, ends don't; leaders see only a part of each
        words = [f"c{k}_{i}" for i in range(60)]
        for j in range(40):
            own = words[: 40 - j // 2] + [f"c{k}_x{j // 4}_{i}" for i in range(j // 2)]
            rows.append((1000 + 100 * k + j, " ".join(own)))
    r.shuffle(rows)
    assert run(spark, rows) == sorted(brute(rows))


def test_linked_groups_meet_few_of_their_members(spark, monkeypatch):
    """Copies by themselves beside a large group, each linked to most of it: one link is enough, so few pairs are compared."""
    monkeypatch.setattr(jaccard, "TRIES", 0)
    monkeypatch.setattr(jaccard, "SUBGROUP", 4)
    met, own = [], jaccard.verified
    monkeypatch.setattr(jaccard, "verified", lambda pairs, sets: (met.append(pairs.where("b < 240").count()), own(pairs, sets))[1])
    r = random.Random(9)
    body = [f"b{i}" for i in range(80)]

    def edited(k, name):
        w = list(body)
        for i in r.sample(range(80), k):
            w[i] = f"{name}_{i}"
        return " ".join(w)

    texts = [edited(1, f"m{i}") for i in range(240)] + [edited(1, f"q{i}") for i in range(60)]
    found = jaccard.shingle_sets(texts)
    rows = [(i, [int(x) for x in s.view("int64")], bytearray(jaccard.bitmap(s)), len(s)) for i, s in enumerate(found)]
    sets = spark.createDataFrame(rows, "node long, tokens array<long>, bits binary, n long")
    nodes = sets.select("node", "tokens", "n", "n").toDF("node", "tokens", "n", "m")
    shared = jaccard.shared_tokens(nodes)
    groups = spark.createDataFrame([(i, 0) for i in range(240)], "node long, comp long")
    links = jaccard.group_links(jaccard.prefixes(shared, nodes, whole=True), shared, groups, sets.select("node", "tokens", "bits")).collect()
    assert all(jaccard.linked(found[a], found[b]) for a, b in links)
    want = {q for q in range(240, 300) if any(jaccard.linked(found[q], found[m]) for m in range(240))}
    assert {a for a, b in links if b < 240} == want
    assert len(want) == 60
    assert sum(met) <= 60 * 2 * jaccard.FIRST * jaccard.SUBGROUP  # of 60 * 240

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from glosslake.llm import lexical, packing, registry, toxicity, vector_codes
from glosslake.llm.words import TERM, words_of
from tests.test_entry import same_rows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_vector_codes", "op12_lexical_topk"])
def test_against_duckdb(spark, name):
    same_rows(spark, name, registry.queries()[name], registry.oracle_sql()[name])


def brute_codes(rows, parts, entries, rounds, scale):
    """Lloyd's rounds from scratch, one list at a time."""
    kept = [(k, lab, [math.floor(scale * x) for x in v]) for k, lab, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0], r[2]))
    size = next((len(v) for _, _, v in kept if len(v) % parts == 0), 0)
    kept = [r for r in kept if len(r[2]) == size]
    w = size // parts
    piece = lambda v, j: v[j * w : (j + 1) * w]
    books = [[piece(v, j) for _, _, v in kept[:entries]] for j in range(parts)]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda p, book: min(range(len(book)), key=lambda i: (gap(p, book[i]), i))
    for _ in range(rounds):
        for j in range(parts):
            own = defaultdict(list)
            for _, _, v in kept:
                own[near(piece(v, j), books[j])].append(piece(v, j))
            books[j] = [[sum(c) // len(own[i]) for c in zip(*own[i], strict=True)] if own[i] else e for i, e in enumerate(books[j])]
    out, by_label = [], Counter()
    for k, lab, v in kept:
        codes = [near(piece(v, j), books[j]) for j in range(parts)]
        error = sum(gap(piece(v, j), books[j][c]) for j, c in enumerate(codes))
        by_label[lab] += error
        out.append((k, lab, "".join(f"{c:02x}" for c in codes), error))
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted((str((k, c, e, by_label[lab])) for k, lab, c, e in out)), digest


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_vector_codes_against_brute_force(spark, seed):
    r = random.Random(seed)
    vector = lambda: [r.choice([r.uniform(-1, 1), 0.25, -0.25]) for _ in range(8)]
    rows = [(i // 2 if i > 30 else i, r.choice([None, 1, 1, 2]), vector()) for i in range(90)]
    rows += [rows[7], rows[7], (None, 1, vector()), (500, 1, None), (501, 1, []), (502, 1, [0.1] * 7), (503, 1, [float("nan")] * 8), (504, 1, [None] + [0.5] * 7), (505, 2, [float("inf")] * 8), (-1, 2, [0.5] * 6)]
    df = spark.createDataFrame([(*x, "clash") for x in rows], "vec_id long, label int, embedding array<double>, code string")
    got, books = vector_codes.trained(df, parts=4, entries=5, rounds=4, scale=64)
    codes = vector_codes.with_label_error(got).select("vec_id", vector_codes.hex_code(got["codes"]).alias("code"), "error", "label_error").collect()
    want, digest = brute_codes(rows, 4, 5, 4, 64)
    assert sorted(str(tuple(x)) for x in codes) == want and vector_codes.books_digest(books) == digest
    back = vector_codes.decoded(got, books, 64).selectExpr("aggregate(zip_with(v, approximation, (a, b) -> pow(a - b * 64, 2)), 0D, (s, x) -> s + x) AS e", "error").collect()
    assert all(round(x["e"]) == x["error"] for x in back)


def test_vector_codes_of_few_and_no_rows(spark, monkeypatch):
    shape = "vec_id long, label int, embedding array<float>"
    assert vector_codes.trained(spark.createDataFrame([(1, 1, None)], shape))[0] is None
    got, books = vector_codes.trained(spark.createDataFrame([(2, None, [1.0] * 8), (1, None, [0.5] * 8)], shape))
    assert books.shape == (8, 2, 1) and {x["vec_id"]: (x["codes"], x["error"]) for x in got.collect()} == {1: ([0] * 8, 0), 2: ([1] * 8, 0)}
    monkeypatch.setattr(vector_codes, "BROADCAST_BYTES", 0)  # too many labels to broadcast: salted
    assert [x["label_error"] for x in vector_codes.with_label_error(got).collect()] == [0, 0]
    with pytest.raises(Exception, match="too large"):
        vector_codes.trained(spark.createDataFrame([(2, None, [1e9] * 8)], shape))


def test_only_changes_are_summed(spark):
    """Sums kept from round to round equal sums from scratch."""
    rows = spark.createDataFrame([([1, 2, 3, 4], [0, 0], [1, 0]), ([5, 6, 7, 8], None, [1, 1])], "v array<int>, before array<tinyint>, codes array<tinyint>")
    got = sorted(tuple(x) for x in vector_codes.changes(rows, 2, 2).collect())
    assert got == [(0, 0, -1, -1, -2), (0, 1, 2, 6, 8), (1, 1, 1, 7, 8)]  # the part that stayed has no row


def brute_search(docs, items, k):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    own = [(d, terms(t)) for d, t in docs]
    own = [(d, Counter(t), len(t)) for d, t in own if t]
    n_docs, length = len(own), sum(n for _, _, n in own)
    df = Counter(t for _, c, _ in own for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c, n in own:
            m = 100 - 25 + (25 * n * n_docs) // length
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c)
            if s > 0:
                scores.append((-s, d is None, d or 0))
        out += [(item, i + 1, None if none else d, -s) for i, (s, none, d) in enumerate(sorted(scores)[:k])]
    return sorted(map(str, out))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_lexical_search_against_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(lexical, "FAN", 2 + seed)
    r = random.Random(seed)
    words = [f"w{int(r.paretovariate(0.7))}" for _ in range(400)] + ["É", "été", "A1", "ü"]
    text = lambda n: r.choice([" ", "-", "_"]).join(r.choice(words) for _ in range(n))
    docs = [(i // 2 if i > 400 else i, text(r.choice([1, 3, 30, 200]))) for i in range(500)] + [(None, text(5)), (None, text(5)), (900, None), (901, ""), (902, " .- "), (903, text(20_000))]
    docs += [docs[3], docs[3], docs[499]] + [(1000 + i, "same text w1 w2") for i in range(60)]
    items = [(i, text(r.choice([1, 4, 12]))) for i in range(25)] + [(3, "w1 W1 same"), (3, "w1 W1 same"), (None, "same"), (70, None), (71, ""), (72, "nowhereatall"), (73, "same text")]
    got = lexical.best_documents(spark.createDataFrame([(*d, 7) for d in docs], "doc_id long, text string, rank int").repartition(5), spark.createDataFrame([(*x, 7) for x in items], "item_id long, text string, score int"), 7, 200 if seed == 3 else 10**6)
    assert sorted(str(tuple(x)) for x in got.select("item_id", "rank", "doc_id", "score").collect()) == brute_search(docs, items, 7)


def test_lexical_search_of_empty_tables(spark):
    docs, items = "doc_id long, text string", "item_id long, text string"
    full = [(1, "a b")]
    for d, i in (([], full), (full, []), ([(1, None)], full), (full, [(1, "")])):
        got = lexical.best_documents(spark.createDataFrame(d, docs), spark.createDataFrame(i, items))
        assert got.columns == ["item_id", "rank", "doc_id", "score"] and got.count() == 0


def test_search_opens_less_than_everything():
    r = np.random.default_rng(3)
    n, terms = 5000, 40
    row = {"lengths": r.integers(50, 60, n), "first": np.arange(0, 3 * n + 1, 3), "terms": np.concatenate([np.sort(r.choice(terms, 3, replace=False)) for _ in range(n)]), "counts": r.integers(1, 3, 3 * n)}
    row["terms"][:60], row["counts"][:60] = np.tile([0, 1, 2], 20), 60  # twenty documents stand out
    tree = lexical.Tree(row, lexical.Statistics(n, int(row["lengths"].sum()), np.full(terms, 1000)), terms)
    opened = []
    tree.first = type("Counted", (np.ndarray,), {"__getitem__": lambda self, i: opened.append(i) or np.ndarray.__getitem__(self, i)})((len(tree.first),), np.int64, tree.first.tobytes())
    assert len(tree.search(np.arange(3), np.full(3, 1000), 5, 0)) >= 5 and len(opened) / 3 < 0.2 * n / lexical.FAN


def test_chain_against_all_taggings():
    r = np.random.default_rng(1)
    chain = toxicity.Chain(np.zeros(4), 0.0, np.array([0.3, -0.7, 1.1]))
    sizes = [1, 3, 7, 2]
    e = r.normal(0, 2, sum(sizes))
    first = np.zeros(len(e), bool)
    first[np.cumsum([0, *sizes[:-1]])] = True
    p, pair, share = chain.marginals(e, first)
    at = 0
    for n in sizes:
        own, z, seen, pairs = e[at : at + n], 0.0, np.zeros(n), np.zeros((n, 3))
        for tags in itertools.product([0, 1], repeat=n):
            steps = [(a, b) for a, b in zip((0, *tags), tags, strict=False)]
            w = math.exp(sum(x for x, t in zip(own, tags, strict=True) if t) + sum({(0, 0): 0.0, (0, 1): 0.3, (1, 0): -0.7, (1, 1): 1.1}[s] for s in steps))
            z += w
            seen += w * np.array(tags)
            for i, s in enumerate(steps):
                if s != (0, 0):
                    pairs[i, {(0, 1): 0, (1, 0): 1, (1, 1): 2}[s]] += w
        assert np.allclose(p[at : at + n], seen / z) and np.allclose(pair[at : at + n], pairs / z) and math.isclose(share[at : at + n].sum(), math.log(z))
        at += n


def test_marginals_across_blocks():
    """A long chain equals one that is gone through step by step."""
    r = np.random.default_rng(2)
    chain, n = toxicity.Chain(np.zeros(4), 0.0, np.array([-2.0, 0.5, 1.0])), 1000
    e, first = r.normal(0, 3, n), np.arange(n) % 333 == 0
    p, _, share = chain.marginals(e, first)
    a, total = np.array([1.0, 0.0]), []
    for x, f in zip(np.exp(e), first, strict=True):
        m = np.array([[1, np.exp(-2) * x], [np.exp(0.5), np.exp(1) * x]])
        a = (m[0] if f else a @ m)
        total.append(math.log(a.sum()))
        a = a / a.sum()
    assert np.allclose(share, total) and math.isclose(p[-1], a[1])


def toxic_rows(n, seed):
    r = random.Random(seed)
    plain = ["".join(r.choice(["la", "mo", "ti", "er", "un"]) for _ in range(r.randint(1, 4))) for _ in range(300)]
    bad = ["grimbo", "vexelta", "grimbolo", "vexeltane", "grimboti"]
    rows = []
    for i in range(n):
        words, toxic = [r.choice(plain) for _ in range(r.randint(5, 80))], i % 3 == 0
        if toxic:
            for _ in range(r.randint(1, 3)):
                words.insert(r.randint(0, len(words)), r.choice(bad))
        rows.append((i, " ".join(words).capitalize() + ".", int(toxic if r.random() > 0.03 else not toxic), toxic))
    return rows


def test_toxic_spans_are_found_and_clean_texts_left(spark):
    rows = toxic_rows(600, 4)
    docs = spark.createDataFrame([(i, t) for i, t, _, _ in rows if i % 2], "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([(i, y) for i, _, y, _ in rows], "doc_id long, toxic int"))
    texts = [t for i, t, _, _ in rows if i % 2 == 0] + ["Élan grimbo", None, "", "...", "la mo " * 400_000 + "vexelta grimbo " + "ti er " * 100]
    truth = [x for i, _, _, x in rows if i % 2 == 0]
    got = toxicity.score_toxicity(spark.createDataFrame([(i, t, 0.0) for i, t in enumerate(texts)], "doc_id long, text string, score double"), model, ["doc_id"]).orderBy("doc_id").collect()
    caught = [x["score"] >= toxicity.THRESHOLD for x in got]
    assert sum(a and b for a, b in zip(caught, truth, strict=False)) >= 0.95 * sum(truth) and sum(a and not b for a, b in zip(caught, truth, strict=False)) <= 0.02 * len(truth)
    for x, t in zip(got[: len(truth)], texts, strict=False):
        assert all(any(w.startswith(("grimbo", "vexelta")) for w in t[s["start"] : s["end"]].lower().split()) for s in x["spans"] if s["marginal"] > 0.9)
    tail = got[len(truth) :]
    assert [(s["start"], s["end"]) for s in tail[0]["spans"]] == [(5, 11)] and [x["spans"] for x in tail[1:4]] == [[], [], []]
    assert len({x["score"] for x in tail[1:4]}) == 1 and 0 <= tail[1]["score"] < toxicity.THRESHOLD
    assert texts[-1][tail[4]["spans"][-1]["start"] :].startswith(("vexelta", "grimbo"))


def test_slices_of_a_long_text(monkeypatch):
    texts = [t for _, t, _, _ in toxic_rows(60, 6)]
    model = toxicity.fit([t for _, t, _, _ in toxic_rows(300, 5)], [y for _, _, y, _ in toxic_rows(300, 5)])
    long = " ".join(texts)
    whole = model.score([long], True)
    monkeypatch.setattr(toxicity, "SLICE", 500)
    cut = model.score([long], True)
    assert [s[:2] for s in whole[1][0]] == [s[:2] for s in cut[1][0]] and abs(whole[0][0] - cut[0][0]) < 0.01
    assert "".join(p for _, p in toxicity._slices(long)) == long


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, "a b", "x"), (None, "a", "x"), (1, "a b", "x"), (4, None, "x")], "doc_id long, text string, toxic string")
    labels = spark.createDataFrame([(1, 0), (None, 1), (4, 1), (4, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, toxicity.training_labels(labels))  # only one label is left
    assert [x["score"] for x in toxicity.score_toxicity(docs, model, ["doc_id"]).collect()] == [0.0] * 4
    assert toxicity.score_toxicity(docs.limit(0), model, ["doc_id"]).count() == 0
    out = toxicity.op13_toxic_spans(spark, SF)
    assert out.columns == ["doc_id", "held_out", "score", "predicted", "spans"] and out.where("score < 0 or score > 1 or predicted <> cast(score >= 0.7 as int)").count() == 0


def test_prefix_hashes():
    words = words_of(["grimbo grim", "Grimbolo x"], TERM)
    p = words.prefixes(6)
    assert p[0] == p[2] != p[1] and words.prefixes(4)[1] == words.prefixes(8)[1] and len(p) == 4


def test_words_with_marks_behind_them_are_encoded_together():
    """Words of letters with marks behind them have the tokenizer's ids, and are not encoded one by one."""
    own = packing.Encoder(packing.vocabulary_path())
    calls, tokenizer = [], own.tokenizer

    class Counted:
        def encode_batch_fast(self, texts, **more):
            calls.append(len(texts))
            return tokenizer.encode_batch_fast(texts, **more)

        def encode(self, text, **more):
            return tokenizer.encode(text, **more)

    own.tokenizer = Counted()
    words = [f"{w}{m}" for w in ("apfel", "été", "xqzvk", "don", "слово", "漢字") for m in ("", "%%%", "!!", "$", "''", "&*&", "_", "-", ".!", '."', "'s", "!'s", "12", "%1", "\\]")]
    texts = [*words, " ".join(words), " ".join(reversed(words)), "%%% 's apfel%%% apfel 7% it's%"]
    want = [b"".join(i.to_bytes(4, "little") for i in tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]
    assert list(own.ids(texts)) == want
    calls.clear()
    list(own.ids([" ".join(f"neu{a}{b}###" for a in "abcdefgh" for b in "abcdefgh")]))
    assert sum(calls) == 1

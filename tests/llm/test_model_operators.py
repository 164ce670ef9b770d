from __future__ import annotations

import random
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from glosslake.llm import decontaminate, langid, main_text, packing
from glosslake.llm.dom import parse

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


def test_language_held_out(spark, docs):
    rows = langid.op2_language_id(spark, SF).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert {r["doc_id"] for r in held} == {r["doc_id"] for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0}
    assert sum(r["lang_pred"] == r["lang"] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_edges(spark, docs):
    model = langid.train(langid.training_rows(docs))
    rows = [(1, None, 1), (2, "", 2), (3, "123 ... !", 3), (None, "the of and", 4), (5, "ß" * 200000, 5), (5, "ß" * 200000, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score int")
    got = langid.identify(df, model, ["doc_id"]).collect()
    assert [(r["lang_pred"], r["score"]) for r in got[:3]] == [("und", 0.0)] * 3 and got[3]["lang_pred"] == "en" and got[4] == got[5]
    assert langid.in_known_language(df, model).count() == 3
    assert langid.in_known_language(df, model).columns == df.columns
    nothing = langid.train(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert {r["lang_pred"] for r in langid.identify(df, nothing, ["doc_id"]).collect()} == {"und"}
    assert langid.in_known_language(df, nothing).count() == 3
    # A text's score doesn't depend on the texts beside it, nor on block sizes.
    texts = [r["text"] for r in docs.limit(20).collect()]
    alone = [model.predict([t])[0][0] for t in texts]
    assert model.predict(texts)[0] == alone


def brute_language(train, text, bits):
    """Gram by gram, with dictionaries: language and probability."""
    import math

    def grams(t):
        kept, before = [], False
        for c in t.lower() + "\n":
            if c.isalpha() or before:
                kept.append(ord(c) if c.isalpha() else 32)
            before = c.isalpha()
        m, mix = 2**32, lambda h: (((h ^ h >> 15) * 0x2C1B3C6D) % 2**32) >> (32 - bits)
        for i, c in enumerate(kept):
            b, a = (kept[i - 1] if i else 32), (kept[i - 2] if i > 1 else 32)
            yield mix(c * 0x9E3779B1 % m)
            yield mix((c + b * 0x01000193 + 1) * 0x85EBCA6B % m)
            if i:
                yield mix((c + b * 0x01000193 + a * 0xC2B2AE35 + 2) * 0x27D4EB2F % m)

    counts, rows = {}, {}
    for t, lang in train:
        rows[lang] = rows.get(lang, 0) + 1
        own = counts.setdefault(lang, {})
        for g in grams(t or ""):
            own[g] = own.get(g, 0) + 1
    if not any(map(str.isalpha, text or "")):
        return "und", 0.0
    total = {x: sum(own.values()) + langid.ALPHA * 2**bits for x, own in counts.items()}
    score = {x: math.log(rows[x] / len(train)) + sum(math.log((own.get(g, 0) + langid.ALPHA) / total[x]) for g in grams(text)) for x, own in counts.items()}
    best = max(sorted(score), key=score.get)
    return best, 1 / sum(math.exp(v - score[best]) for v in score.values())


def test_language_scorer_against_brute_force(spark):
    r = random.Random(12)
    alphabets = {"x": "abcde ", "y": "cdefg ", "z": "aäöé g"}
    text = lambda lang: "".join(r.choice(alphabets[lang]) for _ in range(r.randint(0, 30)))
    train = [(t, lang) for lang in alphabets for t in (text(lang) for _ in range(15))]
    model = langid.train(spark.createDataFrame([(i, *x) for i, x in enumerate(train)], "doc_id long, text string, lang string"))
    texts = [text(lang) for lang in alphabets for _ in range(20)] + ["", None, "  1!", "a", "ab", "a  b", "É"]
    for t in texts:
        (lang,), (p,) = model.predict([t])
        want, score = brute_language(train, t, langid.BITS)
        assert lang == want and p == pytest.approx(score, abs=1e-3), t


def test_any_number_of_languages(spark):
    assert [langid.columns_for(n) for n in (0, 4, 512, 513, 8000)] == [15, 15, 15, 14, 11]
    rows = [(i, chr(0x4E00 + i) * 8, f"l{i:03d}") for i in range(600)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.weights.shape == (2**14 + 1, 600)
    assert sum(a == lang for a, (_, _, lang) in zip(model.predict([t for _, t, _ in rows])[0], rows, strict=True)) > 590


def test_contamination(spark):
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    items = [" ".join(word() for _ in range(n)) for n in (20, 40, 60, 5, 9)] + [None, ""]
    noise = lambda n: " ".join(word() for _ in range(n))
    w = items[1].split()
    swapped = " ".join("zz" if i % 6 == 5 else x for i, x in enumerate(w))
    inserted = " ".join(w[:18] + ["new", "words"] + w[18:])
    texts = [noise(100), f"{noise(30)} {items[0].upper()}\n{noise(30)}", swapped, inserted, " ".join(w[:12]), items[3], items[4], None, "", f"é {items[2]}", noise(5) + " " + " ".join(w[:25]), noise(30000) + " " + items[0]]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, item_id string")
    want = {(1, 0), (2, 1), (3, 1), (6, 4), (9, 2), (10, 1), (11, 0)}
    got = decontaminate.contamination(df, bench).collect()
    assert {(x["doc_id"], x["item_id"]) for x in got} == want
    assert all(texts[x["doc_id"]][x["start"] : x["end"]].split() for x in got)
    assert next(texts[9][x["start"] : x["end"]] for x in got if x["doc_id"] == 9) == items[2]
    # Blocks of the benchmark give the same rows.
    assert {(x["doc_id"], x["item_id"]) for x in decontaminate.contamination(df, bench, block_chars=200).collect()} == want
    clean = decontaminate.without_contaminated(df, bench)
    assert {x["doc_id"] for x in clean.collect()} == set(range(len(texts))) - {d for d, _ in want} and clean.columns == df.columns
    assert decontaminate.contamination(df, bench.limit(0)).count() == 0 and decontaminate.contamination(df.limit(0), bench).count() == 0


def test_quotes_of_long_items():
    item = [f"i{k}" for k in range(250)]
    matcher = decontaminate.Matcher([0], [" ".join(item)])
    noise = [f"n{k}" for k in range(40)]
    quotes = [item[60:160], item[:13], [*item[100:107], "x", *item[108:114]], item[:12], item[100:106]]
    texts = [" ".join([*noise, *q, *noise]) for q in quotes]
    got = matcher.hits(texts)
    assert got["text"].tolist() == [0, 1, 2] and got["n_matched"].tolist() == [100, 13, 13]
    assert [texts[t][a:b].split() for t, a, b in zip(got["text"], got["start"], got["end"], strict=True)] == quotes[:3]


def test_leaks_against_search(spark, docs):
    bench = pd.read_parquet(f"{SF}/benchmark.parquet")
    whole = {(d["doc_id"], i) for d in docs.collect() for i, t in zip(bench["item_id"], bench["text"], strict=True) if t in (d["text"] or "")}
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.op6_benchmark_leaks(spark, SF).collect()}
    assert whole <= got and len(got) <= len(whole) + 1


def test_plan_is_exact_and_tight():
    r = np.random.default_rng(3)
    better = 0
    for case in range(60):
        counts = np.zeros(101, np.int64)
        np.add.at(counts, r.integers(8, 70, r.integers(1, 40)), 1)
        plan, greedy = packing.bin_completion(counts, 100, 3000), packing.best_fit_decreasing(counts, 100)
        for p in (plan, greedy):
            used = np.zeros(101, np.int64)
            for filling, times in p:
                assert sum(filling) <= 100 and times > 0
                for x in filling:
                    used[x] += times
            assert (used == counts).all(), case
        n, m = (sum(t for _, t in p) for p in (plan, greedy))
        assert packing.lower_bound(counts, 100) <= n <= m
        better += n < m
    assert better
    # Optimal by exhaustion where that is feasible.
    for _ in range(25):
        items = sorted(r.integers(20, 80, 7).tolist(), reverse=True)
        counts = np.bincount(items, minlength=101)
        assert sum(t for _, t in packing.bin_completion(counts, 100)) == exhaustive(items, 100)


def exhaustive(items, capacity):
    best = len(items)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(items):
            best = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + items[i] <= capacity:
                go(i + 1, [*bins[:k], bins[k] + items[i], *bins[k + 1 :]])
        go(i + 1, [*bins, items[i]])

    go(0, [])
    return best


def test_encoder_matches_the_tokenizer(docs):
    own = packing.encoder(packing.vocabulary_path())
    texts = [r["text"] for r in docs.limit(60).collect()]
    texts += ["", "  ", "It's naïve İstanbul ΣΑΣ\tx\x1cy", "<|endoftext|>x", "é ́a", "12345 !!??", "don't.stop's, a._b ._ x,'s y'.s", "1.5,2. ..., a.b.c @x.y", "&&&."]
    assert all(np.frombuffer(b, "<u4").tolist() == own.tokenizer.encode(t, add_special_tokens=False).ids for t, b in zip(texts, own.ids(texts), strict=True))


def test_packing(spark, docs):
    extra = spark.createDataFrame([(None, None, 1), (None, "", 2), (7, "word " * 5000, 3), (7, "word " * 5000, 3)], "doc_id long, text string, length int")
    df = docs.select("doc_id", "text").withColumn("length", F.lit(0)).unionByName(extra)
    rows = packing.pack(df).toPandas()
    ends = rows.sort_values(["sequence_id", "offset"])
    assert (ends.groupby("sequence_id")["length"].cumsum() - ends["length"] == ends["offset"]).all()
    filled = ends.groupby("sequence_id")["length"].sum()
    assert filled.max() <= 2048 and len(filled) <= -(-filled.sum() // 2048) + 1
    tokenizer = packing.encoder(packing.vocabulary_path()).tokenizer
    want = []
    for r in df.collect():
        ids = np.array([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want.append((str(r["doc_id"]), k, at, len(part), zlib.crc32(part.tobytes())))
    got = [("None" if pd.isna(r.doc_id) else str(int(r.doc_id)), r.piece, r.start, r.length, r.ids_crc32) for r in rows.itertuples()]
    assert sorted(got) == sorted(want)
    assert packing.pack(df.limit(0)).count() == 0


def test_dom():
    tree = parse("<div class='A bC'><p>one &amp; <b>two<p>three<br>four<script>x<p></script><ul><li>a<li>b</ul>tail</div><!-- c --><td>5 < 6</td>")
    leaves = [(tree.text[i], tree.tag[tree.parent[i]]) for i in range(len(tree.text)) if tree.text[i]]
    assert leaves == [("one & two", "p"), ("three four", "p"), ("a", "li"), ("b", "li"), ("tail", "div"), ("5 < 6", "td")]
    assert tree.words[1] == ("a", "b", "c")
    for html in (None, "", "<", "<a", "</p>", "<p " + 'x="' * 50, "<div>" * 3000 + "deep", "text only"):
        parse(html)


@pytest.mark.parametrize("html,want", [
    ("<p>a</p><svg width='1' /><p>b</p><svg><text>x</text></svg><p>c</p>", "a b c"),
    ("<p>a</p><svg/><p>b</p>", "a b"),
    ("<p>a</p><svg><svg></svg><text>x</text></svg><p>b</p>", "a b"),
    ("<svg><p>a</p><svg><text>x</text></svg><p>b</p>", "a b"),
    *((f"<p>a</p><{name} id=x><p>b</p><{name}><p>c</p>", "a b c") for name in ("svg", "object", "noscript", "iframe", "template")),
    *((f"<p>a</p><{name} id=x><b>x</b></{name.upper()}><p>b</p>", "a b") for name in ("svg", "object", "noscript", "iframe", "template", "script", "style", "title")),
    ("<p>a</p><script>x<p>y", "a"),
    ("<p title=don't>One it's two</p><p>b</p>", "One it's two b"),
    ("<p title = 'a>b' x=\"c>d\" it's>One</p>", "One"),
    ("<p title='a>One</p><p>b</p>", "One b"),
    ('<p class="a"">Hello', "Hello"),
    ('<p>un "closed <a href="x>link</a> tail', 'un "closed link tail'),
    ('<p a="1>2" b=\'3>4\' c=5>One<br/>two', "One two"),
    ("<p>5 < 6 <", "5 < 6 <"),
    ("<![CDATA[x]]><p>a<![CDATA[>b", "ab"),
])
def test_dom_drops_raw_elements_and_tags_alone(html, want):
    assert " ".join(t for t in parse(html).text if t) == want


@pytest.mark.parametrize("piece", ['<a "', "<p ", '<a x="', '<a x=">" ', "<![CDATA[>", "<!-- ", "</b", "<b>", "<li><p>", '<a x="\'>', "<td><b>", "<svg>"])
def test_dom_is_linear(piece):
    import time

    began = time.process_time()
    parse(piece * (1_000_000 // len(piece)))
    assert time.process_time() - began < 30


def brute_marginals(model, tree):
    """By summing over all labellings."""
    from itertools import product

    n, total, content = len(tree.parent), 0.0, np.zeros(len(tree.parent))
    node = [sum((model.node[model.index[f]] for f in main_text.node_features(tree, i) if f in model.index), np.zeros(3)) for i in range(n)]
    for states in product(range(3), repeat=n):
        if any(s == 2 and tree.text[i] is not None for i, s in enumerate(states)):
            continue
        score = model.root[states[0]] + sum(node[i][s] for i, s in enumerate(states))
        score += sum(model.edge[int(tree.text[i] is not None)][states[tree.parent[i]], states[i]] for i in range(1, n))
        total += np.exp(score)
        content += np.exp(score) * (np.array(states) == 0)
    return content / total


def test_messages_are_exact():
    model = main_text.train(list(main_text.labelled_pages(20)), steps=10)
    trees = [parse(h) for h in ("<div><p>a b</p><nav>x</nav></div>y", "<article><p>One two.</p></article>", "", "z")]
    for tree, got in zip(trees, model.marginals(trees), strict=True):
        assert np.allclose(got, brute_marginals(model, tree), atol=1e-6)


def test_main_text_held_out(spark):
    model = main_text.default_model()
    pages = list(main_text.labelled_pages(150, seed=1234))
    df = spark.createDataFrame([(i, None, h, 0) for i, (h, _) in enumerate(pages)], "page_id long, url string, html string, text int")
    got = {r["page_id"]: r["text"] for r in main_text.extract(df, model).collect()}
    assert sum(got[i] == t for i, (_, t) in enumerate(pages)) >= 0.9 * len(pages)
    edges = spark.createDataFrame([(1, None, None), (2, "u", ""), (None, None, "<p>x")], "page_id long, url string, html string")
    assert [r["text"] for r in main_text.extract(edges, model).collect()][:2] == ["", ""]
    assert main_text.extract(edges.limit(0), model).count() == 0
    table = spark.createDataFrame(list(main_text.labelled_pages(30)), "html string, main_text string")
    assert main_text.model_from(table, 20).index


def test_queries_have_their_columns(spark):
    want = {
        "op1_": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"], "op2_": ["doc_id", "held_out", "lang_pred", "score"],
        "op3_": ["page_id", "host", "path", "rule", "verdict"], "op4_": ["doc_id", "n_shingles", "component_id"], "op5_": ["page_id", "url", "text", "n_chars"],
        "op7_": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"], "op8_": ["query_id", "rank", "vec_id", "score"],
        "op9_": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
    }
    queries = __spark_entry__.queries()
    for prefix, columns in want.items():
        (name,) = [q for q in queries if q.startswith(prefix)]
        assert queries[name](spark, SF).columns[: len(columns)] == columns

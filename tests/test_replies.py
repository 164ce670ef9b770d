from __future__ import annotations

from pyspark.sql import functions as F

from glosslake.functions import replies, text
from glosslake.operators import evaluate, lookup


def test_typed_fields_and_settings(spark):
    rows = [(0, '{"url":"a","findings":[{"x":1}]}'), (1, '{"url":null,"findings":{}}'), (2, "[1]"), (3, None), (4, "{bad")]
    df = spark.createDataFrame(rows, "n int, payload string")
    got = df.select("n", replies.pluck_string(F.col("payload"), "url", "-").alias("u"), F.size(replies.pluck_list(F.col("payload"), "findings")).alias("f")).orderBy("n").collect()
    assert [(r["u"], r["f"]) for r in got] == [("a", 1), ("-", 0), ("-", 0), ("-", 0), ("-", 0)]
    stored = spark.createDataFrame([("x", None), (None, 3)], "host string, port int")
    assert [tuple(r) for r in replies.with_defaults(stored, {"host": "h", "port": 1, "on": True}).collect()] == [("x", 1, True), ("h", 3, True)]


def test_status(spark):
    rows = [(None, None, "off"), (True, None, "loaded"), (False, "Model not loaded", "off"), (False, "Not wired", "off"), (False, "loading it", "loading"), (False, "Boom", "error"), (False, None, "error")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "n int, ok boolean, error string, want string")
    s = replies.model_status(F.col("ok"), F.col("error"))
    got = df.select("want", s.alias("s"), replies.status_text(s).alias("t")).orderBy("n").collect()
    assert all(r["s"]["status"] == r["want"] for r in got)
    assert got[1]["t"] == "status:   loaded\nmodelId:  multilingual\nuptime:   0.0 s" and got[5]["t"].endswith("error:    Boom") and got[0]["t"] == "status:   off"


def test_lookups_keep_nulls_and_first_ones(spark):
    state = spark.createDataFrame([(1, "u", None), (2, None, 5)], "tab int, url string, n int")
    asked = spark.createDataFrame([(1,), (2,), (3,), (None,)], "tab int")
    got = {r["tab"]: (r["url"], r["n"]) for r in lookup.state_or_default(asked, state, "tab", {"url": "", "n": 0}).collect()}
    assert got == {1: ("u", None), 2: (None, 5), 3: ("", 0), None: ("", 0)}
    findings = spark.createDataFrame([(1, 2, 0, 3, "b"), (1, 1, 0, 3, "a")], "page_id int, seq int, start int, end int, text string")
    places = spark.createDataFrame([(1, "0-3"), (1, "0-4"), (2, "0-3")], "page_id int, place string")
    assert {(r["page_id"], r["place"]): (r["ok"], r["copied"]) for r in lookup.at_place(findings, places).collect()} == {(1, "0-3"): (True, "a"), (1, "0-4"): (False, None), (2, "0-3"): (False, None)}
    settings = spark.createDataFrame([(1, True), (1, True), (2, False), (3, None)], "tab int, paused boolean")
    assert sorted(r["tab"] or 0 for r in lookup.active(asked, settings, "tab").collect()) == [0, 2, 3]


def test_report(spark):
    counts = spark.createDataFrame([("doi", 1, 1, 0, 2), ("pmid", 0, 0, 0, 0)], "pattern string, tp long, fp long, fn long, tn long")
    scores = evaluate.prf(counts)
    assert [r["line"] for r in evaluate.report_lines(scores).orderBy("pattern").collect()] == ["| `doi` | 1 | 1 | 0 | 2 | 0.50 | 1.00 | 0.67 |", "| `pmid` | 0 | 0 | 0 | 0 | 0.00 | 0.00 | 0.00 |"]
    lines = [r["line"] for r in evaluate.summary_lines(evaluate.macro_micro(scores), scores).orderBy("ord").collect()]
    assert lines == ["- Macro P/R/F1: 0.250 / 0.500 / **0.333**", "- Micro P/R/F1: 0.500 / 1.000 / 0.667", "- Patterns evaluated: 2"]
    none = scores.where("false")
    assert [r["line"] for r in evaluate.summary_lines(evaluate.macro_micro(none), none).collect()] == ["_no data_"]


def test_models(spark):
    assert [(r["id"], r["label"]) for r in replies.available_models(spark).collect()] == [("multilingual", "Multilingual (~25 MB)")]


def test_fixed_is_rounded_from_the_binary_value(spark):
    values = sorted({a / b for b in (1, 3, 7, 8, 16, 40, 80, 200, 400, 1000) for a in range(b + 1)} | {0.005, 0.015, 0.0005})
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = df.select(text.fixed(F.col("v"), 2).alias("two"), text.fixed(F.col("v"), 3).alias("three")).orderBy("i").collect()
    assert [tuple(r) for r in got] == [(f"{v:.2f}", f"{v:.3f}") for v in values]

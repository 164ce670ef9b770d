from __future__ import annotations

import pytest

import __spark_entry__
import corpus_pipeline
from glosslake.llm import registry
from tests.llm.test_jaccard import brute
from tests.test_entry import same_rows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_against_duckdb(spark, name):
    same_rows(spark, name, registry.queries()[name], registry.oracle_sql()[name], "/root/testdata/sf0.01")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        kept[name] = {r["doc_id"] for r in docs.select("doc_id").collect()}
        if name != "packing":
            assert docs.columns == columns
        if name == "jaccard_join":
            rows = [(r["doc_id"], r["text"]) for r in before.collect()]
            assert kept[name] == {c for _, _, c in brute(rows)}
        if name == "pii":
            assert not docs.where("text rlike '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+[.][A-Za-z0-9-]+'").count()
            assert not docs.where("n_chars <> length(text)").count()
    assert kept["packing"] == kept["pii"] == kept["decontamination"] < kept["jaccard_join"] <= kept["language_id"]
    assert len(kept["language_id"]) == 200
    got = {(r["doc_id"], r["piece"], r["ids_crc32"]) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == {(r["doc_id"], r["piece"], r["ids_crc32"]) for r in docs.collect()}
    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run


def test_stages_on_odd_rows(spark):
    rows = [(1, None, None, None, None, 1), (2, "", "en", None, 0, 2), (3, "the and of to in", "en", "s", 16, 3), (3, "the and of to in", "en", "s", 16, 3), (None, "mail a@b.co to us", "en", "s", 17, 4), (5, "the " * 30000, "en", "s", 120000, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, tokens int")
    for frame in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, frame, SF)
            assert out.columns == docs.columns, name
            frame = spark.createDataFrame(out.collect(), docs.schema)
        corpus_pipeline.STAGES[-1][1](spark, frame, SF).collect()

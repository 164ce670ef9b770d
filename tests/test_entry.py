from __future__ import annotations

import glob
import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__
from glosslake.plans import queries as page_queries

SF = "/root/testdata/sf0.001"


def same_rows(spark, name, query, sql, sf=SF):
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    got, want = query(spark, sf).toPandas(), con.sql(sql).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns and len(got) == len(want) > 0, name
    text = lambda df: df[columns].astype(str).sort_values(columns).reset_index(drop=True)
    assert text(got).equals(text(want)), name


@pytest.mark.parametrize("name", sorted(page_queries.oracle_sql()))
def test_query_against_duckdb(spark, name):
    same_rows(spark, name, page_queries.queries()[name], page_queries.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(page_queries.queries()) - set(page_queries.oracle_sql())))
def test_query_without_sql_has_rows(spark, name):
    assert page_queries.queries()[name](spark, SF).limit(1).count() == 1


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 24
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_without_the_training_data_operators(tmp_path):
    """The entry still gives the other queries where that subpackage is gone."""
    root = os.path.dirname(os.path.abspath(__spark_entry__.__file__))
    for pipeline in (True, False):
        copy = tmp_path / str(pipeline)
        shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", *([] if pipeline else ["corpus_pipeline.py"])))
        code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q) and len(q) > 50 and not any(n.startswith('op') and n[2].isdigit() or n == 'pipeline' for n in q)"
        subprocess.run([sys.executable, "-c", code], cwd=copy, env=os.environ | {"PYTHONPATH": str(copy)}, check=True, timeout=120)

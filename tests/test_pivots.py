from __future__ import annotations

import numpy as np
import pytest

from glosslake.operators import pivots, search


@pytest.mark.parametrize("seed", [1, 2])
def test_the_same_rows_as_brute_force(spark, seed):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(6, 8))
    rows = [(i, (centres[i % 6] + 0.2 * r.normal(size=8)).round(1).tolist()) for i in range(400)]
    rows += [(400 + i, rows[i][1]) for i in range(30)]  # ties
    rows += [(500, [0.0] * 8), (501, None), (502, [1.0, None] + [0.0] * 6), (503, [float("nan")] * 8), (504, [1.0] * 3), (-1, [0.0] * 8), (505, [])]
    index = spark.createDataFrame(rows, "ord long, vector array<double>").repartition(3)
    asked = [(i, rows[i * 7][1]) for i in range(40)] + [(90, [0.0] * 8), (91, [1.0, 2.0, 3.0]), (92, None), (93, (-centres[0]).tolist()), (94, [])]
    queries = spark.createDataFrame(asked, "query_id long, q array<double>")
    key = lambda df: sorted((x["query_id"], x["rank"], x["ord"], round(x["similarity"], 9)) for x in df.collect())
    want = key(search.find_similar_each(index, queries, 6))
    assert key(pivots.find_similar_indexed(index, queries, 6, n_pivots=9, tile=20)) == want
    assert key(pivots.find_similar_indexed(index, queries, 6, n_pivots=1)) == want


def test_few_and_no_vectors(spark):
    index = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "ord long, vector array<float>")
    queries = spark.createDataFrame([(7, [1.0, 1.0])], "query_id int, q array<float>")
    got = pivots.find_similar_indexed(index, queries, 5).orderBy("rank").collect()
    assert [(x["ord"], x["rank"]) for x in got] == [(1, 1), (2, 2)]
    assert pivots.find_similar_indexed(index.limit(0), queries).count() == 0 and pivots.find_similar_indexed(index, queries.limit(0)).count() == 0


def test_bounds_hold_and_cells_stay_closed(spark):
    r = np.random.default_rng(4)
    centres = r.normal(size=(30, 16))
    v = np.concatenate([c + 0.05 * r.normal(size=(100, 16)) for c in centres])
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "ord long, vector array<double>")
    known = pivots.build(rows, 40)
    cell = known.angles(v).argmin(axis=1)
    assert known.counts.tolist() == np.bincount(cell, minlength=40).tolist()
    q = v[::50] + 0.01
    least = known.bounds(q)
    angles = np.arccos(np.clip(pivots._unit(q) @ pivots._unit(v).T, -1, 1))
    for c in np.unique(cell):
        assert (least[:, c] <= angles[:, cell == c].min(axis=1) + 1e-9).all()
    queries = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(q)], "query_id long, q array<double>")
    own = pivots._asked(queries, known)
    first = search.find_similar_each(rows, queries, 5)
    assert pivots.opened(own, first, 5).count() < 0.2 * len(q) * 40


def test_queries_of_a_tile_pass_in_blocks(spark, monkeypatch):
    """However many queries open a cell, a task compares so many pairs at once."""
    r = np.random.default_rng(8)
    index = spark.createDataFrame([(i, r.normal(size=6).round(1).tolist()) for i in range(300)], "ord int, vector array<double>")
    queries = spark.createDataFrame([(f"q{i}", r.normal(size=6).round(1).tolist()) for i in range(500)], "query_id string, q array<double>")
    key = lambda df: sorted((x["query_id"], x["rank"], x["ord"], round(x["similarity"], 9)) for x in df.collect())
    most = spark.sparkContext.accumulator(0)
    best = pivots._best

    def counted(q, e, ords, k):
        if len(q) * len(e.rows) > 1000:
            most.add(1)
        return best(q, e, ords, k)

    monkeypatch.setattr(pivots, "PAIRS", 1000)
    monkeypatch.setattr(pivots, "_best", counted)
    got = key(pivots.find_similar_indexed(index, queries, 4, n_pivots=3))
    assert most.value == 0
    assert got == key(search.find_similar_each(index, queries, 4))

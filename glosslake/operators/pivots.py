"""An index of vectors by pivots: exact nearest vectors that open only the cells that may hold one.

Angles between vectors are a metric.  Some vectors are pivots; every vector is
in the cell of its nearest pivot, and of each cell the least and largest angle
to every pivot is known.  A query's own angles to the pivots bound its angle to
a whole cell from below (the triangle inequality).  Each query is answered in
its nearest cell first; the k-th best similarity that it finds there is
certain, and only cells that may hold a better or equal one are opened.

Both sides are dealt by cell, and large cells by tiles, so no task holds more
than ``TILE`` vectors of the index and one batch of queries, which meet in
``PAIRS`` pairs; queries don't pass through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.splits import bounded, spread
from .search import K, SLACK, Held, _best, find_similar_each

#: Pivots at most; angles and bounds of all cells are PIVOTS * PIVOTS numbers.
PIVOTS = 64
#: Vectors of a cell that one task compares.
TILE = 32768
#: Pairs of a query and a vector that a task compares at once: 8 bytes each, a few times over.
PAIRS = 4 << 20


def _finite(v: str) -> Column:
    return F.col(v).isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def _norm(v: str) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.sqrt((rows * rows).sum(axis=1, keepdims=True)), 1e-300)


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


class Pivots:
    """Unit pivots, and of each cell: its vectors, tiles, and least and largest angles to all pivots."""

    def __init__(self, pivots: np.ndarray, counts: np.ndarray, low: np.ndarray, high: np.ndarray, tile: int = TILE):
        self.pivots, self.counts, self.low, self.high = pivots, counts, low, high
        self.tiles = np.maximum(1, -(-counts // tile))

    def angles(self, rows: np.ndarray) -> np.ndarray:
        return np.arccos(np.clip(_unit(rows) @ self.pivots.T, -1, 1))

    def bounds(self, rows: np.ndarray) -> np.ndarray:
        """The least angle that a vector of each cell can have to each row; infinite for empty cells."""
        own = self.angles(rows)
        out = np.zeros((len(rows), len(self.counts)))
        for p in range(len(self.pivots)):
            out = np.maximum(out, np.maximum(own[:, p : p + 1] - self.high[None, :, p], self.low[None, :, p] - own[:, p : p + 1]))
        out[:, self.counts == 0] = np.inf
        return out


def build(rows: DataFrame, n_pivots: int = PIVOTS, tile: int = TILE) -> Pivots:
    """rows: ord, vector (array<double>, one length, no zero vector)."""
    chosen = rows.orderBy(F.xxhash64("ord"), "ord").limit(n_pivots).select("vector").collect()  # n_pivots rows
    pivots = _unit(np.array([r["vector"] for r in chosen], float))
    n = len(pivots)
    own = Pivots(pivots, np.zeros(n, np.int64), np.zeros((n, n)), np.zeros((n, n)))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, low, high = np.zeros(n, np.int64), np.full((n, n), np.inf), np.full((n, n), -np.inf)
        for batch in batches:
            if batch.num_rows:
                angles = own.angles(_matrix(batch.column("vector"), batch.num_rows))
                cell = angles.argmin(axis=1)
                counts += np.bincount(cell, minlength=n)
                np.minimum.at(low, cell, angles)
                np.maximum.at(high, cell, angles)
        held = np.flatnonzero(counts)
        cols = [pa.array(np.repeat(held, n), pa.int32()), pa.array(np.tile(np.arange(n), len(held)), pa.int32()), pa.array(np.repeat(counts[held], n)), pa.array(low[held].ravel()), pa.array(high[held].ravel())]
        yield pa.RecordBatch.from_arrays(cols, names=["cell", "pivot", "n", "low", "high"])

    parts = bounded(rows.select("vector")).mapInArrow(measure, "cell int, pivot int, n long, low double, high double")
    for r in parts.groupBy("cell", "pivot").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).collect():  # n * n rows
        own.counts[r["cell"]], own.low[r["cell"], r["pivot"]], own.high[r["cell"], r["pivot"]] = r["n"], r["low"], r["high"]
    return Pivots(pivots, own.counts, own.low, own.high, tile)


def _tiled(df: DataFrame, cell: str, index: Pivots, key: str | None) -> DataFrame:
    """df with ``tile``: the one of its key, or a row for each tile of the cell."""
    tiles = F.element_at(F.array(*(F.lit(int(t)) for t in index.tiles)), F.col(cell) + 1)
    return df.withColumn("tile", F.pmod(F.xxhash64(key), tiles).cast("int") if key else F.explode(F.sequence(F.lit(0), tiles - 1)))


def _cells(rows: DataFrame, index: Pivots) -> DataFrame:
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = index.angles(_matrix(batch.column("vector"), batch.num_rows)).argmin(axis=1) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32())], names=["ord", "vector", "cell"])

    kind = rows.schema["ord"].dataType.simpleString()
    return _tiled(bounded(rows.select("ord", "vector")).mapInArrow(assign, f"ord {kind}, vector array<double>, cell int"), "cell", index, "ord")


def _asked(queries: DataFrame, index: Pivots) -> DataFrame:
    """query_id, q, home, bounds (by cell)."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                b = index.bounds(_matrix(batch.column("q"), batch.num_rows))
                ends = pa.array(np.arange(0, b.size + 1, b.shape[1]), pa.int32())
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(b.argmin(axis=1), pa.int32()), pa.ListArray.from_arrays(ends, pa.array(b.ravel()))], names=["query_id", "q", "home", "bounds"])

    kind = queries.schema["query_id"].dataType.simpleString()
    return bounded(queries.select("query_id", "q")).mapInArrow(ask, f"query_id {kind}, q array<double>, home int, bounds array<double>")


def _met(index_rows: DataFrame, asked: DataFrame, index: Pivots, k: int) -> DataFrame:
    """query_id, ord, similarity: the k best of each cell and tile for the queries (query_id, q, cell, tile) that open it.

    A tile's vectors and then its queries are one sorted stream.  The vectors
    are held, the queries pass in batches and meet them ``PAIRS`` pairs at a
    time, however many queries open the tile.
    """
    ords, ids = index_rows.schema["ord"].dataType, asked.schema["query_id"].dataType
    left = index_rows.select("cell", "tile", F.lit(0).alias("kind"), "ord", F.lit(None).cast(ids).alias("query_id"), F.col("vector").alias("v"))
    right = asked.select("cell", "tile", F.lit(1).alias("kind"), F.lit(None).cast(ords).alias("ord"), "query_id", F.col("q").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, held = None, [], None
        for batch in batches:
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "tile", "kind")]
            cuts = np.flatnonzero(np.any([np.diff(c) for c in columns], axis=0)) + 1 if batch.num_rows > 1 else []
            for low, high in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                if low == high:
                    continue
                own, rows = batch.slice(low, high - low), high - low
                if (at := (columns[0][low], columns[1][low])) != key:
                    key, parts, held = at, [], None
                if not columns[2][low]:
                    parts.append((own.column("ord"), _matrix(own.column("v"), rows)))
                elif parts or held:
                    if held is None:
                        held = Held(np.concatenate([m for _, m in parts])), pa.concat_arrays([o for o, _ in parts])
                        parts = []
                    q, e = _matrix(own.column("v"), rows), held[0]
                    step = max(1, PAIRS // len(e.rows))
                    for first in range(0, rows, step):
                        row, place, similarity = _best(q[first : first + step], e, np.arange(len(e.rows)), k)
                        yield pa.RecordBatch.from_arrays(
                            [own.column("query_id").take(pa.array(first + row)), held[1].take(pa.array(place)), pa.array(similarity)], names=["query_id", "ord", "similarity"]
                        )

    # By number, because what a task has to do isn't told by its bytes.
    dealt = bounded(left.unionByName(right).repartition(int(index.tiles.sum()), "cell", "tile").sortWithinPartitions("cell", "tile", "kind", "ord"))
    return dealt.mapInArrow(run, f"query_id {ids.simpleString()}, ord {ords.simpleString()}, similarity double")


def opened(queries: DataFrame, first: DataFrame, k: int) -> DataFrame:
    """query_id, q, cell: the cells beside its home that a query must open; first: its k best so far."""
    certain = first.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("similarity")).alias("certain"))
    each = queries.join(certain, "query_id", "left").select("query_id", "q", "home", "certain", F.posexplode("bounds").alias("cell", "bound"))
    may = F.col("certain").isNull() | (F.cos("bound") + SLACK >= F.col("certain"))
    return each.where((F.col("cell") != F.col("home")) & (F.col("bound") < 10.0) & may).select("query_id", "q", "cell")


def _top(rows: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), "ord")
    return rows.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def find_similar_indexed(index: DataFrame, queries: DataFrame, k: int = K, n_pivots: int = PIVOTS, tile: int = TILE) -> DataFrame:
    """query_id, ord, similarity, rank: the same rows as ``find_similar_each``, by the pivots' bounds.

    index: ord, vector; queries: query_id (each once), q.  Vectors of another
    length than most of the index, and zero vectors, have similarity 0 to the
    others: as answers only the k smallest of them can count, and as queries
    they are compared one by one.
    """
    wide = lambda df, key, v, name: spread(df.select(F.col(key), F.col(v).cast("array<double>").alias(name))).where(_finite(name))
    rows, asked = wide(index, "ord", "vector", "vector"), wide(queries, "query_id", "q", "q")
    sizes = rows.where(_norm("vector") > 0).groupBy(F.size("vector").alias("n")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.col("c").desc(), "n").limit(1).collect()
    if not sizes:
        return find_similar_each(index, queries, k)
    usual = lambda v: (F.size(v) == sizes[0]["n"]) & (_norm(v) > 0)
    main, odd = rows.where(usual("vector")), rows.where(~usual("vector"))
    known = build(main, n_pivots, tile)
    cells, own = _cells(main, known), _asked(asked.where(usual("q")), known)
    zero = odd.orderBy("ord").limit(k).select("ord")
    ids = own.schema["query_id"].dataType.simpleString()
    apart = own.select("query_id").crossJoin(F.broadcast(zero)).select("query_id", "ord", F.lit(0.0).alias("similarity"))  # k rows for each query at most
    first = _top(_met(cells, _tiled(own.select("query_id", "q", F.col("home").alias("cell")), "cell", known, None), known, k).unionByName(apart), k).drop("rank")
    second = _met(cells, _tiled(opened(own, first, k), "cell", known, None), known, k)
    out = _top(first.unionByName(second), k)
    rest = asked.where(~usual("q"))
    if not rest.isEmpty():
        out = out.unionByName(find_similar_each(index, rest, k).select(*out.columns))
    return out.withColumn("query_id", F.col("query_id").cast(ids))

"""Nearest vectors by cosine similarity, and a pluggable embedder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.vectors import cosine, l2_normalize
from ..sources.splits import spread

K = 5
#: Queries that go out at once.
QUERIES = 1000
#: By how much a similarity from a matrix product may differ from the sum in order.
SLACK = 1e-9
#: Pairs whose sums are made together.
PAIRS = 1 << 16


def find_similar(index: DataFrame, query: list[float], k: int = K) -> DataFrame:
    """keyword, similarity of the k nearest; ties in the index's order.  A bounded heap on each partition."""
    q = F.lit([float(x) for x in query]).cast("array<double>")
    if k <= 0 or not query:
        return index.select("keyword", F.lit(0.0).alias("similarity")).limit(0)
    scored = index.select("ord", "keyword", cosine(F.col("vector"), q).alias("similarity"))
    return scored.orderBy(F.col("similarity").desc(), "ord").limit(k).select("keyword", "similarity")


def _matrices(vectors: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each length, the rows that have it and their matrix; vectors that are null or hold null, infinite or no numbers are left out."""
    out = {}
    lengths = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False)
    for n in np.unique(lengths[lengths >= 0]):
        rows = np.flatnonzero(lengths == n)
        flat = pc.list_flatten(vectors.take(pa.array(rows))).cast(pa.float64())
        m = flat.to_numpy(zero_copy_only=False).reshape(len(rows), int(n))
        good = np.isfinite(m).all(axis=1)
        out[int(n)] = rows[good], m[good]
    return out


def _in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of pairs of rows, added from the first component on: the same for equal rows wherever they are."""
    out = np.zeros(len(a))
    for d in range(a.shape[1]):
        out += a[:, d] * b[:, d]
    return out


class Held:
    """Rows that many queries meet, with what they need of them."""

    def __init__(self, rows: np.ndarray):
        self.rows, self.unit, self.norms = rows, _unit(rows), np.sqrt(_in_order(rows, rows))


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.sqrt((m * m).sum(axis=1, keepdims=True)), 1e-300)


def _best(q: np.ndarray, e: Held, ords: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """query row, ord, similarity of each query's k best rows of ``e``; a matrix product proposes, sums in order decide."""
    near = _unit(q) @ e.unit.T
    least = np.partition(near, -k, axis=1)[:, -k] if near.shape[1] > k else near.min(axis=1, initial=0)
    rows, cols = np.nonzero(near >= least[:, None] - SLACK)
    norms = np.sqrt(_in_order(q, q))[rows] * e.norms[cols]
    similarity = np.zeros(len(rows))
    for at in range(0, len(rows), PAIRS):
        part = slice(at, at + PAIRS)
        np.divide(_in_order(q[rows[part]], e.rows[cols[part]]), norms[part], out=similarity[part], where=norms[part] > 0)
    order = np.lexsort((ords[cols], -similarity, rows))
    rows, cols, similarity = rows[order], cols[order], similarity[order]
    first = np.r_[True, rows[1:] != rows[:-1]] if len(rows) else np.zeros(0, bool)
    place = np.arange(len(rows)) - np.maximum.accumulate(np.where(first, np.arange(len(rows)), 0))
    keep = place < k
    return rows[keep], ords[cols[keep]], similarity[keep]


def find_similar_each(index: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, ord, similarity for a stated set of queries (query_id, q), in blocks of about ``QUERIES``.

    index: ord, vector.  A block of queries goes to every task and meets each
    Arrow batch of the index in one matrix product; a batch gives its k best
    of each query, and those short lists are ranked.  Ties go to the smaller
    ord; vectors of another length, empty and zero vectors have similarity 0;
    vectors that are null or hold null or non-finite numbers take no part.
    """
    ords, ids = index.schema["ord"].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()
    parts = max(1, -(-queries.count() // QUERIES))
    rows = spread(index.select(F.col("ord"), F.col("vector").cast("array<double>").alias("vector")))
    out = None
    for p in range(parts):
        block = queries.select("query_id", F.col("q").cast("array<double>").alias("q")).where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == p).toArrow()
        own = _block_similar(rows, block.combine_chunks(), k, f"query_id {ids}, ord {ords}, similarity double")
        out = own if out is None else out.unionByName(own)
    by = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), "ord")
    return out.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def _block_similar(rows: DataFrame, block: pa.Table, k: int, shape: str) -> DataFrame:
    ids = block.column("query_id").combine_chunks()
    asked = _matrices(block.column("q").combine_chunks()) if block.num_rows else {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = np.arange(batch.num_rows)
            held = _matrices(batch.column("vector"))
            for n, (at, q) in asked.items():
                for m, (rows_of, e) in held.items():
                    if not len(q) or not len(e):
                        continue
                    # Of other lengths every similarity is 0: the first k by ord stand for the batch.
                    order = np.argsort(batch.column("ord").take(pa.array(rows_of)).to_numpy(zero_copy_only=False), kind="stable")
                    rows_of, e = rows_of[order], e[order]
                    if n == m and n > 0:
                        row, place, similarity = _best(q, Held(e), places[: len(e)], k)
                    else:
                        few = min(k, len(e))
                        row, place, similarity = np.repeat(np.arange(len(q)), few), np.tile(np.arange(few), len(q)), np.zeros(len(q) * few)
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(at[row])), batch.column("ord").take(pa.array(rows_of[place])), pa.array(similarity)], names=["query_id", "ord", "similarity"]
                    )

    return rows.mapInArrow(run, shape)


def mean_pool(tokens: DataFrame, key: str) -> DataFrame:
    """key, vector: the masked mean of token vectors (key, mask, v), of unit length."""
    each = tokens.select(key, "mask", F.posexplode("v").alias("i", "x"))
    mean = F.sum(F.col("x").cast("double") * F.col("mask")) / F.greatest(F.sum(F.col("mask").cast("double")), F.lit(1e-9))
    pooled = each.groupBy(key, "i").agg(mean.alias("m"))
    rows = pooled.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("_v"))
    return rows.select(key, l2_normalize(F.col("_v")).alias("vector"))


def embed(df: DataFrame, load: Callable[[], Callable[[list[str]], list[list[float]]]], text: str = "text", out: str = "vector") -> DataFrame:
    """df with a vector column; ``load`` runs once for each worker and gives the model."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            yield pd.Series(model(texts.fillna("").tolist()))

    return df.withColumn(out, run(F.col(text)))

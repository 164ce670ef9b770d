"""Exact top-k by inner product: tiled matrix products and a tree of merges.

Queries and candidates are dealt into tiles; each (candidate tile, query tile)
pair is one matrix product in numpy, of which only the k best candidates of a
query survive.  The short lists are then merged by a tree of bounded groups.

Defined cases: a vector that is null, is empty, or holds a null or non-finite
component takes no part; vectors of another length than the query's are not
compared with it; rows that repeat an id are separate candidates and separate
queries, each with ranks of its own, and only the query's own row is left out;
ties go to the smaller id; a score beyond 64 bits is the largest that fits; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

SCALE, K, QUERY_EVERY = 1024, 10, 100
#: Rows of a candidate tile and of a query tile: together about 25 MB at 64 dimensions.  Candidates are copied
#: once for each query tile, so one more query costs 1 / QUERY_TILE of the candidates' bytes in the shuffle.
TILE, QUERY_TILE = 32768, 16384
#: Lists that one merge step takes together.
FAN_IN = 16


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and v: floor(scale * x) of each component, usable vectors only; ``numbered`` makes them candidates and queries."""
    wide = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("e")).where(
        F.col("vec_id").isNotNull() & (F.size("e") > 0)
        & F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    )
    return wide.select("vec_id", F.transform("e", lambda x: F.floor(x * scale)).alias("v"))


def numbered(vectors: DataFrame) -> DataFrame:
    """vectors with ``row``, a number that tells its rows apart; a written table, so that the numbers stay."""
    return materialize(vectors.withColumn("row", F.monotonically_increasing_id()), "vectors")


def scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact integer products; floats only while every partial sum is an exact double."""
    bound = float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * rows.shape[1]
    if bound < 2**53:
        return (queries.astype(np.float64) @ rows.astype(np.float64).T).astype(np.int64)
    if bound < 2**63:
        return queries @ rows.T
    most = 2**63 - 1
    return np.clip(queries.astype(object) @ rows.T.astype(object), -most, most).astype(np.int64)


def best_of_tile(k: int):
    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for width, own in left.groupby(left["v"].map(len)):
            of = right[right["q"].map(len) == width]
            if not len(of):
                continue
            ids, numbers = own["vec_id"].to_numpy(), own["row"].to_numpy()
            rows = np.stack(own["v"].to_numpy()).astype(np.int64)
            for at in range(0, len(of), 256):
                s = scores(np.stack(of["q"].to_numpy()[at : at + 256]).astype(np.int64), rows)
                for q, row, line in zip(of["query_id"].to_numpy()[at : at + 256], of["q_row"].to_numpy()[at : at + 256], s, strict=True):
                    mine = numbers != row
                    line, names = (line, ids) if mine.all() else (line[mine], ids[mine])
                    if len(line) > k:
                        cut = np.partition(line, len(line) - k)[len(line) - k]
                        keep = np.flatnonzero(line >= cut)  # all ties of the last place
                        line, names = line[keep], names[keep]
                    order = np.lexsort((names, -line))[:k]
                    out.append((row, q, [{"s": -int(x), "vec_id": int(v)} for x, v in zip(line[order], names[order], strict=True)]))
        return pd.DataFrame(out, columns=["row", "query_id", "best"])

    return best


def merged(parts: DataFrame, k: int, lists: int, fan_in: int = FAN_IN) -> DataFrame:
    """Merge the lists of a query, ``fan_in`` at a time, until one is left.

    parts: row, query_id, tile, best (array of (-score, vec_id), sorted, k at
    most).  No group holds more than fan_in * k entries.
    """
    while lists > 1:
        lists = -(-lists // fan_in)
        parts = parts.groupBy("row", "query_id", F.floor(F.col("tile") / fan_in).alias("tile")).agg(
            F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k).alias("best")
        )
    return parts


def exact_topk(candidates: DataFrame, queries: DataFrame, k: int = K, tile: int = TILE, query_tile: int = QUERY_TILE) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k largest inner products for each query.

    candidates: row, vec_id, v; queries: row, query_id, v; v: arrays of long;
    row: a query leaves the candidate of its own row out.
    """
    n, m = candidates.count(), queries.count()
    tiles, query_tiles = max(1, -(-n // tile)), max(1, -(-m // query_tile))
    spread = lambda key, parts: F.pmod(F.xxhash64(key, F.lit(7)), F.lit(parts))
    left = candidates.withColumn("tile", F.pmod(F.xxhash64("row"), F.lit(tiles)))
    left = left.withColumn("qt", F.explode(F.sequence(F.lit(0), F.lit(query_tiles - 1))))
    right = queries.select(F.col("row").alias("q_row"), "query_id", F.col("v").alias("q")).withColumn("qt", spread("q_row", query_tiles).cast("int"))
    right = right.withColumn("tile", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(tiles - 1).cast("long"))))
    best = (
        left.groupBy("tile", "qt").cogroup(right.groupBy("tile", "qt"))
        .applyInPandas(tile_lists(k), "row long, query_id long, tile long, best array<struct<s:long,vec_id:long>>")
    )
    out = merged(best, k, tiles)
    return out.select("query_id", F.posexplode("best")).select(
        "query_id", (F.col("pos") + 1).alias("rank"), F.col("col.vec_id").alias("vec_id"), (-F.col("col.s")).alias("score")
    )


def tile_lists(k: int):
    best = best_of_tile(k)

    def lists(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return best(left, right).assign(tile=int(key[0]))[["row", "query_id", "tile", "best"]]

    return lists


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = numbered(quantised(table(spark, sf_dir, "embeddings")))
    queries = rows.where(F.col("vec_id") % QUERY_EVERY == 0).withColumnRenamed("vec_id", "query_id")
    return exact_topk(rows, queries)


OP8_SQL = f"""
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON c.r <> q.r AND len(c.v) = len(q.v) WHERE q.vec_id % {QUERY_EVERY} = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= {K}
"""

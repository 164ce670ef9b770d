"""Ranked lexical search: best-first branch-and-bound over max trees of document ranges.

Documents are read once.  Each Arrow batch becomes one *range*: a row with its
documents' ids and lengths and, for the query terms alone, their occurrences.
The index over a range is a tree for each term: its leaves are the documents'
impacts of the term, and each node above has the largest impact of its ``FAN``
children.  A query's bound at a node is the sum of its terms' weights times the
node's maxima; the search opens the node of the highest bound first, down to
documents, and stops where the highest bound that is left is below the score
that is already certain for the k-th place.  Nodes whose bound equals it are
opened, because of ties.

Two passes share the work between ranges, and neither shuffles the index.  The
first opens in every range the best nodes of each query, until k of its
documents are scored; the k-th best score of all of them is certain for the
query.  The second begins with that score, so that nodes without a chance, and
ranges whose root has none, are never opened.  Within a task the certain score
rises from range to range.

The queries (``item_id``, ``text``) go out in blocks of at most ``BLOCK_CHARS``
characters, so what is broadcast has a bound; statistics (documents, lengths,
document frequencies) are counted over all documents.

Defined cases: null and empty texts have no terms and are no documents; items
without a term, or whose terms occur nowhere, get no rows; repeated rows are
documents of their own with equal scores; repeated items are ranked one by one;
null doc_ids come last among equal scores; a null item_id is reported as null;
a very long text is a range by itself; empty tables give no rows; other columns
are not read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from .common import discard, map_batches, materialize, table
from .words import TERM, chunks, words_of

K = 20
#: Children of a node of the tree.
FAN = 16
BLOCK_CHARS = 4_000_000
FILTER_BITS = 20
RANGE = "range long, ids array<{id}>, lengths array<int>, first array<int>, terms array<int>, counts array<int>"


@dataclass
class Queries:
    """A block of items: their distinct terms (hashes, ascending), and each item's terms with repeats."""

    ids: list
    terms: np.ndarray
    own: list[np.ndarray]  # for each item, indexes of ``terms``
    times: list[np.ndarray]  # how often

    @classmethod
    def of(cls, ids: list, texts: list[str | None]) -> Queries:
        words = words_of(texts, TERM)
        terms, which = np.unique(words.hashes, return_inverse=True)
        each = [np.unique(which[a:b], return_counts=True) for a, b in zip(words.first, words.first[1:], strict=False)]
        return cls(ids, terms, [e[0] for e in each], [e[1].astype(np.int64) for e in each])


def postings(docs: DataFrame, queries: Queries) -> DataFrame:
    """One row for each range: ``RANGE``.  Documents without a query term keep their lengths for the statistics."""
    sent = docs.sparkSession.sparkContext.broadcast(queries.terms)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        filled = np.zeros(1 << FILTER_BITS, bool)
        filled[known >> np.uint64(64 - FILTER_BITS)] = True
        for batch in batches:
            texts = batch.column("text").to_pylist()
            lengths, of, terms, counts = [], [], [], []
            for lo, hi in chunks(texts):
                words = words_of(texts[lo:hi], TERM)
                n = np.diff(words.first)
                lengths.append(n)
                maybe = np.flatnonzero(filled[words.hashes >> np.uint64(64 - FILTER_BITS)])
                h = words.hashes[maybe]
                at = np.minimum(np.searchsorted(known, h), max(0, len(known) - 1))
                hit = known[at] == h if len(known) else np.zeros(0, bool)
                doc = np.repeat(np.arange(hi - lo), n)[maybe[hit]]
                pair, times = np.unique(doc * len(known) + at[hit], return_counts=True)
                of.append(pair // max(1, len(known)) + lo)
                terms.append(pair % max(1, len(known)))
                counts.append(times)
            n, of = np.concatenate(lengths), np.concatenate(of)
            real = n > 0
            first = np.concatenate(([0], np.cumsum(np.bincount(of, minlength=len(n))[real])))
            cols = [batch.column("doc_id").filter(pa.array(real)), *(pa.array(x, pa.int32()) for x in (n[real], first, np.concatenate(terms), np.concatenate(counts)))]
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in cols], names=names)

    shape = StructType.fromDDL(RANGE.format(id=id_type))
    names = shape.fieldNames()[1:]
    rows = map_batches(docs.select("doc_id", "text"), scan, StructType(shape.fields[1:]))
    return rows.where(F.size("ids") > 0).select(F.monotonically_increasing_id().alias("range"), *names)


def _frequencies(ranges: DataFrame, n_terms: int) -> np.ndarray:
    """Documents that hold each term; counted in the tasks, summed by Spark."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_terms, np.int64)
        for batch in batches:
            total += np.bincount(batch.column("terms").flatten().to_numpy(), minlength=n_terms)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["term", "n"])

    rows = map_batches(ranges.select("terms"), count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()  # the block's terms at most
    df = np.zeros(n_terms, np.int64)
    df[rows["term"]] = rows["n"]
    return df


@dataclass
class Statistics:
    """What scores depend on besides a document: N, L and the weights of the block's terms."""

    docs: int
    length: int
    weights: np.ndarray

    def impacts(self, lengths: np.ndarray, counts: np.ndarray) -> np.ndarray:
        m = 100 - 25 + (25 * lengths * self.docs) // self.length
        return (1_000_000_000 * counts) // (1000 * counts + 12 * m)


class Tree:
    """The max trees of one range's terms: levels of (terms x nodes), from ranges of FAN documents up to the whole range."""

    def __init__(self, row: dict, stats: Statistics, terms: int):
        lengths, self.first = row["lengths"].astype(np.int64), row["first"]
        of = np.repeat(np.arange(len(lengths)), np.diff(self.first))
        self.terms, self.n = row["terms"], len(lengths)
        self.impact = stats.impacts(lengths[of], row["counts"].astype(np.int64))
        present, self.local = np.unique(self.terms, return_inverse=True)
        self.row_of = np.full(terms, len(present), np.int64)
        self.row_of[present] = np.arange(len(present))
        nodes = -(-self.n // FAN)
        level = np.zeros((len(present) + 1, nodes), np.int64)  # the last row is of terms that the range lacks
        np.maximum.at(level.reshape(-1), self.local * nodes + of // FAN, self.impact)
        self.levels = [level]
        while self.levels[-1].shape[1] > 1:
            below = self.levels[-1]
            self.levels.append(np.maximum.reduceat(below, np.arange(0, below.shape[1], FAN), axis=1))

    def search(self, own: np.ndarray, weights: np.ndarray, k: int, certain: int, enough: int | None = None) -> list[tuple[int, int]]:
        """(score, place) of documents whose score is above 0 and may be among the k best: best-first.

        certain: a score that the k-th place has at least.  enough: stop after
        so many documents, whatever is left.
        """
        rows = self.row_of[own]
        weight = np.zeros(len(self.levels[0]), np.int64)
        weight[rows] = weights
        weight[-1] = 0
        top = len(self.levels) - 1
        heap = [(-int((self.levels[top][rows, 0] * weights).sum()), top, 0)]
        best: list[int] = []  # the k best scores so far, smallest first
        out = []
        while heap and -heap[0][0] >= max(1, certain) and (enough is None or len(out) < enough):
            _, level, node = heapq.heappop(heap)
            if level:
                low, high = node * FAN, min((node + 1) * FAN, self.levels[level - 1].shape[1])
                bounds = weights @ self.levels[level - 1][rows, low:high]
                for child in np.flatnonzero(bounds >= max(1, certain)):
                    heapq.heappush(heap, (-int(bounds[child]), level - 1, low + int(child)))
                continue
            low, high = node * FAN, min((node + 1) * FAN, self.n)
            a, b = self.first[low], self.first[high]
            sums = np.concatenate(([0], np.cumsum(weight[self.local[a:b]] * self.impact[a:b])))
            scores = np.diff(sums[self.first[low : high + 1] - a])
            for doc in np.flatnonzero(scores >= max(1, certain)):
                score = int(scores[doc])
                out.append((score, low + int(doc)))
                heapq.heappush(best, score)
                if len(best) > k:
                    heapq.heappop(best)
            if len(best) == k:
                certain = max(certain, best[0])
        return [x for x in out if enough is not None or x[0] >= certain]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(len(batch)):
            row = {c: batch.column(c)[i].values.to_numpy() for c in ("lengths", "first", "terms", "counts")}
            yield row | {"range": batch.column("range")[i].as_py(), "ids": batch.column("ids")[i].values}


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query, numbered from 1; Spark cuts each task's rows to k before they are shuffled."""
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "range", "place")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def best_documents(docs: DataFrame, items: DataFrame, k: int = K, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the k best documents of each item."""
    item_type, id_type = items.schema["item_id"].dataType.simpleString(), docs.schema["doc_id"].dataType.simpleString()
    parts = [_block(docs, ids, texts, k, item_type) for ids, texts in _blocks(items, block_chars)]
    parts = [p for p in parts if p is not None]
    return reduce(DataFrame.unionByName, parts) if parts else docs.sparkSession.createDataFrame([], f"item_id {item_type}, rank int, doc_id {id_type}, score long")


def _blocks(items: DataFrame, chars: int) -> Iterator[tuple[list, list]]:
    """The items, in blocks of about ``chars`` characters."""
    own = items.select("item_id", "text").where(F.col("text").isNotNull())
    total = own.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = -(-total // chars)
    for part in range(parts):
        block = own if parts == 1 else own.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part)
        rows = block.collect()  # bounded by ``chars``
        yield [r["item_id"] for r in rows], [r["text"] for r in rows]


def _block(docs: DataFrame, ids: list, texts: list[str], k: int, item_type: str) -> DataFrame | None:
    spark = docs.sparkSession
    queries = Queries.of(ids, texts)
    ranges = materialize(postings(docs, queries), "ranges")
    whole = ranges.select(F.size("ids").alias("n"), F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("l"))
    total = whole.agg(F.sum("n").alias("n"), F.sum("l").alias("l")).first()
    if not total["n"] or not len(queries.terms):
        discard(ranges)
        return None
    df = _frequencies(ranges, len(queries.terms))
    weights = np.array([math.floor(1000 * math.log((2 * total["n"] + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    sent = spark.sparkContext.broadcast((queries.own, [weights[o] * t for o, t in zip(queries.own, queries.times, strict=True)], Statistics(total["n"], total["l"], weights), len(weights)))

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, weight, stats, n_terms = sent.value
        best: list[list[int]] = [[] for _ in own]
        for row in _rows(batches):
            tree = Tree(row, stats, n_terms)
            for q, scores in enumerate(best):
                found = tree.search(own[q], weight[q], k, scores[-1] if len(scores) == k else 0, enough=k)
                best[q] = sorted([*scores, *(s for s, _ in found)], reverse=True)[:k]
        for q, scores in enumerate(best):
            yield pa.RecordBatch.from_arrays([pa.array([q] * len(scores), pa.int32()), pa.array(scores, pa.int64())], names=["query", "score"])

    nth = Window.partitionBy("query").orderBy(F.col("score").desc())
    firsts = map_batches(ranges, seeds, "query int, score long").withColumn("n", F.row_number().over(nth)).where(F.col("n") == k)
    certain = np.zeros(len(queries.own), np.int64)
    for r in firsts.select("query", "score").collect():  # a row for each item of the block at most
        certain[r["query"]] = r["score"]
    id_type = docs.schema["doc_id"].dataType.simpleString()
    shape = f"query int, doc_id {id_type}, score long, range long, place int"

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, weight, stats, n_terms = sent.value
        best: list[list[int]] = [[] for _ in own]
        for row in _rows(batches):
            tree = Tree(row, stats, n_terms)
            query, score, place = [], [], []
            for q, scores in enumerate(best):
                found = tree.search(own[q], weight[q], k, max(int(certain[q]), scores[-1] if len(scores) == k else 0))
                best[q] = sorted([*scores, *(s for s, _ in found)], reverse=True)[:k]
                query += [q] * len(found)
                score += [s for s, _ in found]
                place += [p for _, p in found]
            cols = [pa.array(query, pa.int32()), row["ids"].take(pa.array(place, pa.int64())), pa.array(score, pa.int64()), pa.array(np.full(len(query), row["range"])), pa.array(place, pa.int32())]
            yield pa.RecordBatch.from_arrays(cols, names=["query", "doc_id", "score", "range", "place"])

    best = materialize(_ranked(map_batches(ranges, search, shape), k), "best")
    discard(ranges)
    names = spark.createDataFrame(list(enumerate(ids)), f"query int, item_id {item_type}")
    return best.join(F.broadcast(names), "query").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def op12_lexical_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP12_SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_TERMS.format(t="text")} AS ts FROM documents),
n AS (SELECT r, doc_id, len(ts) AS n FROM d WHERE len(ts) > 0),
g AS (SELECT count(*) AS N, CAST(sum(n) AS BIGINT) AS L FROM n),
q AS MATERIALIZED (SELECT row_number() OVER () AS i, item_id, {_TERMS.format(t="text")} AS ts FROM benchmark),
qt AS (SELECT i, t, count(*) AS times FROM (SELECT i, unnest(ts) AS t FROM q) GROUP BY ALL),
tf AS MATERIALIZED (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(ts) AS t FROM d) WHERE t IN (SELECT t FROM qt) GROUP BY ALL),
w AS (SELECT t, CAST(floor(1000 * ln((2 * any_value(N) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, g GROUP BY t),
x AS MATERIALIZED (SELECT tf.r, tf.t, w.w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n.n * g.N) // g.L))) AS s FROM tf JOIN w USING (t) JOIN n USING (r), g),
s AS (SELECT qt.i, x.r, CAST(sum(qt.times * x.s) AS BIGINT) AS score FROM qt JOIN x USING (t) GROUP BY ALL),
k AS (SELECT i, n.doc_id, score, row_number() OVER (PARTITION BY i ORDER BY score DESC, n.doc_id NULLS LAST) AS rank FROM s JOIN n USING (r) WHERE score > 0 QUALIFY rank <= {K})
SELECT q.item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM k JOIN q USING (i)
"""

"""Benchmark decontamination by spaced-seed hashing.

Fixed masks pick four of the words of a window and ignore the others, so a
seed still matches where ignored words were substituted.  The hashes of the
benchmark's windows are looked up for every window of every document; each hit
fixes a diagonal (document place minus item place), along which the whole item
is compared, once for each diagonal.  A document is contaminated by an item if
on one diagonal at least ``MIN_COVER`` of its words, and ``MIN_WORDS``, are
equal; or so many in all on several diagonals, counting *segments* alone; or if
one segment has ``RUN_WORDS`` equal words, whatever their share of the item.  A
segment has at least ``SEGMENT_WORDS`` equal words, each with enough others
around it, and no gap of more than ``GAP`` words.

The benchmark goes out in blocks of at most ``BLOCK_CHARS`` characters (all of
it at once where it is smaller), each applied to all documents, so what is
broadcast has a bound.  Documents need no shuffle.  Repeated words cost no more
than others: equal windows in a row are one entry, here and in the documents,
and two such rows give their diagonals at once.

Defined cases: null or empty texts match nothing; items of fewer than
``MIN_WORDS`` words are no evidence and match nothing; repeated documents are
each reported, repeated items too; a null item_id is reported as null; items
that share a passage are each reported for each document that holds enough of
it; empty tables give no rows; columns of other names are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import map_batches, table
from .words import Words, chunks, windows, words_of

MASKS = ["1111", "11011", "101011", "1100101", "10010011"]
MIN_WORDS = 8
MIN_COVER = 0.5
#: Words of one segment that are enough in an item of any length, and that make a segment at all.
RUN_WORDS, SEGMENT_WORDS = 13, 6
#: An equal word belongs to a segment if DENSE words are equal from REACH before it to REACH behind it.
REACH, DENSE, GAP = 4, 4, 4
BLOCK_CHARS = 32_000_000
FILTER_BITS = 20
#: Pairs of windows, and aligned words, that are handled at once.
AT_ONCE = 1 << 20


def _spans(low: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the ranges, and which number, of all numbers in the ranges from ``low`` on."""
    which = np.repeat(np.arange(len(low)), count)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + low[which]


def _parts(count: np.ndarray, most: int) -> Iterator[slice]:
    """Slices whose counts sum to about ``most``."""
    if len(count):
        edge = np.flatnonzero(np.diff(np.cumsum(count) // most)) + 1
        for low, high in zip([0, *edge], [*edge, len(count)], strict=True):
            yield slice(low, high)


def _rows_of_equals(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places and lengths of rows of equal windows at consecutive places."""
    first = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (at[1:] != at[:-1] + 1)))) if len(h) else np.zeros(0, np.int64)
    return first, np.diff(np.append(first, len(h)))


class Matcher:
    """The seeds of a block of items: for each mask, hashes of rows of equal windows, their first places and lengths."""

    def __init__(self, item_ids: list, texts: list[str | None]):
        words = words_of(texts)
        self.ids, self.first, self.hashes = item_ids, words.first, words.hashes
        self.lengths = np.diff(words.first)
        self.of = np.repeat(np.arange(len(texts)), self.lengths)
        self.need = np.maximum(MIN_WORDS, np.ceil(MIN_COVER * self.lengths)).astype(np.int64)
        self.masks = [([i for i, c in enumerate(m) if c == "1"], len(m)) for m in MASKS]
        self.tables = []
        for picked, span in self.masks:
            h = windows(words.hashes, picked, span)
            at = np.flatnonzero((self.of[: len(h)] == self.of[len(self.of) - len(h) :]) & (self.lengths[self.of[: len(h)]] >= MIN_WORDS)) if len(h) else np.zeros(0, np.int64)
            h = h[at]
            first, n = _rows_of_equals(h, at + self.of[at])  # rows end with their item
            order = np.argsort(h[first], kind="stable")
            filled = np.zeros(1 << FILTER_BITS, bool)
            filled[h >> np.uint64(64 - FILTER_BITS)] = True
            self.tables.append((h[first][order], at[first][order].astype(np.int32), n[order].astype(np.int32), filled))

    def _diagonals(self, words: Words, of: np.ndarray) -> np.ndarray:
        """(text, item, diagonal) of all seeds, each once; a diagonal is a document's word number minus the item's."""
        base = int(self.lengths.max(initial=0))
        wide = len(words.hashes) + base + 1
        keys = []
        for (picked, span), (known, place, n, filled) in zip(self.masks, self.tables, strict=True):
            h = windows(words.hashes, picked, span)
            maybe = np.flatnonzero(filled[h >> np.uint64(64 - FILTER_BITS)]) if len(known) else np.zeros(0, np.int64)
            maybe = maybe[of[maybe] == of[maybe + span - 1]]
            first, m = _rows_of_equals(h[maybe], maybe + of[maybe])
            p = maybe[first]
            low, high = np.searchsorted(known, h[p], "left"), np.searchsorted(known, h[p], "right")
            hit = high > low
            p, m, low, count = p[hit], m[hit], low[hit], (high - low)[hit]
            for part in _parts(count, AT_ONCE):
                which, entry = _spans(low[part], count[part])
                q, item = place[entry].astype(np.int64), self.of[place[entry]]
                own = q - self.first[item]
                begin = p[part][which] - own - (n[entry] - 1)  # a row of m windows and one of n meet on m + n - 1 diagonals
                many = m[part][which] + n[entry] - 1
                for some in _parts(many, AT_ONCE):
                    row, diagonal = _spans(begin[some], many[some])
                    text = of[p[part][which][some]]
                    keys.append(np.unique((text[row] * len(self.lengths) + item[some][row]) * wide + diagonal + base))
        key = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
        pair, diagonal = np.divmod(key, wide)
        return np.stack([*np.divmod(pair, len(self.lengths)), diagonal - base], axis=1)

    def hits(self, texts: list[str | None]) -> dict[str, np.ndarray]:
        """text (index), item (index), n_words, n_matched, start, end (code points) of each match."""
        words = words_of(texts)
        of = np.repeat(np.arange(len(texts)), np.diff(words.first))
        found: dict[tuple[int, int], list] = {}
        lines = self._diagonals(words, of)
        size = self.lengths[lines[:, 1]]
        for part in _parts(size, AT_ONCE):
            self._compared(words, lines[part], size[part], found)
        rows = []
        for (text, item), segments in found.items():
            covered = np.zeros(self.lengths[item], bool)
            for own, _, _ in segments:
                covered[own] = True
            n = int(covered.sum())
            if n >= self.need[item] or max(most for _, _, most in segments) >= RUN_WORDS:
                first = min(int(own[0]) + d for own, d, _ in segments)
                last = max(int(own[-1]) + d for own, d, _ in segments)
                begin = words.text[words.offsets[text] : words.starts[first]].decode("utf-8", "replace")
                middle = words.text[words.starts[first] : words.ends[last]].decode("utf-8", "replace")
                rows.append((text, item, len(covered), n, len(begin), len(begin) + len(middle)))
        table = np.array(rows, np.int64).reshape(-1, 6)
        return dict(zip(("text", "item", "n_words", "n_matched", "start", "end"), table.T, strict=True))

    def _compared(self, words: Words, lines: np.ndarray, size: np.ndarray, found: dict) -> None:
        """Adds to ``found`` each diagonal that counts: its equal words' places in the item, itself, the words of its best segment."""
        text, item, diagonal = lines.T
        line, own = _spans(np.zeros(len(size), np.int64), size)
        at = own + diagonal[line]
        inside = (at >= words.first[text[line]]) & (at < words.first[text[line] + 1])
        same = inside & (words.hashes[np.where(inside, at, 0)] == self.hashes[self.first[item[line]] + own])
        begin = np.cumsum(size) - size
        upto = np.concatenate(([0], np.cumsum(same)))
        total = upto[begin + size] - upto[begin]
        place = np.arange(len(line))
        around = upto[np.minimum(place + REACH + 1, (begin + size)[line])] - upto[np.maximum(place - REACH, begin[line])]
        dense = np.flatnonzero(same & (around >= DENSE))
        if not len(dense):
            return
        cut = np.flatnonzero(np.concatenate(([True], (np.diff(dense) > GAP + 1) | (line[dense[1:]] != line[dense[:-1]]))))
        n = np.diff(np.append(cut, len(dense)))
        best = np.zeros(len(size), np.int64)
        np.maximum.at(best, line[dense[cut]], n)
        in_segment = np.zeros(len(line), bool)
        in_segment[dense[np.repeat(n >= SEGMENT_WORDS, n)]] = True
        for k in np.flatnonzero((best >= SEGMENT_WORDS) | (total >= self.need[item])):
            part = slice(begin[k], begin[k] + size[k])
            counted = same[part] if total[k] >= self.need[item[k]] else in_segment[part]
            found.setdefault((int(text[k]), int(item[k])), []).append((np.flatnonzero(counted), int(diagonal[k]), int(best[k])))


def _blocks(benchmark: DataFrame, chars: int) -> Iterator[tuple[list, list]]:
    """The benchmark's rows, in blocks of about ``chars`` characters."""
    own = benchmark.select("item_id", "text").where(F.col("text").isNotNull())
    total = own.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = -(-total // chars)
    for k in range(parts):
        block = own if parts == 1 else own.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k)
        rows = block.collect()  # bounded by ``chars``
        yield [r["item_id"] for r in rows], [r["text"] for r in rows]


def contamination(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, item_id, n_words, n_matched, start, end: one row for each document and item."""
    id_type, item_type = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    shape = f"doc_id {id_type}, item_id {item_type}, n_words long, n_matched long, start long, end long"
    item_arrow = to_arrow_type(benchmark.schema["item_id"].dataType)
    found = []
    for ids, texts in _blocks(benchmark, block_chars):
        sent = docs.sparkSession.sparkContext.broadcast((ids, texts))

        def match(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(*sent.value)
            for batch in batches:
                rows = batch.column("text").to_pylist()
                for lo, hi in chunks(rows):
                    hit = matcher.hits(rows[lo:hi])
                    doc = batch.column("doc_id").take(pa.array(hit["text"] + lo))
                    item = pa.array([matcher.ids[i] for i in hit["item"]], item_arrow)
                    counts = [pa.array(hit[c]) for c in ("n_words", "n_matched", "start", "end")]
                    yield pa.RecordBatch.from_arrays([doc, item, *counts], names=["doc_id", "item_id", "n_words", "n_matched", "start", "end"])

        found.append(map_batches(docs.select("doc_id", "text"), match, shape))
    return reduce(DataFrame.unionByName, found) if found else docs.sparkSession.createDataFrame([], shape)


def without_contaminated(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of docs that no item contaminates; decided in place, without a join."""
    out = docs
    for ids, texts in _blocks(benchmark, block_chars):
        sent = docs.sparkSession.sparkContext.broadcast((ids, texts))

        def clean(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(*sent.value)
            for batch in batches:
                rows = batch.column("text").to_pylist()
                keep = np.ones(len(rows), bool)
                for lo, hi in chunks(rows):
                    keep[lo + matcher.hits(rows[lo:hi])["text"]] = False
                yield batch.filter(pa.array(keep))

        out = map_batches(out, clean, docs.schema)
    return out


def op6_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _sql() -> str:
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
    seeds = []
    for k, mask in enumerate(MASKS):
        key = " || ' ' || ".join(f"ws[i + {p + 1}]" for p, c in enumerate(mask) if c == "1")
        one = "SELECT {id}, i, {key} AS key FROM (SELECT {id}, ws, unnest(range(len(ws) - {span} + 1)) AS i FROM {t} WHERE len(ws) >= {least})"
        seeds.append(
            f"SELECT DISTINCT a.r, b.q, a.i - b.i AS diagonal FROM ({one.format(id='r', key=key, span=len(mask), t='d', least=len(mask))}) a"
            f" JOIN ({one.format(id='q', key=key, span=len(mask), t='b', least=max(MIN_WORDS, len(mask)))}) b ON a.key = b.key"
        )
    return rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, text, {words} AS ws FROM documents),
b AS MATERIALIZED (SELECT row_number() OVER () AS q, item_id, {words} AS ws FROM benchmark),
g AS (SELECT r, unnest(ws) AS w, unnest(string_split_regex(text, '[^\x20\x09-\x0D]+')[1:len(ws)]) AS gap, unnest(range(len(ws))) AS i FROM d WHERE len(ws) > 0),
p AS MATERIALIZED (SELECT r, i, CAST(sum(length(gap) + length(w)) OVER (PARTITION BY r ORDER BY i) AS BIGINT) AS e, length(w) AS n FROM g),
l AS MATERIALIZED (SELECT DISTINCT r, q, diagonal FROM ({" UNION ALL ".join(seeds)})),
a AS (SELECT r, q, diagonal, len(b.ws) AS n, j, j + diagonal >= 0 AND j + diagonal < len(d.ws) AND coalesce(d.ws[CAST(greatest(j + diagonal, 0) + 1 AS BIGINT)] = b.ws[j + 1], FALSE) AS same
  FROM (SELECT l.*, unnest(range(len(b.ws))) AS j FROM l JOIN b USING (q)) x JOIN d USING (r) JOIN b USING (q)),
f AS (SELECT *, sum(CAST(same AS INTEGER)) OVER (PARTITION BY r, q, diagonal) AS total, greatest({MIN_WORDS}, ceil({MIN_COVER} * n)) AS need,
  same AND sum(CAST(same AS INTEGER)) OVER (PARTITION BY r, q, diagonal ORDER BY j ROWS BETWEEN {REACH} PRECEDING AND {REACH} FOLLOWING) >= {DENSE} AS dense FROM a),
s AS (SELECT *, sum(CAST(new AS INTEGER)) OVER (PARTITION BY r, q, diagonal ORDER BY j) AS seg FROM (
  SELECT r, q, diagonal, j, coalesce(j - lag(j) OVER (PARTITION BY r, q, diagonal ORDER BY j) > {GAP + 1}, TRUE) AS new FROM f WHERE dense)),
z AS (SELECT r, q, diagonal, j, count(*) OVER (PARTITION BY r, q, diagonal, seg) AS m FROM s),
o AS (SELECT r, q, diagonal, max(m) AS best FROM z GROUP BY ALL),
c AS (SELECT f.r, f.q, f.diagonal, f.j, f.n, f.need, o.best FROM f JOIN o USING (r, q, diagonal) LEFT JOIN z ON z.r = f.r AND z.q = f.q AND z.diagonal = f.diagonal AND z.j = f.j
  WHERE f.same AND CASE WHEN f.total >= f.need THEN TRUE ELSE coalesce(z.m >= {SEGMENT_WORDS}, FALSE) END),
k AS (SELECT c.r, c.q, any_value(c.n) AS n_words, count(DISTINCT c.j) AS n_matched, max(best) AS best, any_value(need) AS need, min(p.e - p.n) AS s, max(p.e) AS e
  FROM c JOIN p ON p.r = c.r AND p.i = c.j + c.diagonal GROUP BY c.r, c.q)
SELECT d.doc_id, b.item_id, CAST(n_words AS BIGINT) AS n_words, n_matched, CAST(s AS BIGINT) AS "start", CAST(e AS BIGINT) AS "end" FROM k JOIN d USING (r) JOIN b USING (q) WHERE n_matched >= need OR best >= {RUN_WORDS}
"""


OP6_SQL = _sql()

"""A nesting tree over intervals: spans that cross are cut into pieces that don't.

Spans of a text are one sorted stream; a stack holds the open ones.  A span of
a lower rank is outside: where one begins inside an open span of a higher rank,
that one is closed there and goes on inside.  Of equal ranks, the one that
began first is outside, and the later one is cut at its end.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from ..sources.splits import bounded


class Piece(NamedTuple):
    span: int  # which of the spans
    part: int  # of that span, from 0
    start: int
    end: int
    depth: int
    parent: int | None  # number of the piece around it


def nest(spans: list[tuple[int, int, int]]) -> list[Piece]:
    """Pieces of (start, end, rank) spans, by start, outer ones first; empty spans have none."""
    heap = [(start, rank, -end, i) for i, (start, end, rank) in enumerate(spans) if start < end]
    heapq.heapify(heap)
    out: list[list] = []  # span, start, end, depth, parent
    stack: list[tuple[int, int, int]] = []  # end, rank, number of the piece
    while heap:
        start, rank, end, i = heapq.heappop(heap)
        end = -end
        while stack and stack[-1][0] <= start:
            stack.pop()
        while stack and stack[-1][1] > rank:
            until, other, number = stack.pop()
            heapq.heappush(heap, (start, other, -until, out[number][0]))
            out[number][2] = start  # empty if it began here
        if stack and stack[-1][0] < end:
            heapq.heappush(heap, (stack[-1][0], rank, -end, i))
            end = stack[-1][0]
        out.append([i, start, end, len(stack), stack[-1][2] if stack else None])
        stack.append((end, rank, len(out) - 1))
    number, parts, pieces = {}, Counter(), []
    for k, (i, start, end, depth, parent) in enumerate(out):
        if start < end:
            number[k] = len(pieces)
            pieces.append(Piece(i, parts[i], start, end, depth, None if parent is None else number[parent]))
            parts[i] += 1
    return pieces


def by_text(rows: DataFrame, keys: list[str], order: list[str], shape: str, fold) -> DataFrame:
    """Rows of one key after another through ``fold(rows) -> tuples``; one key's rows are held at a time.

    rows: keys, then whatever fold reads, sorted by ``order`` within a key;
    shape: what the tuples hold.
    """
    own = StructType([*rows.select(*keys).schema, *StructType.fromDDL(shape)])
    kinds = [to_arrow_type(f.dataType) for f in own]
    names, n = own.fieldNames(), len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, out = None, [], []

        def table() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], kind) for j, kind in enumerate(kinds)], names=names)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and row[:n] != key:
                    out += [(*key, *x) for x in fold(held)]
                    held = []
                key = row[:n]
                held.append(row[n:])
            if out:
                yield table()
                out = []
        if held:
            out = [(*key, *x) for x in fold(held)]
        yield table()

    return bounded(rows.repartition(*keys).sortWithinPartitions(*keys, *order)).mapInArrow(run, own)


def nested(spans: DataFrame, keys: list[str], start: str = "start", end: str = "end", rank: str = "rank", ident: str = "span") -> DataFrame:
    """keys, piece, span, part, start, end, depth, parent: the tree of each key's spans."""
    kind = spans.schema[ident].dataType.simpleString()

    def fold(rows: list[tuple]) -> Iterator[tuple]:
        for number, p in enumerate(nest([r[:3] for r in rows])):
            yield (number, rows[p.span][3], *p[1:])

    own = spans.select(*keys, start, end, rank, ident)
    return by_text(own, keys, [start, rank, ident], f"piece int, {ident} {kind}, part int, start int, end int, depth int, parent int", fold)

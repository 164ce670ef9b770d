"""Substring dedup by hashing parts of lines.

Every document is cut into units: a unit ends at a line feed, and inside a line
after a word whose last character is one of ``. ! ? , ; :``, because repeated
passages begin and end inside of lines.  A unit is normalised (ASCII lower
case, white space runs to one space, trimmed), its 128-bit digest is grouped
globally and the earliest occurrence is kept.  Later occurrences are removed
where they form a run of neighbouring repeated units of at least ``min_words``
words: 1 removes every one, a greater value leaves short common phrases of
clean documents.  Removed units keep their offsets in the original text (code
points, end exclusive).

The digests' first occurrences are pre-aggregated (a minimum), never collected;
only digests that occur twice or more are joined back, and only repeats go on
to the step that finds runs.

Defined cases: null, empty and blank texts have no units; white space between
units belongs to none; the earliest occurrence has the smallest doc_id, then
the first place in the order of reading, so of repeated rows, and of rows
without a doc_id (which rank last), exactly one keeps a unit; very long texts
are cut whole; an empty table gives no rows; other columns are not read.

``row`` numbers the rows in the order of reading.  The table is read twice, so
``docs`` must be read alike each time, as files are; write the result of a
shuffle first (``common.materialize``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import map_batches, materialize, table
from .words import chunks, mixed, words_of

#: Words of a run of repeated units from which the query reports it.
PASSAGE_WORDS = 30
#: Names of the row number and the cuts while a table is worked on, and what is white space.
ROW, SPANS, WHITE = "__row", "__spans", " \t\n\x0b\x0c\r"
_ENDS = np.zeros(256, bool)
_ENDS[np.frombuffer(b".!?,;:", np.uint8)] = True
_BASES = [np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)]


def cut(texts: list[str | None]) -> dict[str, np.ndarray]:
    """text (index), unit, start, end (code points), n_words, d1 and d2 of every unit, text by text."""
    words = words_of(texts)
    n = len(words.starts)
    if not n:
        return {c: np.zeros(0, np.int64) for c in ("text", "unit", "start", "end", "n_words", "d1", "d2")}
    raw = np.frombuffer(words.text, np.uint8)
    feeds = np.concatenate(([0], np.cumsum(raw == 10)))  # each text ends with one
    last = _ENDS[raw[words.ends - 1]]
    last[:-1] |= feeds[words.starts[1:]] > feeds[words.ends[:-1]]
    last[-1] = True
    final = np.flatnonzero(last)
    first = np.concatenate(([0], final[:-1] + 1))
    size = final - first + 1
    power = [np.cumprod(np.full(int(size.max()) + 1, b)) for b in _BASES]
    at = np.arange(n) - np.repeat(first, size)
    digests = [mixed(np.add.reduceat(words.hashes * p[at], first) + size.astype(np.uint64)).view(np.int64) for p in power]
    point = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))  # code points before a byte
    text = np.searchsorted(words.first, first, side="right") - 1
    unit = np.arange(len(first)) - np.searchsorted(text, text)
    origin = point[words.offsets[text]]
    return {
        "text": text, "unit": unit, "start": point[words.starts[first]] - origin, "end": point[words.ends[final]] - origin,
        "n_words": size, "d1": digests[0], "d2": digests[1],
    }


def units(docs: DataFrame, keep: list[str]) -> DataFrame:
    """row, doc_id, unit, d1, d2 and the columns ``keep`` (of start, end, n_words) of every unit."""
    kinds = {"unit": pa.int32(), "start": pa.int32(), "end": pa.int32(), "n_words": pa.int32(), "d1": pa.int64(), "d2": pa.int64()}
    names = ["unit", "d1", "d2", *keep]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for lo, hi in chunks(texts):
                found = cut(texts[lo:hi])
                of = pa.array(found["text"] + lo)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row").take(of), batch.column("doc_id").take(of), *(pa.array(found[c], kinds[c]) for c in names)],
                    names=["row", "doc_id", *names],
                )

    shape = ", ".join(f"{c} {'long' if kinds[c] == pa.int64() else 'int'}" for c in names)
    number = F.col(ROW) if ROW in docs.columns else F.monotonically_increasing_id()
    rows = docs.select(number.alias("row"), "doc_id", "text")
    return map_batches(rows, read, f"row long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, {shape}")


def repeated_units(docs: DataFrame, min_words: int = 1) -> DataFrame:
    """One row for each removed unit: row, doc_id, where it is, its run, and which occurrence stays."""
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row", "unit")
    first = units(docs, []).groupBy("d1", "d2").agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    # A table of its own: the join's two sides are then plain shuffles, and a digest that very many units share can be split.
    first = materialize(first, "first")
    repeats = units(docs, ["start", "end", "n_words"]).join(first, ["d1", "d2"]).where(F.col("first") != rank)
    by = Window.partitionBy("row")
    runs = repeats.withColumn("run", F.col("unit") - F.row_number().over(by.orderBy("unit")))
    long = runs.withColumn("run_words", F.sum("n_words").over(Window.partitionBy("row", "run"))).where(F.col("run_words") >= min_words)
    return long.select(
        "row", "doc_id", *(F.col(c).cast("long").alias(c) for c in ("unit", "start", "end", "n_words", "run", "run_words")),
        F.col("first.doc_id").alias("first_doc_id"), F.col("first.unit").cast("long").alias("first_unit"),
    )


def without_repeats(docs: DataFrame, min_words: int = 1) -> DataFrame:
    """docs with ``text`` cut at the repeated units; white space behind a cut run goes with it.

    The rows are numbered once, in a written table, so the cuts meet their rows
    however often docs would be read.
    """
    own = materialize(docs.withColumn(ROW, F.monotonically_increasing_id()), "numbered")
    runs = repeated_units(own, min_words).groupBy("row", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    spans = runs.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias(SPANS)).withColumnRenamed("row", ROW)
    names, kept = own.columns, docs.columns
    at = names.index("text")

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left = [_left(t, s) for t, s in zip(batch.column("text").to_pylist(), batch.column(SPANS).to_pylist(), strict=True)]
            columns = batch.columns
            columns[at] = pa.array(left, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names).select(kept)

    return map_batches(own.join(spans, ROW, "left").select(*names, SPANS), cut_out, docs.schema)


def _left(text: str | None, spans: list[dict] | None) -> str | None:
    """A text without its spans, which are in order and don't overlap."""
    if text is None or not spans:
        return text
    out, at = [], 0
    for s in spans:
        piece = text[at : s["start"]]
        out.append(piece.lstrip(WHITE) if at else piece)
        at = s["end"]
    return "".join([*out, text[at:].lstrip(WHITE)])


def op10_repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_units(table(spark, sf_dir, "documents"), PASSAGE_WORDS).drop("row", "run")


_S = r"\x20\x09-\x0D"
_UNIT = rf"[.!?,;:](?:[{_S}]|\z)|[^{_S}](?s:.*?)(?:[.!?,;:](?:[{_S}]|\z)|\n|\z)"
OP10_SQL = rf"""
WITH d AS (SELECT doc_id, text, row_number() OVER () AS r FROM documents WHERE text IS NOT NULL),
x AS (SELECT r, doc_id, regexp_extract_all(text, '{_UNIT}') AS ms, string_split_regex(text, '{_UNIT}') AS gs FROM d),
u AS (SELECT r, doc_id, unnest(ms) AS m, unnest(gs[1:len(ms)]) AS g, unnest(range(len(ms))) AS unit FROM x),
n AS (
  SELECT r, doc_id, unit, sum(length(g) + length(m)) OVER (PARTITION BY r ORDER BY unit) - length(m) AS start,
    regexp_replace(m, '[{_S}]+\z', '') AS shown,
    regexp_replace(translate(regexp_replace(m, '[{_S}]+\z', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[{_S}]+', ' ', 'g') AS norm FROM u),
seen AS (
  SELECT *, length(norm) - length(replace(norm, ' ', '')) + 1 AS n_words, row_number() OVER w AS place, first_value(doc_id) OVER w AS first_doc_id,
    first_value(unit) OVER w AS first_unit FROM n WINDOW w AS (PARTITION BY norm ORDER BY doc_id NULLS LAST, r, unit)),
runs AS (SELECT *, unit - row_number() OVER (PARTITION BY r ORDER BY unit) AS run FROM seen WHERE place > 1),
long AS (SELECT *, sum(n_words) OVER (PARTITION BY r, run) AS run_words FROM runs)
SELECT doc_id, CAST(unit AS BIGINT) AS unit, CAST(start AS BIGINT) AS "start", CAST(start + length(shown) AS BIGINT) AS "end",
  CAST(n_words AS BIGINT) AS n_words, CAST(run_words AS BIGINT) AS run_words, first_doc_id, CAST(first_unit AS BIGINT) AS first_unit
FROM long WHERE run_words >= {PASSAGE_WORDS}
"""

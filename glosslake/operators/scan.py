"""The pattern scan: candidates, text falsifiers, overlap resolution.

``candidates`` runs the catalog over whole texts in Arrow batches (one small
kernel: expressions compiled once for each worker); falsifiers that look at
the text are applied there, before overlaps are resolved.  Everything after it
is DataFrame work.  ``scan_one`` is the same for one pattern without
falsifiers, in Spark's own expressions.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import cache
from re import IGNORECASE, compile

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.catalog import WS, Catalog, Falsifier, Pattern, default_catalog, java_regex, python_regex
from ..functions.links import CONFIDENCE
from ..functions.text import BOUNDARY, sentences, trimmed
from ..sources.splits import bounded, spread
from .harvest import automaton, matches, possible, spots

#: How many characters before and after a match its falsifiers may look at.
REACH = 100
#: What is known of a match.
FOUND_ARROW = [
    ("ord", pa.int32()), ("pattern_id", pa.string()), ("category", pa.string()), ("label", pa.string()), ("text", pa.string()),
    ("start", pa.int32()), ("end", pa.int32()), ("original_length", pa.int32()), ("priority", pa.int32()),
]
FOUND_DDL = ", ".join(f"`{name}` {'int' if kind == pa.int32() else 'string'}" for name, kind in FOUND_ARROW)
#: Of the sentence that holds a finding whole: its number, its bounds, and those without white space at its ends.
SENTENCE = ("sent", "low", "high", "start", "end")
_TRIM = WS.replace(" - ", "".join(map(chr, range(0x2000, 0x200B))))


@cache
def _boundary():
    """What follows a sentence's end, looked for first because most stops fail it, and the whole boundary."""
    import regex

    return compile(rf"[.!?](?=[{WS}]*(?:\Z|[A-Z(\[\"'¿]))"), regex.compile(BOUNDARY.replace(r"\z", r"\Z"), regex.ASCII)


def sentence_ends(text: str) -> list[int]:
    """Where each sentence but the last ends."""
    may, whole = _boundary()
    return [m.end() for m in may.finditer(text) if m.group() != "." or whole.match(text, m.start())]


def sentence_bounds(text: str, start: int, end: int, ends: list[int] | None = None) -> tuple[int, int] | None:
    """Where the sentence begins and ends that holds the span whole; ``ends`` saves looking for them again."""
    ends = sentence_ends(text) if ends is None else ends
    at = bisect_right(ends, start)
    low, high = ends[at - 1] if at else 0, ends[at] if at < len(ends) else len(text)
    return (low, high) if end <= high else None


def sentence_around(text: str, start: int, end: int, ends: list[int] | None = None) -> str | None:
    """The sentence that holds the span whole."""
    held = sentence_bounds(text, start, end, ends)
    return None if held is None else text[slice(*held)]


class _WordPlaces:
    """Where the words of a context test are in one text: found once, in order, and looked up by bisection.

    A word never crosses a sentence's end, so a sentence holds one if the first
    that begins in it ends in it.
    """

    def __init__(self, words: tuple[str, ...]):
        self.rx = python_regex(r"(?<![a-z0-9])(?:" + "|".join(map(_quoted, words)) + r")(?![a-z0-9])")
        self.known = automaton({w: len(w) for w in words})
        self.text, self.starts, self.ends = None, [], []

    def inside(self, text: str, low: int, high: int) -> bool:
        if text is not self.text:
            lower, places = text.lower(), None
            if len(lower) != len(text):  # a few characters have longer lower cases
                lower, places = _lowered(text)
            found = [m.span() for m in matches(self.rx, lower, [(last + 1 - n,) * 2 for last, n in self.known.iter(lower)])]
            self.text = text
            self.starts = [s if places is None else places[s] for s, _ in found]
            self.ends = [e if places is None else places[e - 1] + 1 for _, e in found]
        i = bisect_left(self.starts, low)
        return i < len(self.starts) and self.ends[i] <= high


def _lowered(text: str) -> tuple[str, list[int]]:
    """The lower case, and the place in ``text`` of each of its characters."""
    parts = [c.lower() for c in text]
    return "".join(parts), [i for i, p in enumerate(parts) for _ in p]


class Kernel:
    """Compiled patterns with their text falsifiers; they run only where one automaton over a text says that a match may begin."""

    def __init__(self, patterns: list[Pattern]):
        self.patterns = [(k, p, python_regex(p.regex, p.flags), [self._test(f) for f in p.falsifiers if f.kind != "parent"]) for k, p in enumerate(patterns)]
        self._key = tuple((rx.pattern, bool(rx.flags & IGNORECASE)) for _, _, rx, _ in self.patterns)
        self._text, self._ends, self._held = None, [], {}

    def _look_at(self, text: str) -> None:
        """A text's boundaries are looked for once, and only if something asks for them."""
        if text is not self._text:
            self._text, self._ends, self._held = text, sentence_ends(text), {}

    def sentence(self, text: str, start: int, end: int) -> tuple[int, ...] | None:
        """``SENTENCE`` of the one that holds a span whole."""
        self._look_at(text)
        at = bisect_right(self._ends, start)
        if at not in self._held:
            low, high = sentence_bounds(text, start, start, self._ends)
            body = text[low:high].lstrip(_TRIM)
            first = high - len(body)
            self._held[at] = (at, low, high, first, first + len(body.rstrip(_TRIM)))
        return self._held[at] if end <= self._held[at][2] else None

    def _bounds(self, text: str, start: int, end: int) -> tuple[int, int] | None:
        self._look_at(text)
        return sentence_bounds(text, start, end, self._ends)

    def _test(self, f: Falsifier):
        if f.kind == "context":
            words = _WordPlaces(f.words)
            return lambda text, start, end: (held := self._bounds(text, start, end)) is not None and words.inside(text, *held)
        if f.kind == "confidence":
            return lambda text, start, end: CONFIDENCE["text"] < f.below
        if f.regex is None:
            tail = (f.text or "").lower()
            found = lambda s: s.lower().endswith(tail)
        else:
            rx = python_regex(f.regex)
            found = lambda s: bool(rx.search(s))
        if f.kind == "before":
            return lambda text, start, end: found(text[max(0, start - REACH) : start].rstrip(_TRIM))
        return lambda text, start, end: found(text[end : end + REACH].rstrip(_TRIM))

    def find(self, text: str) -> Iterator[tuple]:
        at = spots(text, self._key)
        may = possible(text, self._key) if at is None else -1
        for k, p, rx, tests in self.patterns:
            if not may >> k & 1 or at is not None and k not in at:
                continue
            for m in matches(rx, text, at[k]) if at and at[k] else rx.finditer(text):
                whole = m.group()
                captured = m.group(1) if rx.groups and m.group(1) is not None else whole
                if not whole:
                    continue
                start = m.start() + whole.index(captured)
                end = start + len(captured)
                if not any(test(text, start, end) for test in tests):
                    yield k, p.id, p.category, p.label, captured, start, end, len(whole), p.priority


def _quoted(word: str) -> str:
    return "".join(c if c.isalnum() or c == " " else f"\\{c}" for c in word)


def candidates(df: DataFrame, keys: list[str], text: str = "text", catalog: Catalog | None = None, sets: list[str] | None = None, category: str | None = None, sentences: bool = False) -> DataFrame:
    """keys and one row for each match that no text falsifier drops; null texts have none.

    sentences: with ``sentence`` as ``with_sentences`` gives it, found in the same pass over the text.
    """
    patterns = (catalog or default_catalog()).patterns(sets, category)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = Kernel(patterns)
        for batch in batches:
            rows, found, held = [], [], []
            for i, t in enumerate(batch.column("_text")):
                own = t.as_py() or ""
                for match in kernel.find(own):
                    rows.append(i)
                    found.append(match)
                    if sentences:
                        held.append(kernel.sentence(own, match[5], match[6]))
            own = batch.select(keys).take(pa.array(rows, pa.int64()))
            cols = [pa.array([f[j] for f in found], kind) for j, (_, kind) in enumerate(FOUND_ARROW)]
            if sentences:
                parts = [pa.array([h and h[j] for h in held], pa.int32()) for j in range(len(SENTENCE))]
                cols.append(pa.StructArray.from_arrays(parts, names=SENTENCE, mask=pa.array([h is None for h in held], pa.bool_())))
            yield pa.RecordBatch.from_arrays([*own.columns, *cols], names=[*keys, *(n for n, _ in FOUND_ARROW), *(["sentence"] if sentences else [])])

    rows = bounded(spread(df.select(*keys, F.col(text).alias("_text"))))
    more = [f"sentence struct<{', '.join(f'`{n}`: int' for n in SENTENCE)}>"] if sentences else []
    shape = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("_text").schema), FOUND_DDL, *more])
    return rows.mapInArrow(scan, shape)


def resolve_overlaps(found: DataFrame, keys: list[str]) -> DataFrame:
    """Greedy: by start, longest match, priority, registration; a row stays if it starts at the last kept end or later.

    Rows that overlap in a chain are put together by a running maximum of ends;
    a chain's first row always stays and chains don't touch, so the fold over
    one chain is short however long the text is.
    """
    order = [F.col("start"), F.col("original_length").desc(), F.col("priority").desc(), F.col("ord")]
    by = Window.partitionBy(*keys).orderBy(*order)
    before = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    marked = found.withColumn("_new", (F.col("start") >= F.coalesce(before, F.lit(0))).cast("int")).withColumn("_at", F.row_number().over(by))
    chained = marked.withColumn("_chain", F.sum("_new").over(by))
    rest = [c for c in found.columns if c not in keys]
    row = F.struct("_at", *rest)
    kept = lambda acc: F.struct(acc["cursor"].alias("cursor"), acc["rows"].alias("rows"))

    def step(acc: Column, x: Column) -> Column:
        taken = F.struct(x["end"].alias("cursor"), F.array_append(acc["rows"], x).alias("rows"))
        return F.when(x["start"] >= acc["cursor"], taken).otherwise(kept(acc))

    grouped = chained.groupBy(*keys, "_chain").agg(F.array_sort(F.collect_list(row)).alias("_rows"))
    start = F.struct(F.lit(0).alias("cursor"), F.slice("_rows", 1, 0).alias("rows"))
    folded = grouped.select(*keys, F.explode(F.aggregate("_rows", start, step, lambda acc: acc["rows"])).alias("_r"))
    return folded.select(*keys, *(F.col(f"_r.{c}").alias(c) for c in rest))


def scan_text(df: DataFrame, keys: list[str], text: str = "text", **catalog) -> DataFrame:
    """Findings of plain texts: source text, its confidence."""
    out = resolve_overlaps(candidates(df, keys, text, **catalog), keys)
    return out.withColumns({"source": F.lit("text"), "confidence": F.lit(CONFIDENCE["text"])})


def scan_one(df: DataFrame, key: str, pattern: Pattern, text: str = "text") -> DataFrame:
    """key, text, start, end of one pattern's matches, natively; for patterns without falsifiers.

    Matches and the gaps between them come from two expressions; offsets are
    running sums of their lengths.
    """
    if any(f.kind != "parent" for f in pattern.falsifiers):
        raise ValueError(f"{pattern.id} has falsifiers; use scan_text")
    rx = java_regex(pattern.regex, pattern.flags)
    group = 1 if python_regex(pattern.regex, pattern.flags).groups else 0
    hit = spread(df.select(key, text)).where(F.rlike(text, F.lit(rx))).select(F.col(key), F.monotonically_increasing_id().alias("_row"), F.col(text).alias("_text"))
    parts = F.arrays_zip(
        F.regexp_extract_all("_text", F.lit(rx), F.lit(0)).alias("m"), F.regexp_extract_all("_text", F.lit(rx), F.lit(group)).alias("c"),
        F.split("_text", rx, -1).alias("g"),
    )
    each = hit.select(key, "_row", F.posexplode(parts).alias("_i", "_p")).where("_p.m is not null").select(
        key, "_row", "_i", F.length("_p.g").alias("_gap"), F.length("_p.m").alias("_len"), F.col("_p.c").alias("text"),
        F.expr("locate(_p.c, _p.m)").alias("_in"),
    )
    upto = Window.partitionBy("_row").orderBy("_i")
    placed = each.withColumn("start", (F.sum(F.col("_gap") + F.col("_len")).over(upto) - F.col("_len") + F.col("_in") - 1).cast("int"))
    return placed.select(key, "text", "start", (F.col("start") + F.length("text")).cast("int").alias("end"))


def placed_sentences(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, sent, low, high, start, end of all sentences: with their white space, and without it at their ends."""
    each = df.select(*keys, F.posexplode(sentences(F.col(text))).alias("sent", "_s"))
    by = Window.partitionBy(*keys).orderBy("sent")
    lead = F.length("_s") - F.length(F.regexp_replace("_s", f"^[{WS}]+", ""))
    sized = each.select(*keys, "sent", F.length("_s").alias("_n"), lead.alias("_lead"), F.length(trimmed(F.col("_s"))).alias("_body"))
    placed = sized.withColumn("high", F.sum("_n").over(by).cast("int")).withColumn("low", (F.col("high") - F.col("_n")).cast("int"))
    return placed.select(*keys, "sent", "low", "high", (F.col("low") + F.col("_lead")).alias("start"), (F.col("low") + F.col("_lead") + F.col("_body")).alias("end"))


def with_sentences(findings: DataFrame, df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """findings with ``sentence``: sent, low, high, start, end of the one that holds the finding whole; null without one.

    Sentences and findings of a text are one sorted stream, each finding meets
    the last sentence that has begun: no condition on ranges, whatever the
    number of sentences.
    """
    held = F.struct("sent", "low", "high", "start", "end")
    own = placed_sentences(df, keys, text).select(*keys, F.col("low").alias("_at"), F.lit(0).alias("_kind"), held.alias("sentence"))
    rest = [c for c in findings.columns if c not in keys]
    row = F.struct(*rest)
    both = own.withColumn("_f", F.lit(None).cast(findings.select(row.alias("f")).schema["f"].dataType)).unionByName(
        findings.select(*keys, F.col("start").alias("_at"), F.lit(1).alias("_kind"), row.alias("_f")), allowMissingColumns=True
    )
    by = Window.partitionBy(*keys).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    met = both.withColumn("_last", F.last("sentence", ignorenulls=True).over(by)).where("_kind = 1")
    return met.select(*keys, "_f.*", F.when(F.col("_f.end") <= F.col("_last.high"), F.col("_last")).alias("sentence"))


def sentence_spans(df: DataFrame, keys: list[str], findings: DataFrame, text: str = "text") -> DataFrame:
    """keys, sent, start, end of the sentences that hold a finding, without white space at their ends.

    Findings that were scanned with their sentences need no second pass over the texts.
    """
    met = findings if "sentence" in findings.columns else with_sentences(findings.select(*keys, "start", "end"), df, keys, text)
    met = met.where("sentence is not null")
    return met.groupBy(*keys, F.col("sentence.sent").alias("sent")).agg(F.first("sentence.start").alias("start"), F.first("sentence.end").alias("end")).where("start < end")

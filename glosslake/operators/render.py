"""Marked-up text: sentences that hold a finding outside, findings inside."""

from __future__ import annotations

from collections.abc import Iterator
from html import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spans import by_text, nest

SENTENCE, KEYWORD = 1, 2


def escaped(x: Column) -> Column:
    for c, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        x = F.replace(x, F.lit(c), F.lit(name))
    return x


def render(texts: DataFrame, keys: list[str], findings: DataFrame, sentences: DataFrame | None = None, show_keywords: bool = True, text: str = "text") -> DataFrame:
    """keys, html: one string for each text with something to mark.

    Findings may cross sentences and each other: their pieces nest, sentences
    outside.  Where findings have a source, those of texts alone are marked.
    A text and its spans are one sorted stream, written out from left to right.
    Without ``sentences``, the findings' own are marked (``scan_text`` gives
    them), and the texts are scanned once.
    """
    none = lambda kind: F.lit(None).cast(kind)
    mark = lambda start, end: (F.col(start).alias("start"), F.col(end).alias("end"), F.lit(SENTENCE).alias("rank"), F.lit('<mark class="gl-sentence">').alias("tag"))
    tip = F.concat(F.lit('<span class="gl-highlight gl-highlight-'), F.col("category"), F.lit('" title="'), escaped(F.concat_ws(": ", "label", "text")), F.lit('">'))
    span = (F.col("start"), F.col("end"), F.lit(KEYWORD).alias("rank"), tip.alias("tag"))
    if sentences is None:
        each = [F.struct(*mark("sentence.start", "sentence.end"))]
        if show_keywords:
            each.append(F.when(F.col("source") == "text", F.struct(*span)) if "source" in findings.columns else F.struct(*span))
        spans = findings.select(*keys, none("string").alias("_text"), F.explode(F.array(*each)).alias("_s")).select(*keys, "_text", "_s.*").where("start < end")
    else:
        spans = sentences.select(*keys, none("string").alias("_text"), *mark("start", "end"))
        if show_keywords:
            own = findings.where("source = 'text'") if "source" in findings.columns else findings
            spans = spans.unionByName(own.select(*keys, none("string").alias("_text"), *span))
    whole = texts.select(*keys, F.col(text).alias("_text"), none("int").alias("start"), none("int").alias("end"), F.lit(0).alias("rank"), none("string").alias("tag"))
    return by_text(whole.unionByName(spans), keys, ["rank", "start", "end", "tag"], "html string", _written)


def _written(rows: list[tuple]) -> Iterator[tuple]:
    text, spans = rows[0][0], [r for r in rows if r[3]]
    if rows[0][3] or text is None or not spans:  # spans without a text, or a text without spans
        return
    spans = [r for r, before in zip(spans, [None, *spans], strict=False) if r[3] != SENTENCE or r != before]  # a sentence comes with each of its findings
    out, at, open_ = [], 0, []

    def upto(place: int) -> None:
        nonlocal at
        out.append(escape(text[at:place], quote=False).replace('"', "&quot;"))
        at = place

    for p in nest([r[1:4] for r in spans]):
        while len(open_) > p.depth:
            end, tag = open_.pop()
            upto(end)
            out.append(tag)
        upto(p.start)
        out.append(spans[p.span][4])
        open_.append((p.end, "</mark>" if spans[p.span][3] == SENTENCE else "</span>"))
    while open_:
        end, tag = open_.pop()
        upto(end)
        out.append(tag)
    upto(len(text))
    yield ("".join(out),)


def unwrapped(html: Column) -> Column:
    """The inverse of ``render`` for its own marks: tags away, characters back."""
    x = F.regexp_replace(html, r'</?(?:mark|span)(?: class="gl-[^>]*)?>', "")
    for c, name in (('"', "&quot;"), (">", "&gt;"), ("<", "&lt;"), ("&", "&amp;")):
        x = F.replace(x, F.lit(name), F.lit(c))
    return x

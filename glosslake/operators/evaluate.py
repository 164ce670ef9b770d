"""Precision, recall and F1 against labelled examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import fixed
from .scan import scan_text

GATE = 0.85
REPORT_HEAD = ("| Pattern | TP | FP | FN | TN | Precision | Recall | F1 |", "|---|---:|---:|---:|---:|---:|---:|---:|")


def outcomes(gold: DataFrame, findings: DataFrame) -> DataFrame:
    """Each example with its outcome: tp, fp, fn or tn, and the reason of a failure.

    gold: example, pattern, text, expect, expect_null; findings: example, pattern_id, text, start.
    The first finding of the example's pattern decides.
    """
    first = findings.groupBy("example", "pattern_id").agg(F.min_by("text", F.struct("start", "ord")).alias("got"))
    own = gold.join(first, (gold["example"] == first["example"]) & (gold["pattern"] == first["pattern_id"]), "left").select(gold["*"], "got")
    negative = F.col("expect").isNull() | F.coalesce("expect_null", F.lit(False))
    outcome = (
        F.when(negative & F.col("got").isNull(), "tn").when(negative, "fp")
        .when(F.col("got").isNull(), "fn").when(F.col("got") == F.col("expect"), "tp").otherwise("fp")
    )
    reason = F.when(negative & F.col("got").isNotNull(), "fp").when(~negative & F.col("got").isNull(), "fn").when(~negative & (F.col("got") != F.col("expect")), "fp-mismatch")
    return own.withColumn("outcome", outcome).withColumn("reason", reason)


def confusion(rows: DataFrame, by: str = "pattern") -> DataFrame:
    count = lambda o: F.sum((F.col("outcome") == o).cast("long")).alias(o)
    return rows.groupBy(by).agg(*map(count, ("tp", "fp", "fn", "tn")))


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))


def prf(counts: DataFrame) -> DataFrame:
    p, r = _ratio(F.col("tp"), F.col("tp") + F.col("fp")), _ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    out = counts.withColumn("precision", p).withColumn("recall", r)
    return out.withColumn("f1", F.coalesce(2 * F.col("precision") * F.col("recall") / F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0)), F.lit(0.0)))


def macro_micro(scores: DataFrame, gate: float = GATE) -> DataFrame:
    """Means of the patterns' ratios, ratios of the sums, and whether macro F1 reaches the gate."""
    sums = scores.agg(*(F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")), *(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))
    p, r = _ratio(F.col("tp"), F.col("tp") + F.col("fp")), _ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    out = sums.withColumn("micro_precision", p).withColumn("micro_recall", r)
    f1 = F.coalesce(2 * F.col("micro_precision") * F.col("micro_recall") / F.nullif(F.col("micro_precision") + F.col("micro_recall"), F.lit(0.0)), F.lit(0.0))
    return out.withColumn("micro_f1", f1).withColumn("passed", F.col("macro_f1") >= gate).drop("tp", "fp", "fn")


def failures(rows: DataFrame, each: int = 5) -> DataFrame:
    """The first failures of every pattern, in the examples' order."""
    at = F.row_number().over(Window.partitionBy("pattern").orderBy("example"))
    return rows.where("reason is not null").withColumn("place", at).where(F.col("place") <= each)


def report_lines(scores: DataFrame) -> DataFrame:
    """pattern, line: the rows of a metrics table in Markdown, without its head (``REPORT_HEAD``)."""
    two = lambda c: fixed(F.col(c), 2)
    cells = F.concat_ws(" | ", F.concat(F.lit("`"), "pattern", F.lit("`")), "tp", "fp", "fn", "tn", two("precision"), two("recall"), two("f1"))
    return scores.select("pattern", F.concat(F.lit("| "), cells, F.lit(" |")).alias("line"))


def summary_lines(totals: DataFrame, scores: DataFrame) -> DataFrame:
    """ord, line: the macro and micro ratios, and how many patterns were judged; no pattern, no data."""
    three = lambda a, mark="": F.concat(F.lit(mark), fixed(F.col(a), 3), F.lit(mark))
    row = lambda name, kind, mark="": F.concat(F.lit(f"- {name} P/R/F1: "), F.concat_ws(" / ", three(f"{kind}_precision"), three(f"{kind}_recall"), three(f"{kind}_f1", mark)))
    counted = totals.crossJoin(scores.agg(F.count(F.lit(1)).alias("n")))  # one row each
    lines = F.array(row("Macro", "macro", "**"), row("Micro", "micro"), F.concat(F.lit("- Patterns evaluated: "), F.col("n").cast("string")))
    return counted.select(F.posexplode(F.when(F.col("n") > 0, lines).otherwise(F.array(F.lit("_no data_")))).alias("ord", "line"))


def quoted(text: Column) -> Column:
    """A text as a literal in quotes, ``None`` for a null: control characters and backslashes escaped, the quote that needs no escape."""
    body = text
    for c, name in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        body = F.replace(body, F.lit(c), F.lit(name))
    double = F.contains(text, F.lit("'")) & ~F.contains(text, F.lit('"'))
    single = F.concat(F.lit("'"), F.replace(body, F.lit("'"), F.lit("\\'")), F.lit("'"))
    return F.coalesce(F.when(double, F.concat(F.lit('"'), body, F.lit('"'))).otherwise(single), F.lit("None"))


def failure_lines(rows: DataFrame, each: int = 5) -> DataFrame:
    """pattern, place, line: a heading for each pattern with failures (place 0), and its first ones."""
    first = failures(rows, each)
    sample = F.concat(F.lit("- **"), "reason", F.lit("**: text=`"), quoted(F.col("text")), F.lit("` expected=`"), quoted(F.col("expect")), F.lit("` got=`"), quoted(F.col("got")), F.lit("`"))
    heads = first.groupBy("pattern").agg(F.lit(0).alias("place")).select("pattern", "place", F.concat(F.lit("### `"), "pattern", F.lit("`")).alias("line"))
    return heads.unionByName(first.select("pattern", "place", sample.alias("line")))


def report_document(rows: DataFrame, title: str = "Gold set evaluation") -> DataFrame:
    """section, pattern, place, line: the whole report in Markdown, to be read in this order.

    rows: what ``outcomes`` gives.  Sections: title, metrics by pattern, totals,
    failure samples; a section without rows says so.
    """
    counts = confusion(rows)
    scores = prf(counts)
    fixed_lines = [(0, 0, f"# {title}"), (1, 0, "## Per-pattern metrics"), (1, 1, REPORT_HEAD[0]), (1, 2, REPORT_HEAD[1]), (2, 0, "## Totals"), (3, 0, "## Failure samples (first 5 per pattern)")]
    spark = rows.sparkSession
    heads = spark.createDataFrame([(s, "", p, line) for s, p, line in fixed_lines], "section int, pattern string, place int, line string")
    table = report_lines(scores).select(F.lit(1).alias("section"), "pattern", F.lit(3).alias("place"), "line")
    totals = summary_lines(macro_micro(scores), scores).select(F.lit(2).alias("section"), F.lit("").alias("pattern"), (F.col("ord") + 1).alias("place"), "line")
    samples = failure_lines(rows).select(F.lit(3).alias("section"), "pattern", "place", "line")
    none = rows.where("reason is not null").agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(F.lit(3).alias("section"), F.lit("").alias("pattern"), F.lit(1).alias("place"), F.lit("_none_").alias("line"))
    return heads.unionByName(table).unionByName(totals).unionByName(samples).unionByName(none)


def evaluate_gold(gold: DataFrame) -> DataFrame:
    """The scores of the scan on a gold set."""
    return prf(confusion(outcomes(gold, scan_text(gold, ["example"]))))

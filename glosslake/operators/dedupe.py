"""Groups of findings that name the same thing, and their counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.links import source_rank
from ..functions.text import normalised


def _ranked(findings: DataFrame, page: str, seq: str) -> DataFrame:
    keyed = findings.withColumn("norm_text", normalised(F.col("text")))
    score = F.coalesce(F.col("confidence"), F.lit(0.0)) * 1000 + source_rank(F.col("source"))
    by = Window.partitionBy(page, "category", "norm_text")
    return keyed.withColumn("_place", F.row_number().over(by.orderBy(score.desc(), seq)))


def dedupe(findings: DataFrame, page: str = "page_id", seq: str = "seq") -> DataFrame:
    """One row for each (page, category, normalised text), best source first.

    representative: the best finding; mentions: the others in rank order, at
    most as many as one page holds.  group_ord: by category, first start, first
    arrival.
    """
    ranked = _ranked(findings, page, seq)
    row = F.struct("_place", *[c for c in findings.columns if c != page])
    grouped = ranked.groupBy(page, "category", "norm_text").agg(
        F.array_sort(F.collect_list(row)).alias("_rows"), F.min("start").alias("first_start"), F.min(seq).alias("first_seq"), F.count(F.lit(1)).alias("mention_count")
    )
    order = Window.partitionBy(page).orderBy("category", "first_start", "first_seq")
    return grouped.select(
        page, "category", "norm_text", F.col("_rows")[0].dropFields("_place").alias("representative"), "mention_count",
        F.transform(F.slice("_rows", 2, F.greatest(F.size("_rows") - 1, F.lit(0))), lambda r: r.dropFields("_place")).alias("mentions"),
        "first_start", F.row_number().over(order).alias("group_ord"),
    )


def representatives(findings: DataFrame, page: str = "page_id", seq: str = "seq") -> DataFrame:
    """The best finding of each group, flat."""
    return _ranked(findings, page, seq).where("_place = 1").drop("_place")


def category_chips(findings: DataFrame, page: str = "page_id") -> DataFrame:
    """Groups for each page and category."""
    keyed = findings.select(page, "category", normalised(F.col("text")).alias("norm_text"))
    return keyed.distinct().groupBy(page, "category").agg(F.count(F.lit(1)).alias("n_groups"))


def unique_vs_mentions(findings: DataFrame, page: str = "page_id") -> DataFrame:
    """unique groups and all mentions of each page, and the label that a report shows."""
    keyed = findings.select(page, "category", normalised(F.col("text")).alias("norm_text"))
    groups = keyed.groupBy(page, "category", "norm_text").agg(F.count(F.lit(1)).alias("n"))
    out = groups.groupBy(page).agg(F.count(F.lit(1)).alias("n_unique"), F.sum("n").alias("n_mentions"))
    both = F.concat(F.lit("unique · "), F.col("n_mentions").cast("string"), F.lit(" mentions"))
    return out.withColumn("label", F.when(F.col("n_unique") < F.col("n_mentions"), both).otherwise("unique"))

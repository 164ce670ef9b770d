"""Batches, gold sets, vector indexes and the vault, as Spark sources and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .downloads import LEAST_BYTES, refusal
from .json_splits import SPLIT_BYTES, read_items, read_lines


def read_batch(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """item (ordinal), text of ``{"items": [{"text": ...}]}``; anything else is an error, a text that isn't a string is null."""
    items = read_items(spark, path, "items", split_bytes).select(F.col("ordinal").cast("int").alias("item"), F.try_parse_json("value").alias("v"))
    text = F.when(F.schema_of_variant(F.try_variant_get("v", "$.text", "variant")) == "STRING", F.try_variant_get("v", "$.text", "string"))
    return items.select("item", text.alias("text"))


def batch_results(items: DataFrame, findings: DataFrame) -> DataFrame:
    """item, findings: every item is there, also without findings; results keep the items' order."""
    found = findings.groupBy("item").agg(
        F.array_sort(F.collect_list(F.struct("start", "end", F.col("pattern_id").alias("patternId"), "category", "text"))).alias("_f")
    )
    shape = "array<struct<patternId:string,category:string,text:string,start:int,end:int>>"
    own = F.transform("_f", lambda x: F.struct(x["patternId"].alias("patternId"), x["category"].alias("category"), x["text"].alias("text"), x["start"].alias("start"), x["end"].alias("end")))
    return items.select("item").join(found, "item", "left").select("item", F.coalesce(own, F.array().cast(shape)).alias("findings"))


def results_json(results: DataFrame) -> DataFrame:
    """item, json: one line for each item."""
    return results.select("item", F.to_json(F.struct("findings")).alias("json"))


def read_gold(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """example, file, pattern, text, expect, expect_null of JSON lines, by file name and line; blank lines and ``#`` comments are left out."""
    lines = read_lines(spark, path, split_bytes)
    parsed = F.from_json("value", "pattern string, text string, expect string, expect_null boolean").alias("g")
    return lines.select(F.col("ordinal").alias("example"), "file", parsed).select("example", "file", "g.*")


def read_vectors(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """ord, keyword, vector of an index file ``{model, dimensions, items: [{keyword, vector}]}``."""
    items = read_items(spark, path, "items", split_bytes).select(F.col("ordinal").alias("ord"), F.from_json("value", "keyword string, vector array<float>").alias("i"))
    return items.select("ord", "i.*")


def read_papers(spark: SparkSession, root: str, category: str | None = None) -> DataFrame:
    """category, filename, path, size of the vault's papers, by path; contents are not read.  Without a folder there are none."""
    if not _exists(spark, f"{root}/papers"):
        return spark.createDataFrame([], "category string, filename string, path string, size long")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{root}/papers").select("path", F.col("length").alias("size"))
    inner = F.element_at(F.split("path", "/papers/", -1), -1)
    out = files.where("size > 0").select(F.element_at(F.split(inner, "/"), 1).alias("category"), F.element_at(F.split(inner, "/"), -1).alias("filename"), "path", "size")
    return (out.where(F.col("category") == category) if category else out).orderBy("path")


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def import_markdown(category: Column, pattern_id: Column, text: Column, url: Column, title: Column, by: str = "glosslake") -> Column:
    """A finding's note: a heading and a list."""
    line = lambda name, value: F.concat(F.lit(f"- {name}: "), F.coalesce(value, F.lit("")), F.lit("\n"))
    return F.concat(
        F.lit("# "), text, F.lit("\n\n"), line("category", category), line("pattern", pattern_id), line("source_url", url),
        line("source_title", title), line("imported_by", F.lit(by)),
    )


def pending_downloads(plan: DataFrame, papers: DataFrame) -> DataFrame:
    """The valid plans whose file isn't in the vault with more than ``LEAST_BYTES`` bytes."""
    there = papers.where(F.col("size") > LEAST_BYTES).select("category", "filename")
    own = plan.where(refusal(F.col("url"), F.col("category"), F.col("filename"), F.col("format")).isNull())
    own = own.withColumn("_file", F.concat_ws(".", "filename", "format"))
    return own.join(there.select("category", F.col("filename").alias("_file")), ["category", "_file"], "left_anti").drop("_file")

"""Where a finding can be opened or saved: pure expressions over its columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .catalog import WS
from .text import trimmed

# Confidence that saving needs, and the rank of sources.
MIN_SAVE_CONFIDENCE = 0.85
SOURCE_RANK = {"meta": 5, "json-ld": 4, "canonical": 3, "opengraph": 2, "microdata": 2, "text": 1, "anchor": 0}
CONFIDENCE = {"meta": 1.0, "json-ld": 0.95, "canonical": 0.9, "opengraph": 0.85, "microdata": 0.85, "text": 0.7, "anchor": 0.6}
#: The prefix only tells where a match may begin; the group is the identifier alone.
DOI = rf"(?i)(?:doi:[{WS}]*|doi\.org/)?(10\.\d{{4,9}}/[^?{WS}#]+)"
ARXIV = rf"(?i)(?:arxiv\.org/(?:abs|pdf)/|arXiv:[{WS}]*)(\d{{4}}\.\d{{4,5}}(?:v\d+)?)"

ARXIV_IDS, DOI_IDS = ("arxiv.id", "arxiv.abs"), ("doi", "doi.url")


def open_url(pattern_id: Column, text: Column) -> Column:
    return F.when(pattern_id.isin(*ARXIV_IDS), F.concat(F.lit("https://arxiv.org/pdf/"), text)).when(
        pattern_id.isin(*DOI_IDS), F.concat(F.lit("https://doi.org/"), text)
    )


def open_label(pattern_id: Column) -> Column:
    return F.when(pattern_id.isin(*ARXIV_IDS), F.lit("Open PDF on arXiv")).when(pattern_id.isin(*DOI_IDS), F.lit("Resolve on doi.org"))


def arxiv_filename(text: Column) -> Column:
    own = trimmed(text)
    return F.when(F.rlike(own, F.lit(r"^\d{4}\.\d{4,5}(?:v\d+)?\z")), own)


def doi_filename(text: Column) -> Column:
    """Unsafe characters to one underscore, none at the ends, 200 characters; null if nothing is left."""
    plain = F.regexp_replace(F.regexp_replace(text, r'[\\/<>:"|?*\x00-\x1f]', "_"), "_+", "_")
    return F.nullif(F.substring(F.regexp_replace(plain, r"^_+|_+\z", ""), 1, 200), F.lit(""))


def certified(source: Column, confidence: Column) -> Column:
    return (source != "text") & (F.coalesce(confidence, F.lit(0.0)) >= MIN_SAVE_CONFIDENCE)


def with_save_plan(findings: DataFrame, pattern_id: str = "pattern_id", text: str = "text", source: str = "source", confidence: str = "confidence") -> DataFrame:
    """findings with ``save`` (url, category, filename, format; null if it can't be saved), ``status`` (planned or skipped) and ``reason``."""
    # Names of files are columns of their own first: each is used more than once, and one large expression would not compile.
    # Each is made only for the rows that may be saved and whose pattern uses it.
    kind, sure = F.col(pattern_id), certified(F.col(source), F.col(confidence))
    only = lambda x, *ids: F.when(sure & kind.isin(*ids), x)
    own = only(trimmed(F.col(text)), "pmid", "pdf_url", "dc.identifier")
    first = findings.withColumns({"_own": own, "_doi": only(doi_filename(F.col(text)), *DOI_IDS, "biorxiv", "medrxiv")})
    inner = first.withColumns({f"_in_{name}": only(F.regexp_extract("_own", rx, 1), "dc.identifier") for name, rx in (("doi", DOI), ("arxiv", ARXIV))})
    second = inner.withColumns({
        "_in_file": only(doi_filename(F.col("_in_doi")), "dc.identifier"),
        "_stem": only(F.regexp_replace(F.element_at(F.split("_own", "/", -1), -1), r"(?i)\.pdf\z", ""), "pdf_url"),
    })
    put = lambda p, x, suffix="": F.concat(F.lit(p), F.col(x), F.lit(suffix))
    cases = [
        (kind.isin(*ARXIV_IDS), put("https://arxiv.org/pdf/", text), only(arxiv_filename(F.col(text)), *ARXIV_IDS), "pdf"),
        (kind.isin(*DOI_IDS), put("https://doi.org/", text), F.col("_doi"), "html"),
        (kind == "pmid", put("https://europepmc.org/article/MED/", "_own"), F.when(F.rlike("_own", F.lit(r"^\d{6,9}\z")), put("pmid-", "_own")), "html"),
        (kind == "biorxiv", put("https://www.biorxiv.org/content/", text, ".full.pdf"), F.col("_doi"), "pdf"),
        (kind == "medrxiv", put("https://www.medrxiv.org/content/", text, ".full.pdf"), F.col("_doi"), "pdf"),
        (kind == "pdf_url", F.col("_own"), F.when(F.rlike("_own", F.lit("^(?i)https?://")), F.nullif(F.substring("_stem", 1, 200), F.lit(""))), "pdf"),
        ((kind == "dc.identifier") & (F.col("_in_doi") != ""), put("https://doi.org/", "_in_doi"), F.col("_in_file"), "html"),
        ((kind == "dc.identifier") & (F.col("_in_arxiv") != ""), put("https://arxiv.org/pdf/", "_in_arxiv"), arxiv_filename(F.col("_in_arxiv")), "pdf"),
    ]
    pick = {n: F.lit(None).cast("string") for n in ("_url", "_file", "_format")}
    for when, url, filename, form in reversed(cases):
        for name, value in zip(pick, (url, filename, F.lit(form)), strict=True):
            pick[name] = F.when(when, value).otherwise(pick[name])
    third = second.withColumns(pick)
    info = F.struct(F.col("_url").alias("url"), F.lit("citation").alias("category"), F.col("_file").alias("filename"), F.col("_format").alias("format"))
    planned = third.withColumn("save", F.when(sure & F.col("_file").isNotNull(), info))
    unsupported = F.concat(F.lit("pattern '"), kind, F.lit("' not downloadable in v1"))
    reason = F.when(F.col(source) == "text", "text-body match: not a certified source").otherwise(unsupported)
    return planned.select(*findings.columns, "save", F.when(F.col("save").isNotNull(), "planned").otherwise("skipped").alias("status"), F.when(F.col("save").isNull(), reason).alias("reason"))


def source_rank(source: Column) -> Column:
    rank: Column = F.lit(0)
    for name, r in SOURCE_RANK.items():
        rank = F.when(source == name, r).otherwise(rank)
    return rank

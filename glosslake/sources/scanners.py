"""Scanners of a page's own metadata: six sources in one pass over ``elements``.

Each is an expression over one element that gives its candidates; all of them
together are one explode, so a page is read and classified once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.catalog import WS
from ..functions.links import ARXIV, CONFIDENCE, DOI
from ..functions.text import trimmed

# Metadata names and what they carry, and the places of identifiers.
META = {
    "citation_doi": "doi", "citation_doi_url": "doi.url", "citation_arxiv_id": "arxiv.id", "citation_pmid": "pmid",
    "citation_pmcid": "pmcid", "citation_pdf_url": "pdf_url", "dc_identifier": "dc.identifier",
}
ITEMPROPS = ("identifier", "doi", "sameas", "url")
ITEMTYPES = ("scholarlyarticle", "creativework", "article", "publication")
ARXIV_URL = r"(?i)arxiv\.org/(?:abs|pdf)/(\d{4}\.\d{4,5}(?:v\d+)?)"
DOI_URL = rf"(?i)doi\.org/(10\.\d{{4,9}}/[^?{WS}#]+)"
PREPRINT_OR_DOI_URL = rf"(?i)(?:doi\.org/|(?:www\.)?(?:biorxiv|medrxiv)\.org/content/)(10\.\d{{4,9}}/[^?{WS}#]+)"
META_DOI_URL = rf'(?i)doi\.org/(10\.\d{{4,9}}/[^"{WS}<>]+)'
PUBMED_URL = r"(?i)(?:pubmed\.ncbi\.nlm\.nih\.gov|www\.ncbi\.nlm\.nih\.gov/pubmed)/(\d{6,9})"
PMC_URL = r"(?i)ncbi\.nlm\.nih\.gov/pmc/articles/(PMC\d+)"
SOURCES = ("meta", "canonical", "json-ld", "opengraph", "microdata", "anchor")


def _attr(name: str) -> Column:
    return F.col("attrs")[name]


def first_match(value: Column, rules: list[tuple[str, str, Column | str]]) -> Column:
    """struct<pattern_id, text, label> of the first expression that is found in ``value``."""
    out: Column | None = None
    for pattern_id, rx, label in rules:
        got = F.regexp_extract(value, rx, 1)
        hit = F.struct(F.lit(pattern_id).alias("pattern_id"), got.alias("text"), (F.lit(label) if isinstance(label, str) else label).alias("label"))
        out = F.when(got != "", hit) if out is None else out.when(got != "", hit)
    return out


def resolved(href: Column, base: Column) -> Column:
    """A link's address: absolute ones stay, others are put behind the page's scheme, host or folder."""
    origin = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*(?:/[^?#]*/|/)?)", 1)
    folder = F.when(F.endswith(folder, F.lit("/")), folder).otherwise(F.concat(folder, F.lit("/")))
    return (
        F.when(F.rlike(href, F.lit("^[a-zA-Z][a-zA-Z0-9+.-]*:")), href)
        .when(F.startswith(href, F.lit("//")), F.concat(F.regexp_extract(base, "^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1), href))
        .when(F.startswith(href, F.lit("/")), F.concat(origin, href)).when(href == "", F.lit("")).otherwise(F.concat(folder, href))
    )


def _meta() -> Column:
    kinds = F.create_map(*(F.lit(x) for pair in META.items() for x in pair))
    name = F.lower(F.coalesce(_attr("name"), F.lit("")))
    own = (F.col("tag") == "META") & (F.startswith(name, F.lit("citation_")) | F.startswith(name, F.lit("dc.")))
    kind = kinds[F.replace(name, F.lit("."), F.lit("_"))]
    content = trimmed(F.coalesce(_attr("content"), F.lit("")))
    inner = F.regexp_extract(content, META_DOI_URL, 1)
    text = F.when((kind == "doi.url") & (inner != ""), inner).otherwise(content)
    return F.when(own & kind.isNotNull(), F.struct(kind.alias("pattern_id"), text.alias("text"), _attr("name").alias("label")))


def _canonical() -> Column:
    href = resolved(trimmed(F.coalesce(_attr("href"), F.lit(""))), F.coalesce("url", F.lit("")))
    rules = [("arxiv.id", ARXIV_URL, "canonical link arXiv"), ("doi", DOI_URL, "canonical link DOI")]
    return F.when((F.col("tag") == "LINK") & (F.lower(_attr("rel")) == "canonical"), first_match(href, rules))


def _jsonld(value: Column) -> Column:
    return first_match(trimmed(value), [("doi", DOI, "JSON-LD DOI"), ("arxiv.id", ARXIV, "JSON-LD arXiv"), ("pmid", r"^(\d{6,9})\z", "JSON-LD PMID")])


def _opengraph() -> Column:
    value = F.coalesce(_attr("content"), F.lit(""))
    own = (F.col("tag") == "META") & F.lower(_attr("property")).isin("og:url", "og:see_also")
    return F.when(own, first_match(value, [("doi", DOI, "og:url DOI"), ("arxiv.id", ARXIV, "og:url arXiv")]))


def _microdata() -> Column:
    prop = F.lower(_attr("itemprop"))
    value = F.coalesce(_attr("content"), _attr("href"), _attr("src"), trimmed(F.coalesce("text_content", F.lit(""))))
    label = F.concat(F.lit("microdata "), prop)
    return F.when(prop.isin(*ITEMPROPS), first_match(value, [("doi", DOI, label), ("arxiv.id", ARXIV, label)]))


def _academic(scope: Column) -> Column:
    kind = F.lower(F.coalesce(scope["itemtype"], F.lit("")))
    return reduce(Column.__or__, (F.contains(kind, F.lit(t)) for t in ITEMTYPES), kind == "")


def _href() -> Column:
    return F.when(F.col("tag").isin("A", "LINK"), trimmed(_attr("href")))


def _anchor() -> Column:
    rules = [("arxiv.id", ARXIV_URL, "anchor arXiv"), ("doi", PREPRINT_OR_DOI_URL, "anchor DOI"), ("pmid", PUBMED_URL, "anchor PMID"), ("pmcid", PMC_URL, "anchor PMCID")]
    return first_match(_href(), rules)


def source_candidates(sources: tuple[str, ...] = SOURCES) -> Column:
    """array<struct<src_ord, at, href, f>> of one element: what each source finds in it.

    ``at`` orders a page's findings of one source; ``href`` names the link of an
    anchor; ``f`` is null where nothing was found.  An element of nested scopes
    has a candidate for each of them.
    """

    def row(source: str, at: list[Column], f: Column) -> Column:
        href = _href() if source == "anchor" else F.lit(None).cast("string")
        return F.struct(F.lit(SOURCES.index(source)).alias("src_ord"), F.array(*(c.cast("int") for c in at)).alias("at"), href.alias("href"), f.alias("f"))

    el, none = F.col("el_ord"), F.array().cast("array<struct<el_ord:int,itemtype:string>>")
    single = {"meta": _meta, "canonical": _canonical, "opengraph": _opengraph, "anchor": _anchor}
    parts = [F.array(row(s, [el], single[s]())) for s in sources if s in single]
    if "json-ld" in sources:
        values = F.coalesce("values", F.array().cast("array<string>"))
        parts.append(F.transform(values, lambda v, i: row("json-ld", [el, i], _jsonld(v))))
    if "microdata" in sources:
        scopes = F.filter(F.coalesce("scopes", none), _academic)
        parts.append(F.transform(scopes, lambda s: row("microdata", [s["el_ord"], el], _microdata())))
    return F.filter(F.concat(*parts), lambda c: c["f"].isNotNull() & (c["f"]["text"] != ""))


def first_of_equal_links(found: DataFrame) -> DataFrame:
    """Candidate rows (page_id, src_ord, at, href, ...) without the later ones of a page's equal links."""
    by = Window.partitionBy("page_id", "src_ord", "href").orderBy("at")
    return found.withColumn("_n", F.row_number().over(by)).where(F.col("href").isNull() | (F.col("_n") == 1)).drop("_n", "href")


def scan_sources(elements: DataFrame, sources: tuple[str, ...] = SOURCES) -> DataFrame:
    """The findings of the named sources, in the order of ``SOURCES`` by (src_ord, at)."""
    each = elements.select("page_id", F.explode(source_candidates(sources)).alias("c")).select("page_id", "c.*")
    own = first_of_equal_links(each) if "anchor" in sources else each
    return own.select(
        "page_id", "src_ord", "at", F.col("f.pattern_id").alias("pattern_id"), F.lit("citation").alias("category"), F.col("f.label").alias("label"),
        F.col("f.text").alias("text"), F.lit(0).alias("start"), F.length("f.text").alias("end"), F.length("f.text").alias("original_length"),
        F.lit(0).alias("priority"), source_name().alias("source"), source_confidence().alias("confidence"),
    )


def source_name() -> Column:
    """The name of ``src_ord``; -1 is the text itself."""
    return F.element_at(F.array(*map(F.lit, ("text", *SOURCES))), F.col("src_ord") + 2)


def source_confidence() -> Column:
    return F.element_at(F.array(*(F.lit(CONFIDENCE[s]) for s in ("text", *SOURCES))), F.col("src_ord") + 2)


def distinct_hrefs(elements: DataFrame) -> DataFrame:
    """The first of each page's equal links."""
    own = elements.where(F.col("tag").isin("A", "LINK")).withColumn("href", trimmed(_attr("href"))).where("href <> ''")
    by = Window.partitionBy("page_id", "href").orderBy("el_ord")
    return own.withColumn("_n", F.row_number().over(by)).where("_n = 1").select("page_id", "el_ord", "tag", "href")


def scan_meta(elements: DataFrame) -> DataFrame:
    return scan_sources(elements, ("meta",))


def scan_canonical(elements: DataFrame) -> DataFrame:
    return scan_sources(elements, ("canonical",))


def scan_jsonld(elements: DataFrame) -> DataFrame:
    return scan_sources(elements, ("json-ld",))


def scan_opengraph(elements: DataFrame) -> DataFrame:
    return scan_sources(elements, ("opengraph",))


def scan_microdata(elements: DataFrame) -> DataFrame:
    return scan_sources(elements, ("microdata",))


def scan_anchors(elements: DataFrame) -> DataFrame:
    return scan_sources(elements, ("anchor",))

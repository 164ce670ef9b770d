"""The page pipeline: parse, scan, drop by element, add the page's own metadata, group, report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.catalog import Catalog, default_catalog
from ..functions.links import open_url, with_save_plan
from ..functions.text import display_id, shortened
from ..operators.dedupe import dedupe
from ..operators.scan import Kernel, resolve_overlaps, scan_text
from ..sources.html import parse_pages
from ..sources.scanners import first_of_equal_links, source_candidates, source_confidence, source_name


def parent_falsified(catalog: Catalog, sets: list[str] | None = None) -> list[tuple[str, str | None, str | None]]:
    return [(p.id, f.tag, f.css_class) for p in catalog.patterns(sets) for f in p.falsifiers if f.kind == "parent"]


def _falsified(catalog: Catalog, sets: list[str] | None, pattern_id: Column) -> Column:
    """Whether a match's element speaks against it: its tag, its class, or both where a falsifier names both."""
    rules = parent_falsified(catalog, sets)
    listed = lambda names: F.array(*map(F.lit, names)).cast("array<string>")
    tag = F.coalesce(F.upper("parent_tag"), F.lit(""))
    own = lambda *parts: F.concat_ws(" ", pattern_id, *parts)
    by_tag = F.array_contains(listed([f"{p} {t.upper()}" for p, t, c in rules if t and not c]), own(tag))
    by_class = F.arrays_overlap(listed([f"{p} {c}" for p, t, c in rules if c and not t]), F.transform("parent_classes", lambda c: own(c)))
    by_both = F.arrays_overlap(listed([f"{p} {t.upper()} {c}" for p, t, c in rules if t and c]), F.transform("parent_classes", lambda c: own(tag, c)))
    each = [by for by, used in ((by_tag, any(t and not c for _, t, c in rules)), (by_class, any(c and not t for _, t, c in rules)), (by_both, any(t and c for _, t, c in rules))) if used]
    always = pattern_id.isin([p for p, t, c in rules if not t and not c]) if any(not t and not c for _, t, c in rules) else F.lit(False)
    return F.col("parent_tag").isNotNull() & reduce(Column.__or__, each, always)


def scan_nodes(nodes: DataFrame, catalog: Catalog | None = None, sets: list[str] | None = None) -> DataFrame:
    """Findings of text nodes; those whose element speaks against them go after overlaps are resolved, and nothing comes back."""
    catalog = catalog or default_catalog()
    found = scan_text(nodes, ["page_id", "node_ord", "parent_tag", "parent_classes"], catalog=catalog, sets=sets)
    return found.where(~_falsified(catalog, sets, F.col("pattern_id"))).drop("parent_tag", "parent_classes")


def analyze_pages(pages: DataFrame, catalog: Catalog | None = None, sets: list[str] | None = None) -> DataFrame:
    """All findings of every page: text ones first, then the metadata's, numbered by ``seq``.

    A page is parsed once: its text nodes are scanned where they are read, and
    text nodes and elements go on as rows of one table.  Everything after that
    is by page, so the rows are shuffled once.  A metadata finding never
    overlaps another: it is alone at its place.
    """
    catalog = catalog or default_catalog()
    patterns = catalog.patterns(sets)
    parsed = parse_pages(pages, lambda: Kernel(patterns).find)
    shape = {f.name: f.dataType.elementType for f in parsed.schema if f.name in ("text_nodes", "elements")}
    node = lambda n: F.struct(n.alias("node"), F.lit(None).cast(shape["elements"]).alias("el"))
    element = lambda e: F.struct(F.lit(None).cast(shape["text_nodes"]).alias("node"), e.alias("el"))
    items = F.concat(F.transform(F.filter("text_nodes", lambda n: F.size(n["found"]) > 0), node), F.transform("elements", element))
    each = parsed.select("page_id", "url", F.explode(items).alias("i")).select("page_id", "url", "i.node.node_ord", "i.node.parent_tag", "i.node.parent_classes", "i.node.found", "i.el.*")

    named = lambda pattern_id, text, label: F.struct(pattern_id.alias("pattern_id"), text.alias("text"), label.alias("label"))
    rest = {"category": "string", "start": "int", "end": "int", "original_length": "int", "priority": "int", "ord": "int"}
    in_text = F.transform("found", lambda m: F.struct(
        F.lit(-1).alias("src_ord"), F.array("node_ord").alias("at"), F.lit(None).cast("string").alias("href"), named(m["pattern_id"], m["text"], m["label"]).alias("f"),
        *(m[c].alias(c) for c in rest), _falsified(catalog, sets, m["pattern_id"]).alias("falsified"),
    ))
    in_source = F.transform(source_candidates(), lambda c: F.struct(
        c["src_ord"].alias("src_ord"), c["at"].alias("at"), c["href"].alias("href"), named(c["f"]["pattern_id"], c["f"]["text"], c["f"]["label"]).alias("f"),
        *(F.lit(None).cast(kind).alias(name) for name, kind in rest.items()), F.lit(False).alias("falsified"),
    ))
    rows = each.select("page_id", F.explode(F.when(F.col("node_ord").isNotNull(), in_text).otherwise(in_source)).alias("c")).select("page_id", "c.*", "c.f.*").drop("f")
    size = F.length("text")
    filled = {"category": F.lit("citation"), "start": F.lit(0), "end": size, "original_length": size, "priority": F.lit(0), "ord": F.lit(0)}
    rows = rows.withColumns({c: F.coalesce(c, value) for c, value in filled.items()}).repartition("page_id")
    kept = resolve_overlaps(first_of_equal_links(rows), ["page_id", "src_ord", "at"]).where("not falsified")
    placed = kept.withColumns({"source": source_name(), "confidence": source_confidence()})
    by = Window.partitionBy("page_id").orderBy("src_ord", F.when(F.col("src_ord") < 0, F.concat("at", F.array("start"))).otherwise(F.col("at")), "pattern_id", "text")
    return placed.withColumn("seq", F.row_number().over(by).cast("long")).drop("src_ord", "at", "ord", "falsified")


def report(findings: DataFrame) -> DataFrame:
    """One row for each group: its id, text, mentions, and where it opens or saves."""
    groups = dedupe(findings).select("page_id", "group_ord", "mention_count", "representative.*")
    return with_save_plan(groups).select(
        "page_id", "group_ord", display_id(F.col("category"), F.col("pattern_id")).alias("display_id"), shortened(F.col("text")).alias("text"),
        F.col("mention_count").alias("mentions"), open_url(F.col("pattern_id"), F.col("text")).alias("open_url"), "status", "reason", "save.filename",
    )

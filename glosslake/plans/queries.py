"""Named queries over the driver's tables, and their DuckDB SQL.

The tables hold few citations of their own, so some queries append a fixed
sentence to every whole text (or a head to every page) from its id alone; the
SQL appends the same.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import catalog, links, replies, text, vectors
from ..functions.catalog import WS, Catalog, Pattern, PatternSet, default_catalog, dialect_spaces, python_regex
from ..operators import dedupe, evaluate, harvest, lookup, scan, search
from ..sources import files, html, notes, scanners
from ..streaming import state
from . import pages as page_plan

CATALOG = default_catalog()
PATTERNS = {p.id: p for p in CATALOG.patterns()}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Every pattern once, and the near misses that falsifiers drop; the same expression for both engines.
APPENDED = """concat(coalesce(text, ''), '. See arXiv:2401.', lpad(concat('', doc_id % 100000), 5, '0'), 'v2 and https://arxiv.org/abs/2312.', lpad(concat('', doc_id % 100000), 5, '0'),
 ' here. The DOI 10.1234/abc.', doc_id, ' is cited; lists 10.1038/x', doc_id, ', 10.1126/y', doc_id, ' stay. Via https://doi.org/10.5555/zz-', doc_id,
 ' ok. PMID: ', 1200000 + doc_id, ' and PMC', 7100000 + doc_id, ' noted. Code https://github.com/org/repo', doc_id, '.git is out. At https://www.biorxiv.org/content/10.1101/2020.', doc_id,
 ' and https://www.medrxiv.org/content/10.1101/2021.', doc_id, ' too. Theorem 3.', doc_id, ' and Definition 2.1 give eq (', doc_id, '), not 159(2). It is O(n log n) for a muon at CERN-LHC with 125 GeV energy.',
 ' Dug 55 kg at depth ', doc_id, '. CO2 and TP53 and p53 by qPCR in Escherichia coli at NeurIPS 2023 with BERT-base on ImageNet.')"""


def appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").selectExpr("doc_id", f"{APPENDED} AS text")


def scan_query(p: Pattern) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        # One search for strings that a match must hold tells where the expression runs; natively it would pass over every text four times.
        found = scan.candidates(appended(spark, sf_dir), ["doc_id"], catalog=Catalog(PatternSet("one", p.label, (p,))))
        return found.select("doc_id", "text", "start", "end")

    return run


def _re2(p: Pattern) -> str:
    rx = {
        "pmid": r"(?:PMID:?\s*|pubmed\.ncbi\.nlm\.nih\.gov/)(\d+)",
        "pmcid": r"(?:\b|(?:pmc\.ncbi\.nlm\.nih\.gov/articles/))(PMC\d+)",
        "github": r"(https?://github\.com/[A-Za-z0-9][A-Za-z0-9._-]+/[A-Za-z0-9._-]+)",
    }.get(p.id, p.regex)
    rx = dialect_spaces(rx)
    return ("(?i)" if "i" in p.flags else "") + rx.replace("'", "''")


def _scan_sql(p: Pattern, more: str = "") -> str:
    rx, group = _re2(p), 1 if _groups(p) else 0
    keep = {
        "pmid": "length(c) BETWEEN 6 AND 9",
        "pmcid": "length(c) BETWEEN 7 AND 11",
        "github": "substr(t, CAST(e AS BIGINT) + 1, 1) IN ('', ' ', '#', '/', '?', chr(10), chr(9))",
        "doi": rf"NOT regexp_matches(substr(t, CAST(e AS BIGINT) + 1, 100), '^[;,][{WS}]*10\.')",
        "math.equation": r"NOT regexp_matches(substr(t, CAST(greatest(e - length(m) + instr(m, c) - 100, 1) AS BIGINT), CAST(least(e - length(m) + instr(m, c) - 1, 100) AS BIGINT)), '\d\($')",
    }.get(p.id, "TRUE")
    shown = r"regexp_replace(c, '\.git$', '')" if p.id == "github" else "c"
    return f"""
WITH d AS (SELECT doc_id, {APPENDED} AS t FROM documents),
x AS (SELECT doc_id, t, regexp_extract_all(t, '{rx}') AS ms, regexp_extract_all(t, '{rx}', {group}) AS cs, string_split_regex(t, '{rx}') AS gs FROM d),
u AS (SELECT doc_id, t, unnest(ms) AS m, unnest(cs) AS c, unnest(gs[1:len(ms)]) AS g, unnest(range(len(ms))) AS i FROM x),
p AS (SELECT doc_id, t, m, c, sum(length(g) + length(m)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM u)
SELECT doc_id, {shown} AS text, CAST(e - length(m) + instr(m, c) - 1 AS INTEGER) AS "start",
  CAST(e - length(m) + instr(m, c) - 1 + length({shown}) AS INTEGER) AS "end"{more} FROM p WHERE {keep}"""


def _sentences_sql(t: str = APPENDED) -> str:
    """doc_id, b, e, body: sentences by their first and last place; each of ``.!?`` is judged by what is before and behind it."""
    before, behind = "substr(t, greatest(i - 12, 1), i - greatest(i - 12, 1))", "substr(t, i + 1, 400)"
    start = r"""[A-Z(\["''¿]"""
    return rf"""(
WITH d AS (SELECT doc_id, {t} AS t FROM documents), g AS (SELECT doc_id, t, string_split_regex(t, '[.!?]') AS gs FROM d),
u AS (SELECT doc_id, t, unnest(gs) AS g, unnest(range(len(gs))) AS k FROM g),
p AS (SELECT doc_id, t, CAST(sum(length(g) + 1) OVER (PARTITION BY doc_id ORDER BY k) AS BIGINT) AS i FROM u),
b AS (SELECT doc_id, i FROM p WHERE i <= length(t) AND regexp_matches({behind}, '^[{WS}]*($|{start})')
  AND (substr(t, i, 1) <> '.' OR NOT regexp_matches({before}, '(^|[^A-Za-z])({"|".join(text.ABBREVIATIONS)})$')
    AND NOT (regexp_matches({before}, '(^|[^A-Za-z])[A-Za-z]$') AND regexp_matches({behind}, '^[{WS}]{{0,99}}[A-Z]')))),
e AS (SELECT doc_id, i AS e FROM b UNION SELECT doc_id, length(t) FROM d WHERE length(t) > 0),
s AS (SELECT doc_id, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY e), 0) AS b FROM e)
SELECT doc_id, b, e, row_number() OVER (PARTITION BY doc_id ORDER BY e) - 1 AS sent, substr(t, b + 1, e - b) AS body FROM s JOIN d USING (doc_id))"""


def _units_sql(more: str = "") -> str:
    p = PATTERNS["physics.units"]
    words = "|".join(catalog.GEOGRAPHY)
    return f"""SELECT * FROM ({_scan_sql(p, more)}) u WHERE NOT EXISTS (SELECT 1 FROM {_sentences_sql()} g
 WHERE g.doc_id = u.doc_id AND g.b <= u."start" AND u."end" <= g.e AND regexp_matches(lower(g.body), '(^|[^a-z0-9])({words})($|[^a-z0-9])'))"""


def _groups(p: Pattern) -> int:
    return python_regex(p.regex, p.flags).groups


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of the whole texts by category and pattern, after falsifiers and overlaps."""
    found = scan.scan_text(appended(spark, sf_dir), ["doc_id"])
    return found.groupBy("category", "pattern_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("n_docs"))


def overlap_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.scan_text(appended(spark, sf_dir), ["doc_id"], sets=["citations"]).select("doc_id", "pattern_id", "text", "start", "end")


def _overlap_sql(sets: list[str] | None = None) -> str:
    more = [(p, f", length(m) AS n, {p.priority} AS priority, {k} AS ord, '{p.id}' AS pattern_id") for k, p in enumerate(CATALOG.patterns(sets))]
    rows = [f"({_units_sql(m) if p.id == 'physics.units' else _scan_sql(p, m)})" for p, m in more]
    return f"""WITH RECURSIVE c AS ({" UNION ALL ".join(f"SELECT * FROM {r}" for r in rows)}),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY "start", n DESC, priority DESC, ord) AS rn FROM c),
w AS (SELECT doc_id, rn, pattern_id, text, "start", "end", TRUE AS kept, "end" AS cursor FROM r WHERE rn = 1
 UNION ALL SELECT r.doc_id, r.rn, r.pattern_id, r.text, r."start", r."end", r."start" >= w.cursor, CASE WHEN r."start" >= w.cursor THEN r."end" ELSE w.cursor END
 FROM w JOIN r ON r.doc_id = w.doc_id AND r.rn = w.rn + 1)
SELECT doc_id, pattern_id, text, "start", "end" FROM w WHERE kept"""


def natural_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan.scan_text(_table(spark, sf_dir, "documents"), ["doc_id"])
    return found.groupBy("pattern_id").agg(F.count(F.lit(1)).alias("n"))


def sentence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return appended(spark, sf_dir).select("doc_id", F.size(text.sentences(F.col("text"))).alias("n_sentences"))


def marked_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = appended(spark, sf_dir)
    return scan.sentence_spans(docs, ["doc_id"], scan.scan_text(docs, ["doc_id"], sentences=True))


_KINDS = " ".join(f"WHEN '{p.id}' THEN '{p.category}'" for p in PATTERNS.values())
COUNTS_SQL = f"SELECT CASE pattern_id {_KINDS} END AS category, pattern_id, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM ({_overlap_sql()}) GROUP BY ALL"
SPLIT_SQL = f"SELECT doc_id, CAST(count(*) AS INTEGER) AS n_sentences FROM {_sentences_sql()} GROUP BY doc_id"
MARKED_SQL = rf"""SELECT * FROM (SELECT doc_id, CAST(sent AS INTEGER) AS sent, CAST(b + length(body) - length(regexp_replace(body, '^[{WS}]+', '')) AS INTEGER) AS "start",
 CAST(b + length(regexp_replace(body, '[{WS}]+$', '')) AS INTEGER) AS "end" FROM {_sentences_sql()} s
 WHERE EXISTS (SELECT 1 FROM ({_overlap_sql()}) f WHERE f.doc_id = s.doc_id AND f."start" >= s.b AND f."end" <= s.e)) WHERE "start" < "end" """


# Findings for grouping, links and plans: made from order lines, the same on both engines.
FINDINGS = """SELECT l_orderkey AS page_id, l_linenumber * 100000000 + l_partkey AS seq,
 CASE l_suppkey % 3 WHEN 0 THEN 'citation' WHEN 1 THEN 'math' ELSE 'cs' END AS category,
 CASE l_partkey % 9 WHEN 0 THEN 'arxiv.id' WHEN 1 THEN 'doi' WHEN 2 THEN 'doi.url' WHEN 3 THEN 'pmid' WHEN 4 THEN 'biorxiv' WHEN 5 THEN 'pdf_url' WHEN 6 THEN 'dc.identifier' WHEN 7 THEN 'github' ELSE 'math.theorem' END AS pattern_id,
 CASE l_partkey % 9 WHEN 0 THEN concat('2401.', lpad(concat('', l_partkey % 100000), 5, '0')) WHEN 3 THEN concat('', 1000000 + l_partkey)
  WHEN 5 THEN concat('https://host.example/p/', l_partkey, '.pdf') WHEN 6 THEN concat('doi:10.5555/A b', l_partkey) ELSE concat('10.1234/P:', l_partkey % 5, '<x>  Yv', l_linenumber) END AS text,
 CASE l_suppkey % 7 WHEN 0 THEN 'meta' WHEN 1 THEN 'json-ld' WHEN 2 THEN 'canonical' WHEN 3 THEN 'opengraph' WHEN 4 THEN 'microdata' WHEN 5 THEN 'text' ELSE 'anchor' END AS source,
 CAST(CASE l_suppkey % 7 WHEN 0 THEN 1.0 WHEN 1 THEN 0.95 WHEN 2 THEN 0.9 WHEN 3 THEN 0.85 WHEN 4 THEN 0.85 WHEN 5 THEN 0.7 ELSE 0.6 END AS DOUBLE) AS confidence,
 CAST(l_quantity AS INT) AS start FROM lineitem"""


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(FINDINGS.replace("FROM lineitem", "FROM {lineitem}"), lineitem=_table(spark, sf_dir, "lineitem"))


NORM = rf"regexp_replace(trim(regexp_replace(lower(text), '[{WS}]+', ' ', 'g')), '([0-9])v[0-9]+$', '\1')"
RANKED_SQL = f"""WITH f AS ({FINDINGS}), n AS (SELECT *, {NORM} AS norm_text,
  CASE source WHEN 'meta' THEN 5 WHEN 'json-ld' THEN 4 WHEN 'canonical' THEN 3 WHEN 'opengraph' THEN 2 WHEN 'microdata' THEN 2 WHEN 'text' THEN 1 ELSE 0 END AS r FROM f),
k AS (SELECT *, row_number() OVER (PARTITION BY page_id, category, norm_text ORDER BY confidence * 1000 + r DESC, seq) AS place FROM n),
g AS (SELECT page_id, category, norm_text, count(*) AS mention_count, min(start) AS first_start, min(seq) AS first_seq FROM n GROUP BY ALL)"""


def dedupe_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedupe.dedupe(findings(spark, sf_dir))
    return out.select("page_id", "category", "norm_text", "mention_count", "first_start", "group_ord", F.col("representative.source").alias("source"), F.size("mentions").alias("n_others"))


DEDUPE_SQL = f"""{RANKED_SQL} SELECT g.page_id, g.category, g.norm_text, mention_count, first_start,
 CAST(row_number() OVER (PARTITION BY g.page_id ORDER BY g.category, first_start, first_seq) AS INTEGER) AS group_ord, k.source, CAST(mention_count - 1 AS INTEGER) AS n_others
FROM g JOIN k ON k.page_id = g.page_id AND k.category = g.category AND k.norm_text = g.norm_text AND place = 1"""


def representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.representatives(findings(spark, sf_dir)).select("page_id", "category", "norm_text", "seq", "source", "confidence")


def link_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return links.with_save_plan(findings(spark, sf_dir)).select(
        "page_id", "seq", links.open_url(c("pattern_id"), c("text")).alias("open_url"), links.open_label(c("pattern_id")).alias("open_label"),
        "save.url", "save.filename", "save.format", "status", "reason",
    )


_FILE = r"""nullif(substr(regexp_replace(regexp_replace(regexp_replace({}, '[\\/<>:"|?*\x00-\x1f]', '_', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 200), '')"""
LINK_SQL = rf"""WITH f AS ({FINDINGS}),
x AS (SELECT *, source <> 'text' AND confidence >= 0.85 AS sure, regexp_extract(text, '(10\.\d{{4,9}}/[^?{WS}#]+)', 1) AS inner_doi, {_FILE.format("text")} AS doi_file FROM f),
y AS (SELECT *,
 CASE WHEN NOT sure THEN NULL WHEN pattern_id = 'arxiv.id' AND regexp_full_match(text, '\d{{4}}\.\d{{4,5}}(?:v\d+)?') THEN text
  WHEN pattern_id IN ('doi', 'doi.url', 'biorxiv') THEN doi_file WHEN pattern_id = 'pmid' AND regexp_full_match(text, '\d{{6,9}}') THEN concat('pmid-', text)
  WHEN pattern_id = 'pdf_url' THEN regexp_replace(string_split(text, '/')[-1], '\.pdf$', '') WHEN pattern_id = 'dc.identifier' AND inner_doi <> '' THEN {_FILE.format("inner_doi")} END AS filename FROM x)
SELECT page_id, seq,
 CASE WHEN pattern_id = 'arxiv.id' THEN concat('https://arxiv.org/pdf/', text) WHEN pattern_id IN ('doi', 'doi.url') THEN concat('https://doi.org/', text) END AS open_url,
 CASE WHEN pattern_id = 'arxiv.id' THEN 'Open PDF on arXiv' WHEN pattern_id IN ('doi', 'doi.url') THEN 'Resolve on doi.org' END AS open_label,
 CASE WHEN filename IS NULL THEN NULL WHEN pattern_id = 'arxiv.id' THEN concat('https://arxiv.org/pdf/', text) WHEN pattern_id IN ('doi', 'doi.url') THEN concat('https://doi.org/', text)
  WHEN pattern_id = 'pmid' THEN concat('https://europepmc.org/article/MED/', text) WHEN pattern_id = 'biorxiv' THEN concat('https://www.biorxiv.org/content/', text, '.full.pdf')
  WHEN pattern_id = 'pdf_url' THEN text ELSE concat('https://doi.org/', inner_doi) END AS url,
 filename, CASE WHEN filename IS NULL THEN NULL WHEN pattern_id IN ('arxiv.id', 'biorxiv', 'pdf_url') THEN 'pdf' ELSE 'html' END AS format,
 CASE WHEN filename IS NULL THEN 'skipped' ELSE 'planned' END AS status,
 CASE WHEN filename IS NOT NULL THEN NULL WHEN source = 'text' THEN 'text-body match: not a certified source' ELSE concat('pattern ''', pattern_id, ''' not downloadable in v1') END AS reason FROM y"""

#: A head with one of each kind of metadata for every page, and repeated links.
HEAD = """concat('<html><head><meta name="citation_doi" content=" 10.1234/p', page_id, ' "><meta name="DC.identifier" content="doi:10.2/x"><link rel="canonical" href="https://doi.org/10.5555/c', page_id,
 '?x=1"><meta property="og:url" content="https://arxiv.org/abs/2401.', lpad(concat('', page_id % 100000), 5, '0'), '"><script type="application/ld+json">{"@graph":[{"identifier":["10.7777/j', page_id,
 '", {"value":"1234567"}], "sameAs":{"value":"https://arxiv.org/abs/2302.00001"}}]}</script><script type="application/ld+json">{broken</script></head><body><div itemscope itemtype="https://schema.org/ScholarlyArticle"><span itemprop="identifier">10.8888/m',
 page_id, '</span><a href="https://www.ncbi.nlm.nih.gov/pubmed/', 3000000 + page_id, '">x</a><a href="https://www.ncbi.nlm.nih.gov/pubmed/', 3000000 + page_id, '">y</a></div><p>TP53 in arXiv:2401.00001</p><code>arXiv:2401.00002</code><h1>BRCA1</h1>', coalesce(html, ''))"""


def headed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").selectExpr("page_id", "url", f"{HEAD} AS html")


def source_query(f: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = f(html.elements(html.parse_pages(headed(spark, sf_dir))))
        return found.select("page_id", "pattern_id", "label", "text", "source", "confidence")

    return run


def _source_sql(rows: list[tuple[str, str, str, str, float]]) -> str:
    one = "SELECT page_id, '{}' AS pattern_id, '{}' AS label, {} AS text, '{}' AS source, CAST({} AS DOUBLE) AS confidence FROM pages"
    return " UNION ALL ".join(one.format(*r) for r in rows)


SOURCE_ROWS = {
    "source_meta": [("doi", "citation_doi", "concat('10.1234/p', page_id)", "meta", 1.0), ("dc.identifier", "DC.identifier", "'doi:10.2/x'", "meta", 1.0)],
    "source_canonical": [("doi", "canonical link DOI", "concat('10.5555/c', page_id)", "canonical", 0.9)],
    "source_jsonld": [("doi", "JSON-LD DOI", "concat('10.7777/j', page_id)", "json-ld", 0.95), ("arxiv.id", "JSON-LD arXiv", "'2302.00001'", "json-ld", 0.95)],
    "source_opengraph": [("arxiv.id", "og:url arXiv", "concat('2401.', lpad(concat('', page_id % 100000), 5, '0'))", "opengraph", 0.85)],
    "source_microdata": [("doi", "microdata identifier", "concat('10.8888/m', page_id)", "microdata", 0.85)],
    "source_anchor": [("doi", "anchor DOI", "concat('10.5555/c', page_id)", "anchor", 0.6), ("pmid", "anchor PMID", "concat('', 3000000 + page_id)", "anchor", 0.6)],
}
SCANNERS = {
    "source_meta": scanners.scan_meta, "source_canonical": scanners.scan_canonical, "source_jsonld": scanners.scan_jsonld,
    "source_opengraph": scanners.scan_opengraph, "source_microdata": scanners.scan_microdata, "source_anchor": scanners.scan_anchors,
}


def hrefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scanners.distinct_hrefs(html.elements(html.parse_pages(_table(spark, sf_dir, "pages"))))
    return found.select("page_id", "href")


def page_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_plan.report(page_plan.analyze_pages(headed(spark, sf_dir)))


def page_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.category_chips(page_plan.analyze_pages(headed(spark, sf_dir)))


# Outcomes of a classifier (low quality foretells toxic) by fifth of the ids.
OUTCOMES = """SELECT doc_id AS example, concat('part', doc_id % 5) AS pattern,
 CASE WHEN toxic = 1 AND quality = 0 THEN 'tp' WHEN toxic = 1 THEN 'fn' WHEN quality = 0 THEN 'fp' ELSE 'tn' END AS outcome,
 CASE WHEN toxic = 1 AND quality <> 0 THEN 'fn' WHEN toxic = 0 AND quality = 0 THEN 'fp' END AS reason FROM labels"""


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(OUTCOMES.replace("FROM labels", "FROM {labels}"), labels=_table(spark, sf_dir, "labels"))


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def eval_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.prf(evaluate.confusion(outcomes(spark, sf_dir))), "precision", "recall", "f1")


def eval_macro_micro(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluate.macro_micro(evaluate.prf(evaluate.confusion(outcomes(spark, sf_dir))))
    return rounded(out, *(f"{a}_{b}" for a in ("macro", "micro") for b in ("precision", "recall", "f1")))


def eval_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.failures(outcomes(spark, sf_dir)).select("pattern", "place", "example", "reason")


CONFUSION = "SELECT pattern, " + ", ".join(f"CAST(sum(CASE WHEN outcome = '{o}' THEN 1 ELSE 0 END) AS BIGINT) AS {o}" for o in ("tp", "fp", "fn", "tn")) + f" FROM ({OUTCOMES}) GROUP BY pattern"
PRF_COLUMNS = "coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS r, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f"
PRF_SQL = f"SELECT pattern, tp, fp, fn, tn, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1 FROM (SELECT *, {PRF_COLUMNS} FROM ({CONFUSION}))"
MACRO_SQL = f"""WITH c AS (SELECT *, {PRF_COLUMNS} FROM ({CONFUSION})), s AS (SELECT avg(p) AS mp, avg(r) AS mr, avg(f) AS mf, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM c)
SELECT round(mp, 6) AS macro_precision, round(mr, 6) AS macro_recall, round(mf, 6) AS macro_f1, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS micro_precision,
 round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS micro_recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS micro_f1, mf >= 0.85 AS passed FROM s"""
FAILURES_SQL = f"SELECT pattern, CAST(row_number() OVER (PARTITION BY pattern ORDER BY example) AS INTEGER) AS place, example, reason FROM ({OUTCOMES}) WHERE reason IS NOT NULL QUALIFY place <= 5"


def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("ord"), F.col("embedding").alias("vector"))
    queries = rows.where("ord % 20 = 0").select(F.col("ord").alias("query_id"), F.col("vector").alias("q"))
    return rounded(search.find_similar_each(rows, queries), "similarity")


COSINE_SQL = """SELECT query_id, ord, round(similarity, 6) AS similarity, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, ord) AS INTEGER) AS rank FROM (
 SELECT q.vec_id AS query_id, e.vec_id AS ord, coalesce(list_inner_product(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))
  / nullif(sqrt(list_inner_product(CAST(e.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[]))) * sqrt(list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))), 0), 0) AS similarity
 FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0) QUALIFY rank <= 5"""


def vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding")
    unit = vectors.l2_normalize(e)
    out = _table(spark, sf_dir, "embeddings").select("vec_id", vectors.l2_norm(e).alias("norm"), vectors.dot(e, F.slice(e, 1, 8)).alias("head_dot"), vectors.cosine(e, vectors.head(e)).alias("other_length"), F.aggregate(unit, F.lit(0.0), lambda a, x: a + x).alias("unit_sum"))
    return rounded(out, "norm", "head_dot", "other_length", "unit_sum")


NORMS_SQL = """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), n AS (SELECT *, sqrt(list_inner_product(e, e)) AS norm FROM v)
SELECT vec_id, round(norm, 6) AS norm, round(list_inner_product(e[1:8], e[1:8]), 6) AS head_dot, round(CAST(0 AS DOUBLE), 6) AS other_length, round(list_sum(list_transform(e, lambda x: x / norm)), 6) AS unit_sum FROM n"""


def catalog_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sets of the catalog, and what a scan of the documents finds of each."""
    rows = CATALOG.frame(spark)
    sets = rows.groupBy("set_id", "set_name").agg(F.array_sort(F.collect_list(F.struct("ord", "id"))).alias("p"))
    found = scan.scan_text(_table(spark, sf_dir, "documents"), ["doc_id"]).select("doc_id", F.col("pattern_id").alias("id"))
    seen = found.join(F.broadcast(rows.select("id", "set_id")), "id").groupBy("set_id").agg(F.count(F.lit(1)).alias("n_findings"), F.countDistinct("doc_id").alias("n_docs"))
    named = sets.select("set_id", "set_name", F.array_join(F.transform("p", lambda x: x["id"]), ",").alias("patterns"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return named.join(seen, "set_id", "left").select("set_id", "set_name", "patterns", zero("n_findings"), zero("n_docs"))


def catalog_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every keyword of the catalog, and where the documents hold it."""
    words = catalog.keywords(CATALOG, spark)
    held = harvest.places(appended(spark, sf_dir), ["doc_id"], [r["keyword"] for r in words.collect()])  # the catalog's own list
    seen = held.groupBy("keyword").agg(F.count(F.lit(1)).alias("n_places"), F.countDistinct("doc_id").alias("n_docs"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return words.join(seen, "keyword", "left").select("keyword", zero("n_places"), zero("n_docs"))


def catalog_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The patterns that only one side knows: the catalog and what a scan of the appended texts finds; one pass over the texts."""
    own = CATALOG.frame(spark).select("id", F.lit(True).alias("own"), F.lit(False).alias("seen"))
    seen = scan.candidates(appended(spark, sf_dir), ["doc_id"]).select(F.col("pattern_id").alias("id"), F.lit(False).alias("own"), F.lit(True).alias("seen"))
    sides = own.unionByName(seen).groupBy("id").agg(F.bool_or("own").alias("own"), F.bool_or("seen").alias("seen"))
    return sides.select("id", F.when(F.col("own") & F.col("seen"), "both").when(F.col("own"), "catalog").otherwise("scan").alias("side"))


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join("'" + str(x).replace("'", "''") + "'" for x in r) + ")" for r in rows)


SETS_SQL = f"""WITH s AS (SELECT * FROM (VALUES {_values([(s.id, s.name, ','.join(p.id for p in s.patterns)) for s in CATALOG.sets])}) t(set_id, set_name, patterns)),
 f AS ({_overlap_sql().replace(APPENDED, "text")})
 SELECT s.set_id, s.set_name, s.patterns, count(f.doc_id) AS n_findings, count(DISTINCT f.doc_id) AS n_docs FROM s LEFT JOIN f ON list_contains(string_split(s.patterns, ','), f.pattern_id) GROUP BY ALL"""
PLACES_SQL = f"""WITH w AS (SELECT DISTINCT keyword FROM (VALUES {_values([(x,) for p in PATTERNS.values() for x in (p.label, p.tooltip)] + [(x,) for x in catalog.KEYWORDS])}) t(keyword)),
 d AS (SELECT doc_id, {APPENDED} AS t FROM documents), g AS (SELECT doc_id, t, keyword, string_split(t, keyword) AS gs FROM d JOIN w ON contains(t, keyword)),
 u AS (SELECT doc_id, t, keyword, unnest(gs) AS g, unnest(range(len(gs))) AS k, len(gs) AS n FROM g),
 p AS (SELECT doc_id, t, keyword, k, n, CAST(sum(length(g) + length(keyword)) OVER (PARTITION BY doc_id, keyword ORDER BY k) AS BIGINT) AS e FROM u)
 SELECT doc_id, keyword, CAST(e - length(keyword) AS INTEGER) AS "start", CAST(e AS INTEGER) AS "end" FROM p WHERE k < n - 1
 AND NOT regexp_matches(substr(t, e - length(keyword), CASE WHEN e > length(keyword) THEN 1 ELSE 0 END), '[0-9A-Za-z_]') AND NOT regexp_matches(substr(t, e + 1, 1), '[0-9A-Za-z_]')"""
KEYWORDS_SQL = f"""SELECT w.keyword, count(p.doc_id) AS n_places, count(DISTINCT p.doc_id) AS n_docs
 FROM (SELECT DISTINCT keyword FROM (VALUES {_values([(x,) for p in PATTERNS.values() for x in (p.label, p.tooltip)] + [(x,) for x in catalog.KEYWORDS])}) t(keyword)) w LEFT JOIN ({PLACES_SQL}) p ON p.keyword = w.keyword GROUP BY ALL"""
PARITY_SQL = f"SELECT id, 'both' AS side FROM (VALUES {_values([(p,) for p in PATTERNS])}) t(id)"


def imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "documents").selectExpr("doc_id", "concat('é/', lang, ' .x', doc_id) AS name", "lang", "source")
    note = files.import_markdown(F.lit("citation"), F.lit("doi"), F.col("name"), F.col("source"), F.lit(None).cast("string"))
    return rows.select("doc_id", notes.import_path(F.lit("citation"), F.col("name")).alias("path"), note.alias("body"), notes.import_path(F.lit("a/b"), F.col("name")).alias("refused"))


IMPORTS_SQL = r"""SELECT doc_id, concat('imports/citation/é_', lang, '__x', doc_id, '.md') AS path,
 concat('# é/', lang, ' .x', doc_id, chr(10), chr(10), '- category: citation', chr(10), '- pattern: doi', chr(10), '- source_url: ', source, chr(10), '- source_title: ', chr(10), '- imported_by: glosslake', chr(10)) AS body,
 CAST(NULL AS VARCHAR) AS refused FROM documents"""

MINUTES = 60_000


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events")


def latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.latest(events(spark, sf_dir), F.col("user_id"), "event_id").select(F.col("state_key").alias("user_id"), "event_id", "event_type", "value", "n_updates")


LATEST_SQL = "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value, count(*) AS n_updates FROM events GROUP BY user_id"


def _throttle_sql(millis: int, strict: bool = False) -> str:
    apart = f"{'>' if strict else '>='} o + INTERVAL {millis} MILLISECOND"
    inside = f"{'<=' if strict else '<'} o + INTERVAL {millis} MILLISECOND"
    return f"""WITH RECURSIVE w AS (SELECT user_id, min(ts) AS o FROM events GROUP BY user_id
 UNION ALL SELECT w.user_id, (SELECT min(e.ts) FROM events e WHERE e.user_id = w.user_id AND e.ts {apart}) FROM w WHERE o IS NOT NULL)
SELECT w.user_id, o AS opened, count(*) AS n FROM w JOIN events e ON e.user_id = w.user_id AND e.ts >= o AND e.ts {inside} WHERE o IS NOT NULL GROUP BY ALL"""


def debounce_sql(millis: int) -> str:
    return f"""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER b < INTERVAL {millis} MILLISECOND THEN 0 ELSE 1 END AS new FROM events WINDOW b AS (PARTITION BY user_id ORDER BY ts)),
r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS run FROM g)
SELECT user_id, max(ts) AS settled, arg_max(value, ts) AS value, count(*) AS n FROM r GROUP BY user_id, run"""


def type_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.changes(events(spark, sf_dir), "user_id", "event_id", ["event_type"]).select("user_id", "event_id", "event_type")


CHANGES_SQL = "SELECT user_id, event_id, event_type FROM events QUALIFY event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id)"
CHIPS_SQL = f"{RANKED_SQL} SELECT page_id, category, count(*) AS n_groups FROM g GROUP BY ALL"
UNIQUE_SQL = f"{RANKED_SQL} SELECT page_id, count(*) AS n_unique, CAST(sum(mention_count) AS BIGINT) AS n_mentions, CASE WHEN count(*) < sum(mention_count) THEN concat('unique · ', CAST(sum(mention_count) AS BIGINT), ' mentions') ELSE 'unique' END AS label FROM g GROUP BY page_id"
REPRESENTATIVES_SQL = f"{RANKED_SQL} SELECT page_id, category, norm_text, seq, source, confidence FROM k WHERE place = 1"
_NATURAL_SQL = " UNION ALL ".join(f"SELECT '{p}' AS pattern_id, * FROM ({_scan_sql(PATTERNS[p]).replace(APPENDED, 'text')})" for p in PATTERNS if p not in ("physics.units",))
NATURAL_SQL = f"SELECT pattern_id, count(*) AS n FROM ({_NATURAL_SQL}) GROUP BY pattern_id"


#: Another head for each sixth of the pages: the kinds that ``HEAD`` leaves out, and near misses.
VARIANTS = """CASE page_id % 6
 WHEN 0 THEN concat('<meta name="citation_arxiv_id" content="2401.', lpad(concat('', page_id % 100000), 5, '0'), '"><link rel="canonical" href="/abs/2402.00001v3">')
 WHEN 1 THEN concat('<META NAME="citation_doi_url" content="https://doi.org/10.1/no"><meta name="citation_doi_url" content="https://doi.org/10.1234/u', page_id, '">')
 WHEN 2 THEN concat('<meta property="og:see_also" content="doi:10.4321/s', page_id, '?q"><meta property="og:title" content="10.4321/no">')
 WHEN 3 THEN concat('<div itemscope itemtype="https://schema.org/Person"><i itemprop="doi">10.9999/no</i></div><section itemscope><img itemprop="sameAs" src="https://arxiv.org/pdf/2403.', lpad(concat('', page_id % 100000), 5, '0'), '"></section>')
 WHEN 4 THEN concat('<a href="https://www.ncbi.nlm.nih.gov/pmc/articles/PMC', 1000 + page_id, '/">a</a><a href=" https://www.ncbi.nlm.nih.gov/pmc/articles/PMC', 1000 + page_id, '/ ">b</a><a href="https://www.biorxiv.org/content/10.1101/', page_id, '#x">c</a>')
 ELSE concat('<script type="application/ld+json">[{"sameAs":{"url":"10.6666/w', page_id, '"},"description":"', 2000000 + page_id, '","name":"10.6666/no"}]</script><link rel="canonical" href="https://host.example/none">') END"""


def source_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").selectExpr("page_id", "'https://arxiv.org/list/new?x=/y' AS url", f"concat({VARIANTS}, coalesce(html, '')) AS html")
    found = scanners.scan_sources(html.elements(html.parse_pages(pages)))
    return found.select("page_id", "pattern_id", "label", "text", "source", "confidence")


_PADDED = "lpad(concat('', page_id % 100000), 5, '0')"
VARIANT_ROWS = [
    (0, "arxiv.id", "citation_arxiv_id", f"concat('2401.', {_PADDED})", "meta", 1.0), (0, "arxiv.id", "canonical link arXiv", "'2402.00001v3'", "canonical", 0.9),
    (1, "doi.url", "citation_doi_url", "'https://doi.org/10.1/no'", "meta", 1.0), (1, "doi.url", "citation_doi_url", "concat('10.1234/u', page_id)", "meta", 1.0),
    (2, "doi", "og:url DOI", "concat('10.4321/s', page_id)", "opengraph", 0.85), (3, "arxiv.id", "microdata sameas", f"concat('2403.', {_PADDED})", "microdata", 0.85),
    (4, "pmcid", "anchor PMCID", "concat('PMC', 1000 + page_id)", "anchor", 0.6), (4, "doi", "anchor DOI", "concat('10.1101/', page_id)", "anchor", 0.6),
    (5, "doi", "JSON-LD DOI", "concat('10.6666/w', page_id)", "json-ld", 0.95), (5, "pmid", "JSON-LD PMID", "concat('', 2000000 + page_id)", "json-ld", 0.95),
]
VARIANTS_SQL = " UNION ALL ".join(f"{_source_sql([row])} WHERE page_id % 6 = {k}" for k, *row in VARIANT_ROWS)


def batch_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch sink: one JSON line for each text, in order of places, also for texts without a finding."""
    items = appended(spark, sf_dir).selectExpr("doc_id AS item", "CASE WHEN doc_id % 3 = 0 THEN 'nothing' ELSE text END AS text")
    found = scan.scan_text(items, ["item"], sets=["citations"])
    return files.results_json(files.batch_results(items, found))


def _batch_sql() -> str:
    kinds = " ".join(f"WHEN '{p.id}' THEN '{p.category}'" for p in CATALOG.patterns(["citations"]))
    one = f"""concat('{{"patternId":"', pattern_id, '","category":"', CASE pattern_id {kinds} END, '","text":"', f.text, '","start":', f."start", ',"end":', f."end", '}}')"""
    return f"""SELECT d.doc_id AS item, concat('{{"findings":[', coalesce(string_agg({one}, ',' ORDER BY f."start", f."end") FILTER (WHERE f.pattern_id IS NOT NULL), ''), ']}}') AS json
FROM documents d LEFT JOIN ({_overlap_sql(["citations"])}) f ON f.doc_id = d.doc_id AND d.doc_id % 3 <> 0 GROUP BY d.doc_id"""


#: Examples whose outcome follows from the document's id: right ones, a wrong expectation, a missing finding and two negatives.
GOLD = """SELECT doc_id AS example, CASE doc_id % 5 WHEN 3 THEN 'cs.dataset' WHEN 4 THEN 'math.equation' ELSE 'doi' END AS pattern,
 CASE doc_id % 5 WHEN 0 THEN concat('See 10.1234/g', doc_id, ' and 10.1234/later.') WHEN 1 THEN concat('See 10.1234/g', doc_id, ' here.') WHEN 2 THEN 'No number here.'
  WHEN 3 THEN 'On ImageNet only.' ELSE concat('JAMA 2023;', doc_id, '(2):201') END AS text,
 CASE doc_id % 5 WHEN 0 THEN concat('10.1234/g', doc_id) WHEN 1 THEN '10.1234/other' WHEN 2 THEN '10.1234/missing' END AS expect, doc_id % 5 = 3 AS expect_null FROM documents"""


def gold_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = spark.sql(GOLD.replace("FROM documents", "FROM {documents}"), documents=_table(spark, sf_dir, "documents"))
    return evaluate.outcomes(gold, scan.scan_text(gold, ["example"])).select("example", "pattern", "expect", "got", "outcome", "reason")


GOLD_SQL = f"""SELECT example, pattern, expect, CASE example % 5 WHEN 0 THEN expect WHEN 1 THEN concat('10.1234/g', example) WHEN 3 THEN 'ImageNet' END AS got,
 CASE example % 5 WHEN 0 THEN 'tp' WHEN 1 THEN 'fp' WHEN 2 THEN 'fn' WHEN 3 THEN 'fp' ELSE 'tn' END AS outcome,
 CASE example % 5 WHEN 1 THEN 'fp-mismatch' WHEN 2 THEN 'fn' WHEN 3 THEN 'fp' END AS reason FROM ({GOLD})"""


def eval_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.report_lines(evaluate.prf(evaluate.confusion(outcomes(spark, sf_dir))))


REPORT_SQL = f"""SELECT pattern, concat('| `', pattern, '` | ', tp, ' | ', fp, ' | ', fn, ' | ', tn, ' | ', printf('%.2f', p), ' | ', printf('%.2f', r), ' | ', printf('%.2f', f), ' |') AS line
FROM (SELECT *, {PRF_COLUMNS} FROM ({CONFUSION}))"""


def state_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    state_of = latest_state(spark, sf_dir).where("user_id % 3 <> 0").select("user_id", "event_type", "n_updates")
    asked = _table(spark, sf_dir, "events").selectExpr("user_id").distinct()
    return lookup.state_or_default(asked, state_of, "user_id", {"event_type": "", "n_updates": 0}).withColumn("n_updates", F.col("n_updates").cast("long"))


LOOKUP_SQL = f"""SELECT user_id, CASE WHEN user_id % 3 <> 0 THEN event_type ELSE '' END AS event_type, CASE WHEN user_id % 3 <> 0 THEN n_updates ELSE 0 END AS n_updates FROM ({LATEST_SQL})"""


def active_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    settings = _table(spark, sf_dir, "events").selectExpr("user_id", "user_id % 4 = 0 AS paused").distinct()
    return lookup.active(events(spark, sf_dir), settings, "user_id").select("event_id", "user_id")


def finding_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = findings(spark, sf_dir).withColumn("end", F.col("start") + F.length("text"))
    asked = findings(spark, sf_dir).selectExpr("page_id", "concat(start, '-', CASE WHEN page_id % 2 = 0 THEN start + length(text) ELSE -1 END) AS place").distinct()
    return lookup.at_place(rows, asked)


FINDING_AT_SQL = f"""WITH f AS (SELECT *, start + length(text) AS e FROM ({FINDINGS})), a AS (SELECT DISTINCT page_id, concat(start, '-', CASE WHEN page_id % 2 = 0 THEN e ELSE -1 END) AS place FROM f),
g AS (SELECT page_id, concat(start, '-', e) AS place, arg_min(text, seq) AS copied FROM f GROUP BY ALL)
SELECT a.page_id, a.place, copied IS NOT NULL AS ok, copied, CASE WHEN copied IS NULL THEN 'Finding not found' END AS error FROM a LEFT JOIN g ON a.page_id = g.page_id AND a.place = g.place"""


def models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The models that may be offered, and how many of the given vectors have their length."""
    sizes = _table(spark, sf_dir, "embeddings").groupBy(F.size("embedding").alias("dimensions")).agg(F.count(F.lit(1)).alias("n_vectors"))
    return replies.available_models(spark).join(sizes, "dimensions", "left").select("ord", "id", "label", "dimensions", F.coalesce("n_vectors", F.lit(0).cast("long")).alias("n_vectors"))


def message_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field of a message by its type, and the state that a reply tells."""
    payload = F.expr("""CASE event_id % 4 WHEN 0 THEN concat('{"url":"', event_type, '","findings":[', props, ',', props, ']}') WHEN 1 THEN '{"url":7,"findings":"x"}' WHEN 2 THEN 'broken{' END""")
    ok = F.expr("CASE WHEN event_id % 5 < 3 THEN false WHEN event_id % 5 = 3 THEN true END")
    error = F.expr("CASE event_id % 5 WHEN 0 THEN 'Model NOT loaded' WHEN 1 THEN 'still loading' END")
    status = replies.status_text(replies.model_status(ok, error))
    return events(spark, sf_dir).select("event_id", replies.pluck_string(payload, "url", "none").alias("url"), F.size(replies.pluck_list(payload, "findings")).alias("n_findings"), status.alias("status"))


FIELDS_SQL = """SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_type ELSE 'none' END AS url, CAST(CASE event_id % 4 WHEN 0 THEN 2 ELSE 0 END AS INTEGER) AS n_findings,
 CASE event_id % 5 WHEN 1 THEN concat('status:   loading', chr(10), 'modelId:  multilingual', chr(10), 'uptime:   0.0 s') WHEN 2 THEN concat('status:   error', chr(10), 'modelId:  multilingual', chr(10), 'error:    unknown error')
  WHEN 3 THEN concat('status:   loaded', chr(10), 'modelId:  multilingual', chr(10), 'uptime:   0.0 s') ELSE 'status:   off' END AS status FROM events"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import extended

    out = extended.queries() | {"scan_" + p.id.replace(".", "_").lower(): scan_query(p) for p in PATTERNS.values()}
    out |= {k: source_query(f) for k, f in SCANNERS.items()} | {"source_all": source_query(scanners.scan_sources)}
    return out | {
        "scan_counts": flagship, "overlap_resolve": overlap_resolve, "scan_natural_counts": natural_counts, "sentence_split_counts": sentence_counts, "marked_sentences": marked_sentences,
        "dedupe_groups": dedupe_groups, "dedupe_representatives": representatives,
        "category_chips": lambda s, d: dedupe.category_chips(findings(s, d)), "unique_vs_mentions": lambda s, d: dedupe.unique_vs_mentions(findings(s, d)),
        "link_plan": link_plan, "anchor_distinct_href": hrefs, "page_report": page_report, "page_categories": page_categories,
        "eval_prf": eval_prf, "eval_macro_micro": eval_macro_micro, "eval_failures_top5": eval_failures,
        "cosine_topk": cosine_topk, "vector_norms": vector_norms, "catalog_sets": catalog_sets, "catalog_keywords": catalog_keywords, "catalog_parity": catalog_parity,
        "import_render": imports, "latest_state_per_user": latest_state,
        "throttle": lambda s, d: state.throttle(events(s, d), "user_id", "ts", 600 * MINUTES),
        "cooldown": lambda s, d: state.cooldown(events(s, d), "user_id", "ts", 900 * MINUTES),
        "debounce_sessions": lambda s, d: state.debounce(events(s, d), "user_id", "ts", "value", 600 * MINUTES),
        "state_changes": type_changes, "source_variants": source_variants, "batch_results": batch_results, "gold_outcomes": gold_outcomes, "eval_report": eval_report,
        "state_lookup": state_lookup, "active_events": active_events, "finding_at_place": finding_at, "available_models": models, "message_fields": message_fields,
    }


def oracle_sql() -> dict[str, str]:
    from . import extended

    out = extended.oracle_sql() | {"scan_" + p.id.replace(".", "_").lower(): _scan_sql(p) for p in PATTERNS.values() if p.id != "physics.units"}
    out |= {k: _source_sql(rows) for k, rows in SOURCE_ROWS.items()} | {"source_all": _source_sql([r for rows in SOURCE_ROWS.values() for r in rows])}
    return out | {
        "overlap_resolve": _overlap_sql(["citations"]), "scan_physics_units": _units_sql(), "scan_counts": COUNTS_SQL, "sentence_split_counts": SPLIT_SQL, "marked_sentences": MARKED_SQL,
        "scan_natural_counts": NATURAL_SQL, "dedupe_groups": DEDUPE_SQL, "dedupe_representatives": REPRESENTATIVES_SQL, "category_chips": CHIPS_SQL, "unique_vs_mentions": UNIQUE_SQL,
        "link_plan": LINK_SQL, "anchor_distinct_href": "SELECT DISTINCT page_id, trim(href) AS href FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS href FROM pages) WHERE trim(href) <> ''",
        "eval_prf": PRF_SQL, "eval_macro_micro": MACRO_SQL, "eval_failures_top5": FAILURES_SQL, "cosine_topk": COSINE_SQL, "vector_norms": NORMS_SQL,
        "catalog_sets": SETS_SQL, "catalog_keywords": KEYWORDS_SQL, "catalog_parity": PARITY_SQL, "import_render": IMPORTS_SQL, "latest_state_per_user": LATEST_SQL,
        "throttle": _throttle_sql(600 * MINUTES), "cooldown": f"SELECT user_id, opened AS fired FROM ({_throttle_sql(900 * MINUTES, True)})", "debounce_sessions": debounce_sql(600 * MINUTES), "state_changes": CHANGES_SQL,
        "source_variants": VARIANTS_SQL, "batch_results": _batch_sql(), "gold_outcomes": GOLD_SQL, "eval_report": REPORT_SQL, "state_lookup": LOOKUP_SQL,
        "active_events": "SELECT event_id, user_id FROM events WHERE user_id % 4 <> 0", "finding_at_place": FINDING_AT_SQL,
        "available_models": "SELECT CAST(0 AS INTEGER) AS ord, 'multilingual' AS id, 'Multilingual (~25 MB)' AS label, CAST(384 AS INTEGER) AS dimensions, (SELECT count(*) FROM embeddings WHERE len(embedding) = 384) AS n_vectors", "message_fields": FIELDS_SQL,
    }

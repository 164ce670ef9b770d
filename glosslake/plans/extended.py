"""More named queries and their SQL: triggers and reports over time, the vault, marked texts, keywords, reports of failures."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import replies, text
from ..functions.catalog import Catalog, Falsifier, Pattern, PatternSet
from ..operators import evaluate, harvest, pivots, render, scan, search
from ..sources import downloads, files, html
from ..streaming import triggers
from . import pages as page_plan
from . import queries as q

MINUTES = 60_000
SETTLE, POLL, EXPIRE = 720 * MINUTES, 360 * MINUTES, 900 * MINUTES

# Page events from the event table: three kinds open a page of that name, one pauses and one resumes.
PAGE_EVENTS = """SELECT user_id, ts, event_id, CASE WHEN event_type IN ('view', 'click', 'purchase') THEN event_type END AS url,
 CASE event_type WHEN 'error' THEN TRUE WHEN 'signup' THEN FALSE END AS paused, event_type, CAST(floor(value) AS BIGINT) % 3 AS mentions FROM events"""


def page_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(PAGE_EVENTS.replace("FROM events", "FROM {events}"), events=q.events(spark, sf_dir))


def rescans(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = triggers.rescan_triggers(page_events(spark, sf_dir), "user_id", "ts", "event_id", "url", "paused", SETTLE, POLL)
    return out.withColumn("at", F.unix_micros(F.col("at").cast("timestamp")))


RESCANS_SQL = f"""WITH e AS (SELECT *, epoch_us(ts) AS w, min(epoch_us(ts)) OVER (PARTITION BY user_id) AS t0 FROM ({PAGE_EVENTS})),
p AS (SELECT DISTINCT user_id, t0 AS w, 'first' AS cause FROM e UNION ALL SELECT DISTINCT user_id, t0 + {SETTLE * 1000}, 'settled' FROM e),
s AS (SELECT user_id, t0, (w - t0 + {POLL * 1000 - 1}) // {POLL * 1000} AS tick, arg_max(url, (w, event_id)) AS url FROM e WHERE url IS NOT NULL GROUP BY ALL),
m AS (SELECT user_id, t0 + tick * {POLL * 1000} AS w, 'url' AS cause FROM s QUALIFY lag(url) OVER (PARTITION BY user_id ORDER BY tick) <> url),
f AS (SELECT user_id, w, event_id, paused, lag(paused) OVER (PARTITION BY user_id ORDER BY w, event_id) AS was FROM e WHERE paused IS NOT NULL)
SELECT user_id, w AS "at", cause FROM (SELECT * FROM p UNION ALL SELECT * FROM m) x
WHERE NOT coalesce((SELECT arg_max(f.paused, (f.w, f.event_id)) FROM f WHERE f.user_id = x.user_id AND f.w <= x.w), FALSE)
UNION ALL SELECT user_id, w, 'resume' AS cause FROM f WHERE was AND NOT paused"""


def repaints(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = triggers.report_changes(page_events(spark, sf_dir), "user_id", "ts", "event_id", ["event_type", "mentions"], EXPIRE)
    return out.select("user_id", "event_id", "event_type", "mentions")


REPAINTS_SQL = f"""SELECT user_id, event_id, event_type, mentions FROM ({PAGE_EVENTS}) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id) QUALIFY NOT coalesce(
 event_type = lag(event_type) OVER w AND mentions IS NOT DISTINCT FROM lag(mentions) OVER w AND ts - lag(ts) OVER w <= INTERVAL {EXPIRE} MILLISECOND, FALSE)"""


def plan_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The requests that the link plan makes, with a place of their own."""
    made = F.struct("url", "filename", "format", "status")
    # Exploded, so that each long expression is evaluated once and not in every condition on it.
    rows = q.link_plan(spark, sf_dir).select("page_id", "seq", F.explode(F.array(made)).alias("p")).select("page_id", "seq", "p.*").where("status = 'planned'")
    return rows.select("page_id", "seq", "url", F.lit("citation").alias("category"), "filename", "format")


def pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is still to be fetched: the vault has every seventh page's files, some of them too small to count."""
    plan = plan_rows(spark, sf_dir)
    papers = plan.where("page_id % 7 = 0").select("category", F.concat_ws(".", "filename", "format").alias("filename"), (F.col("seq") % 5000).alias("size"))
    papers = papers.repartition("category", "filename").groupBy("category", "filename").agg(F.min("size").alias("size"))
    return files.pending_downloads(plan, papers).select("page_id", "seq", "url", "filename", "format")


PENDING_SQL = f"""WITH p AS (SELECT * FROM ({q.LINK_SQL}) WHERE status = 'planned'), v AS (SELECT filename, format, min(seq % 5000) AS size FROM p WHERE page_id % 7 = 0 GROUP BY ALL)
SELECT page_id, seq, url, filename, format FROM p WHERE url <> '' AND NOT regexp_matches(filename, '[/\\\\]|^\\.') AND NOT EXISTS (SELECT 1 FROM v WHERE v.filename = p.filename AND v.format = p.format AND v.size > {downloads.LEAST_BYTES})"""

# Requests with every fault, by the document's id.
REQUESTS = """SELECT doc_id AS seq, doc_id % 5 AS batch, CASE WHEN doc_id % 7 = 0 THEN '' ELSE concat('https://h.example/', doc_id) END AS url, CASE WHEN doc_id % 11 = 0 THEN '../x' ELSE lang END AS category,
 CASE doc_id % 6 WHEN 0 THEN concat('.f', doc_id) WHEN 1 THEN concat('a/', doc_id) ELSE concat('f', doc_id) END AS filename, CASE doc_id % 4 WHEN 0 THEN 'exe' WHEN 1 THEN 'html' ELSE 'pdf' END AS format FROM documents"""


def refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of each batch of requests before anything is fetched: how many are refused, and the answers in order."""
    rows = spark.sql(REQUESTS.replace("FROM documents", "FROM {documents}"), documents=q._table(spark, sf_dir, "documents"))
    error = downloads.refusal(*(F.col(c) for c in downloads.REQUEST))
    answers = rows.withColumns({"error": error, "ok": error.isNull(), "path": F.when(error.isNull(), downloads.vault_path("vault")), "size": F.lit(None).cast("long"), "skipped": F.lit(None).cast("string")})
    out = downloads.batch_answers(answers)
    return out.select("batch", "ok", "n", F.array_join(F.transform("results", lambda r: F.coalesce(r["error"], r["path"])), "; ").alias("answers"))


REFUSALS_SQL = f"""WITH r AS (SELECT *, CASE WHEN coalesce(url, '') = '' OR coalesce(category, '') = '' OR coalesce(filename, '') = '' OR coalesce(format, '') = '' THEN 'missing required field'
 WHEN format NOT IN ('pdf', 'html') THEN concat('unsupported format: ', format) WHEN regexp_matches(filename, '[/\\\\]|^\\.') THEN concat('unsafe filename: ''', filename, '''')
 WHEN NOT regexp_full_match(category, '[A-Za-z0-9_-]+') THEN concat('unsafe category: ''', category, '''') END AS error FROM ({REQUESTS}))
SELECT batch, bool_and(error IS NULL) AS ok, count(*) AS n, string_agg(coalesce(error, concat('vault/papers/', category, '/', filename, '.', format)), '; ' ORDER BY seq) AS answers FROM r GROUP BY batch"""


def highlighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts with their findings and sentences marked, and whether taking the marks away gives the text back."""
    docs = q.appended(spark, sf_dir)
    marked = render.render(docs, ["doc_id"], scan.scan_text(docs, ["doc_id"], sentences=True))
    return marked.join(docs.select("doc_id", F.col("text").alias("_t")), "doc_id").select("doc_id", "html", (render.unwrapped(F.col("html")) == F.col("_t")).alias("same"))


_ESC = "replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"
_LABELS = " ".join(f"WHEN '{p.id}' THEN '{p.label}'" for p in q.PATTERNS.values())
HIGHLIGHTED_SQL = f"""WITH d AS (SELECT doc_id, {q.APPENDED} AS t FROM documents), m AS ({q.MARKED_SQL}), f AS ({q._overlap_sql()}),
c AS (SELECT doc_id, s, e, text, pattern_id, list_sort(list_distinct(list_concat([s, e], coalesce(bs, [])))) AS cuts FROM (
  SELECT f.doc_id, f."start" AS s, f."end" AS e, f.text, f.pattern_id, list(m.b) FILTER (WHERE m.b IS NOT NULL) AS bs
  FROM f LEFT JOIN (SELECT doc_id, "start" AS b FROM m UNION ALL SELECT doc_id, "end" FROM m) m ON m.doc_id = f.doc_id AND m.b > f."start" AND m.b < f."end" GROUP BY ALL)),
k AS (SELECT doc_id, unnest(cuts[1:len(cuts) - 1]) AS s, unnest(cuts[2:]) AS e, concat('<span class="gl-highlight gl-highlight-', CASE pattern_id {q._KINDS} END, '" title="', {_ESC.format(f"concat(CASE pattern_id {_LABELS} END, ': ', text)")}, '">') AS tag FROM c),
x AS (SELECT doc_id, "start" AS pos, 2 AS r, '<mark class="gl-sentence">' AS tag FROM m UNION ALL SELECT doc_id, "end", 1, '</mark>' FROM m UNION ALL SELECT doc_id, s, 3, tag FROM k UNION ALL SELECT doc_id, e, 0, '</span>' FROM k),
o AS (SELECT x.doc_id, pos, r, tag, coalesce(lag(pos) OVER (PARTITION BY x.doc_id ORDER BY pos, r), 0) AS b, t FROM x JOIN d ON d.doc_id = x.doc_id)
SELECT doc_id, concat(string_agg(concat({_ESC.format("substr(t, b + 1, pos - b)")}, tag), '' ORDER BY pos, r), {_ESC.format("substr(any_value(t), max(pos) + 1)")}) AS html, TRUE AS same FROM o GROUP BY doc_id"""


def finding_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every finding with the number of the sentence that holds it whole."""
    met = scan.scan_text(q.appended(spark, sf_dir), ["doc_id"], sentences=True)
    return met.select("doc_id", "pattern_id", "start", "end", F.col("sentence.sent").alias("sent"))


FINDING_SENTENCES_SQL = f"""SELECT f.doc_id, f.pattern_id, f."start", f."end", CAST(s.sent AS INTEGER) AS sent FROM ({q._overlap_sql()}) f
 LEFT JOIN {q._sentences_sql()} s ON s.doc_id = f.doc_id AND s.b <= f."start" AND f."end" <= s.e"""


def keyword_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = [r["keyword"] for r in q.catalog.keywords(q.CATALOG, spark).collect()]  # the catalog's own list
    return harvest.places(q.appended(spark, sf_dir), ["doc_id"], words)


#: One pattern that is no match in a sentence that names a collider.
EXCLUDED = Catalog(PatternSet("own", "Own", (Pattern("own.energy", "Energy", "physics", r"\b\d+ GeV\b", exclude_in_sentence=("collider", "beam")),)))
ENERGIES = "concat(coalesce(text, ''), '. The collider had ', doc_id, ' GeV. It gave ', doc_id + 1, ' GeV', CASE WHEN doc_id % 3 = 0 THEN ' of BEAM' ELSE ' beams' END, '. At ', doc_id, ' GeV')"


def excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = q._table(spark, sf_dir, "documents").selectExpr("doc_id", f"{ENERGIES} AS text")
    return scan.scan_text(docs, ["doc_id"], catalog=EXCLUDED).select("doc_id", "text", "start", "end")


EXCLUDED_SQL = f"""WITH d AS (SELECT doc_id, {ENERGIES} AS t FROM documents)
SELECT doc_id, concat(doc_id, ' GeV') AS text, CAST(length(t) - length(concat(doc_id, ' GeV')) AS INTEGER) AS "start", CAST(length(t) AS INTEGER) AS "end" FROM d
UNION ALL SELECT doc_id, concat(doc_id + 1, ' GeV'), CAST(length(t) - length(concat(doc_id + 1, ' GeV beams. At ', doc_id, ' GeV')) AS INTEGER), CAST(length(t) - length(concat(' beams. At ', doc_id, ' GeV')) AS INTEGER) FROM d WHERE doc_id % 3 <> 0"""


#: A finding of a text has a confidence of 0.7: one pattern drops what is below that, the other what is below 0.8.
DOUBTED = Catalog(PatternSet("own", "Own", (
    Pattern("own.kept", "Kept", "default", r"\bZX1\b", falsifiers=(Falsifier("confidence", below=0.7),)),
    Pattern("own.dropped", "Dropped", "default", r"\bZX2\b", falsifiers=(Falsifier("confidence", below=0.8),)),
)))


def doubted(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = q._table(spark, sf_dir, "documents").selectExpr("doc_id", "concat(coalesce(text, ''), '. Both ZX1 and ZX2') AS text")
    return scan.scan_text(docs, ["doc_id"], catalog=DOUBTED).select("doc_id", "pattern_id", "start", "end")


DOUBTED_SQL = """SELECT doc_id, 'own.kept' AS pattern_id, CAST(length(coalesce(text, '')) + 7 AS INTEGER) AS "start", CAST(length(coalesce(text, '')) + 10 AS INTEGER) AS "end" FROM documents"""


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How whole texts are shown and named: shortened, as a file name, and under an id of their language and source."""
    c = F.col
    return q._table(spark, sf_dir, "documents").select(
        "doc_id", text.shortened(c("text")).alias("shown"), text.safe_name(c("text")).alias("file"), text.display_id(c("lang"), F.concat_ws(".", "source", "doc_id")).alias("display_id")
    )


NAMES_SQL = r"""SELECT doc_id, CASE WHEN length(text) > 80 THEN concat(substr(text, 1, 77), '…') ELSE text END AS shown, substr(regexp_replace(text, '[^\p{L}\p{N}_-]', '_', 'g'), 1, 80) AS file,
 concat(lang, '.', doc_id) AS display_id FROM documents"""


def parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of the head's own texts that their elements leave: not in code, not in headings."""
    found = page_plan.scan_nodes(html.text_nodes(html.parse_pages(q.headed(spark, sf_dir))))
    return found.where("text IN ('TP53', 'BRCA1', '2401.00001', '2401.00002') AND pattern_id IN ('bio.gene', 'arxiv.id')").select("page_id", "pattern_id", "text")


PARENTS_SQL = "SELECT page_id, unnest(['bio.gene', 'arxiv.id']) AS pattern_id, unnest(['TP53', '2401.00001']) AS text FROM pages"


def pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean of each label's vectors, every third one masked, of unit length."""
    rows = q._table(spark, sf_dir, "embeddings").selectExpr("label", "CASE WHEN vec_id % 3 = 0 THEN 0 ELSE 1 END AS mask", "embedding AS v")
    return search.mean_pool(rows, "label").select("label", F.posexplode("vector").alias("i", "x")).select("label", "i", F.round("x", 6).alias("x"))


POOLED_SQL = """WITH e AS (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(range(len(embedding))) AS i FROM embeddings WHERE vec_id % 3 <> 0), m AS (SELECT label, i, avg(x) AS x FROM e GROUP BY ALL)
SELECT label, CAST(i AS INTEGER) AS i, round(x / sqrt(sum(x * x) OVER (PARTITION BY label)), 6) AS x FROM m"""

STORED = "SELECT user_id, max(CASE WHEN event_type = 'error' THEN TRUE END) AS paused, max(CASE WHEN event_type = 'signup' AND value > 30 THEN event_type END) AS model FROM events GROUP BY user_id"
DEFAULTS = {"paused": False, "model": "multilingual", "keywords": False}


def settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replies.with_defaults(spark.sql(STORED.replace("FROM events", "FROM {events}"), events=q.events(spark, sf_dir)), DEFAULTS)


SETTINGS_SQL = f"SELECT user_id, coalesce(paused, FALSE) AS paused, coalesce(model, 'multilingual') AS model, FALSE AS keywords FROM ({STORED})"


def document(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = spark.sql(q.GOLD.replace("FROM documents", "FROM {documents}"), documents=q._table(spark, sf_dir, "documents"))
    return evaluate.report_document(evaluate.outcomes(gold, scan.scan_text(gold, ["example"])))


_COUNTED = "SELECT pattern, " + ", ".join(f"CAST(count(*) FILTER (WHERE outcome = '{o}') AS BIGINT) AS {o}" for o in ("tp", "fp", "fn", "tn")) + f" FROM ({q.GOLD_SQL}) GROUP BY pattern"
_THREE = "printf('%.3f', {})"
DOCUMENT_SQL = f"""WITH o AS (SELECT g.*, d.text FROM ({q.GOLD_SQL}) g JOIN ({q.GOLD}) d ON d.example = g.example), c AS (SELECT *, {q.PRF_COLUMNS} FROM ({_COUNTED})),
s AS (SELECT avg(p) AS mp, avg(r) AS mr, avg(f) AS mf, sum(tp) / nullif(sum(tp) + sum(fp), 0) AS p, sum(tp) / nullif(sum(tp) + sum(fn), 0) AS r, count(*) AS n FROM c),
k AS (SELECT *, row_number() OVER (PARTITION BY pattern ORDER BY example) AS place FROM o WHERE reason IS NOT NULL QUALIFY place <= 5)
SELECT * FROM (VALUES (0, '', 0, '# Gold set evaluation'), (1, '', 0, '## Per-pattern metrics'), (1, '', 1, '{evaluate.REPORT_HEAD[0]}'), (1, '', 2, '{evaluate.REPORT_HEAD[1]}'), (2, '', 0, '## Totals'), (3, '', 0, '## Failure samples (first 5 per pattern)')) t(section, pattern, place, line)
UNION ALL SELECT 1, pattern, 3, concat('| `', pattern, '` | ', tp, ' | ', fp, ' | ', fn, ' | ', tn, ' | ', printf('%.2f', p), ' | ', printf('%.2f', r), ' | ', printf('%.2f', f), ' |') FROM c
UNION ALL SELECT 2, '', 1, concat('- Macro P/R/F1: ', {_THREE.format("mp")}, ' / ', {_THREE.format("mr")}, ' / **', {_THREE.format("mf")}, '**') FROM s
UNION ALL SELECT 2, '', 2, concat('- Micro P/R/F1: ', {_THREE.format("p")}, ' / ', {_THREE.format("r")}, ' / ', {_THREE.format("2 * p * r / (p + r)")}) FROM s
UNION ALL SELECT 2, '', 3, concat('- Patterns evaluated: ', n) FROM s
UNION ALL SELECT DISTINCT 3, pattern, 0, concat('### `', pattern, '`') FROM k
UNION ALL SELECT 3, pattern, CAST(place AS INTEGER), concat('- **', reason, '**: text=`''', text, '''` expected=`', CASE WHEN expect IS NULL THEN 'None' ELSE concat('''', expect, '''') END, '` got=`', CASE WHEN got IS NULL THEN 'None' ELSE concat('''', got, '''') END, '`') FROM k"""


def cosine_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every twentieth vector's nearest ones, by the pivots' bounds."""
    rows = q._table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("ord"), F.col("embedding").alias("vector"))
    asked = rows.where("ord % 20 = 0").select(F.col("ord").alias("query_id"), F.col("vector").alias("q"))
    return q.rounded(pivots.find_similar_indexed(rows, asked), "similarity")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "rescan_triggers": rescans, "report_changes": repaints, "pending_downloads": pending, "download_refusals": refusals, "highlighted_html": highlighted, "finding_sentences": finding_sentences,
        "keyword_places": keyword_places, "excluded_in_sentence": excluded, "parent_falsified": parents, "mean_pooled": pooled, "settings_over_defaults": settings, "eval_document": document, "cosine_topk_indexed": cosine_indexed, "confidence_falsified": doubted, "display_names": names,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "rescan_triggers": RESCANS_SQL, "report_changes": REPAINTS_SQL, "pending_downloads": PENDING_SQL, "download_refusals": REFUSALS_SQL, "highlighted_html": HIGHLIGHTED_SQL, "finding_sentences": FINDING_SENTENCES_SQL,
        "keyword_places": q.PLACES_SQL, "excluded_in_sentence": EXCLUDED_SQL, "parent_falsified": PARENTS_SQL, "mean_pooled": POOLED_SQL, "settings_over_defaults": SETTINGS_SQL, "eval_document": DOCUMENT_SQL, "cosine_topk_indexed": q.COSINE_SQL, "confidence_falsified": DOUBTED_SQL, "display_names": NAMES_SQL,
    }

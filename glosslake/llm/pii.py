"""Personal data (native): expressions propose spans, checks confirm, context scores.

Proposals come from one expression for each kind; validators (octet ranges,
Luhn, digit counts, mod-97) confirm or drop them, and words just before a span
raise its score.  Spans of the base kinds stay whenever they are valid; the
method's own kinds (iban, telephone or social security numbers written without
a country code, the values of passwords and tokens, access keys with a known
prefix) stay if their score reaches ``MIN_SCORE``, nothing beside them makes
them part of something longer, and they don't touch a base span.

Everything is a DataFrame expression.  A text's matches are exploded with the
length of the gap before each, and offsets are running sums by document, so a
text with very many matches costs linear time.  Offsets are code points.

Defined cases: null text is empty: no spans and the hash of the empty string;
repeated rows are scanned one by one; a null doc_id is kept; an empty table
gives no rows; columns that the operator doesn't name are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import table

#: Possessive forms of the base expressions: they match the same spans, and
#: neither recurse nor go back on very long runs.  A match starts at a run's
#: start or where the last match ended.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: The method's own kinds match without looking around; what stands beside a match decides afterwards, without retries.
IBAN = r"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)"
LOCAL = r"(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}"
SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}"
KEY_NAME = r"(?:[Tt]oken|TOKEN|[Pp]assw(?:or)?d|PASSW(?:OR)?D|[Ss]ecret|SECRET|[Aa]pi[_-]?[Kk]ey|API[_-]?KEY|[Aa]ccess[_-]?[Kk]ey|ACCESS[_-]?KEY)"
SET_TO = r"[\x22\x27]?\x20?[=:]\x20?[\x22\x27]?"
#: The span is the value, group 1.
SECRET = rf"{KEY_NAME}{SET_TO}([A-Za-z0-9+/_.~-]{{8,}})"
ACCESS_KEY = r"(?:A[KS]IA[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,})"

OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
#: How many code points before a span are searched for context.
CONTEXT = 40
MIN_SCORE = 0.6
BONUS = 0.3

#: kind, expression, guard that is cheap to test, score without context, context words.
KINDS = [
    ("email", EMAIL, "@", 0.9, "e-?mail|contact|write|reach"),
    ("ip", IP, r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]", 0.6, "ip|host|server|address"),
    ("card", CARD, r"[0-9](?:[\x20-]?[0-9]){13}", 0.7, "card|visa|credit|payment"),
    ("phone", PHONE, r"\+[0-9]", 0.7, "phone|tel|call|mobile|fax"),
    ("iban", IBAN, r"[A-Z]{2}[0-9]{2}[\x20A-Z0-9]", 0.8, "iban|account|bank"),
    ("local_phone", LOCAL, r"[0-9]{3}[\x20.-][0-9]{4}", 0.4, "phone|tel|call|mobile|fax"),
    ("ssn", SSN, r"[0-9]{3}-[0-9]{2}-[0-9]{4}", 0.4, "ssn|social security"),
    ("secret", SECRET, rf"{KEY_NAME}{SET_TO}[A-Za-z0-9+/_.~-]", 0.6, "config|login|credential|auth"),
    ("access_key", ACCESS_KEY, r"A[KS]IA[A-Z0-9]{16}|gh[pousr]_|xox[abprs]-", 0.8, "aws|key|github|slack"),
]
BASE = 4
#: Characters that must not stand before and behind a match of the method's own kinds.
BESIDE = {
    "iban": ("[A-Za-z0-9]$", "^[A-Za-z0-9]"), "local_phone": ("[A-Za-z0-9.+-]$", "^[A-Za-z0-9]"), "ssn": ("[A-Za-z0-9.+-]$", "^[A-Za-z0-9-]"),
    "secret": ("[A-Za-z0-9]$", None), "access_key": ("[A-Za-z0-9]$", "^[A-Za-z0-9]"),
}
MASKS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "iban": "[IBAN]", "local_phone": "[PHONE]", "ssn": "[SSN]", "secret": "[SECRET]", "access_key": "[SECRET]"}


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def mod97(iban: Column) -> Column:
    """Remainder of an IBAN: the first four characters go to the end, A is 10."""
    plain = F.replace(iban, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4)))
    value = lambda c: F.when(c < "A", F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    step = lambda acc, c: (acc * F.when(c < "A", 10).otherwise(100) + value(c)) % 97
    return F.aggregate(F.split(turned, ""), F.lit(0), step)


def confirmed(kind: str, x: Column) -> Column:
    if kind == "ip":
        return F.rlike(x, F.lit(rf"^(?:{OCTET}\.){{3}}{OCTET}$"))
    if kind == "card":
        return F.length(digits(x)).between(14, 19) & F.when(F.length(digits(x)).between(14, 19), F.call_function("luhn_check", digits(x))).otherwise(False)
    if kind == "phone":
        return F.length(digits(x)).between(10, 15)
    if kind == "iban":
        return F.length(F.replace(x, F.lit(" "), F.lit(""))).between(15, 34) & (mod97(x) == 1)
    if kind == "ssn":
        return ~F.rlike(x, F.lit("^(?:000|666|9)")) & ~F.rlike(x, F.lit("-00-|-0000$"))
    if kind == "secret":
        return F.rlike(x, F.lit("[0-9]")) & F.rlike(x, F.lit("[A-Za-z]"))
    return F.lit(True)


def pieces(text: Column, rx: str) -> Column:
    """array<struct<m, g, n>>: each match, the gap before it and the gap behind it; the last has a null match."""
    gaps = F.split(text, rx, -1)
    return F.arrays_zip(F.regexp_extract_all(text, F.lit(rx), F.lit(0)).alias("m"), gaps.alias("g"), F.slice(gaps, F.lit(2), F.size(gaps)).alias("n"))


def value(kind: str, z: Column) -> Column:
    """What a match's span covers: all of it, or its end."""
    return F.regexp_extract(z["m"], SECRET, 1) if kind == "secret" else z["m"]


def stands_alone(kind: str, z: Column) -> Column:
    before, behind = BESIDE.get(kind, (None, None))
    ok = ~F.rlike(z["g"], F.lit(before)) if before else F.lit(True)
    return ok & ~F.rlike(z["n"], F.lit(behind)) if behind else ok


def in_context(z: Column, words: str) -> Column:
    return F.rlike(F.lower(F.right(z["g"], F.lit(CONTEXT))), F.lit(rf"(?:^|[^a-z0-9_])(?:{words})"))


def proposals(text: Column, k: int) -> Column:
    kind, rx, guard, score, words = KINDS[k]
    shape = "array<struct<k:int,i:int,gap:int,len:int,ok:boolean,score:double>>"
    own = F.transform(
        F.filter(pieces(text, rx), lambda z: z["m"].isNotNull()),
        lambda z, i: F.struct(
            F.lit(k).alias("k"), i.alias("i"), (F.length(z["g"]) + F.length(z["m"]) - F.length(value(kind, z))).alias("gap"), F.length(value(kind, z)).alias("len"),
            (confirmed(kind, value(kind, z)) & stands_alone(kind, z)).alias("ok"),
            F.least(F.lit(1.0), F.lit(score) + F.when(in_context(z, words), BONUS).otherwise(0.0)).alias("score"),
        ),
    )
    hit = F.contains(text, F.lit(guard)) if guard == "@" else F.rlike(text, F.lit(guard))
    return F.when(hit, own.cast(shape)).otherwise(F.array().cast(shape))


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id and spans, array of (start, k, end, kind, score), sorted, for every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("_row"), text.alias("_text"))
    found = F.concat(*(proposals(F.col("_text"), k) for k in range(len(KINDS))))
    each = rows.select("doc_id", "_row", F.explode_outer(found).alias("p")).select("doc_id", "_row", "p.*").repartition("_row")
    before = Window.partitionBy("_row", "k").orderBy("i")
    placed = each.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(before)).withColumn("start", F.col("end") - F.col("len"))
    kinds = F.array(*(F.lit(k[0]) for k in KINDS))
    stays = F.col("ok") & ((F.col("k") < BASE) | (F.col("score") >= MIN_SCORE))
    span = F.struct("start", "k", "end", kinds[F.col("k")].alias("kind"), "score")
    out = placed.groupBy("_row", "doc_id").agg(F.array_sort(F.collect_list(F.when(stays, span))).alias("all"))
    # A span of the method's own kinds goes where a base span ends after its start and starts before its end.
    # Spans are sorted: the running maximum of base ends, and the next base start, decide in one pass each.
    own = Window.partitionBy("_row").orderBy("start", "k")
    flat = (
        out.select("_row", "doc_id", F.explode_outer("all").alias("s")).select("_row", "doc_id", "s.*")
        .withColumn("_until", F.max(F.when(F.col("k") < BASE, F.col("end"))).over(own.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("_next", F.min(F.when(F.col("k") < BASE, F.col("start"))).over(own.rowsBetween(1, Window.unboundedFollowing)))
    )
    touches = (F.col("k") >= BASE) & (
        F.coalesce(F.col("_until") > F.col("start"), F.lit(False)) | F.coalesce(F.col("_next") < F.col("end"), F.lit(False))
    )
    keep = F.when(F.col("k").isNotNull() & ~touches, F.struct("start", "k", "end", "kind", "score"))
    return flat.groupBy("_row", "doc_id").agg(F.array_sort(F.collect_list(keep)).alias("spans")).drop("_row")


def redact(docs: DataFrame) -> DataFrame:
    """docs with ``text`` masked, kind after kind, in place.

    Each kind looks at the text in which the kinds before it are masked: what
    ``find_pii`` lists is masked, and so is what only becomes valid beside a mask.
    """
    out = docs
    for k in range(len(KINDS)):
        out = out.withColumn("text", _masked(F.col("text"), k))
    return out


def _masked(x: Column, k: int) -> Column:
    kind, rx, guard, score, words = KINDS[k]
    stays = lambda z: confirmed(kind, value(kind, z)) & stands_alone(kind, z) & (F.lit(score >= MIN_SCORE) | in_context(z, words))
    mask = lambda z: F.concat(F.left(z["m"], F.length(z["m"]) - F.length(value(kind, z))), F.lit(MASKS[kind]))
    piece = lambda z: F.concat(z["g"], F.when(z["m"].isNull(), "").when(stays(z), mask(z)).otherwise(z["m"]))
    hit = F.contains(x, F.lit(guard)) if guard == "@" else F.rlike(x, F.lit(guard))
    return F.when(hit, F.array_join(F.transform(pieces(x, rx), piece), "")).otherwise(x)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op7_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["k"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["k"] < BASE)
    return found.select(
        "doc_id", *(count(k).alias(f"n_{KINDS[k][0]}") for k in range(BASE)),
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
        F.size("spans").cast("long").alias("n_spans"),
    )


def _sql() -> str:
    """The same in DuckDB's SQL, with plain expressions for the base kinds."""
    plain = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "card": r"[0-9](?:[\x20-]?[0-9])+", "phone": PHONE,
        "iban": IBAN, "local_phone": LOCAL, "ssn": SSN, "secret": SECRET, "access_key": ACCESS_KEY,
    }
    valid = {
        "email": "TRUE",
        "ip": rf"regexp_full_match(v, '(?:{OCTET}\.){{3}}{OCTET}')",
        "card": "length(d) BETWEEN 14 AND 19 AND list_sum(list_transform(generate_series(1, CAST(length(d) AS INT)), lambda j:"
                " CASE WHEN (length(d) - j) % 2 = 0 THEN CAST(substr(d, j, 1) AS INT)"
                " ELSE (2 * CAST(substr(d, j, 1) AS INT)) % 10 + (2 * CAST(substr(d, j, 1) AS INT)) // 10 END)) % 10 = 0",
        "phone": "length(d) BETWEEN 10 AND 15",
        "iban": "length(replace(v, ' ', '')) BETWEEN 15 AND 34 AND list_reduce(list_transform(string_split(substr(replace(v, ' ', ''), 5) || substr(v, 1, 4), ''), lambda c:"
                " CASE WHEN c < 'A' THEN ascii(c) - 48 ELSE ascii(c) - 55 END), lambda a, x: (a * CASE WHEN x < 10 THEN 10 ELSE 100 END + x) % 97) = 1",
        "local_phone": "TRUE",
        "ssn": "NOT regexp_matches(v, '^(?:000|666|9)') AND NOT regexp_matches(v, '-00-|-0000$')",
        "secret": "regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]')",
        "access_key": "TRUE",
    }
    parts = []
    for k, (kind, rx, _, score, words) in enumerate(KINDS):
        rx = plain[kind]
        own = f"regexp_extract(m, '{rx}', 1)" if kind == "secret" else "m"
        before, behind = BESIDE.get(kind, (None, None))
        more = f" AND NOT regexp_matches(g, '{before}')" * bool(before) + f" AND NOT regexp_matches(n, '{behind}')" * bool(behind)
        more += rf" AND regexp_matches(lower(right(g, {CONTEXT})), '(?:^|[^a-z0-9_])(?:{words})')" * (score < MIN_SCORE)
        parts.append(f"""
  SELECT r, {k} AS k, '{kind}' AS kind, e - length(v) AS s, e FROM (
    SELECT r, g, n, m, {own} AS v, regexp_replace(m, '[^0-9]', '', 'g') AS d, sum(length(g) + length(m)) OVER (PARTITION BY r ORDER BY i) AS e FROM (
      SELECT r, unnest(ms) AS m, unnest(gs[1:len(ms)]) AS g, unnest(gs[2:]) AS n, unnest(range(len(ms))) AS i FROM (
        SELECT r, regexp_extract_all(t, '{rx}') AS ms, string_split_regex(t, '{rx}') AS gs FROM d)))
  WHERE {valid[kind]}{more}""")
    count = ", ".join(f"count(*) FILTER (k = {k}) AS n_{KINDS[k][0]}" for k in range(BASE))
    text = lambda some: f"coalesce(string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s, k){some}, '')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents), a AS ({" UNION ALL ".join(parts)}),
f AS (SELECT * FROM a WHERE k < {BASE} OR NOT EXISTS (SELECT 1 FROM a b WHERE b.r = a.r AND b.k < {BASE} AND b.s < a.e AND b.e > a.s)),
g AS (SELECT r, {count}, {text(f" FILTER (k < {BASE})")} AS base, {text("")} AS j, count(*) AS n FROM f GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(n_{KINDS[k][0]}, 0) AS n_{KINDS[k][0]}" for k in range(BASE))}, sha256(coalesce(base, '')) AS base_sha256, coalesce(j, '') AS spans,
  coalesce(n, 0) AS n_spans
FROM d LEFT JOIN g ON g.r = d.r
"""


OP7_SQL = _sql()

"""Vector code compression: one codebook for each part of the vectors, by Lloyd rounds that are maintained by their changes.

Components become integers (``floor(SCALE * x)``), and vectors are cut into
``PARTS`` equal parts.  Every round assigns each part to its codebook's nearest
entry and writes the assignments down beside those of the round before.  Sums
and counts of the entries are kept from round to round: a part that moved takes
its components from its old entry and gives them to the new one, and only these
plus and minus rows are aggregated and shuffled (at most one row for each entry
and task).  The running sums, 8 * 16 rows of integers, are all that the driver
holds.  All arithmetic is exact.

Defined cases: a vector that is null, is empty, or holds a null or non-finite
component is dropped, and so is one whose length isn't that of the vector of
the smallest vec_id whose length the parts divide.  Null vec_ids come last,
equal ones are ordered by their components; repeated rows are coded one by one.
With fewer kept vectors than entries the codebooks are as much smaller.  A
component of more than 2 ** 26 after scaling is an error, because squared
distances would no longer fit.  An empty table gives no rows.  Other columns
are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import BROADCAST_BYTES, discard, map_batches, materialize, row_bytes, table

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: The largest integer component: 64 squared differences of up to twice this fit into 62 bits for up to 64 dimensions.
LARGEST = 1 << 26
#: Copies of a label's sum that its rows are dealt over where labels are too many to broadcast.
SALTS = 32


def integers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, label and v (integer components) of the usable vectors, of any length."""
    wide = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("_e")).where(
        (F.size("_e") > 0) & F.forall("_e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    )
    large = F.exists("_e", lambda x: F.abs(x * scale) > LARGEST)
    checked = F.when(large, F.raise_error(F.lit("a component is too large for exact distances"))).otherwise(F.transform("_e", lambda x: F.floor(x * scale)))
    return wide.select("vec_id", "label", checked.cast("array<int>").alias("v"))


def nearest(points: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entry that is nearest to each point, the lower one of equal ones, and its squared distance."""
    reach = int(max(np.abs(points).max(initial=0), np.abs(book).max(initial=0)))
    kind = np.float64 if 4 * reach * reach * book.shape[1] < 2**53 else np.int64  # products of floats are exact as long as they are this small
    p, b = points.astype(kind), book.astype(kind)
    best = ((b * b).sum(axis=1) - 2 * (p @ b.T)).argmin(axis=1)
    gap = points.astype(np.int64) - book[best]
    return best, (gap * gap).sum(axis=1)


def assigned(rows: DataFrame, books: np.ndarray, last: bool = False) -> DataFrame:
    """rows (with v and codes, an array of entry numbers or null) with before (the old codes), new codes and, at last, the squared error."""
    parts = len(books)
    sent = rows.sparkSession.sparkContext.broadcast(books)
    kept = [c for c in rows.columns if c not in ("codes", "before")]
    said = StructType.fromDDL("before array<tinyint>, codes array<tinyint>" + (", error long" if last else ""))
    shape = StructType([*rows.select(*kept).schema, *said])
    names = shape.fieldNames()

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            v = batch.column("v").flatten().to_numpy().reshape(len(batch), parts, -1)
            codes, error = np.empty((len(batch), parts), np.int8), np.zeros(len(batch), np.int64)
            for j in range(parts):
                codes[:, j], gap = nearest(v[:, j], own[j])
                error += gap
            ends = pa.array(np.arange(0, codes.size + 1, parts), pa.int32())
            out = [batch.column(c) for c in kept] + [batch.column("codes"), pa.ListArray.from_arrays(ends, pa.array(codes.ravel()))]
            yield pa.RecordBatch.from_arrays(out + ([pa.array(error)] if last else []), names=names)

    return map_batches(rows.select(*kept, "codes"), assign, shape)


def changes(rows: DataFrame, parts: int, width: int) -> DataFrame:
    """part, entry, n and s1 ... of what the parts that moved take away and bring: one row for each entry."""
    moved = rows.select("v", "before", "codes", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    old, new = F.element_at("before", F.col("part") + 1), F.element_at("codes", F.col("part") + 1)
    own = F.slice("v", F.col("part") * width + 1, F.lit(width))
    both = moved.select("part", old.alias("old"), new.alias("new"), own.alias("p")).where("old is distinct from new")
    signed = both.select("part", "p", F.explode(F.array(F.struct(F.col("new").alias("entry"), F.lit(1).alias("sign")), F.struct(F.col("old").alias("entry"), F.lit(-1).alias("sign")))).alias("c"))
    signed = signed.select("part", F.col("c.entry").alias("entry"), F.col("c.sign").alias("sign"), "p").where("entry is not null")
    sums = [F.sum(F.col("sign") * F.get("p", F.lit(k)).cast("long")).alias(f"s{k}") for k in range(width)]
    return signed.groupBy("part", "entry").agg(F.sum("sign").alias("n"), *sums)


def trained(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame | None, np.ndarray]:
    """vec_id, label, v, codes and error of the kept vectors (a scratch table), and the codebooks (parts, entries, width); (None, empty) without any.

    The arithmetic is exact, so the result doesn't depend on the partitioning.
    """
    usable = integers(vectors, scale)
    order = [F.col("vec_id").asc_nulls_last(), "v"]
    first = usable.where((F.size("v") % parts) == 0).orderBy(*order).limit(1).select(F.size("v")).collect()
    if not first:
        return None, np.zeros((parts, 0, 0), np.int64)
    size = first[0][0]
    width = size // parts
    rows = materialize(usable.where(F.size("v") == size).withColumn("codes", F.lit(None).cast("array<tinyint>")), "vectors")
    seeds = np.array([r["v"] for r in rows.orderBy(*order).limit(entries).select("v").collect()], np.int64)  # 16 rows
    books = seeds.reshape(len(seeds), parts, width).transpose(1, 0, 2)
    counts, sums = np.zeros(books.shape[:2], np.int64), np.zeros(books.shape, np.int64)
    for _ in range(rounds):
        now = materialize(assigned(rows, books), "codes")
        discard(rows)
        rows = now
        for r in changes(rows, parts, width).collect():  # parts * entries rows at most
            counts[r["part"], r["entry"]] += r["n"]
            sums[r["part"], r["entry"]] += np.array(r[3:], np.int64)
        used = counts > 0
        books = np.where(used[..., None], sums // np.maximum(counts, 1)[..., None], books)
    final = materialize(assigned(rows, books, last=True).drop("before"), "codes")
    discard(rows)
    return final, books


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def hex_code(codes: Column) -> Column:
    """Two hex digits for each part."""
    return F.array_join(F.transform(codes, lambda c: F.lpad(F.lower(F.hex(c.cast("long"))), 2, "0")), "")


def decoded(codes: DataFrame, books: np.ndarray, scale: int = SCALE) -> DataFrame:
    """codes with ``approximation``: the vector that the codes stand for."""
    spark = codes.sparkSession
    flat = [(j, i, [float(x) / scale for x in books[j, i]]) for j in range(books.shape[0]) for i in range(books.shape[1])]
    entry = F.map_from_entries(F.collect_list(F.struct((F.col("part") * 256 + F.col("entry")).alias("k"), "e")))
    book = spark.createDataFrame(flat, "part int, entry int, e array<double>").agg(entry.alias("_book"))
    whole = F.flatten(F.transform("codes", lambda c, j: F.element_at("_book", j * 256 + c.cast("int"))))
    return codes.crossJoin(F.broadcast(book)).withColumn("approximation", whole).drop("_book")  # one row of parts * entries


def with_label_error(rows: DataFrame) -> DataFrame:
    """rows with label_error: the error of all rows of the same label, nulls together."""
    sums = rows.groupBy("label").agg(F.sum("error").alias("label_error"))
    n = sums.count()
    if n * row_bytes(sums) <= BROADCAST_BYTES:
        small, own = F.broadcast(sums.withColumnRenamed("label", "_label")), rows
        return own.join(small, F.col("label").eqNullSafe(F.col("_label"))).drop("_label")
    salted = sums.withColumnRenamed("label", "_label").withColumn("_to", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64("vec_id", "v"), F.lit(SALTS)).cast("int"))
    return dealt.join(salted, F.col("label").eqNullSafe(F.col("_label")) & (F.col("_salt") == F.col("_to"))).drop("_label", "_salt", "_to")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, books = trained(table(spark, sf_dir, "embeddings"))
    if rows is None:
        kind = table(spark, sf_dir, "embeddings").schema["vec_id"].dataType.simpleString()
        return spark.createDataFrame([], f"vec_id {kind}, code string, error long, label_error long, codebooks_sha256 string")
    out = with_label_error(rows)
    return out.select("vec_id", hex_code(F.col("codes")).alias("code"), "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


def _sql() -> str:
    """The rounds written out; every round is an assignment and a mean."""
    steps = [f"""
k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, v) AS r, vec_id, label, v, len(v) // {PARTS} AS w FROM (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
  WHERE len(v) = (SELECT len(embedding) FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(embedding) % {PARTS} = 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 ORDER BY vec_id NULLS LAST LIMIT 1)),
p AS MATERIALIZED (SELECT r, j AS part, list_slice(v, j * w + 1, j * w + w) AS x, w FROM k, range({PARTS}) t(j)),
b0 AS MATERIALIZED (SELECT part, r - 1 AS entry, x FROM p WHERE r <= {ENTRIES})"""]
    for i in range(ROUNDS + 1):
        steps.append(f"""
a{i} AS MATERIALIZED (SELECT p.r, p.part, arg_min(b.entry, (list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), b.entry)) AS entry,
  min(list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS d FROM p JOIN b{i} b ON b.part = p.part GROUP BY p.r, p.part)""")
        if i < ROUNDS:
            steps.append(f"""
m{i} AS (SELECT a.part, a.entry, u.pos, CAST(sum(p.x[u.pos]) AS HUGEINT) AS s, count(*) AS c FROM a{i} a JOIN p ON p.r = a.r AND p.part = a.part, LATERAL (SELECT unnest(range(1, p.w + 1)) AS pos) u GROUP BY ALL),
n{i} AS (SELECT part, entry, list(CAST((s - ((s % c) + c) % c) // c AS BIGINT) ORDER BY pos) AS x FROM m{i} GROUP BY ALL),
b{i + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(n.x, b.x) AS x FROM b{i} b LEFT JOIN n{i} n ON n.part = b.part AND n.entry = b.entry)""")
    done = ROUNDS
    return f"""
WITH {",".join(steps)},
f AS (SELECT r, string_agg(printf('%02x', CAST(entry AS INTEGER)), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{done} GROUP BY r),
h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{done})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM k JOIN f USING (r), h
"""


OP11_SQL = _sql()

"""Hilbert-curve sharding (native).

Several metadata dimensions are quantised to small grids, a row's cell is
mapped to its index on a Hilbert curve, rows are sorted by that index and the
order is cut into runs.  Rows that are near in all dimensions land in the same
run, so the min/max statistics of the files prune on every dimension at once.

Law ``rows``: the runs' row counts differ by one at most.

Defined cases: null text counts as empty (size 1, CRC 0); a null language or
source has a bucket of its own; a null doc_id sorts first; repeated rows are
kept, each with a slot; an empty table gives an empty result; columns that the
operator doesn't name are not read and so can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import global_rank, table

BITS = 6
N_SHARDS = 8


def size_bucket(size: Column, bits: int = BITS) -> Column:
    """Half-octave of a positive size: twice its bit length, plus its second bit."""
    bits_of = F.bin(size)
    length, second = F.length(bits_of), (F.substring(bits_of, 2, 1) == "1").cast("int")
    return F.least(2 * length + second, F.lit((1 << bits) - 1)).cast("long")


def value_bucket(value: Column, bits: int = BITS) -> Column:
    """Bucket of a string by its MD5; null is the bucket of the empty string."""
    return F.conv(F.substring(F.md5(F.coalesce(value, F.lit("")).cast("binary")), 1, 2), 16, 10).cast("long") % (1 << bits)


def with_hilbert(df: DataFrame, dims: list[str], bits: int = BITS, index: str = "hilbert") -> DataFrame:
    """Add the Hilbert index of the cell ``dims`` (integers below ``2 ** bits``).

    Skilling's transform, a projection for each step, so that every expression
    stays small; then the bits of the axes are interleaved.
    """
    axes = [f"_x{i}" for i in range(len(dims))]
    rest = df.columns
    df = df.select("*", *(F.col(d).cast("long").alias(x) for d, x in zip(dims, axes, strict=True)))
    for level in range(bits - 1, 0, -1):
        q, low = 1 << level, (1 << level) - 1
        for i, x in enumerate(axes):
            own, first = F.col(x), F.col(axes[0])
            swap = first.bitwiseXOR(own).bitwiseAND(F.lit(low))
            high = own.bitwiseAND(F.lit(q)) != 0
            new = {axes[0]: F.when(high, first.bitwiseXOR(F.lit(low))).otherwise(first.bitwiseXOR(swap))}
            if i:
                new[x] = F.when(high, own).otherwise(own.bitwiseXOR(swap))
            df = df.withColumns(new)
    for before, x in zip(axes, axes[1:], strict=False):
        df = df.withColumn(x, F.col(x).bitwiseXOR(F.col(before)))
    flip: Column = F.lit(0).cast("long")
    for level in range(bits - 1, 0, -1):
        bit = F.col(axes[-1]).bitwiseAND(F.lit(1 << level)) != 0
        flip = flip.bitwiseXOR(F.when(bit, F.lit((1 << level) - 1).cast("long")).otherwise(F.lit(0).cast("long")))
    df = df.withColumn("_flip", flip).withColumns({x: F.col(x).bitwiseXOR(F.col("_flip")) for x in axes})
    out: Column = F.lit(0).cast("long")
    for level in range(bits - 1, -1, -1):
        for i, x in enumerate(axes):
            bit = F.shiftright(F.col(x), level).bitwiseAND(F.lit(1))
            out = out + F.shiftleft(bit, level * len(axes) + len(axes) - 1 - i)
    return df.select(*rest, out.alias(index))


def hilbert_shards(docs: DataFrame, n_shards: int = N_SHARDS, bits: int = BITS) -> DataFrame:
    """doc_id, size, text_crc32, lang, source, hilbert, shard and slot of every document."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    cells = docs.select(
        "doc_id", "lang", "source",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
    ).select(
        "*",
        size_bucket(F.col("size"), bits).alias("_size_cell"),
        value_bucket(F.col("lang"), bits).alias("_lang_cell"),
        value_bucket(F.col("source"), bits).alias("_source_cell"),
    )
    cells = with_hilbert(cells, ["_size_cell", "_lang_cell", "_source_cell"], bits)
    cells = cells.drop("_size_cell", "_lang_cell", "_source_cell")
    ranked, total = global_rank(cells, ["hilbert", "text_crc32", "doc_id", "size"], "hilbert")
    each, more = divmod(total, n_shards)
    longer = more * (each + 1)  # rows in the shards that hold one row more
    shard = F.when(F.col("rank") < longer, F.expr(f"rank div {each + 1}")).otherwise(F.expr(f"{more} + (rank - {longer}) div {max(each, 1)}"))
    slot = F.col("rank") - F.col("shard") * each - F.least(F.col("shard"), F.lit(more))
    return ranked.withColumn("shard", shard.cast("int")).withColumn("slot", slot.cast("long")).drop("rank")


def op1_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = hilbert_shards(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
        "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert",
    )

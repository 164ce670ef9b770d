"""Helpers that several operators share: scratch tables, global ranks, checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

#: Bytes of a batch that goes to a Python worker; one longer row is a batch by itself.
BATCH_BYTES = 4 << 20
#: A side is broadcast only when its counted rows take at most this many bytes.
BROADCAST_BYTES = 24 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_batches(df: DataFrame, step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], shape: str | StructType) -> DataFrame:
    """``df.mapInArrow`` with batches bounded by bytes and not by rows alone.

    The bound is a setting of the session; a smaller one stays.
    """
    name, conf = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession.conf
    if int(conf.get(name).rstrip("b")) > BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))
    return df.mapInArrow(step, shape)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Only a plain ``local`` master, where driver and executors are one process,
    may fall back to a temporary folder.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if path:
        return path
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = f"file://{tempfile.mkdtemp(prefix='glosslake-')}"
    spark.sparkContext.setCheckpointDir(path)
    return spark.sparkContext.getCheckpointDir()


def materialize(df: DataFrame, name: str, few: bool = False) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts the lineage: later jobs read files that survive a lost executor,
    and values that depend on the partitioning are fixed.  The files go with
    ``discard``, or when the session's JVM ends.

    few: the rows take little room, but come from many tasks; they are put
    together into files of Spark's advisory size.
    """
    spark = df.sparkSession
    df = df.hint("rebalance") if few else df
    path = f"{shared_dir(spark)}/glosslake-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    files, hadoop = _files(spark, path)
    files.deleteOnExit(hadoop)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete the files of materialised tables that nothing reads any more."""
    for t in tables:
        files, hadoop = _files(t.sparkSession, t.scratch_path)
        files.delete(hadoop, True)
        files.cancelDeleteOnExit(hadoop)


def _files(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def row_bytes(df: DataFrame) -> int:
    """About what a row takes in a broadcast table: 32 bytes and its values (a string or digest as 48)."""
    fixed = {"tinyint": 8, "smallint": 8, "int": 8, "bigint": 8, "float": 8, "double": 8, "boolean": 8, "date": 8, "timestamp": 8}
    return 32 + sum(fixed.get(f.dataType.simpleString(), 48) for f in df.schema)


def broadcast_if_small(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``F.broadcast(df)`` if its counted rows are small, else ``df`` for a shuffled join.

    df: columns of fixed size, digests and short names only.
    """
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n * row_bytes(df) <= limit else df


def global_rank(df: DataFrame, keys: list[str | Column], name: str, rank: str = "rank") -> tuple[DataFrame, int]:
    """``df`` with the exact 0-based global rank by ``keys``, and its row count.

    Rows are range-partitioned and sorted; a row's position within its partition
    is written down once, and the partitions' row counts (one row each) give the
    offsets.  Rows that are equal in all keys may be very many: where they come
    from parts them, so they needn't be in one range.
    """
    pos = F.monotonically_increasing_id()
    ranged = df.withColumn("_tie", pos).repartitionByRange(*keys, "_tie").sortWithinPartitions(*keys).drop("_tie")
    placed = materialize(ranged.withColumn("_pos", pos), name)
    part = F.shiftrightunsigned("_pos", 33)
    counts = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    ranked = (
        placed.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")  # one row for each partition
        .withColumn(rank, F.col("_before") + F.col("_pos").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_pos", "_part", "_before")
    )
    return ranked, placed.count()

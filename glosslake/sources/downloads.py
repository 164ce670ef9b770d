"""Downloads against a ledger: what was fetched is never fetched again, what failed stays open.

A request (url, category, filename, format, seq) is answered by a row: ok, path,
size, skipped, error.  Answers are kept in the ledger, a folder of Parquet parts
by batch; a batch is in it whole or not at all.  A batch that is repeated gives
the answers that it has; one that stopped half-way is done again, and files
that it has stored already count as there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .notes import CATEGORY, opened

#: Files of at most this many bytes don't count as downloaded.
LEAST_BYTES = 1024
FORMATS = ("pdf", "html")
ANSWER = "ok boolean, path string, size long, skipped string, error string"
REQUEST = ["url", "category", "filename", "format"]


def refusal(url: Column, category: Column, filename: Column, kind: Column) -> Column:
    """Why a request can't be answered, or null."""
    missing = F.lit(False)
    for c in (url, category, filename, kind):
        missing = missing | (F.coalesce(c, F.lit("")) == "")
    return (
        F.when(missing, "missing required field")
        .when(~kind.isin(*FORMATS), F.concat(F.lit("unsupported format: "), kind))
        .when(F.rlike(filename, F.lit(r"[/\\\x00]|^\.")), F.concat(F.lit("unsafe filename: '"), filename, F.lit("'")))
        .when(~F.rlike(category, F.lit(CATEGORY)), F.concat(F.lit("unsafe category: '"), category, F.lit("'")))
    )


def vault_path(root: str) -> Column:
    return F.concat(F.lit(f"{root}/papers/"), "category", F.lit("/"), "filename", F.lit("."), "format")


def vault_store(root: str) -> Callable[[str, str, bytes], None]:
    """``store`` for a vault: a file is there whole or not at all."""

    def store(category: str, name: str, body: bytes) -> None:
        files, base = opened(f"{root}/papers/{category}")
        files.create_dir(base)
        with files.open_output_stream(f"{base}/.{name}.part") as out:
            out.write(body)
        files.move(f"{base}/.{name}.part", f"{base}/{name}")

    return store


def vault_size(root: str) -> Callable[[str, str], int]:
    """``size`` for a vault: the bytes of a stored file, 0 without one."""

    def size(category: str, name: str) -> int:
        files, path = opened(f"{root}/papers/{category}/{name}")
        return files.get_file_info(path).size or 0

    return size


def read_ledger(spark: SparkSession, root: str) -> DataFrame:
    """batch, url, category, filename, format, seq and the answer of everything that was asked for."""
    shape = f"url string, category string, filename string, format string, seq long, {ANSWER}, batch long"
    files, base = opened(f"{root}/ledger")
    if files.get_file_info(base).type != pafs.FileType.Directory:
        return spark.createDataFrame([], shape)
    return spark.read.schema(shape).parquet(f"{root}/ledger").where("batch is not null")


def open_requests(ledger: DataFrame) -> DataFrame:
    """The requests whose file no answer has brought yet and that a new try may bring: each once, as asked for last."""
    by = Window.partitionBy("category", "filename", "format")
    last = ledger.withColumn("_ok", F.max("ok").over(by)).withColumn("_n", F.row_number().over(by.orderBy(F.col("batch").desc(), F.col("seq").desc())))
    refused = refusal(*(F.col(c) for c in REQUEST))
    return last.where((F.col("_n") == 1) & ~F.col("_ok") & refused.isNull()).select(*REQUEST, "seq")


def answered(requests: DataFrame, root: str, fetch: Callable[[str], bytes], store: Callable[[str, str, bytes], None], size: Callable[[str, str], int]) -> DataFrame:
    """requests with their answers.  Of requests for one file the first is fetched, and later ones find it there.

    ``fetch`` raises for a status of 400 or more, and then nothing is stored; a
    failure is its row's answer and doesn't stop others.
    """
    checked = requests.withColumn("error", refusal(*(F.col(c) for c in REQUEST))).withColumn("path", vault_path(root))
    shape = f"url string, category string, filename string, format string, seq long, {ANSWER}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                name, there, answer = f"{r['filename']}.{r['format']}", 0, (False, None, None, None, r["error"])
                if r["error"] is None:
                    try:
                        there = size(r["category"], name)
                        if there > LEAST_BYTES:
                            answer = (True, r["path"], there, "already exists", None)
                        else:
                            body = fetch(r["url"])
                            store(r["category"], name, body)
                            answer = (True, r["path"], len(body), None, None)
                    except Exception as e:  # the row's answer
                        answer = (False, None, None, None, str(e))
                out.append((*(r[c] for c in (*REQUEST, "seq")), *answer))
            kinds = [pa.string()] * 4 + [pa.int64(), pa.bool_(), pa.string(), pa.int64(), pa.string(), pa.string()]
            names = [*REQUEST, "seq", "ok", "path", "size", "skipped", "error"]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], names=names)

    # Requests for one file meet in one task, in their order: the second finds what the first has stored.
    dealt = checked.select(*REQUEST, F.col("seq").cast("long").alias("seq"), "path", "error").repartition("category", "filename", "format")
    return dealt.sortWithinPartitions("category", "filename", "format", "seq").mapInArrow(run, shape)


def download_batch(requests: DataFrame, batch: int, root: str, fetch, store=None, size=None, retry: bool = True) -> DataFrame:
    """The answers of one batch, from the ledger if it is there; else fetched, with what is still open, and written down."""
    spark = requests.sparkSession
    files, base = opened(f"{root}/ledger/batch={batch}")
    if files.get_file_info(f"{base}/_SUCCESS").type != pafs.FileType.File:
        before = read_ledger(spark, root).where(F.col("batch") != batch)
        asked = requests.select(*REQUEST, F.col("seq").cast("long").alias("seq"))
        if retry:
            again = open_requests(before).join(asked.select("category", "filename", "format").distinct(), ["category", "filename", "format"], "left_anti")
            asked = asked.unionByName(again)
        rows = answered(asked, root, fetch, store or vault_store(root), size or vault_size(root))
        rows.write.mode("overwrite").parquet(f"{root}/ledger/batch={batch}")
    return read_ledger(spark, root).where(F.col("batch") == batch)


def batch_answers(ledger: DataFrame) -> DataFrame:
    """batch, ok (of all of it), n, results in the requests' order."""
    row = F.struct("seq", "ok", "path", "size", "skipped", "error")
    return ledger.groupBy("batch").agg(F.bool_and("ok").alias("ok"), F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(row)).alias("results"))


def download_stream(requests: DataFrame, root: str, fetch, store=None, size=None, checkpoint: str | None = None):
    """Starts a stream of requests whose micro-batches are ``download_batch``; a batch that runs again after a failure is the same batch."""
    run = lambda df, batch: download_batch(df, batch, root, fetch, store, size).count()
    return requests.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint or f"{root}/ledger-checkpoint").start()

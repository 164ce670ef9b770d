"""Work for all cores from tables of few splits."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Bytes for each core from which the file splits alone give every core enough to do.
BYTES_PER_CORE = 16 << 20


def spread(df: DataFrame) -> DataFrame:
    """df, dealt evenly over the cores where it is so small that a file's row groups would leave most of them idle.

    For what comes before a costly step for each row.  Rows and values stay as
    they are; from ``BYTES_PER_CORE`` bytes for each core nothing is shuffled.
    """
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size < cores * BYTES_PER_CORE else df


#: Bytes of a batch that goes to a Python worker; one longer row is a batch by itself.
BATCH_BYTES = 4 << 20


def bounded(df: DataFrame) -> DataFrame:
    """df, with the session's batches for Python workers bounded by bytes and not by rows alone; a smaller bound stays."""
    name, conf = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession.conf
    if int(conf.get(name).rstrip("b")) > BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))
    return df

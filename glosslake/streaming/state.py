"""State over event streams, each with a batch form that gives the same rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def throttle(events: DataFrame, key: str, ts: str, millis: int, strict: bool = False) -> DataFrame:
    """key, opened, n: the first event opens a timer, events within ``millis`` of it are absorbed.

    strict: an event exactly ``millis`` later is absorbed as well.  A gap of ``millis`` or more always opens a new one, so each key's events
    are cut into bursts there by a window function; bursts are dealt over the tasks, and each task reads its rows in order and holds one
    open timer, however long a burst is.  Events without a time have no part.
    """
    apart = millis * 1000 + int(strict)
    by = Window.partitionBy(key).orderBy("_at")
    timed = events.select(F.col(key), _micros(ts).alias("_at")).where("_at is not null")
    cut = timed.withColumn("_new", F.coalesce((F.col("_at") - F.lag("_at").over(by) >= apart).cast("int"), F.lit(1)))
    bursts = cut.withColumn("_burst", F.sum("_new").over(by)).select(key, "_burst", "_at")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        who, opened, n = None, 0, 0
        for batch in batches:
            out = []
            for k, burst, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if who == (k, burst) and at - opened < apart:
                    n += 1
                    continue
                if who is not None:
                    out.append((who[0], opened, n))
                who, opened, n = (k, burst), at, 1
            yield rows(out, batch.schema)
        if who is not None:
            yield rows([(who[0], opened, n)], batch.schema)

    def rows(out: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
        kinds = (schema.field(0).type, pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], names=[key, "_o", "n"])

    kind = events.schema[key].dataType.simpleString()
    ordered = bursts.repartition(key, "_burst").sortWithinPartitions(key, "_burst", "_at")
    timers = ordered.mapInArrow(fold, f"`{key}` {kind}, _o long, n long")
    return timers.select(key, F.timestamp_micros("_o").cast(events.schema[ts].dataType).alias("opened"), "n")


def debounce(events: DataFrame, key: str, ts: str, value: str, millis: int) -> DataFrame:
    """key, settled, value, n: the last event of every run whose gaps are below ``millis``."""
    by = Window.partitionBy(key).orderBy(ts)
    gap = _micros(ts) - F.lag(_micros(ts)).over(by)
    runs = events.select(key, ts, value, F.coalesce((gap >= millis * 1000).cast("int"), F.lit(1)).alias("_new")).withColumn("_run", F.sum("_new").over(by))
    return runs.groupBy(key, "_run").agg(F.max(ts).alias("settled"), F.max_by(value, ts).alias("value"), F.count(F.lit(1)).alias("n")).drop("_run")


def cooldown(events: DataFrame, key: str, ts: str, millis: int) -> DataFrame:
    """key, fired: an event fires if the last fired one is more than ``millis`` old."""
    return throttle(events, key, ts, millis, strict=True).select(key, F.col("opened").alias("fired"))


def latest(events: DataFrame, key: Column, seq: str) -> DataFrame:
    """One row for each key: the last arrival, whole."""
    row = F.struct(*[c for c in events.columns])
    return events.groupBy(key.alias("state_key")).agg(F.max_by(row, seq).alias("state"), F.count(F.lit(1)).alias("n_updates")).select("state_key", "state.*", "n_updates")


def tab_key(sender: Column, asked: Column) -> Column:
    return F.coalesce(sender, asked, F.lit(-1))


def changes(counts: DataFrame, key: str, ts: str, values: list[str]) -> DataFrame:
    """The rows whose values differ from the key's row before: what a report repaints."""
    before = Window.partitionBy(key).orderBy(ts)
    same = F.lit(True)
    for v in values:
        same = same & F.col(v).eqNullSafe(F.lag(v).over(before))
    return counts.withColumn("_first", F.row_number().over(before) == 1).withColumn("_same", same).where(F.col("_first") | ~F.col("_same")).drop("_first", "_same")


def latest_stream(events: DataFrame, key: str, seq: str, value: str) -> DataFrame:
    """The stream form of ``latest``: update mode, one state row for each key."""
    return events.groupBy(key).agg(F.max_by(value, seq).alias(value), F.max(seq).alias(seq))


def debounce_stream(events: DataFrame, key: str, ts: str, value: str, millis: int, late: str = "10 minutes") -> DataFrame:
    """The stream form of ``debounce``: session windows, closed by the watermark."""
    session = F.session_window(ts, f"{millis} milliseconds")
    runs = events.withWatermark(ts, late).groupBy(key, session)
    return runs.agg(F.max(ts).alias("settled"), F.max_by(value, ts).alias("value"), F.count(F.lit(1)).alias("n")).drop("session_window")


def throttle_stream(events: DataFrame, key: str, ts: str, millis: int, late: str = "10 minutes") -> DataFrame:
    """The stream form of ``throttle``: the open timer is the key's state.

    Events wait until the watermark has passed them, so that late ones take
    their place; a key's state is the open timer and the events that wait.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    kind = events.schema[key].dataType.simpleString()

    def step(name: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        opened, n, waiting = state.get if state.exists else (None, 0, [])
        for pdf in batches:
            waiting = [*waiting, *(int(t.value // 1000) for t in pd.to_datetime(pdf[ts]))]
        mark = state.getCurrentWatermarkMs() * 1000
        ready, waiting = sorted(t for t in waiting if t <= mark), [t for t in waiting if t > mark]
        out = []
        for t in ready:
            if opened is None or t - opened >= millis * 1000:
                if opened is not None:
                    out.append((name[0], pd.Timestamp(opened, unit="us"), n))
                opened, n = t, 0
            n += 1
        if opened is not None and not waiting and opened + millis * 1000 <= mark:
            out.append((name[0], pd.Timestamp(opened, unit="us"), n))
            opened, n = None, 0
        if opened is None and not waiting:
            state.remove()
        else:
            state.update((opened, n, waiting))
            wake = min(waiting) if waiting else opened + millis * 1000
            state.setTimeoutTimestamp(max(wake // 1000, mark // 1000) + 1)
        yield pd.DataFrame(out, columns=[key, "opened", "n"])

    return (
        events.withWatermark(ts, late).groupBy(key)
        .applyInPandasWithState(step, f"{key} {kind}, opened timestamp, n long", "opened long, n long, waiting array<long>", "append", GroupStateTimeout.EventTimeTimeout)
    )

from __future__ import annotations

import datetime as dt
import random

import pytest

from glosslake.streaming import state, triggers

T0 = dt.datetime(2024, 1, 1)
SHAPE = "user string, ts timestamp, n long, url string, paused boolean"
at = lambda ms: T0 + dt.timedelta(milliseconds=ms)
ms = lambda t: round((t - T0) / dt.timedelta(milliseconds=1))


def triggered(df):
    return sorted((r["user"], ms(r["at"]), r["cause"]) for r in df.collect())


def test_rescan_triggers(spark):
    rows = [
        ("a", at(100), 1, "u", None), ("a", at(1100), 2, "v", None), ("a", at(1101), 3, "w", None), ("a", at(1500), 4, "u", None), ("a", at(1600), 5, "v", None),  # v at 1100, v again at 2100
        ("b", at(0), 6, "u", True), ("b", at(500), 7, "v", None), ("b", at(3000), 8, None, False), ("b", at(3001), 9, None, False), ("b", at(3500), 10, "w", None), ("b", at(4000), 11, None, True),
        ("c", at(0), 12, None, None), ("c", at(10), 13, "u", None), ("c", at(1990), 14, None, True), ("c", None, 15, "x", None),
    ]
    got = triggered(triggers.rescan_triggers(spark.createDataFrame(rows, SHAPE), "user", "ts", "n", "url", "paused"))
    assert got == [("a", 100, "first"), ("a", 1100, "url"), ("a", 2100, "settled"), ("b", 3000, "resume"), ("c", 0, "first")]


def random_events(n, seed):
    r = random.Random(seed)
    rows = [(r.choice("abc"), at(r.randrange(0, 60_000, 50)), i, r.choice([None, "u", "v", "w"]), r.choice([None, None, True, False])) for i in range(n)]
    return rows


def streamed(spark, tmp_path, rows, make, name, late_rows=()):
    """Rows in three shuffled parts within the watermark's delay, some of them twice, then two that move time on, then late ones."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    src = str(tmp_path / "in")
    parts = [rows[0::3], [*rows[1::3], *rows[0:9]], rows[2::3], [("z", T0 + dt.timedelta(hours=5), 10**6, "u", None)], [*late_rows, ("z", T0 + dt.timedelta(hours=6), 10**6 + 1, "u", None)], [("z", T0 + dt.timedelta(hours=7), 10**6 + 2, "u", None)]]
    spark.createDataFrame(parts[0], SHAPE).coalesce(1).write.mode("append").parquet(src)
    q = make(spark.readStream.schema(SHAPE).parquet(src)).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
        for p in parts[1:]:
            spark.createDataFrame(p, SHAPE).coalesce(1).write.mode("append").parquet(src)
            q.processAllAvailable()
    finally:
        q.stop()
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    return spark.table(name).where("user <> 'z'")


@pytest.mark.parametrize("seed", [1, 2])
def test_rescan_stream_equals_batch(spark, tmp_path, seed):
    rows = random_events(150, seed)
    args = ("user", "ts", "n", "url", "paused")
    got = streamed(spark, tmp_path, rows, lambda s: triggers.rescan_triggers_stream(s, *args), f"rescans{seed}", [("a", at(30_000), 999, "late", False)])
    assert triggered(got) == triggered(triggers.rescan_triggers(spark.createDataFrame(rows, SHAPE), *args))


@pytest.mark.parametrize("expire", [None, 1500])
def test_change_stream_equals_batch(spark, tmp_path, expire):
    rows = random_events(150, 5)
    df, args = spark.createDataFrame([*rows, *rows[:20]], SHAPE), ("user", "ts", "n", ["url", "paused"], expire)
    got = streamed(spark, tmp_path, rows, lambda s: triggers.report_changes_stream(s, *args), f"changes{expire}", [("a", at(30_000), 999, "late", False)])
    want = sorted(map(str, triggers.report_changes(df, *args).collect()))
    assert sorted(map(str, got.collect())) == want
    if expire is None:  # the same rows as the plain window
        assert len(want) == state.changes(df.dropDuplicates().selectExpr("*", "struct(ts, n) AS o"), "user", "o", ["url", "paused"]).count()


def test_cooldown_stream_equals_batch(spark, tmp_path):
    rows = random_events(150, 6)
    got = streamed(spark, tmp_path, rows, lambda s: triggers.cooldown_stream(s, "user", "ts", "n", 4000), "cooled", [("a", at(30_000), 999, "late", False)])
    want = state.cooldown(spark.createDataFrame(rows, SHAPE), "user", "ts", 4000)
    assert sorted((r["user"], r["fired"]) for r in got.collect()) == sorted((r["user"], r["fired"]) for r in want.collect())

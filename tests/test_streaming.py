from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from glosslake.streaming import state

T0 = dt.datetime(2024, 1, 1)
MS = [0, 100, 700, 800, 900, 1700, 3000, 3799, 3800]


def events(spark):
    rows = [(i, "a", T0 + dt.timedelta(milliseconds=m), m) for i, m in enumerate(MS)] + [(99, "b", T0, 7)]
    return spark.createDataFrame(rows, "event_id long, user string, ts timestamp, value long")


def test_throttle_and_cooldown(spark):
    got = [((r["opened"] - T0) / dt.timedelta(milliseconds=1), r["n"]) for r in state.throttle(events(spark), "user", "ts", 800).where("user = 'a'").orderBy("opened").collect()]
    assert got == [(0, 3), (800, 2), (1700, 1), (3000, 2), (3800, 1)]
    fired = [(r["fired"] - T0) / dt.timedelta(milliseconds=1) for r in state.cooldown(events(spark), "user", "ts", 800).where("user = 'a'").orderBy("fired").collect()]
    assert fired == [0, 900, 3000]


def test_debounce_latest_changes(spark):
    got = [(r["value"], r["n"]) for r in state.debounce(events(spark), "user", "ts", "value", 250).where("user = 'a'").orderBy("settled").collect()]
    assert got == [(100, 2), (900, 3), (1700, 1), (3000, 1), (3800, 2)]
    last = {r["state_key"]: (r["event_id"], r["n_updates"]) for r in state.latest(events(spark), F.col("user"), "event_id").collect()}
    assert last == {"a": (8, 9), "b": (99, 1)}
    rows = spark.createDataFrame([(1, "a", 1), (2, "a", 1), (3, "a", 2), (4, "a", None), (5, "a", None)], "t long, k string, n long")
    assert [r["t"] for r in state.changes(rows, "k", "t", ["n"]).orderBy("t").collect()] == [1, 3, 4]
    assert spark.range(1).select(state.tab_key(F.lit(None).cast("long"), F.lit(None).cast("long")).alias("k")).first()["k"] == -1


def run(spark, tmp_path, make, mode, name):
    src = str(tmp_path / "in")
    events(spark).coalesce(1).write.parquet(src)
    end = spark.createDataFrame([(1000, "z", T0 + dt.timedelta(hours=5), 0)], "event_id long, user string, ts timestamp, value long")
    stream = make(spark.readStream.schema(events(spark).schema).parquet(src))
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
        end.write.mode("append").parquet(src)
        q.processAllAvailable()
        end.withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 HOUR")).write.mode("append").parquet(src)
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.sql(f"SELECT * FROM {name}").collect()


def test_streams_agree_with_batch(spark, tmp_path):
    rows = run(spark, tmp_path / "a", lambda s: state.debounce_stream(s, "user", "ts", "value", 250), "append", "debounced")
    want = {(r["user"], r["value"], r["n"]) for r in state.debounce(events(spark), "user", "ts", "value", 250).collect()}
    assert {(r["user"], r["value"], r["n"]) for r in rows if r["user"] != "z"} == want
    rows = run(spark, tmp_path / "b", lambda s: state.throttle_stream(s, "user", "ts", 800), "append", "throttled")
    want = {(r["user"], r["opened"], r["n"]) for r in state.throttle(events(spark), "user", "ts", 800).collect()}
    assert {(r["user"], r["opened"], r["n"]) for r in rows if r["user"] != "z"} == want
    rows = run(spark, tmp_path / "c", lambda s: state.latest_stream(s, "user", "event_id", "value"), "update", "latest")
    assert {(r["user"], r["event_id"]) for r in rows} >= {("a", 8), ("b", 99)}

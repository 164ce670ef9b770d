from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from glosslake.sources import downloads, notes

NOTE = "category string, name string, body string, seq long"
REQUEST = "url string, category string, filename string, format string, seq long"


def tree(root):
    return {os.path.relpath(os.path.join(d, f), root): open(os.path.join(d, f)).read() for d, _, names in os.walk(root) for f in names if not f.endswith(".crc")}


def test_two_calls_and_a_clash(spark, tmp_path):
    root = str(tmp_path)
    first = spark.createDataFrame([("citation", "n", "old", 1), ("citation", "n", "new", 2), ("cs", "m +é", "other", 1), ("a/b", "x", "no", 1), ("cs", "../x", "no", 2), ("cs", ".x", "no", 3), ("cs", None, "no", 4), ("cs", "e", None, 5)], NOTE).repartition(3)
    answers = notes.write_imports(first, root)
    assert sorted((r["name"] or "", r["ok"], r["error"]) for r in answers.where("not ok").collect()) == [(n, False, "path traversal blocked") for n in ("", "../x", ".x", "x")]
    assert answers.where("name = 'm +é'").first()["path"] == f"{root}/imports/cs/m +é.md"
    assert tree(root) == {"imports/citation/n.md": "new", "imports/cs/m +é.md": "other", "imports/cs/e.md": ""}
    notes.write_imports(spark.createDataFrame([("citation", "n", "newer", 1), ("citation", "k", "kept", 1)], NOTE), root)
    assert sorted(map(tuple, notes.read_imports(spark, root).collect())) == [("citation", "k", "kept"), ("citation", "n", "newer"), ("cs", "m +é", "other")]
    assert notes.write_imports(spark.createDataFrame([], NOTE), root).count() == 0 and len(tree(root)) == 4
    assert notes.read_imports(spark, str(tmp_path / "none")).count() == 0


def test_a_failed_task_writes_nothing(spark, tmp_path):
    root = str(tmp_path)
    spark.dataSource.register(notes.NoteSource)
    bad = spark.range(8).select(F.lit("cs").alias("category"), F.when(F.col("id") == 7, F.lit("a/b")).otherwise(F.concat(F.lit("n"), F.col("id"))).alias("name"), F.lit("x").alias("body")).repartition(4)
    with pytest.raises(Exception, match="leaves its folder"):
        bad.write.format("notes").mode("append").option("path", root).option("call", "c1").save()
    notes.publish(spark, root)
    assert tree(root) == {}


def test_a_call_that_died_before_publishing_is_finished(spark, tmp_path):
    root = str(tmp_path)
    spark.dataSource.register(notes.NoteSource)
    rows = spark.createDataFrame([("cs", "a", "first"), ("cs", "b", "first")], "category string, name string, body string")
    rows.write.format("notes").mode("append").option("path", root).option("call", "c1").save()  # committed, not published
    assert not os.path.exists(f"{root}/imports/cs") and notes.read_imports(spark, root).count() == 0
    notes.write_imports(spark.createDataFrame([("cs", "a", "second", 1)], NOTE), root)
    assert tree(root) == {"imports/cs/a.md": "second", "imports/cs/b.md": "first"}


def requests(spark, *rows):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], REQUEST)


class Web:
    """Counts what is fetched, over processes, in a folder."""

    def __init__(self, folder, broken=()):
        self.folder, self.broken = str(folder), set(broken)
        os.makedirs(self.folder, exist_ok=True)

    def __call__(self, url):
        open(f"{self.folder}/{url}-{os.getpid()}-{os.urandom(4).hex()}", "w").close()
        if url in self.broken:
            raise OSError(f"HTTP 404 from {url}")
        return b"x" * 2000

    def seen(self):
        return sorted(f.split("-")[0] for f in os.listdir(self.folder))


def test_refusals(spark):
    rows = requests(spark, ("u", "c", "f", "pdf"), ("", "c", "f", "pdf"), ("u", None, "f", "pdf"), ("u", "c", "f", "exe"), ("u", "c", "a/b", "pdf"), ("u", "c", ".f", "html"), ("u", "../c", "f", "pdf"))
    got = [r[0] for r in rows.select("seq", downloads.refusal(*(F.col(c) for c in downloads.REQUEST)).alias("e")).orderBy("seq").select("e").collect()]
    assert got == [None, "missing required field", "missing required field", "unsupported format: exe", "unsafe filename: 'a/b'", "unsafe filename: '.f'", "unsafe category: '../c'"]


def test_a_repeated_batch_fetches_nothing_and_failures_stay_open(spark, tmp_path):
    root, web = str(tmp_path / "vault"), Web(tmp_path / "web", {"u2"})
    batch = requests(spark, ("u1", "cs", "a", "pdf"), ("u2", "cs", "b", "pdf"), ("u1b", "cs", "a", "pdf"), ("u3", "cs", ".x", "pdf"))
    got = downloads.download_batch(batch, 0, root, web).orderBy("seq").collect()
    assert [(r["ok"], r["size"], r["skipped"], r["error"]) for r in got] == [(True, 2000, None, None), (False, None, None, "HTTP 404 from u2"), (True, 2000, "already exists", None), (False, None, None, "unsafe filename: '.x'")]
    assert [tuple(r)[:5] for r in downloads.download_batch(batch, 0, root, web).orderBy("seq").collect()] == [tuple(r)[:5] for r in got] and web.seen() == ["u1", "u2"]
    assert [r["url"] for r in downloads.open_requests(downloads.read_ledger(spark, root)).collect()] == ["u2"]
    web.broken.clear()
    again = downloads.download_batch(requests(spark, ("u4", "cs", "d", "html")), 1, root, web)
    assert sorted((r["url"], r["ok"]) for r in again.collect()) == [("u2", True), ("u4", True)] and downloads.open_requests(downloads.read_ledger(spark, root)).count() == 0
    answers = {r["batch"]: (r["ok"], r["n"], [x["ok"] for x in r["results"]]) for r in downloads.batch_answers(downloads.read_ledger(spark, root)).collect()}
    assert answers[0] == (False, 4, [True, False, True, False]) and answers[1][:2] == (True, 2)


def test_a_stream_that_stops_half_way(spark, tmp_path):
    root, web, src = str(tmp_path / "vault"), Web(tmp_path / "web"), str(tmp_path / "in")
    plain = downloads.vault_store(root)

    def dying(category, name, body):
        if name == "f3.pdf":
            os._exit(1)  # the worker is gone, and with it the batch
        plain(category, name, body)

    rows = requests(spark, *((f"u{i}", "cs", f"f{i}", "pdf") for i in range(5))).coalesce(1)
    rows.write.parquet(src)
    stream = lambda: spark.readStream.schema(REQUEST).parquet(src)
    q = downloads.download_stream(stream(), root, web, dying)
    with pytest.raises(Exception):  # noqa: B017
        q.processAllAvailable()
    q.stop()
    assert downloads.read_ledger(spark, root).count() == 0
    stored = set(os.listdir(f"{root}/papers/cs"))
    before = web.seen()
    q = downloads.download_stream(stream(), root, web)
    try:
        q.processAllAvailable()
        rows.limit(1).write.mode("append").parquet(src)  # asked for again in a later batch
        q.processAllAvailable()
    finally:
        q.stop()
    ledger = downloads.read_ledger(spark, root)
    assert ledger.where("batch = 0 and ok").count() == 5 and ledger.where("batch = 1").select("skipped").collect()[0][0] == "already exists"
    fetched = web.seen()[:]
    for f in stored:  # stored before the crash: not fetched again
        assert fetched.count(f"u{f[1]}") == before.count(f"u{f[1]}")
    assert len(os.listdir(f"{root}/papers/cs")) == 5

"""The import sink: one Markdown file for each note, as a Spark data source.

A call stages its notes first, each task in a folder of its own; when all tasks
have succeeded, the commit writes down which folders count, and an abort
removes them all.  ``publish`` then moves the staged files to
``imports/<category>/<name>.md`` in parallel.  Moving is repeatable: a call that
dies between commit and publish is finished by the next one, before its own
notes, so the last note of a name stays also over calls.  Nothing but those
files is ever written outside of the staging folder.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..functions.text import safe_name

CATEGORY = r"^[A-Za-z0-9_-]+$"
STAGED = ".staged"
#: A name that would leave its folder, or hide in it.
UNSAFE = r"[/\\\x00]|^\.|^\z"


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path within it."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def import_path(category: Column, text: Column) -> Column:
    """Where an import goes in the vault; null for a category that isn't a plain name."""
    return F.when(F.rlike(category, F.lit(CATEGORY)), F.concat(F.lit("imports/"), category, F.lit("/"), safe_name(text), F.lit(".md")))


@dataclass
class Staged(WriterCommitMessage):
    folder: str
    notes: int


class NoteWriter(DataSourceWriter):
    def __init__(self, root: str, call: str):
        self.base = f"{root}/imports/{STAGED}/{call}"

    def write(self, iterator: Iterator) -> Staged:
        files, base = opened(self.base)
        folder, n = f"{base}/{uuid.uuid4().hex}", 0  # an attempt that fails leaves a folder that no commit names
        for row in iterator:
            category, name = row["category"], row["name"]
            if not _plain(category) or not _plain(name):
                raise ValueError(f"a note's name leaves its folder: {category}/{name}")
            files.create_dir(f"{folder}/{category}")
            with files.open_output_stream(f"{folder}/{category}/{name}.md") as out:
                out.write((row["body"] or "").encode("utf-8", "surrogatepass"))
            n += 1
        return Staged(folder, n)

    def commit(self, messages: list) -> None:
        files, base = opened(self.base)
        folders = [m.folder for m in messages if m is not None and m.notes]
        if not folders:
            return self.abort(messages)
        files.create_dir(base)
        with files.open_output_stream(f"{base}/_COMMITTED.tmp") as out:
            out.write(json.dumps(folders).encode())
        files.move(f"{base}/_COMMITTED.tmp", f"{base}/_COMMITTED")

    def abort(self, messages: list) -> None:
        files, base = opened(self.base)
        if files.get_file_info(base).type == pafs.FileType.Directory:
            files.delete_dir(base)


def _plain(name: str | None) -> bool:
    return bool(name) and not name.startswith(".") and not any(c in name for c in "/\\\0")


class NoteSource(DataSource):
    """``df.write.format("notes").option("path", root).option("call", id)``: category, name, body."""

    @classmethod
    def name(cls) -> str:
        return "notes"

    def schema(self) -> str:
        return "category string, name string, body string"

    def writer(self, schema, overwrite: bool) -> NoteWriter:
        return NoteWriter(self.options["path"], self.options["call"])


def checked_notes(notes: DataFrame) -> DataFrame:
    """notes with ``error``: null, or why the note is refused."""
    plain = F.rlike(F.coalesce("category", F.lit("")), F.lit(CATEGORY)) & ~F.rlike(F.coalesce("name", F.lit("")), F.lit(UNSAFE))
    return notes.withColumn("error", F.when(~plain, F.lit("path traversal blocked")))


def write_imports(notes: DataFrame, root: str) -> DataFrame:
    """Writes notes (category, name, body, seq) and gives each one's answer: category, name, seq, ok, path, error.

    The last note of a name stays.  Refused ones are answered and not written.
    """
    spark = notes.sparkSession
    spark.dataSource.register(NoteSource)
    answers = checked_notes(notes)
    last = answers.where("error is null").groupBy("category", "name").agg(F.max_by("body", "seq").alias("body"))
    publish(spark, root)
    last.write.format("notes").mode("append").option("path", root).option("call", uuid.uuid4().hex).save()
    publish(spark, root)
    path = F.concat_ws("/", F.lit(f"{root}/imports"), "category", F.concat("name", F.lit(".md")))
    return answers.select("category", "name", "seq", F.col("error").isNull().alias("ok"), F.when(F.col("error").isNull(), path).alias("path"), "error")


def publish(spark: SparkSession, root: str) -> None:
    """Moves what committed calls have staged; calls without a commit are left to their writers."""
    files, base = opened(f"{root}/imports/{STAGED}")
    if files.get_file_info(base).type != pafs.FileType.Directory:
        return
    calls = [c.path for c in files.get_file_info(pafs.FileSelector(base)) if files.get_file_info(f"{c.path}/_COMMITTED").type == pafs.FileType.File]
    for call in calls:  # one, or those that a lost driver has left
        with files.open_input_stream(f"{call}/_COMMITTED") as f:
            folders = json.loads(f.read())
        rows = spark.createDataFrame([(x,) for x in folders], "folder string").repartition(len(folders))  # a row for each task of the call

        def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, target = opened(f"{root}/imports")
            for batch in batches:
                moved = 0
                for folder in batch.column("folder").to_pylist():
                    for f in own.get_file_info(pafs.FileSelector(folder, recursive=True, allow_not_found=True)):
                        if f.type == pafs.FileType.File:
                            category = posixpath.basename(posixpath.dirname(f.path))
                            own.create_dir(f"{target}/{category}")
                            own.move(f.path, f"{target}/{category}/{posixpath.basename(f.path)}")
                            moved += 1
                yield pa.RecordBatch.from_arrays([pa.array([moved])], names=["moved"])

        rows.mapInArrow(move, "moved long").agg(F.sum("moved")).collect()
        files.delete_dir(call)


def read_imports(spark: SparkSession, root: str) -> DataFrame:
    """category, name, body of the notes in the vault; empty files have no row."""
    files, base = opened(f"{root}/imports")
    if files.get_file_info(base).type != pafs.FileType.Directory:
        return spark.createDataFrame([], "category string, name string, body string")
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").option("recursiveFileLookup", "true").load(f"{root}/imports")
    inner = F.split(F.element_at(F.split("path", "/imports/", -1), -1), "/")
    own = rows.where(~F.contains("path", F.lit(f"/imports/{STAGED}/"))).withColumn("_p", inner)
    name = F.call_function("url_decode", F.replace(F.regexp_replace(F.element_at("_p", -1), r"\.md\z", ""), F.lit("+"), F.lit("%2B")))
    return own.select(F.element_at("_p", 1).alias("category"), name.alias("name"), F.col("content").cast("string").alias("body"))

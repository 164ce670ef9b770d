"""JSON lines and long JSON lists, read in byte ranges.

A split reads what begins in it.  Ordinals over a whole file or set of files
come from the counts of the splits before (a row for each split), so no task
sees more than its own range, and the rows are the same for any size of splits.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.window import Window

from .notes import opened

SPLIT_BYTES = 32 << 20
#: Bytes that are read at once.
BLOCK = 1 << 20
UNUSED = re.compile(rb"\s*(?:#|\Z)")


@dataclass
class Range(InputPartition):
    file: str
    split: int
    start: int
    end: int


def ranges(path: str, split_bytes: int, suffix: str = "") -> list[Range]:
    """Splits of a file, or of the files of a folder by name."""
    files, base = opened(path)
    info = files.get_file_info(base)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == pafs.FileType.File else sorted((f for f in files.get_file_info(pafs.FileSelector(base)) if f.type == pafs.FileType.File and f.path.endswith(suffix) and not f.base_name.startswith((".", "_"))), key=lambda f: f.path)
    out = []
    for f in found:
        out += [Range(f.path, len(out) + k, at, min(f.size, at + split_bytes)) for k, at in enumerate(range(0, f.size, split_bytes))]
    return out


class LineReader(DataSourceReader):
    def __init__(self, path: str, split_bytes: int):
        self.path, self.split_bytes = path, split_bytes

    def partitions(self) -> list[Range]:
        return ranges(self.path, self.split_bytes, ".jsonl") or [Range("", 0, 0, 0)]

    def read(self, part: Range) -> Iterator[tuple]:
        if not part.file:
            return
        files, _ = opened(self.path)
        with files.open_input_file(part.file) as f:
            n = 0
            for line in _lines(f, part.start, part.end):
                if not UNUSED.match(line):
                    yield (part.file, part.split, n, line.decode("utf-8", "replace"))
                    n += 1


def _lines(f, start: int, end: int) -> Iterator[bytes]:
    """The lines that begin from ``start`` on and before ``end``."""
    at, rest = max(0, start - 1), b""
    f.seek(at)
    skip = start > 0  # up to the end of the line that holds the byte before
    while True:
        block = f.read(BLOCK)
        rest += block
        pieces = rest.split(b"\n")
        rest = pieces.pop() if block else b""
        for line in pieces:
            if not skip and at >= end:
                return
            if not skip:
                yield line.removesuffix(b"\r")
            skip = False
            at += len(line) + 1
        if not block or not skip and at >= end:
            return


class LineSource(DataSource):
    """``spark.read.format("used_lines")``: file, split, n (within the split), value; blank lines and ``#`` comments are left out."""

    @classmethod
    def name(cls) -> str:
        return "used_lines"

    def schema(self) -> str:
        return "file string, split int, n long, value string"

    def reader(self, schema) -> LineReader:
        return LineReader(self.options["path"], int(self.options.get("splitbytes") or SPLIT_BYTES))


def with_ordinals(rows: DataFrame, ordinal: str) -> DataFrame:
    """rows (split, n, ...) with their number over all splits."""
    counts = rows.groupBy("split").agg(F.count(F.lit(1)).alias("_c"))  # a row for each split
    before = F.coalesce(F.sum("_c").over(Window.orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(F.broadcast(counts.select("split", before.alias("_before"))), "split").withColumn(ordinal, F.col("_before") + F.col("n")).drop("_before", "n", "split")


def read_lines(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """ordinal, file, value of the used lines of one JSONL file or of a folder's, by file name and place."""
    spark.dataSource.register(LineSource)
    rows = spark.read.format("used_lines").option("path", path).option("splitBytes", split_bytes).load()
    return with_ordinals(rows, "ordinal").select("ordinal", "file", "value")


# A long list in one JSON object: {"items": [ ... ], ...}.  What a byte means depends on what comes before it: whether it
# is inside of a string, how deep, and below which key.  Each split says what it does to either beginning.
TOKEN = re.compile(rb'["{}\[\],]')
STRING_END = re.compile(rb'(?:[^"\\]|\\.)*+"', re.S)


def _cut(f, at: int, size: int) -> int:
    """``at``, or behind the escape that it would cut."""
    low = max(0, at - BLOCK)
    f.seek(low)
    head = f.read(at - low)
    if at < size and (len(head) - len(head.rstrip(b"\\"))) % 2:
        return at + 1
    return at


def _bytes(files, part: dict, size: int) -> tuple[bytes, int]:
    with files.open_input_file(part["file"]) as f:
        low, high = (_cut(f, x, size) if 0 < x < size else x for x in (part["start"], part["end"]))
        f.seek(low)
        return f.read(high - low), low


def _tokens(data: bytes, inside: bool) -> Iterator[tuple[int, bytes, int]]:
    """(place, token, end) outside of strings; a string is one token, and one that the data doesn't end is ``b'"'`` to its end."""
    at = 0
    if inside:
        m = STRING_END.match(data)
        at = m.end() if m else len(data)
        yield 0, b"" if m else b'"', at  # the rest of a string
    while m := TOKEN.search(data, at):
        at = m.end()
        if m.group() == b'"':
            s = STRING_END.match(data, at)
            yield m.start(), b"s" if s else b'"', (at := s.end() if s else len(data))
        else:
            yield m.start(), m.group(), at


def _depth(token: bytes) -> int:
    return (token in (b"{", b"[")) - (token in (b"}", b"]"))


def _effect(data: bytes, inside: bool) -> tuple[bool, int]:
    """Whether the data ends inside of a string, and by how much it goes deeper."""
    depth, ends = 0, False
    for _, token, _ in _tokens(data, inside):
        depth += _depth(token)
        ends = token == b'"'
    return ends, depth


def _key(data: bytes, at: int, more) -> str | None:
    """The string that begins at ``at`` if a colon follows it; what the data cuts off is read on."""
    text, blocks = data[at:], None
    while True:
        m = STRING_END.match(text, 1)
        rest = text[m.end() :].lstrip() if m else b""
        if rest:
            return json.loads(text[: m.end()]) if rest.startswith(b":") else None
        blocks = more() if blocks is None else blocks
        block = next(blocks, b"")
        if not block:
            return None
        text += block


def _outline(data: bytes, inside: bool, depth: int, field: str, more) -> tuple[str | None, int, int]:
    """Of the outermost object: the last key that begins here, and how many lists begin below the key from before and below ``field``."""
    key, seen, before, own = None, False, 0, 0
    for at, token, end in _tokens(data, inside):
        if depth == 1 and token in (b"s", b'"') and data[at : at + 1] == b'"' and (name := _key(data, at, more)) is not None:
            key, seen = name, True
        if depth == 1 and token == b"[":
            before += not seen
            own += seen and key == field
        depth += _depth(token)
    return key, before, own


def read_items(spark: SparkSession, path: str, field: str = "items", split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """ordinal, value: the elements of the list ``field`` of one JSON object, each as JSON text.

    Three passes over the bytes: what each split does to strings and depth, its
    last key, and the elements.  Anything but an object with one such list is
    an error.
    """
    parts = [(r.file, r.split, r.start, r.end) for r in ranges(path, split_bytes)]
    if len({p[0] for p in parts}) != 1:
        raise ValueError(f"a batch needs a list of {field}")
    files, _ = opened(path)
    size = files.get_file_info(parts[0][0]).size
    splits = spark.createDataFrame(parts, "file string, split int, start long, end long").repartition(len(parts), "split")

    def over(df: DataFrame, shape: str, rows_of) -> DataFrame:
        """Each split's bytes through ``rows_of(part, data, more)``; more: what follows them in the file."""
        kinds = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}
        columns = [c.split() for c in shape.split(", ")]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, _ = opened(path)
            for batch in batches:
                for part in batch.to_pylist():
                    data, low = _bytes(own, part, size)
                    rows = list(rows_of(part, data, lambda low=low, data=data, part=part: _rest(own, part["file"], low + len(data))))
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[k]) for i, (_, k) in enumerate(columns)], names=[n for n, _ in columns])

        return df.mapInArrow(run, shape)

    inside, depth, states = False, 0, []
    known = over(splits, "split int, out_ends boolean, out_depth long, in_ends boolean, in_depth long", lambda p, data, more: [(p["split"], *_effect(data, False), *_effect(data, True))])
    for r in known.orderBy("split").collect():  # a row for each split
        states.append((r["split"], inside, depth))
        inside, depth = (r["in_ends"], depth + r["in_depth"]) if inside else (r["out_ends"], depth + r["out_depth"])
    if inside or depth:
        raise ValueError("a batch must be one JSON object")
    begun = splits.join(F.broadcast(spark.createDataFrame(states, "split int, inside boolean, depth long")), "split")
    last, under, lists = None, [], 0
    outline = over(begun, "split int, key string, before long, own long", lambda p, data, more: [(p["split"], *_outline(data, p["inside"], p["depth"], field, more))])
    for r in outline.orderBy("split").collect():  # a row for each split
        under.append((r["split"], last))
        lists += r["own"] + (r["before"] if last == field else 0)
        last = r["key"] if r["key"] is not None else last
    if lists != 1:
        raise ValueError(f"a batch needs a list of {field}")
    ready = begun.join(F.broadcast(spark.createDataFrame(under, "split int, key string")), "split")
    found = over(ready, "split int, n long, value string", lambda p, data, more: ((p["split"], n, x) for n, x in enumerate(_elements(data, p["inside"], p["depth"], p["key"], field, more))))
    return with_ordinals(found, "ordinal").select("ordinal", "value")


def _rest(files, file: str, at: int) -> Iterator[bytes]:
    """Blocks of the file from ``at`` on."""
    with files.open_input_file(file) as f:
        f.seek(at)
        while block := f.read(BLOCK):
            yield block


def _elements(data: bytes, inside: bool, depth: int, key: str | None, field: str, more) -> Iterator[str]:
    """Elements of the list whose bracket or comma before them is in the data; the last one may end behind it."""
    begin = None
    for at, token, end in _tokens(data, inside):
        if depth == 1 and token in (b"s", b'"') and data[at : at + 1] == b'"' and (name := _key(data, at, more)) is not None:
            key = name
        if key == field and depth == 2 and begin is not None and token in (b",", b"]"):
            yield from _value(data[begin:at])
            begin = None
        depth += _depth(token)
        if key == field and depth == 2 and token in (b"[", b","):
            begin = end
    if begin is not None:
        yield from _value(_until_end(data[begin:], more()))


def _until_end(text: bytes, blocks: Iterator[bytes]) -> bytes:
    """An element whose beginning is ``text``, up to the comma or bracket behind it."""
    while True:
        depth = 0
        for at, token, _ in _tokens(text, False):
            if depth == 0 and token in (b",", b"]"):
                return text[:at]
            depth += _depth(token)
        block = next(blocks, b"")
        if not block:
            raise ValueError("a batch must be one JSON object")
        text += block


def _value(text: bytes) -> Iterator[str]:
    """The element, if there is one between its separators."""
    value = text.decode("utf-8", "replace").strip()
    if value:
        json.loads(value)
        yield value

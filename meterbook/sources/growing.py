"""Lines of files that producers append to, by byte ranges, as a table of ranges and as a stream.

A file is read from where the last pass ended up to its last newline, and no
further: a line whose end isn't written yet is held back until it is. A last
line without a newline is taken if it is one JSON value, which can't go on. A
range has the lines that begin in it, so each range is a task of its own
whatever the file's size, and every line is read by exactly one.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: Bytes of a range.
RANGE_BYTES = 64 << 20
#: Files of a task, if they are small.
TASK_FILES = 100
_BLOCK = 1 << 20
_BOM = b"\xef\xbb\xbf"


def _store(path: str) -> tuple[fs.FileSystem, str, str]:
    """The store of a path, the name in it, and what goes before a name to make it a path again."""
    scheme, rest = path.split("://", 1) if "://" in path else ("file", path.removeprefix("file:"))
    if scheme == "file":
        return fs.LocalFileSystem(), rest, ""
    host, _, name = rest.partition("/")
    store, root = fs.FileSystem.from_uri(f"{scheme}://{host}")
    root = root.rstrip("/")
    return store, f"{root}/{name}", f"{scheme}://{host}"[: -len(root) or None]


def opened(path: str) -> BinaryIO:
    store, name, _ = _store(path)
    return store.open_input_file(name)


def listed(folder: str, extensions: tuple[str, ...]) -> dict[str, int]:
    """The bytes of every file below a folder that has one of the extensions, in any case."""
    store, name, before = _store(folder)
    found = store.get_file_info(fs.FileSelector(name, recursive=True, allow_not_found=True))
    return {before + f.path: f.size for f in found if f.type == fs.FileType.File and f.base_name[:1] not in "._" and f.extension.lower() in extensions}


def whole_end(path: str, start: int, length: int) -> int:
    """Up to where a file's lines from start on are whole."""
    if length <= start:
        return start
    with opened(path) as file:
        end, tail = length, b""
        while end > start:
            begin = max(start, end - _BLOCK)
            file.seek(begin)
            block = file.read(end - begin)
            cut = block.rfind(b"\n")
            if cut >= 0:
                return length if _complete(block[cut + 1 :] + tail) else begin + cut + 1
            tail, end = block + tail, begin
    return length if _complete(tail) else start


def _complete(text: bytes) -> bool:
    """Whether a text can't go on: a JSON object or array that has ended."""
    if text.strip()[:1] not in (b"{", b"["):
        return False
    try:
        json.loads(text)
    except (ValueError, RecursionError):
        return False
    return True


def lines_in(file: BinaryIO, first: int, begin: int, end: int, stop: int) -> Iterator[list[bytes]]:
    """Some at a time, the lines of bytes first to stop that start in begin to end; first is the start of a line."""
    at, held = begin, bytearray()
    file.seek(begin)
    if begin > first:
        # The line that holds the byte before belongs to another range.
        at -= 1
        file.seek(at)
        while True:
            block = file.read(min(_BLOCK, stop - at))
            cut = block.find(b"\n")
            if not block or (cut < 0 and at + len(block) >= end):
                return
            if cut >= 0:
                held += block[cut + 1 :]
                at += cut + 1
                break
            at += len(block)
    new = 0
    while at < end:
        cut = held.rfind(b"\n", new)
        if cut < 0:
            new = len(held)
            block = file.read(min(_BLOCK, stop - at - new))
            if not block:
                if held:
                    yield [bytes(held)]
                return
            held += block
            continue
        some = bytes(held[:cut]).split(b"\n")
        if at + cut >= end:
            before, place = 0, at
            while before < len(some) and place < end:
                place += len(some[before]) + 1
                before += 1
            some = some[:before]
        yield some
        del held[: cut + 1]
        at, new = at + cut + 1, 0


def _batches(path: str, first: int, begin: int, end: int, stop: int) -> Iterator[pa.RecordBatch]:
    with opened(path) as file:
        for i, some in enumerate(lines_in(file, first, begin, end, stop)):
            if i == 0 and begin == 0:
                some[0] = some[0].removeprefix(_BOM)
            texts = [t for t in (line.strip().decode("utf-8", "replace") for line in some) if t]
            if texts:
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array([path] * len(texts), pa.string())], ["value", "path"])


def with_ends(files: DataFrame, lines: tuple[str, ...]) -> DataFrame:
    """files (path, start, length and others) with stop: the end of whole lines for files of lines, the length for others."""

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*[batch.column(c).to_pylist() for c in ("path", "start", "length")], strict=True)
            yield batch.append_column("stop", pa.array([whole_end(*r) if r[0].rpartition(".")[2].lower() in lines else r[2] for r in rows], pa.int64()))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema)
    return files.mapInArrow(ends, f"{kinds}, stop long")


def dealt(ranges: DataFrame, range_bytes: int, counted: DataFrame | None = None) -> DataFrame:
    """Ranges (path, begin, end and others), each for a task; small ones share tasks. counted: the same ranges by a cheaper plan, to be counted."""
    rows, total = (ranges if counted is None else counted).agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("end") - F.col("begin")), F.lit(0))).first()
    tasks = max(1, min(rows, -(-total // range_bytes) + rows // TASK_FILES + 1))
    return ranges.repartitionByRange(tasks, F.xxhash64("path", "begin"))


def read_ranges(files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """value and path of the lines of files (path, start, stop), each range in a task; small files share tasks."""
    size = F.col("stop") - F.col("start")
    number = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((size - 1) / range_bytes)))
    ranges = files.where(size > 0).select("path", "start", "stop", number.alias("number"))
    begin = F.col("start") + F.col("number") * range_bytes
    ranges = ranges.select("path", "start", begin.alias("begin"), F.least(begin + range_bytes, F.col("stop")).alias("end"), "stop")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in zip(*[batch.column(c).to_pylist() for c in ("path", "start", "begin", "end", "stop")], strict=True):
                yield from _batches(*r)

    return dealt(ranges, range_bytes).mapInArrow(read, "value string, path string")


def read_whole(files: DataFrame) -> DataFrame:
    """value and path of whole files (path)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with opened(path) as file:
                    text = file.read().decode("utf-8", "replace")
                yield pa.RecordBatch.from_arrays([pa.array([text], pa.large_string()).cast(pa.string()), pa.array([path], pa.string())], ["value", "path"])

    return files.select("path").mapInArrow(read, "value string, path string")


class Ranges(InputPartition):
    def __init__(self, ranges: list[tuple[str, int, int, int, int]]):
        super().__init__(None)
        self.ranges = ranges


def dealt_ranges(spans: dict[str, tuple[int, int]], range_bytes: int) -> list[Ranges]:
    """The ranges of each file's span, a task each; those of small files are put together."""
    tasks: list[Ranges] = []
    small, held = [], 0
    for path, (start, stop) in sorted(spans.items()):
        for begin in range(start, stop, range_bytes):
            end = min(begin + range_bytes, stop)
            if stop - start >= range_bytes:
                tasks.append(Ranges([(path, start, begin, end, stop)]))
                continue
            small.append((path, start, begin, end, stop))
            held += end - begin
            if held >= range_bytes or len(small) >= TASK_FILES:
                tasks.append(Ranges(small))
                small, held = [], 0
    return [*tasks, Ranges(small)] if small else tasks


class _Lines:
    def __init__(self, options: dict[str, str]):
        self.folder, self.extensions = options["path"], tuple(options["extensions"].split(","))
        self.range_bytes = int(options.get("rangeBytes", RANGE_BYTES))
        #: Of each file, its size when it was last looked at, and the end of its whole lines then.
        self.seen: dict[str, tuple[int, int]] = {}

    def ends(self) -> dict[str, int]:
        """Up to where each file can be read. Only files whose size has changed are looked into."""
        sizes = listed(self.folder, self.extensions)
        for path, size in sizes.items():
            was, end = self.seen.get(path, (-1, 0))
            if size != was:
                self.seen[path] = (size, whole_end(path, end if end <= size else 0, size))
        self.seen = {p: s for p, s in self.seen.items() if p in sizes}
        return {p: end for p, (_, end) in self.seen.items()}

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        for r in partition.ranges:
            yield from _batches(*r)


class _Batch(_Lines, DataSourceReader):
    def partitions(self) -> list[Ranges]:
        return dealt_ranges({p: (0, end) for p, end in self.ends().items()}, self.range_bytes)


class _Stream(_Lines, DataSourceStreamReader):
    """The offset is the set of file ends: {path: bytes read}. A file that has become shorter is read from its start."""

    def initialOffset(self) -> dict:  # noqa: N802 - the interface's names
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        return self.ends()

    def partitions(self, start: dict, end: dict) -> list[Ranges]:
        spans = {p: (start.get(p, 0) if start.get(p, 0) <= stop else 0, stop) for p, stop in end.items()}
        return dealt_ranges({p: s for p, s in spans.items() if s[0] < s[1]}, self.range_bytes)

    def commit(self, end: dict) -> None:
        pass


class GrowingLines(DataSource):
    """Options: path (a folder), extensions (joined by commas), rangeBytes."""

    @classmethod
    def name(cls) -> str:
        return "growing_lines"

    def schema(self) -> str:
        return "value string, path string"

    def reader(self, schema: object) -> DataSourceReader:
        return _Batch(self.options)

    def streamReader(self, schema: object) -> DataSourceStreamReader:  # noqa: N802
        return _Stream(self.options)


def _options(folder: str, extensions: tuple[str, ...], range_bytes: int) -> dict[str, str]:
    return {"path": folder, "extensions": ",".join(extensions), "rangeBytes": str(range_bytes)}


def lines(spark: SparkSession, folder: str, extensions: tuple[str, ...], range_bytes: int = RANGE_BYTES) -> DataFrame:
    """value and path of all whole lines below a folder."""
    spark.dataSource.register(GrowingLines)
    return spark.read.format("growing_lines").options(**_options(folder, extensions, range_bytes)).load()


def line_stream(spark: SparkSession, folder: str, extensions: tuple[str, ...], range_bytes: int = RANGE_BYTES) -> DataFrame:
    """A stream of the lines below a folder, those that are added to known files among them."""
    spark.dataSource.register(GrowingLines)
    return spark.readStream.format("growing_lines").options(**_options(folder, extensions, range_bytes)).load()

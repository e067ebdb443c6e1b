"""Event logs in binary form: a Spark data source that plans chunk ranges and leaves the bytes to a decoder.

Such logs are a header and chunks of a fixed size that can be read on their own, so a file is cut into
ranges of chunks. A task takes one range or, of large logs, several: there are some TASKS tasks, or as many as keep a task at TASK_BYTES. The format's decoder is named by an option
(`module:function`; it gets a chunk's bytes and yields records as XML text, an empty one for what
is damaged): BINARY_XML is that of binary logs; `lines` decodes text with one record a line, in which a chunk begins
after the first line feed and ends with the line that it began.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .events import parse_records

#: The decoder of binary logs (factloom.sources.binxml).
BINARY_XML = "factloom.sources.binxml:decode"
HEADER = 4096
CHUNK = 64 << 10
#: Chunks that one task decodes.
CHUNKS = 256
BATCH_ROWS = 1_000
#: Small ranges are put together to about this many tasks, of at most so many bytes (a range may be longer).
TASKS = 64
TASK_BYTES = 32 << 20


class Chunks(InputPartition):
    def __init__(self, path: str, start: int, end: int, size: int) -> None:
        self.path, self.start, self.end, self.size = path, start, end, size


class Task(InputPartition):
    """Ranges that one task reads."""

    def __init__(self, ranges: list[Chunks]) -> None:
        self.ranges = ranges


def together(ranges: Iterator[Chunks], total: int) -> Iterator[Task]:
    """Ranges in their order put into tasks; neighbours in a file become one range."""
    most = min(TASK_BYTES, -(-total // TASKS))
    held, size = [], 0
    for r in ranges:
        n = r.end - r.start
        if held and size + n > most:
            yield Task(held)
            held, size = [], 0
        if held and held[-1].path == r.path and held[-1].end == r.start:
            held[-1] = Chunks(r.path, held[-1].start, r.end, r.size)
        else:
            held.append(r)
        size += n
    if held:
        yield Task(held)


class EventLogReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"] if "://" in options["path"] else "file://" + options["path"].removeprefix("file:")
        self.decoder = options.get("decoder", "lines")
        text = self.decoder == "lines"
        self.header, self.chunk = int(options.get("header", 0 if text else HEADER)), int(options.get("chunk", CHUNK))
        self.step = self.chunk * int(options.get("chunks", CHUNKS))

    def partitions(self) -> list[Task]:
        from pyarrow import fs

        system, at = fs.FileSystem.from_uri(self.path)
        found = system.get_file_info(at)
        if found.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [found] if found.type == fs.FileType.File else [f for f in system.get_file_info(fs.FileSelector(at, recursive=True)) if f.type == fs.FileType.File and not f.base_name.startswith((".", "_"))]
        ranges = (Chunks(f.path, a, min(a + self.step, f.size), f.size) for f in sorted(files, key=lambda f: f.path) for a in range(self.header, f.size, self.step))
        return list(together(ranges, sum(f.size for f in files)))

    def read(self, part: Task | None) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        if part is None:
            return
        system, _ = fs.FileSystem.from_uri(self.path)
        for piece in part.ranges:
            with system.open_input_file(piece.path) as source:
                records = self.lines(source, piece) if self.decoder == "lines" else self.decoded(source, piece)
                while rows := list(islice(records, BATCH_ROWS)):
                    at, texts = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array([piece.path] * len(at)), pa.array(at, pa.int64()), pa.array(texts, pa.string())], names=["path", "offset", "value"])

    def decoded(self, source, part: Chunks) -> Iterator[tuple[int, str]]:
        decode = self.load(self.decoder)
        for at in range(part.start, part.end, self.chunk):
            source.seek(at)
            for text in decode(source.read(min(self.chunk, part.size - at))):
                yield at, text

    @staticmethod
    def load(name: str) -> Callable[[bytes], Iterator[str]]:
        module, _, function = name.partition(":")
        return getattr(importlib.import_module(module), function)

    def lines(self, source, part: Chunks) -> Iterator[tuple[int, str]]:
        """The lines that begin in the range, read a chunk at a time."""
        at, held = max(0, part.start - 1), b""
        source.seek(at)
        skip = part.start > 0  # the range before reads the line that reaches into this one
        while at < part.end:
            data = source.read(self.chunk)
            if not data:
                break
            held += data
            while at < part.end and (n := held.find(b"\n")) >= 0:
                if not skip:
                    yield at, held[:n].decode("utf-8", "replace")
                skip, at, held = False, at + n + 1, held[n + 1 :]
            if skip and b"\n" not in held:
                at, held = at + len(held), b""
        if held and not skip and at < part.end:
            yield at, held.decode("utf-8", "replace")


class EventLogSource(DataSource):
    """spark.read.format("factloom_event_log").load(file or folder); options decoder, header, chunk, chunks."""

    @classmethod
    def name(cls) -> str:
        return "factloom_event_log"

    def schema(self) -> str:
        return "path string, offset long, value string"

    def reader(self, schema) -> EventLogReader:
        return EventLogReader(dict(self.options))


def read_binary_log(spark: SparkSession, path: str, decoder: str = "lines", **options: int) -> DataFrame:
    """Parsed records of a log file, or of all logs of a folder."""
    spark.dataSource.register(EventLogSource)
    reader = spark.read.format("factloom_event_log").option("decoder", decoder)
    for name, value in options.items():
        reader = reader.option(name, str(value))
    return parse_records(reader.load(path))

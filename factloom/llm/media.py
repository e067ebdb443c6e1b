"""Media columns: payloads stored as images in archives, read back by byte ranges.

store_media() packs each partition's payloads as 8-bit grey images (PNG, 64 samples a row,
lossless) into ZIP archives of bounded size whose members are stored as they are. MediaSource
reads a folder of archives, its own or others (stored or deflated members): it plans partitions
as byte ranges of archives from file sizes alone, and a task finds its members in the archive's
directory (those that begin in its range) and reads them in blocks of neighbours, a bounded
Arrow batch each. An archive of this module says in its comment where in its directory the members of each INDEX_BYTES
begin, so that a range reads its part of the directory; of others it is read whole. A member that a block does not give whole is read by its own offset, again
on its own if that fails.

Null and empty texts are 64 zero bytes. A null id is kept as null. Repeated rows are separate
members. Task attempts write the same bytes under the same name, so a task that runs again
replaces its archive rather than adding to it. Members whose names are not of this module's
form have no doc_id.
"""

from __future__ import annotations

import hashlib
import re
import struct
import time
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .common import map_texts, scratch, slices, utf8_of

ROW = 64
#: Archive bytes that one reading task covers.
RANGE_BYTES = 16 << 20
#: Ranges become longer where there would be more of them.
MOST_RANGES = 50_000
#: An archive ends when it is so long, so that its directory stays short.
ARCHIVE_BYTES = 256 << 20
#: A place in the directory is noted for each so many archive bytes; the notes must fit a comment of 64 KB.
INDEX_BYTES = 1 << 20
#: Media bytes in one Arrow batch, and in one read.
BATCH_BYTES = 2 << 20
ATTEMPTS = 4
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
_LOCAL, _CENTRAL, _END, _END64, _LOCATOR = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
_INDEX = b"factloom index 1\n"
_MOST_NOTES = (0xFFFF - len(_INDEX)) // 16


# -- the image format

def payload(data: bytes) -> bytes:
    return data + bytes(-len(data) % ROW or (0 if data else ROW))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(data: bytes) -> bytes:
    """data: a positive multiple of 64 bytes. The same data give the same bytes."""
    rows = len(data) // ROW
    lines = np.zeros((rows, ROW + 1), np.uint8)  # each row begins with its filter, 0
    lines[:, 1:] = np.frombuffer(data, np.uint8).reshape(rows, ROW)
    return _SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", ROW, rows, 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + _chunk(b"IEND", b"")


def from_png(image: bytes) -> bytes:
    """The samples of an image of to_png(); checksums and sizes are held against the header."""
    if image[:8] != _SIGNATURE:
        raise ValueError("not a PNG image")
    at, packed, size = 8, b"", None
    while at < len(image):
        n, kind = struct.unpack(">I4s", image[at : at + 8])
        body = image[at + 8 : at + 8 + n]
        if struct.unpack(">I", image[at + 8 + n : at + 12 + n])[0] != zlib.crc32(kind + body):
            raise ValueError("a chunk's checksum differs")
        if kind == b"IHDR":
            size = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed += body
        at += 12 + n
    if size is None or size[2:] != (8, 0, 0, 0, 0):
        raise ValueError("only plain 8-bit grey images")
    lines = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(size[1], size[0] + 1)
    if lines[:, 0].any():
        raise ValueError("only unfiltered rows")
    return lines[:, 1:].tobytes()


def feature(data: bytes) -> str:
    """Mean, spread and a 64-bit difference hash over a grid of 8 x 9 means, all in integers."""
    x = np.frombuffer(data, np.uint8).astype(np.int64)
    n = len(x)
    mean, square = int(x.sum()) * 1000 // n, int((x * x).sum()) * 1000 // n
    edges = np.arange(73) * n // 72
    total = np.concatenate([[0], np.cumsum(x)])
    grid = ((total[edges[1:]] - total[edges[:-1]]) * 1000 // np.maximum(1, np.diff(edges))).reshape(8, 9)
    bits = (grid[:, 1:] > grid[:, :-1]).ravel()
    return f"{n}:{mean}:{square}:{np.packbits(bits).tobytes().hex()}"


# -- archives

def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


def _normal(path: str) -> str:
    return path if "://" in path or not path.startswith("file:") else "file://" + path.removeprefix("file:")


class ArchiveWriter:
    """A ZIP archive without compression, with 64-bit sizes where needed, written front to back."""

    def __init__(self, out) -> None:
        self.out, self.at, self.entries = out, 0, []

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, name: str, data: bytes) -> None:
        raw, crc, start = name.encode(), zlib.crc32(data), self.at
        self._put(struct.pack("<4sHHHHHIIIHH", _LOCAL, 20, 0x800, 0, 0, 33, crc, len(data), len(data), len(raw), 0) + raw)
        self._put(data)
        self.entries.append((raw, crc, len(data), start))

    def close(self) -> None:
        start, notes, last = self.at, [], -1
        step = max(INDEX_BYTES, -(-start // _MOST_NOTES))
        for raw, crc, n, offset in self.entries:
            if offset // step > last:
                last = offset // step
                notes.append((offset, self.at))
            extra = struct.pack("<HHQ", 1, 8, offset) if offset >= 0xFFFFFFFF else b""
            self._put(struct.pack("<4sHHHHHHIIIHHHHHII", _CENTRAL, 45, 45 if extra else 20, 0x800, 0, 0, 33, crc, n, n, len(raw), len(extra), 0, 0, 0, 0, min(offset, 0xFFFFFFFF)) + raw + extra)
        size, count, end = self.at - start, len(self.entries), self.at
        self._put(struct.pack("<4sQHHIIQQQQ", _END64, 44, 45, 45, 0, 0, count, count, size, start))
        self._put(struct.pack("<4sIQI", _LOCATOR, 0, end, 1))
        self._put(struct.pack("<4sHHHHIIH", _END, 0, 0, min(count, 0xFFFF), min(count, 0xFFFF), min(size, 0xFFFFFFFF), min(start, 0xFFFFFFFF), len(_INDEX) + 16 * len(notes)))
        self._put(_INDEX + b"".join(struct.pack("<QQ", *x) for x in notes))


#: Names that store_media() gives: number, id, and the payload's bytes without padding.
_NAME = re.compile(r"[0-9]+-(null|-?[0-9]+)\.([0-9]+)\.png")
#: The longest end of an archive: a comment may have 64 KB.
_TAIL = 22 + 0xFFFF + 76


@dataclass(frozen=True)
class Member:
    name: str
    offset: int  # of its local header
    packed: int  # bytes in the archive
    size: int
    crc: int
    method: int


def directory(source, size: int, first: int = 0, end: int | None = None) -> Iterator[Member]:
    """The members of an archive, in the directory's order: all, or at least those that begin from `first` on and before `end`."""
    base = max(0, size - _TAIL)
    tail = _read_at(source, base, size - base)
    at = tail.rfind(_END)
    if at < 0:
        raise ValueError("no archive directory")
    length, start = struct.unpack("<II", tail[at + 12 : at + 20])
    if (wide := tail.rfind(_END64, 0, at)) >= 0 and tail[at - 20 : at - 16] == _LOCATOR:
        length, start = struct.unpack("<QQ", tail[wide + 40 : wide + 56])
    stop = start + length
    comment = tail[at + 22 :]
    if comment.startswith(_INDEX):
        notes = list(struct.iter_unpack("<QQ", comment[len(_INDEX) :]))
        start = max([p for o, p in notes if o <= first], default=start)
        stop = min([p for o, p in notes if end is not None and o >= end], default=stop)
    length = max(0, stop - start)
    data = _read_at(source, start, length)
    at = 0
    while at < length:
        method = struct.unpack("<H", data[at + 10 : at + 12])[0]
        crc, packed, n, name, extra, comment = struct.unpack("<IIIHHH", data[at + 16 : at + 34])
        offset = struct.unpack("<I", data[at + 42 : at + 46])[0]
        more = data[at + 46 + name : at + 46 + name + extra]
        values = iter(_wide_values(more))
        n, packed, offset = (next(values) if v == 0xFFFFFFFF else v for v in (n, packed, offset))
        yield Member(data[at + 46 : at + 46 + name].decode("utf-8", "replace"), offset, packed, n, crc, method)
        at += 46 + name + extra + comment


def _wide_values(extra: bytes) -> list[int]:
    """The 64-bit numbers that stand for those that do not fit a directory entry."""
    at = 0
    while at + 4 <= len(extra):
        kind, n = struct.unpack("<HH", extra[at : at + 4])
        if kind == 1:
            return list(struct.unpack(f"<{n // 8}Q", extra[at + 4 : at + 4 + n // 8 * 8]))
        at += 4 + n
    return []


def _read_at(source, offset: int, size: int) -> bytes:
    source.seek(offset)
    data = source.read(size)
    if len(data) != size:
        raise OSError(f"short read at {offset}")
    return data


def content(m: Member, local: bytes) -> bytes | None:
    """A member's bytes out of what begins with its local header, or None if they are not there whole."""
    if local[:4] != _LOCAL or len(local) < 30:
        return None
    at = 30 + sum(struct.unpack("<HH", local[26:30]))
    data = local[at : at + m.packed]
    if len(data) != m.packed:
        return None
    if m.method == 8:
        try:
            data = zlib.decompress(data, -15)
        except zlib.error:
            return None
    elif m.method:
        raise ValueError(f"{m.name}: members can be stored or deflated only")
    return data if zlib.crc32(data) == m.crc else None


def blocks(members: list[Member]) -> Iterator[list[Member]]:
    """Neighbours of about BATCH_BYTES together, packed or not, with no long gaps between them."""
    held: list[Member] = []
    total = 0
    for m in members:
        last = held[-1] if held else None
        if last and (total + max(m.size, m.packed) > BATCH_BYTES or m.offset - last.offset - last.packed > BATCH_BYTES // 8):
            yield held
            held, total = [], 0
        held.append(m)
        total += max(m.size, m.packed)
    if held:
        yield held


def read_block(block: list[Member], source, size: int, open_again: Callable) -> list[bytes]:
    """The members of a block by one read; those that it does not give whole are read one by one."""
    start, last = block[0].offset, block[-1]
    end = min(size, last.offset + last.packed + 30 + len(last.name.encode()) + 64)  # local headers may be longer than expected
    try:
        data = _read_at(source, start, end - start)
    except OSError:
        data = b""
    return [found if (found := content(m, data[m.offset - start :][: m.packed + 4096])) is not None else read_member(m, size, open_again) for m in block]


def read_member(m: Member, size: int, open_again: Callable) -> bytes:
    """One member by its own offset, with a file handle of its own each time."""
    for attempt in range(ATTEMPTS):
        try:
            with open_again() as source:
                head = _read_at(source, m.offset, 30)
                found = content(m, head + _read_at(source, m.offset + 30, sum(struct.unpack("<HH", head[26:30])) + m.packed))
            if found is not None:
                return found
        except OSError:
            if attempt + 1 == ATTEMPTS:
                raise
        if attempt + 1 < ATTEMPTS:
            time.sleep(0.1 * 2**attempt)
    raise OSError(f"{m.name}: the member at {m.offset} is damaged")


class Range(InputPartition):
    def __init__(self, path: str, size: int, start: int, end: int) -> None:
        self.path, self.size, self.start, self.end = path, size, start, end


class MediaReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.step = _normal(options["path"]), int(options.get("rangebytes", RANGE_BYTES))

    def partitions(self) -> list[Range]:
        from pyarrow import fs

        system, at = _filesystem(self.path)
        files = [f for f in system.get_file_info(fs.FileSelector(at)) if f.path.endswith(".zip")]
        step = max(self.step, sum(f.size for f in files) // MOST_RANGES)
        return [Range(f.path, f.size, a, min(a + step, f.size)) for f in sorted(files, key=lambda f: f.path) for a in range(0, f.size, step)]

    def read(self, part: Range | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # a folder without archives
            return
        system, _ = _filesystem(self.path)
        with system.open_input_file(part.path) as source:
            members = sorted((m for m in directory(source, part.size, part.start, part.end) if part.start <= m.offset < part.end and not m.name.endswith("/")), key=lambda m: m.offset)
            for block in blocks(members):
                images = read_block(block, source, part.size, lambda: system.open_input_file(part.path))
                found = [_NAME.fullmatch(m.name) for m in block]
                yield self.batch([int(f[1]) if f and f[1] != "null" else None for f in found], [m.name for m in block], [m.offset for m in block], images)

    @staticmethod
    def batch(ids: list, names: list, offsets: list, images: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(names, pa.string()), pa.array(offsets, pa.int64()), pa.array(images, pa.binary())], names=["doc_id", "member", "offset", "image"])


class MediaSource(DataSource):
    """spark.read.format("factloom_media").load(folder); option rangeBytes: archive bytes of a partition."""

    @classmethod
    def name(cls) -> str:
        return "factloom_media"

    def schema(self) -> str:
        return "doc_id long, member string, offset long, image binary"

    def reader(self, schema) -> MediaReader:
        return MediaReader(dict(self.options))


def store_media(df: DataFrame, folder: str, *, doc_id: str = "doc_id", text: str = "text") -> None:
    """Writes the archives, one for each partition of df that has rows."""
    from pyspark import TaskContext
    from pyspark.sql import functions as F

    folder = _normal(folder)
    _filesystem(folder)[0].create_dir(_filesystem(folder)[1], recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, at = _filesystem(folder)
        rows = ((i, data) for part in slices(batches) for i, data in zip(part.column(0).to_pylist(), utf8_of(part), strict=True))
        row, number = next(rows, None), 0
        while row is not None:
            name = f"part-{TaskContext.get().partitionId():06d}-{number:04d}.zip"
            held, count = f"{at}/.{name}.{uuid.uuid4().hex}", 0
            with system.open_output_stream(held) as out:
                writer = ArchiveWriter(out)
                while row is not None and writer.at < ARCHIVE_BYTES:
                    i, data = row
                    writer.add(f"{count:09d}-{'null' if i is None else i}.{len(data)}.png", to_png(payload(data)))
                    count += 1
                    row = next(rows, None)
                writer.close()
            system.move(held, f"{at}/{name}")
            number += 1
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([count], pa.int64())], names=["archive", "members"])

    written = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(run, "archive string, members long")
    written.write.format("noop").mode("overwrite").save()


def media_table(df: DataFrame, folder: str | None = None, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Stores the payloads of df and returns the archives' members as a table: doc_id, member, offset, image."""
    spark = df.sparkSession
    folder = folder or scratch(spark) + "/media"
    store_media(df, folder, doc_id=doc_id, text=text)
    spark.dataSource.register(MediaSource)
    return spark.read.format("factloom_media").load(folder)


def media_features(members: DataFrame) -> DataFrame:
    """Digests and features of members, from the stored bytes."""
    from pyspark.sql import functions as F

    def work(batch: pa.RecordBatch) -> list:
        images = batch.column(1).to_pylist()
        data = [from_png(x) for x in images]
        named = [_NAME.fullmatch(m) for m in batch.column(2).to_pylist()]
        sizes = [int(m[2]) if m else len(x) for m, x in zip(named, data, strict=True)]
        return [sizes, [len(x) for x in data], [hashlib.sha256(x).hexdigest() for x in data], [zlib.crc32(x[-ROW:]) for x in data], [len(x) for x in images], [hashlib.sha256(x).hexdigest() for x in images], [feature(x) for x in data]]

    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    ddl = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return map_texts(members.select("doc_id", F.col("image").alias("text"), "member"), ddl, names, work, keep=("member",))

"""A content-addressed store on shared storage, filled by executors: one copy of each content, packed into files, and a manifest.

A job stores a table of contents, or files by their paths (which executors read in pieces, so that their
size does not matter). What is new is found by hash first: in the job the first name of a content stays,
and contents that the store has are left out. Tasks then append new contents to packs of about PACK_BYTES in a
staging folder, each beside a part of the manifest that says where in which pack a content lies. The
driver publishes a job by one rename of its staging folder, after it has removed what attempts left behind
that were not committed; it handles names of parts and packs, never of contents. A job that fails leaves nothing.

`<root>/jobs/<job>/packs`, `<root>/jobs/<job>/manifest`; jobs are named by the time they began, so that of two jobs that store the same content
at the same time the manifest shows the earlier one's. Null contents are no contents; empty ones are.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..plans.lineage import cut_lineage

PACK_BYTES = 256 << 20
PIECE = 4 << 20
#: Rows of a task's manifest that are held before they are written.
ROWS = 10_000
MANIFEST = "evidence_hash string, original_path string, original_name string, size_bytes long, ingested_at string, pack string, offset long"
PUBLIC = ["evidence_hash", "original_name", "size_bytes", "ingested_at"]
FORMAT = "factloom_vault"


def opened(uri: str):
    """A file system and the path in it, of a URI or a plain path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


@dataclass
class Stored(WriterCommitMessage):
    """What one task wrote, by file name."""

    packs: list[str]
    parts: list[str]


class VaultWriter(DataSourceArrowWriter):
    def __init__(self, options: dict) -> None:
        self.root, self.job = options["path"].rstrip("/"), options["job"]
        self.pack_bytes = int(options.get("pack_bytes", PACK_BYTES))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Stored:
        """Rows (evidence_hash, original_path, original_name, content); a null content is read from original_path."""
        system, root = opened(self.root)
        staging = f"{root}/_staging/{self.job}"
        done, held, out, place, name = Stored([], []), [], None, 0, ""
        kind = pa.schema([("evidence_hash", pa.string()), ("original_path", pa.string()), ("original_name", pa.string()), ("size_bytes", pa.int64()), ("ingested_at", pa.string()), ("pack", pa.string()), ("offset", pa.int64())])

        def settle() -> None:
            if held:
                part = f"{uuid.uuid4().hex}.parquet"
                system.create_dir(f"{staging}/manifest", recursive=True)
                pq.write_table(pa.Table.from_pylist(held, kind), f"{staging}/manifest/{part}", filesystem=system)
                done.parts.append(part)
                held.clear()

        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    if out is None or place >= self.pack_bytes:
                        if out is not None:
                            out.close()
                        name, place = f"{uuid.uuid4().hex}.pack", 0
                        system.create_dir(f"{staging}/packs", recursive=True)
                        out = system.open_output_stream(f"{staging}/packs/{name}")
                        done.packs.append(name)
                    digest, size = hashlib.sha256(), 0
                    for piece in self.pieces(row):
                        digest.update(piece)
                        out.write(piece)
                        size += len(piece)
                    if digest.hexdigest() != row["evidence_hash"]:
                        raise OSError(f"{row['original_path']} changed while it was stored")
                    held.append({"evidence_hash": row["evidence_hash"], "original_path": row["original_path"], "original_name": row["original_name"], "size_bytes": size, "ingested_at": datetime.now(UTC).isoformat(), "pack": name, "offset": place})
                    place += size
                    if len(held) >= ROWS:
                        settle()
        finally:
            if out is not None:
                out.close()
        settle()
        return done

    @staticmethod
    def pieces(row: dict) -> Iterator[bytes]:
        if row["content"] is not None:
            yield row["content"]
            return
        system, path = opened(row["original_path"])
        with system.open_input_stream(path) as source:
            while piece := source.read(PIECE):
                yield piece

    def commit(self, messages: list[Stored | None]) -> None:
        from pyarrow import fs

        system, root = opened(self.root)
        staging = f"{root}/_staging/{self.job}"
        good = {f"packs/{p}" for m in messages if m for p in m.packs} | {f"manifest/{p}" for m in messages if m for p in m.parts}
        for f in system.get_file_info(fs.FileSelector(staging, recursive=True, allow_not_found=True)):
            if f.type == fs.FileType.File and "/".join(f.path.split("/")[-2:]) not in good:
                system.delete_file(f.path)
        if good:
            system.create_dir(f"{root}/jobs", recursive=True)
            system.move(staging, f"{root}/jobs/{self.job}")

    def abort(self, messages: list[Stored | None]) -> None:
        from pyarrow import fs

        system, root = opened(self.root)
        if system.get_file_info(f"{root}/_staging/{self.job}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/_staging/{self.job}")


class VaultSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "evidence_hash string, original_path string, original_name string, content binary"

    def writer(self, schema, overwrite: bool) -> VaultWriter:
        return VaultWriter(dict(self.options))


def hash_of_file(path: str) -> tuple[str, int]:
    digest, size = hashlib.sha256(), 0
    for piece in VaultWriter.pieces({"content": None, "original_path": path}):
        digest.update(piece)
        size += len(piece)
    return digest.hexdigest(), size


class Vault:
    def __init__(self, spark: SparkSession, root: str, pack_bytes: int = PACK_BYTES) -> None:
        self.spark, self.root, self.pack_bytes = spark, root.rstrip("/"), pack_bytes

    # -- storing

    def store_table(self, df: DataFrame, *, content: str, path: Column, order: Column | None = None) -> None:
        """Stores the contents of a column (text as UTF-8); of equal ones the first in order of `order` (or the path) gives the name."""
        data = F.col(f"`{content}`").cast("binary")
        rows = df.where(data.isNotNull()).select(F.sha2(data, 256).alias("evidence_hash"), path.cast("string").alias("original_path"), data.alias("content"), (path if order is None else order).alias("_o"))
        new = rows.join(self._known(), "evidence_hash", "left_anti")
        first = new.groupBy("evidence_hash").agg(F.min(F.struct("_o", "original_path"))["original_path"].alias("original_path"), F.any_value("content").alias("content"))
        self._write(first)

    def store_files(self, paths: DataFrame, *, path: str = "path") -> DataFrame:
        """Stores the files that a column names; returns (path, evidence_hash, size_bytes) of all of them. A file that is not there is an error."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [hash_of_file(p) for p in batch.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([h for h, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())], names=["path", "evidence_hash", "size_bytes"])

        hashed = cut_lineage(paths.select(F.col(f"`{path}`").alias("path")).where("path is not null").mapInArrow(run, "path string, evidence_hash string, size_bytes long"), "hashed")
        new = hashed.join(self._known(), "evidence_hash", "left_anti").groupBy("evidence_hash").agg(F.min("path").alias("original_path"))
        self._write(new.repartition(F.col("evidence_hash")).withColumn("content", F.lit(None).cast("binary")))
        return hashed

    def _known(self) -> DataFrame:
        return self.manifest().select("evidence_hash").distinct()

    def _write(self, rows: DataFrame) -> None:
        self.spark.dataSource.register(VaultSource)
        job = f"{datetime.now(UTC):%Y%m%dT%H%M%S%f}-{uuid.uuid4().hex[:8]}"
        named = rows.select("evidence_hash", "original_path", F.regexp_extract("original_path", r"([^/\\]*)[/\\]*$", 1).alias("original_name"), "content")
        named.write.format(FORMAT).mode("append").option("job", job).option("pack_bytes", str(self.pack_bytes)).save(self.root)

    # -- reading

    def jobs(self) -> list[str]:
        from pyarrow import fs

        system, root = opened(self.root)
        return sorted(f.base_name for f in system.get_file_info(fs.FileSelector(f"{root}/jobs", allow_not_found=True)) if f.type == fs.FileType.Directory)

    def manifest(self) -> DataFrame:
        """MANIFEST and `job`; a content has one row, that of the first job which stored it."""
        uri = self.root if "://" in self.root else f"file://{self.root}"
        folders = [f"{uri}/jobs/{j}/manifest" for j in self.jobs()]
        if not folders:
            return self.spark.createDataFrame([], MANIFEST + ", job string")
        rows = self.spark.read.schema(MANIFEST).parquet(*folders)
        rows = rows.withColumn("job", F.regexp_extract(F.col("_metadata.file_path"), "/jobs/([^/]+)/manifest/", 1))
        columns = [c for c in rows.columns if c != "evidence_hash"]
        return rows.groupBy("evidence_hash").agg(F.min_by(F.struct(*columns), F.struct("job", "pack", "offset")).alias("r")).select("evidence_hash", "r.*")

    def list_all(self) -> DataFrame:
        return self.manifest().select(*PUBLIC)

    def packs(self) -> list[str]:
        """Folders of the jobs' packs."""
        return [f"{self.root}/jobs/{j}/packs" for j in self.jobs()]

    def contents(self, hashes: DataFrame | None = None) -> DataFrame:
        """(evidence_hash, content), read from the packs in order of place and checked; of all contents, or of those that a table names."""
        rows = self.manifest()
        if hashes is not None:
            rows = rows.join(hashes.select("evidence_hash").distinct(), "evidence_hash", "left_semi")
        root = self.root

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            system, base = opened(root)
            last, source = None, None
            for batch in batches:
                for row in batch.to_pylist():
                    at = f"{base}/jobs/{row['job']}/packs/{row['pack']}"
                    if at != last:
                        if source is not None:
                            source.close()
                        last, source = at, system.open_input_file(at)
                    data = source.read_at(row["size_bytes"], row["offset"])
                    if hashlib.sha256(data).hexdigest() != row["evidence_hash"]:
                        raise OSError(f"content {row['evidence_hash']} is damaged in {at}")
                    yield pa.RecordBatch.from_arrays([pa.array([row["evidence_hash"]]), pa.array([data], pa.binary())], names=["evidence_hash", "content"])
            if source is not None:
                source.close()

        # Ranges of places rather than packs: a large pack is read by several tasks.
        placed = rows.select("job", "pack", "offset", "size_bytes", "evidence_hash").repartitionByRange("job", "pack", "offset").sortWithinPartitions("job", "pack", "offset")
        return placed.mapInArrow(run, "evidence_hash string, content binary")

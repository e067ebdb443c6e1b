"""A content-addressed store of source files: one copy for each SHA-256, and one manifest entry beside it.

The manifest is a folder with a JSON file for each hash, read by Spark as a table. An entry is
made under its final name or not at all, so that sources can be stored at the same time and a
run that stops half-way leaves nothing that looks stored.
"""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import uuid
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = 1 << 20
MANIFEST = "evidence_hash string, original_path string, original_name string, stored_path string, ingested_at string, size_bytes long"
PUBLIC = ["evidence_hash", "original_name", "size_bytes", "ingested_at"]


def hash_file(path: str | Path) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


class EvidenceStore:
    def __init__(self, spark: SparkSession, root: str | Path) -> None:
        self.spark, self.root = spark, Path(root)
        self.copies, self.book = self.root / "copies", self.root / "manifest"
        for folder in (self.copies, self.book):
            folder.mkdir(parents=True, exist_ok=True)

    def _entry(self, sha: str) -> Path:
        return self.book / f"{sha}.json"

    def ingest(self, path: str | Path) -> str:
        """Copies the file unless its content is known; the first name stays. Returns the hash."""
        source = Path(path)
        if not source.exists():
            raise FileNotFoundError(source)
        if not source.is_file():
            raise ValueError(f"not a regular file: {source}")
        draft = self.copies / f".{uuid.uuid4().hex}"
        digest, size = hashlib.sha256(), 0
        with source.open("rb") as a, draft.open("wb") as b:  # read once: what is hashed is what is kept
            while data := a.read(CHUNK):
                digest.update(data)
                size += len(data)
                b.write(data)
        sha = digest.hexdigest()
        if self.has(sha):
            draft.unlink()
            return sha
        stored = self.copies / f"{sha}{source.suffix}"
        os.replace(draft, stored)
        row = (sha, str(source), source.name, str(stored), datetime.now(UTC).isoformat(), size)
        text = json.dumps(dict(zip([c.split()[0] for c in MANIFEST.split(", ")], row, strict=True)))
        draft.write_text(text)
        try:
            os.link(draft, self._entry(sha))  # of two that store the same at once, one wins
        except FileExistsError:
            pass
        draft.unlink()
        return sha

    def has(self, sha: str) -> bool:
        return self._entry(sha).exists()

    def __len__(self) -> int:
        return sum(p.suffix == ".json" for p in self.book.iterdir())

    def get_metadata(self, sha: str) -> dict:
        if not self.has(sha):
            raise KeyError(sha)
        return json.loads(self._entry(sha).read_text())

    def get_path(self, sha: str) -> Path:
        return Path(self.get_metadata(sha)["stored_path"])

    def read(self, sha: str) -> bytes:
        return self.get_path(sha).read_bytes()

    def manifest(self) -> DataFrame:
        return self.spark.read.schema(MANIFEST).json(f"file://{self.book.resolve()}")

    def list_all(self) -> DataFrame:
        return self.manifest().select(*PUBLIC)

    def contents(self) -> DataFrame:
        """path, length and SHA-256 of the stored copies, from the bytes."""
        files = self.spark.read.format("binaryFile").load(f"file://{self.copies.resolve()}")
        return files.select("path", "length", F.sha2("content", 256).alias("evidence_hash"))


def export_manifest(manifest: DataFrame) -> DataFrame:
    """(evidence_hash, entry): the entries as JSON text, for systems that read one."""
    rest = [c for c in manifest.columns if c != "evidence_hash"]
    return manifest.select("evidence_hash", F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}).alias("entry"))


def stored(hashes: DataFrame, manifest: DataFrame) -> DataFrame:
    """hashes (evidence_hash, ...) with `stored`: whether the manifest has them. has() for a table."""
    have = manifest.select("evidence_hash").distinct().withColumn("stored", F.lit(True))
    return hashes.join(have, "evidence_hash", "left").withColumn("stored", F.coalesce("stored", F.lit(False)))


def dedup_blobs(blobs: DataFrame, content: str, seq: str) -> DataFrame:
    """One row for each content of a table of blobs: its hash, and the other columns of its first row."""
    hashed = blobs.withColumn("evidence_hash", F.sha2(F.col(content), 256)).drop(content)
    rest = [c for c in hashed.columns if c != "evidence_hash"]
    return hashed.groupBy("evidence_hash").agg(F.min_by(F.struct(*rest), seq).alias("r"), F.count("*").alias("n_copies")).select("evidence_hash", "r.*", "n_copies")

"""Where a node comes from: its hash, and what the manifest knows of the file with that hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_source(nodes: DataFrame, manifest: DataFrame) -> DataFrame:
    """Nodes with the public columns of their source; nulls where the hash is not stored."""
    return nodes.join(manifest.select("evidence_hash", "original_name", "size_bytes", "ingested_at"), "evidence_hash", "left")


def evidence_listing(manifest: DataFrame) -> DataFrame:
    """The manifest by time of ingestion, unknown times first; the hash decides ties."""
    return manifest.orderBy(F.coalesce("ingested_at", F.lit("")), "evidence_hash")

"""Findings and ingest reports: append-only rows, their summaries, and the Markdown report."""

from __future__ import annotations

import uuid
from dataclasses import asdict, dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession

FINDINGS = "finding_id string, claim string, supporting_node_keys array<string>, confidence string, committed_at timestamp"
RUNS = "parser_name string, source_path string, evidence_hash string, nodes_added long, nodes_merged long, edges_added long, edges_merged long, parser_stats map<string,long>, started_at timestamp, finished_at timestamp"
TITLE = "# Investigation Report"


@dataclass
class Finding:
    claim: str
    supporting_node_keys: list[str]
    confidence: str
    finding_id: str = field(default_factory=lambda: str(uuid.uuid4()))
    committed_at: datetime = field(default_factory=lambda: datetime.now(UTC))


@dataclass
class IngestRun:
    parser_name: str
    source_path: str | None = None
    evidence_hash: str | None = None
    nodes_added: int = 0
    nodes_merged: int = 0
    edges_added: int = 0
    edges_merged: int = 0
    parser_stats: dict[str, int] = field(default_factory=dict)
    started_at: datetime = field(default_factory=lambda: datetime.now(UTC))
    finished_at: datetime | None = None

    @property
    def duration_seconds(self) -> float:
        return (self.finished_at - self.started_at).total_seconds() if self.finished_at else 0.0


class FindingReport:
    """Findings can be added, not changed or removed."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self._findings = spark, []

    def commit(self, finding: Finding) -> None:
        self._findings.append(finding)

    def __len__(self) -> int:
        return len(self._findings)

    def table(self) -> DataFrame:
        return self.spark.createDataFrame([(f.finding_id, f.claim, f.supporting_node_keys, f.confidence, f.committed_at) for f in self._findings], FINDINGS)

    def to_markdown(self) -> str:
        if not self._findings:
            return f"{TITLE}\n\nNo findings committed.\n"
        out = [TITLE, "", f"**Findings committed:** {len(self)}", ""]
        for n, f in enumerate(self._findings, 1):
            out += [f"## Finding {n} — `{f.confidence}`", "", f"**Claim:** {f.claim}", "", f"**Committed:** {f.committed_at.isoformat()}", "", f"**Supporting evidence:** {len(f.supporting_node_keys)} node(s)", *(f"  - `{k}`" for k in f.supporting_node_keys), ""]
        return "\n".join(out)


def runs_table(spark: SparkSession, runs: list[IngestRun]) -> DataFrame:
    return spark.createDataFrame([tuple(asdict(r).values()) for r in runs], RUNS)


def runs_summary(runs: list[IngestRun]) -> dict:
    total = lambda c: sum(getattr(r, c) for r in runs)
    return {"runs": len(runs), **{c: total(c) for c in ("nodes_added", "nodes_merged", "edges_added", "edges_merged")}}

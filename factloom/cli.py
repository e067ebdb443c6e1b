"""Command line: `python -m factloom version`, `python -m factloom investigate FOLDER --output FOLDER`."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from . import __version__


def investigate(folder: Path, output: Path, source_type: str) -> dict:
    """Ingests every file of a folder, and writes nodes, edges, the runs' summary and the findings report."""
    from pyspark.sql import SparkSession

    from .operators.session import Session

    spark = SparkSession.builder.appName("factloom").getOrCreate()
    session = Session(spark, output / "evidence", folder)
    results = {str(f): session.ingest_artifact(str(f), source_type) for f in sorted(folder.rglob("*")) if f.is_file()}
    for name, nodes in session.graph.by_type.items():
        nodes.write.mode("overwrite").parquet(str(output / "nodes" / name))
    if session.graph.edges is not None:
        session.graph.edges.write.mode("overwrite").parquet(str(output / "edges"))
    summary = {"files": results, **session.summary(), **session.stats()}
    (output / "summary.json").write_text(json.dumps(summary, indent=1))
    (output / "report.md").write_text(session.report.to_markdown())
    return summary


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="factloom", description="Typed evidence graphs on Spark.")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("version", help="print the version")
    run = commands.add_parser("investigate", help="ingest a folder of evidence")
    run.add_argument("folder", type=Path)
    run.add_argument("--output", type=Path, default=Path("runs"))
    run.add_argument("--source-type", default="defender_evtx")
    given = parser.parse_args(arguments)
    if given.command == "version":
        print(f"factloom {__version__}")
        return 0
    if not given.folder.is_dir():
        print(f"no folder: {given.folder}", file=sys.stderr)
        return 2
    given.output.mkdir(parents=True, exist_ok=True)
    summary = investigate(given.folder, given.output, given.source_type)
    print(json.dumps({k: v for k, v in summary.items() if k != "files"}))
    return 0 if all(r["status"] == "ok" for r in summary["files"].values()) else 1

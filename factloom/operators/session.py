"""A session: one graph, one evidence store, one report, and the five service calls on them.

A run's observations go into hash buckets beside the canonical rows of the runs before it
(factloom.plans.buckets): a run writes its own rows and, now and then, the buckets that have outgrown their
base. How many nodes and edges there are is what runs have added; nothing is counted again.
Order is (run, rank, row), so that whatever an earlier run saw came first. Each call returns a
dict and reports expected problems in it.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import CONFIDENCE_RANKS
from ..plans.buckets import BucketStore, edge_store, node_store
from ..plans.fold import canonical_columns, fold
from ..plans.lineage import cut_lineage
from ..plans.schema import NODE_TYPES
from ..sources.evidence import EvidenceStore
from ..sources.registry import READERS, check_path
from . import gate, parsers
from .graph import DEFAULT_LIMIT, Graph, node_key_of, plain, resolved_edges
from .reports import Finding, FindingReport, IngestRun, runs_summary

EDGES = "edges"
_EDGE = "src_key string, dst_key string, edge_type string, ts timestamp, confirmed_by array<string>, evidence_hash string, derivation string"


class Session:
    def __init__(self, spark: SparkSession, store_root: str | Path, evidence_root: str | Path | None = None) -> None:
        self.spark = spark
        self.store = EvidenceStore(spark, store_root)
        self.evidence_root = None if evidence_root is None else Path(evidence_root).resolve()
        self._graph = Graph({})
        self._stale: set[str] = set()
        self.stores: dict[str, BucketStore] = {}
        self.report = FindingReport(spark)
        self.runs: list[IngestRun] = []

    # -- the graph

    def _order(self, df: DataFrame) -> Column:
        """(run, rank, row) for a seq that is a number or (rank, row)."""
        seq, parts = F.col("seq"), isinstance(df.schema["seq"].dataType, StructType)
        rank, row = (seq["rank"], seq["row"]) if parts else (F.lit(0), seq)
        return F.struct(F.lit(len(self.runs)).alias("run"), rank.cast("int").alias("rank"), row.cast("long").alias("row")).alias("seq")

    def _store(self, what: str, make: Callable[[], BucketStore]) -> BucketStore:
        return self.stores.setdefault(what, make())

    @property
    def graph(self) -> Graph:
        """The graph as it is now, read when it is asked for: runs in between cost no fold. Tables read before the last change stay readable until vacuum()."""
        nodes, edges = dict(self._graph.by_type), self._graph.edges
        for what in sorted(self._stale):
            rows = self.stores[what].rows()
            if what == EDGES:
                edges = edges if rows is None else rows
            elif rows is not None:
                nodes[what] = rows
        if self._stale:
            self._graph, self._stale = Graph(nodes, edges, self.stores), set()
        return self._graph

    def node_keys(self) -> DataFrame | None:
        """node_key of all nodes, some more than once: nothing is folded for it."""
        parts = [keys for what, store in self.stores.items() if what != EDGES and (keys := store.keys(store.known_buckets())) is not None]
        return reduce(DataFrame.unionAll, parts) if parts else None

    def vacuum(self) -> None:
        """Deletes the files of earlier states of the graph."""
        for store in self.stores.values():
            store.vacuum()

    def add_observations(self, node_type: str, obs: DataFrame) -> tuple[int, int]:
        """Folds observations (with seq) into the graph, after all earlier ones; returns nodes added and merged."""
        spec = NODE_TYPES[node_type]
        store = self._store(node_type, lambda: node_store(self.spark, spec))
        counts = store.add(obs.withColumn("seq", self._order(obs)), len(self.runs))
        self._stale.add(node_type)
        return counts

    def add_edges(self, edges: DataFrame, *, strict: bool = False) -> tuple[int, int]:
        """Folds in edges whose ends exist; with strict, an edge without an end is an error. Orphans count as neither added nor merged."""
        edges = cut_lineage(edges.withColumn("seq", self._order(edges)), "edges")
        nodes = self.node_keys()
        good = edges.limit(0) if nodes is None else resolved_edges(edges, nodes)
        if strict and good.count() < edges.count():
            raise KeyError("an edge's end is not in the graph")
        counts = self._store(EDGES, lambda: edge_store(self.spark)).add(good.drop("confidence"), len(self.runs))
        self._stale.add(EDGES)
        return counts

    # -- runs

    def run_detections(self, records: DataFrame, source: str | None = None) -> IngestRun:
        """One run of the detection parser: store the source, fill in provenance, parse, fold."""
        run = IngestRun("defender", source)
        if source is not None:
            run.evidence_hash = self.store.ingest(source)
            records = parsers.with_provenance(records, run.evidence_hash, parsers.derivation("defender_evtx", Path(source).name))
        if "seq" not in records.columns:
            records = records.withColumn("seq", F.monotonically_increasing_id())
        for c in ("_evidence_hash", "_derivation"):
            if c not in records.columns:
                records = records.withColumn(c, F.lit(None).cast("string"))
        obs, stats = parsers.detections(records, F.lit(run.started_at))
        run.nodes_added, run.nodes_merged = self.add_observations("AntivirusDetection", obs)
        found = stats.first()
        run.parser_stats = {"skipped_event_count": found["skipped_event_count"], "malformed_count": found["malformed_count"]}
        return self._close(run)

    def run_processes(self, scanned: DataFrame, listed: DataFrame, relations: DataFrame | None = None) -> IngestRun:
        """One run of the process parser: two listings folded on their own first, then parent relations."""
        run = IngestRun("volatility")
        spec = NODE_TYPES["Process"]
        obs = parsers.process_observations(scanned, "psscan", 0, F.lit(run.started_at)).unionByName(parsers.process_observations(listed, "pslist", 1, F.lit(run.started_at)))
        counts = {r["plugin"]: r["n_new"] for r in parsers.plugin_counts(obs, ["host_hostname", "pid", "start_time"]).collect()}
        folded = cut_lineage(fold(obs.drop("_plugin"), spec), "processes")
        once = folded.select(*canonical_columns(spec, folded.columns), F.col("first_seq").alias("seq")).drop("n_observations")
        run.nodes_added, run.nodes_merged = self.add_observations("Process", once)
        run.parser_stats = {"psscan_count": counts.get("psscan", 0), "pslist_count": counts.get("pslist", 0)}
        if relations is not None:
            edges, stats = parsers.spawned(relations, folded)
            run.edges_added, run.edges_merged = self.add_edges(edges)
            run.parser_stats["pstree_failures"] = stats.first()["failures"]
        return self._close(run)

    def _close(self, run: IngestRun) -> IngestRun:
        run.finished_at = datetime.now(UTC)
        self.runs.append(run)
        return run

    def totals(self) -> tuple[int, int]:
        """Nodes and edges, by what runs have added."""
        return sum(s.added for name, s in self.stores.items() if name != EDGES), self.stores[EDGES].added if EDGES in self.stores else 0

    def summary(self) -> dict:
        return runs_summary(self.runs)

    def stats(self) -> dict:
        nodes, edges = self.totals()
        return {"evidence_count": len(self.store), "node_count": nodes, "edge_count": edges, "ingest_runs": len(self.runs), "findings": len(self.report)}

    # -- the five calls

    def ingest_artifact(self, path: str, source_type: str) -> dict:
        file, problem = check_path(path, source_type, self.evidence_root)
        if problem:
            return problem
        try:
            records = READERS[source_type](self.spark, str(file)).where("valid").drop("value", "valid", "raw_data")
            n = records.count()
            run = self.run_detections(records, str(file))
        except OSError as e:
            return {"status": "error", "error": "unreadable_source", "message": str(e)}
        return {"status": "ok", "source_type": source_type, "evidence_hash": run.evidence_hash, "records_read": n, "nodes_added": run.nodes_added, "nodes_merged": run.nodes_merged, "skipped_event_count": run.parser_stats["skipped_event_count"], "graph_totals": dict(zip(("nodes", "edges"), self.totals(), strict=True))}

    def query_graph(self, node_type: str | None = None, filters: list[dict] | None = None, limit: int = DEFAULT_LIMIT) -> dict:
        return self.graph.query(node_type, filters, limit)

    def get_node_provenance(self, key: str | list) -> dict:
        node_key = node_key_of(self.spark, key)
        try:
            node = self.graph.get_node(node_key)
        except KeyError:
            return {"status": "error", "error": "node_not_found", "message": f"unknown node: {key}"}
        out = {"status": "ok", "node_key": node_key, "evidence_hash": node["evidence_hash"], "derivation": node["derivation"], "observed_at": plain(node["observed_at"])}
        if node.get("observed_by"):
            out["observed_by"] = node["observed_by"]
        if self.store.has(node["evidence_hash"]):
            meta = self.store.get_metadata(node["evidence_hash"])
            out["source_evidence"] = {c: meta[c] for c in ("original_name", "size_bytes", "ingested_at")}
        return out

    def commit_finding(self, claim: str, supporting_node_keys: list, confidence_hint: str = "suspected") -> dict:
        if confidence_hint not in CONFIDENCE_RANKS:
            return {"status": "error", "error": "bad_confidence_hint", "message": f"no such confidence; there are {sorted(CONFIDENCE_RANKS)}"}
        keys = [node_key_of(self.spark, k) or str(k) for k in supporting_node_keys]
        claims = self.spark.createDataFrame([("c", confidence_hint)], "claim_id string, hint string")
        support = self.spark.createDataFrame([("c", i, k) for i, k in enumerate(keys)], "claim_id string, pos int, node_key string")
        nodes = self.graph.nodes()
        if nodes is None:
            nodes = self.spark.createDataFrame([], "node_key string, disputed boolean")
        edges = self.graph.edges
        if edges is None:
            edges = self.spark.createDataFrame([], _EDGE + ", confidence string")
        row = gate.judge(claims, support, nodes, edges).first()
        decision = {"decision": row["decision"], "confidence_hint": confidence_hint, "final_confidence": row["final_confidence"], "total_findings": len(self.report)}
        if row["decision"].startswith("rejected"):
            why = "nothing is cited" if row["n_cited"] == 0 else f"{row['n_missing']} of the cited nodes are unknown, the first is {row['first_missing']}"
            return {"status": "ok", **decision, "reason": why}
        if not claim:
            return {"status": "error", "error": "empty_claim", "message": "claim must not be empty"}
        finding = Finding(claim, keys, row["final_confidence"])
        self.report.commit(finding)
        return {"status": "ok", **decision, "total_findings": len(self.report), "finding_id": finding.finding_id, "reason": "Confidence lowered to what the evidence supports." if row["decision"] == "downgraded_confidence" else "All cited nodes exist; the evidence supports the confidence."}

    def list_evidence(self) -> dict:
        rows = [r.asDict() for r in self.store.list_all().orderBy(F.coalesce("ingested_at", F.lit("")), "evidence_hash").collect()]
        return {"status": "ok", "evidence": rows, "evidence_count": len(rows), "ingest_runs": len(self.runs), "graph_totals": dict(zip(("nodes", "edges"), self.totals(), strict=True))}

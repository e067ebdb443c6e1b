"""Queries of the parts that work on files and sessions: stores, readers, reports, service calls; and of all node types."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import graph
from .operators.reports import Finding, FindingReport, IngestRun, runs_summary
from .operators.service import build_server
from .operators.session import Session
from .plans import fold as folds
from .plans import schema as S
from .plans.buckets import BucketStore, node_store
from .plans.lineage import cut_lineage, scratch
from .queries import DET, EDGE, HASH, NIGHT, PROC, SPAWN_EDGES, detection_records, edge_table, process_nodes, process_obs, query, relations, table, xml_records
from .sources.binxml import encode_events
from .sources.eventlog import BINARY_XML, read_binary_log
from .sources.evidence import EvidenceStore, export_manifest
from .sources.registry import check_path, records_frame
from .sources.vault import Vault


def folder(spark: SparkSession) -> str:
    """A scratch folder for plain files, on the driver's side of the folder that all share."""
    path = scratch(spark).removeprefix("file://")
    if "://" in path:
        raise ValueError("these queries make plain files: spark.checkpoint.dir must be a mounted folder")
    os.makedirs(path)
    return path


def nation_files(spark: SparkSession, sf: str) -> tuple[str, list]:
    """A file for each nation that holds its region's number, so that contents repeat."""
    at = folder(spark)
    rows = table(spark, sf, "nation").orderBy("n_nationkey").collect()
    for r in rows:
        with open(f"{at}/{r['n_nationkey']:02d}.txt", "w") as f:
            f.write(f"region {r['n_regionkey']}")
    return at, rows


# -- sources and stores

@query("SELECT event_id AS seq, event_id % 11 <> 0 AS valid, CASE WHEN event_id % 11 <> 0 THEN 'h' || user_id END AS computer FROM events")
def s01_event_log_files(spark: SparkSession, sf: str) -> DataFrame:
    """Records written to files, read again in byte ranges; the sequence number travels in the record's text."""
    at = scratch(spark)
    records = xml_records(spark, sf).select(F.concat("value", F.lit("<!--"), "seq", F.lit("-->")).alias("value"))
    records.write.text(at)
    parsed = read_binary_log(spark, at, chunk=16 << 10, chunks=4)
    return parsed.select(F.regexp_extract("value", "<!--([0-9]+)-->$", 1).cast("long").alias("seq"), "valid", "computer")


@query(f"WITH {DET} SELECT seq, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f+00:00') AS time_created, eid AS event_id, host AS computer, coalesce(threat, '') AS threat_name, true AS valid FROM det WHERE seq % 11 <> 0 UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, false FROM det WHERE seq % 11 = 0")
def s01_s04_binary_logs(spark: SparkSession, sf: str) -> DataFrame:
    """Events as chunks of binary records, one in eleven damaged, stored by executors and read again from the packs in ranges of chunks."""
    log = cut_lineage(binary_log(detection_records(spark, sf, by_day=False)), "chunks")
    vault = Vault(spark, scratch(spark))
    vault.store_table(log, content="chunk", path=F.concat(F.lit("log-"), "first"))
    parsed = read_binary_log(spark, vault.packs()[0], BINARY_XML, header=0, chunks=16)
    return parsed.select(F.col("_record_id").alias("seq"), "time_created", "event_id", "computer", "threat_name", "valid")


def binary_log(records: DataFrame) -> DataFrame:
    """(first, chunk): detection records as chunks of binary XML, with the number of each chunk's first record."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in b.to_pylist())
        for chunk in encode_events(rows, ["Threat Name", "Action Name"]):
            yield pa.RecordBatch.from_arrays([pa.array([int.from_bytes(chunk[8:16], "little")]), pa.array([chunk], pa.binary())], names=["first", "chunk"])

    micros = F.unix_micros("time_created")
    ticks = F.when(F.col("seq") % 11 == 0, F.lit((1 << 63) - 1)).otherwise(micros * 10 + 116444736000000000)  # no time that there is, or one since 1601
    named = records.select(F.col("seq").alias("number"), "event_id", ticks.alias("ticks"), "computer", F.col("threat_name").alias("Threat Name"), F.col("action").alias("Action Name"))
    return named.mapInArrow(run, "first long, chunk binary")


@query("SELECT sha256(text) AS evidence_hash, 'doc' || min(doc_id) AS original_name, CAST(strlen(text) AS BIGINT) AS size_bytes, sha256(text) AS content_hash FROM documents WHERE text IS NOT NULL GROUP BY text")
def s04_s08_p03_vault(spark: SparkSession, sf: str) -> DataFrame:
    """Documents stored by executors in two jobs that overlap, listed, and read back from their packs."""
    docs, vault = table(spark, sf, "documents"), Vault(spark, scratch(spark))
    for part in (docs.where("doc_id % 3 <> 0"), docs):  # the second job adds what the first did not have
        vault.store_table(part, content="text", path=F.concat(F.lit("doc"), "doc_id"), order=F.col("doc_id"))
    back = vault.contents().select("evidence_hash", F.sha2("content", 256).alias("content_hash"))
    first = docs.groupBy(F.sha2("text", 256).alias("evidence_hash")).agg(F.concat(F.lit("doc"), F.min("doc_id")).alias("original_name"))
    return vault.list_all().select("evidence_hash", "size_bytes").join(first, "evidence_hash").join(back, "evidence_hash", "left").select("evidence_hash", "original_name", "size_bytes", "content_hash")


@query("SELECT sha256('region ' || n_regionkey) AS evidence_hash, printf('%02d.txt', min(n_nationkey)) AS original_name, CAST(length('region ' || n_regionkey) AS BIGINT) AS size_bytes, true AS same_bytes FROM nation GROUP BY n_regionkey")
def s04_s06_s08_k01_store(spark: SparkSession, sf: str) -> DataFrame:
    """Files stored twice, the store opened again, and its copies hashed from their bytes."""
    at, rows = nation_files(spark, sf)
    store = EvidenceStore(spark, f"{at}/store")
    for _ in range(2):
        for r in rows:
            store.ingest(f"{at}/{r['n_nationkey']:02d}.txt")
    again = EvidenceStore(spark, f"{at}/store")
    bytes_ = again.contents().select(F.col("evidence_hash").alias("_h"), F.lit(True).alias("same"))
    listed = again.list_all()
    return listed.join(bytes_, listed["evidence_hash"] == F.col("_h"), "left").select("evidence_hash", "original_name", "size_bytes", F.coalesce("same", F.lit(False)).alias("same_bytes"))


@query("SELECT sha256('region ' || n_regionkey) AS evidence_hash, printf('%02d.txt', min(n_nationkey)) AS original_name, 'region ' || n_regionkey AS content FROM nation GROUP BY n_regionkey")
def p03_byte_recovery(spark: SparkSession, sf: str) -> DataFrame:
    at, rows = nation_files(spark, sf)
    store = EvidenceStore(spark, f"{at}/store")
    found = {store.ingest(f"{at}/{r['n_nationkey']:02d}.txt") for r in rows}
    return spark.createDataFrame([(h, store.get_metadata(h)["original_name"], store.read(h).decode()) for h in sorted(found)], "evidence_hash string, original_name string, content string")


@query("SELECT n_nationkey AS id, '{\"original_name\":\"' || n_name || '\",\"size_bytes\":' || n_regionkey || ',\"ingested_at\":null}' AS entry FROM nation")
def json_manifest_entries(spark: SparkSession, sf: str) -> DataFrame:
    m = table(spark, sf, "nation").select(F.col("n_nationkey").alias("evidence_hash"), F.col("n_name").alias("original_name"), F.col("n_regionkey").alias("size_bytes"), F.lit(None).cast("string").alias("ingested_at"))
    return export_manifest(m).withColumnRenamed("evidence_hash", "id")


@query("SELECT n_nationkey AS pid, CASE WHEN n_nationkey % 2 = 0 THEN n_name END AS name FROM nation")
def s10_records_in_memory(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "nation").collect()
    records: list = [{"pid": r["n_nationkey"], **({"name": r["n_name"]} if r["n_nationkey"] % 2 == 0 else {})} for r in rows]
    return records_frame(spark, [*records, "not a record"], "pid long, name string")


@query("SELECT * FROM (VALUES ('a.txt', 'defender_evtx', 'ok'), ('a.txt', 'pcap', 'unsupported_source_type'), ('none', 'defender_evtx', 'file_not_found'), ('in', 'defender_evtx', 'not_a_file'), ('../outside.txt', 'defender_evtx', 'path_outside_allowlist'), ('link.txt', 'defender_evtx', 'path_outside_allowlist')) AS t(path, source_type, outcome)")
def s11_s12_path_guard(spark: SparkSession, sf: str) -> DataFrame:
    from pathlib import Path

    top = Path(folder(spark))
    root = top / "root"
    (root / "in").mkdir(parents=True)
    (root / "a.txt").write_text("a")
    (top / "outside.txt").write_text("b")
    (root / "link.txt").symlink_to(top / "outside.txt")
    asked = [("a.txt", "defender_evtx"), ("a.txt", "pcap"), ("none", "defender_evtx"), ("in", "defender_evtx"), ("../outside.txt", "defender_evtx"), ("link.txt", "defender_evtx")]
    answers = [(p, t, (check_path(str(root / p), t, root.resolve())[1] or {"error": "ok"})["error"]) for p, t in asked]
    return spark.createDataFrame(answers, "path string, source_type string, outcome string")


# -- all node types

def of_every_type(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """For each node type one raw row a nation."""
    k, name = F.col("n_nationkey").cast("long"), F.col("n_name")
    text = lambda prefix: F.concat(F.lit(prefix), k)
    at = F.when(k % 4 != 0, F.lit(NIGHT).cast("timestamp") + F.make_interval(secs=k))
    raw = {
        "Host": {"hostname": text("n"), "machine_guid": F.when(k % 3 != 0, text("g"))},
        "User": {"sid": text("S-1-5-")},
        "NetworkEndpoint": {"protocol": F.lit("tcp"), "remote_addr": text("10.0.0."), "remote_port": (k + 1000).cast("int")},
        "File": {"host_hostname": F.lit("h"), "full_path": F.concat(F.lit("\\??\\C:\\"), name, F.lit(".TXT"))},
        "RegistryKey": {"host_hostname": F.lit("h"), "hive_name": F.lit("SYSTEM"), "key_path": F.concat(F.lit("\\A\\"), name, F.lit("\\")), "value_name": F.when(k % 2 == 0, text("v"))},
        "Process": {"host_hostname": F.lit("h"), "pid": k, "start_time": at, "name": name},
        "ScheduledTask": {"host_hostname": F.lit("h"), "task_path": text("/T")},
        "Service": {"host_hostname": F.lit("h"), "service_name": text("s")},
        "Module": {"host_hostname": F.lit("h"), "image_path": F.concat(F.lit("C:\\"), name), "base_address": (k * 4096).cast("decimal(20,0)")},
        "AntivirusDetection": {"host_hostname": F.lit("h"), "event_id": F.lit(1116), "detection_time": F.coalesce(at, F.lit(NIGHT).cast("timestamp")), "threat_name": name},
    }
    n = table(spark, sf, "nation")
    return {t: n.select(k.alias("id"), *(c.alias(f) for f, c in columns.items())) for t, columns in raw.items()}


AT = "strftime(TIMESTAMP '2024-01-01' + to_seconds(k), '%Y-%m-%dT%H:%M:%S.000000Z')"
KEYS = {
    "Host": "'\"' || CASE WHEN k % 3 <> 0 THEN 'g' ELSE 'n' END || k || '\"'",
    "User": "'\"S-1-5-' || k || '\"'",
    "NetworkEndpoint": "'\"tcp\",\"k1\":\"10.0.0.' || k || '\",\"k2\":' || (k + 1000)",
    "File": "'\"h\",\"k1\":\"c:/' || lower(n_name) || '.txt\"'",
    "RegistryKey": "'\"h\",\"k1\":\"SYSTEM\",\"k2\":\"a/' || lower(n_name) || '\",\"k3\":' || CASE WHEN k % 2 = 0 THEN '\"v' || k || '\"' ELSE 'null' END",
    "Process": f"'\"h\",\"k1\":' || k || ',\"k2\":' || CASE WHEN k % 4 <> 0 THEN '\"' || {AT} || '\"' ELSE 'null' END",
    "ScheduledTask": "'\"h\",\"k1\":\"/T' || k || '\"'",
    "Service": "'\"h\",\"k1\":\"s' || k || '\"'",
    "Module": "'\"h\",\"k1\":\"c:/' || lower(n_name) || '\",\"k2\":' || (k * 4096)",
    "AntivirusDetection": f"'\"h\",\"k1\":1116,\"k2\":\"' || CASE WHEN k % 4 <> 0 THEN {AT} ELSE '2024-01-01T00:00:00.000000Z' END || '\",\"k3\":\"' || n_name || '\"'",
}


@query(" UNION ALL ".join(f"SELECT '{t}' AS node_type, k AS id, '{{\"t\":\"{t}\",\"k0\":' || {sql} || '}}' AS node_key FROM (SELECT *, CAST(n_nationkey AS BIGINT) AS k FROM nation)" for t, sql in KEYS.items()))
def t13_keys_of_all_types(spark: SparkSession, sf: str) -> DataFrame:
    parts = [S.NODE_TYPES[t].keyed(df).select(F.lit(t).alias("node_type"), "id", "node_key") for t, df in of_every_type(spark, sf).items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


MISSING = {"Host": "hostname_missing", "User": "sid_missing,sid_length", "NetworkEndpoint": "protocol_missing", **dict.fromkeys(("File", "RegistryKey", "Process", "ScheduledTask", "Service", "Module", "AntivirusDetection"), "host_hostname_missing")}


@query("SELECT t AS node_type, CASE k % 3 WHEN 1 THEN 'evidence_hash' WHEN 2 THEN m ELSE '' END AS problems, count(*) AS n FROM (SELECT n_nationkey AS k FROM nation), (VALUES " + ", ".join(f"('{t}', '{m}')" for t, m in MISSING.items()) + ") AS v(t, m) GROUP BY 1, 2")
def t12_validation_of_all_types(spark: SparkSession, sf: str) -> DataFrame:
    parts = []
    for t, df in of_every_type(spark, sf).items():
        spec, k = S.NODE_TYPES[t], F.col("id") % 3
        needed = spec.required[0]
        raw = df.withColumns({needed: F.when(k != 2, F.col(needed)), "evidence_hash": F.when(k == 1, "short").otherwise(HASH), "derivation": F.lit("t"), "observed_at": F.lit(NIGHT).cast("timestamp")}).drop("id")
        parts.append(S.checked(raw, spec).select(F.lit(t).alias("node_type"), F.array_join("problems", ",").alias("problems")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out.groupBy("node_type", "problems").agg(F.count("*").alias("n"))


@query("SELECT 'User' AS node_type, count(*) FILTER (WHERE c_custkey % 3 = 0) AS n_folded, count(*) FILTER (WHERE c_custkey % 3 <> 0) AS n_refused, (SELECT count(DISTINCT s) FROM (SELECT 'S-1-5-' || c_custkey % 100 AS s FROM customer WHERE c_custkey % 3 = 0)) AS n_nodes FROM customer")
def a19_merge_guard(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of three types under the same identities: those of the type fold, the others are told apart."""
    k = F.col("c_custkey")
    obs = table(spark, sf, "customer").select(k.alias("seq"), F.concat(F.lit("S-1-5-"), k % 100).alias("sid"), F.col("c_name").alias("username"), F.when(k % 3 == 0, "User").when(k % 3 == 1, "Host").alias("node_type"), F.lit(HASH).alias("evidence_hash"), F.lit("t").alias("derivation"), F.lit(NIGHT).cast("timestamp").alias("observed_at"))
    own = obs.where("node_type = 'User'")
    nodes = folds.fold(own, S.USER)
    return graph.totals(n_folded=own, n_refused=folds.foreign(obs, S.USER), n_nodes=nodes).select(F.lit("User").alias("node_type"), "n_folded", "n_refused", "n_nodes")


@query("SELECT n_nationkey AS id, n_nationkey % 5 <> 4 AS readable FROM nation")
def f10_keys_from_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Identities as lists, read by position; a list that does not fit its type is none."""
    rows = table(spark, sf, "nation").collect()
    made = []
    for r in rows:
        k = r["n_nationkey"]
        key = [["User", f"S-1-5-{k}"], ["Process", "h", k, None], ["AntivirusDetection", "h", 1116, "2024-01-01T00:00:00+00:00", r["n_name"]], ["Module", "h", "C:\\x", str(k * 4096)], ["Process", "h", "not a number", None]][k % 5]
        made.append((k, graph.node_key_of(spark, key) is not None))
    return spark.createDataFrame(made, "id long, readable boolean")


@query(f"WITH {PROC}, {EDGE} SELECT (SELECT count(*) FROM (SELECT DISTINCT host, pid, start FROM proc)) AS n_nodes, (SELECT count(*) FROM edge) AS n_edges")
def a16_counts_of_a_graph(spark: SparkSession, sf: str) -> DataFrame:
    counts = graph.Graph({"Process": process_nodes(spark, sf)}, edge_table(spark, sf)).counts()
    return spark.createDataFrame([counts], "n_nodes long, n_edges long")


# -- sessions and reports

def listing(spark: SparkSession, sf: str) -> DataFrame:
    """Whole rows, one in seven without a name: those the parser drops."""
    obs = process_obs(spark, sf)
    return obs.select("pid", F.when(F.col("seq") % 7 != 0, F.col("name")).alias("name"), "image_path", "command_line", "parent_pid", "start_time", "exit_time", F.col("evidence_hash").alias("_evidence_hash"), F.col("derivation").alias("_derivation"), F.col("host_hostname").alias("_host_hostname"), "seq")


@query(f"WITH {PROC}, p AS (SELECT *, (seq % 2) * 1000000000000 + seq AS place FROM proc WHERE seq % 7 <> 0) SELECT host AS host_hostname, pid, strftime(start, '%Y') AS year, min_by(name, place) AS name, CASE WHEN count(DISTINCT seq % 2) = 2 THEN 'pslist,psscan' WHEN min(seq % 2) = 0 THEN 'pslist' ELSE 'psscan' END AS observed_by FROM p GROUP BY host, pid, start")
def t07_two_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Two runs of the process parser: whatever the first run saw, by either plugin, comes before the second run."""
    session = Session(spark, folder(spark))
    rows = listing(spark, sf)
    none = rows.limit(0)
    session.run_processes(none, rows.where("seq % 2 = 0"))
    session.run_processes(rows.where("seq % 2 = 1"), none)
    return session.graph.by_type["Process"].select("host_hostname", "pid", F.date_format("start_time", "yyyy").alias("year"), "name", F.array_join("observed_by", ",").alias("observed_by"))


@query(f"WITH {SPAWN_EDGES}, good AS (SELECT * FROM proc WHERE seq % 7 <> 0), n AS (SELECT count(*) AS n FROM (SELECT DISTINCT host, pid, start FROM good)) SELECT 1 AS runs, n AS nodes_added, CAST(0 AS BIGINT) AS nodes_merged, n AS node_count FROM n")
def k04_run_summary(spark: SparkSession, sf: str) -> DataFrame:
    session = Session(spark, folder(spark))
    rows = listing(spark, sf)
    session.run_processes(rows.where("seq % 2 = 0"), rows.where("seq % 2 = 1"), relations(spark, sf))
    found = session.summary() | session.stats()
    return spark.createDataFrame([(found["runs"], found["nodes_added"], found["nodes_merged"], found["node_count"])], "runs int, nodes_added long, nodes_merged long, node_count long")


RUNS = f"{PROC}, p AS (SELECT *, seq % 10 AS run, (seq % 10) * 1000000000000 + seq AS place FROM proc)"


def in_runs(spark: SparkSession, sf: str) -> tuple[BucketStore, list[tuple[int, int, int]]]:
    """Process observations in ten runs into buckets; what each run added and merged."""
    store, obs, counts = node_store(spark, S.PROCESS, buckets=8), cut_lineage(process_obs(spark, sf), "observations"), []
    for run in range(10):
        mine = obs.where(F.col("seq") % 10 == run).withColumn("seq", F.struct(F.lit(run).alias("run"), F.lit(0).alias("rank"), F.col("seq").cast("long").alias("row")))
        counts.append((run, *store.add(mine, run)))
    return store, counts


@query(f"WITH {RUNS} SELECT host AS host_hostname, pid, strftime(start, '%Y') AS year, min_by(name, place) AS name, min_by(image, place) FILTER (WHERE image IS NOT NULL) AS image_path, count(*) AS n_observations, CAST(min(run) AS INTEGER) AS first_run FROM p GROUP BY host, pid, start")
def u04_ten_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Ten runs into buckets: what is known after them is one fold of all rows in order of runs."""
    store, _ = in_runs(spark, sf)
    return store.rows().select("host_hostname", "pid", F.date_format("start_time", "yyyy").alias("year"), "name", "image_path", "n_observations", F.col("first_seq.run").alias("first_run"))


@query(f"WITH {RUNS}, f AS (SELECT min(run) AS run FROM p GROUP BY host, pid, start), r AS (SELECT run, count(*) AS n FROM p GROUP BY run), a AS (SELECT run, count(*) AS n FROM f GROUP BY run) SELECT CAST(run AS INTEGER) AS run, coalesce(a.n, 0) AS added, r.n - coalesce(a.n, 0) AS merged, CAST(sum(coalesce(a.n, 0)) OVER (ORDER BY run) AS BIGINT) AS total FROM r LEFT JOIN a USING (run)")
def a15_a17_run_totals(spark: SparkSession, sf: str) -> DataFrame:
    """What each run added and merged, and the totals that are kept instead of counting."""
    _, counts = in_runs(spark, sf)
    total, rows = 0, []
    for run, added, merged in counts:
        total += added
        rows.append((run, added, merged, total))
    return spark.createDataFrame(rows, "run int, added long, merged long, total long")


@query(f"WITH {PROC}, ask AS (SELECT host, pid, start, bool_or(true) FROM proc WHERE seq % 20 = 0 GROUP BY ALL) SELECT p.host AS host_hostname, p.pid, strftime(p.start, '%Y') AS year, count(*) AS n_observations FROM proc p JOIN ask ON p.host = ask.host AND p.pid = ask.pid AND p.start IS NOT DISTINCT FROM ask.start GROUP BY p.host, p.pid, p.start")
def f12_lookup_of_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes by a table of keys, those of every twentieth order and some that there are not; buckets meet buckets."""
    obs = process_obs(spark, sf)
    store = node_store(spark, S.PROCESS, buckets=16)
    store.add(obs.withColumn("seq", F.struct(F.lit(0).alias("run"), F.lit(0).alias("rank"), F.col("seq").cast("long").alias("row"))), 0)
    asked = S.PROCESS.keyed(obs.where("seq % 20 = 0")).select("node_key")
    found = store.lookup_table(asked.unionAll(asked.select(F.concat("node_key", F.lit("?")))))
    return found.select("host_hostname", "pid", F.date_format("start_time", "yyyy").alias("year"), "n_observations")


CASES = """(VALUES (1, 'accepted', 'inferred', 1), (2, 'rejected_empty_support', NULL, 1), (3, 'rejected_missing_node', NULL, 1), (4, 'downgraded_confidence', 'inferred', 2), (5, 'bad_confidence_hint', NULL, 2), (6, 'empty_claim', NULL, 2), (7, 'bad_arguments', NULL, 2), (8, 'unknown_tool', NULL, 2))"""


@query(f"SELECT * FROM {CASES} AS t(id, outcome, final_confidence, n_findings)")
def g08_g09_k02_p05_commit_calls(spark: SparkSession, sf: str) -> DataFrame:
    """The gate through the service: each way in which a finding can be taken or refused."""
    session = Session(spark, folder(spark))
    session.add_observations("User", of_every_type(spark, sf)["User"].select(F.col("id").alias("seq"), "sid", F.lit(HASH).alias("evidence_hash"), F.lit("t").alias("derivation"), F.lit(NIGHT).cast("timestamp").alias("observed_at")))
    service = build_server(session)
    node, ask = ["User", "S-1-5-1"], "commit_finding"
    calls = [(ask, {"claim": "seen", "supporting_node_keys": [node], "confidence_hint": "inferred"}), (ask, {"claim": "x", "supporting_node_keys": [], "confidence_hint": "inferred"}), (ask, {"claim": "x", "supporting_node_keys": [node, "none"], "confidence_hint": "inferred"}), (ask, {"claim": "sure", "supporting_node_keys": [node], "confidence_hint": "confirmed"}), (ask, {"claim": "x", "supporting_node_keys": [node], "confidence_hint": "certain"}), (ask, {"claim": "", "supporting_node_keys": [node], "confidence_hint": "inferred"}), (ask, {"claim": 5}), ("drop_finding", {})]
    out = []
    for i, (name, arguments) in enumerate(calls, 1):
        got = service.call(name, arguments)
        out.append((i, got.get("decision") or got["error"], got.get("final_confidence"), len(session.report)))
    return spark.createDataFrame(out, "id int, outcome string, final_confidence string, n_findings int")


@query("SELECT * FROM (VALUES ('commit_finding', 'claim,supporting_node_keys'), ('get_node_provenance', 'key'), ('ingest_artifact', 'path,source_type'), ('list_evidence', ''), ('query_graph', '')) AS t(name, required)")
def p05_registered_calls(spark: SparkSession, sf: str) -> DataFrame:
    tools = build_server(Session(spark, folder(spark))).listing()
    return spark.createDataFrame([(t["name"], ",".join(t["inputSchema"]["required"])) for t in tools], "name string, required string")


@query("SELECT n_nationkey + 1 AS number, '## Finding ' || (n_nationkey + 1) || ' — `' || CASE n_nationkey % 2 WHEN 0 THEN 'suspected' ELSE 'inferred' END || '`' AS heading, '**Claim:** ' || n_name AS claim, n_regionkey AS n_keys FROM nation")
def k03_report_markdown(spark: SparkSession, sf: str) -> DataFrame:
    report = FindingReport(spark)
    for r in table(spark, sf, "nation").orderBy("n_nationkey").collect():
        report.commit(Finding(r["n_name"], [f"k{i}" for i in range(r["n_regionkey"])], "inferred" if r["n_nationkey"] % 2 else "suspected"))
    sections = report.to_markdown().split("\n## ")[1:]
    rows = []
    for n, section in enumerate(sections, 1):
        lines = section.split("\n")
        rows.append((n, f"## {lines[0]}", lines[2], sum(x.startswith("  - `") for x in lines)))
    return spark.createDataFrame(rows, "number long, heading string, claim string, n_keys long")


@query("SELECT count(*) AS runs, CAST(sum(n_nationkey) AS BIGINT) AS nodes_added, CAST(sum(n_regionkey) AS BIGINT) AS nodes_merged, CAST(0 AS BIGINT) AS edges_added, CAST(0 AS BIGINT) AS edges_merged FROM nation")
def k04_runs_total(spark: SparkSession, sf: str) -> DataFrame:
    runs = [IngestRun("p", nodes_added=r["n_nationkey"], nodes_merged=r["n_regionkey"]) for r in table(spark, sf, "nation").collect()]
    total = runs_summary(runs)
    return spark.createDataFrame([tuple(total.values())], ", ".join(f"{c} long" for c in total))


@query("SELECT count(*) AS n_findings, count(*) AS n_ids, 36 AS id_length FROM nation")
def uuid_finding_ids(spark: SparkSession, sf: str) -> DataFrame:
    report = FindingReport(spark)
    for r in table(spark, sf, "nation").collect():
        report.commit(Finding(r["n_name"], ["k"], "inferred"))
    return report.table().agg(F.count("*").alias("n_findings"), F.countDistinct("finding_id").alias("n_ids"), F.max(F.length("finding_id")).alias("id_length"))


@query("SELECT * FROM (VALUES ('a', 2, 'ok'), ('b', 1, 'ok'), ('c', 0, 'bad_filter_op'), ('d', 0, 'ok')) AS t(id, returned, outcome)")
def l01_query_calls(spark: SparkSession, sf: str) -> DataFrame:
    """query_graph with a limit, with a filter, with a bad one, and with one that no type can match."""
    session = Session(spark, folder(spark))
    session.add_observations("User", of_every_type(spark, sf)["User"].select(F.col("id").alias("seq"), "sid", F.lit(HASH).alias("evidence_hash"), F.lit("t").alias("derivation"), F.lit(NIGHT).cast("timestamp").alias("observed_at")))
    asked = {"a": (None, [], 2), "b": ("User", [{"field": "sid", "op": "eq", "value": "S-1-5-7"}], 100), "c": (None, [{"field": "sid", "op": "like", "value": "x"}], 100), "d": (None, [{"field": "sid", "op": "eq", "value": 7}], 100)}
    out = []
    for i, (kind, flts, limit) in asked.items():
        got = json.loads(json.dumps(session.query_graph(kind, flts, limit), default=str))
        out.append((i, got.get("returned", 0), "ok" if got["status"] == "ok" else got["error"]))
    return spark.createDataFrame(out, "id string, returned int, outcome string")



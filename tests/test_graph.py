from __future__ import annotations

import random
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from factloom.functions import filters, text
from factloom.operators import catalogue, gate, graph, parsers
from factloom.operators.session import Session
from factloom.plans import fold as folds
from factloom.plans import schema as S
from factloom.sources import events
from factloom.sources.evidence import EvidenceStore

T0 = datetime(2023, 1, 25, 8, tzinfo=UTC)
HASH = "a" * 64


def column(spark, values, c, kind="string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], f"x {kind}").select(c(F.col("x"))).collect()]


def test_text_functions(spark):
    assert column(spark, ["C:\\Windows\\A.exe", "\\??\\C:\\u\\F.txt", "", None, "//x"], text.file_path_key) == ["c:/windows/a.exe", "c:/u/f.txt", "", None, "/x"]
    assert column(spark, ["\\A\\b\\", "A/B", "//"], text.registry_path_key) == ["a/b", "a/b", ""]
    assert column(spark, ["2025-04-12 08:21:44 x", "2025-04-12T08:21:44", "a b c"], text.iso_time_text) == ["2025-04-12T08:21:44 x", "2025-04-12T08:21:44", "aTb c"]
    assert column(spark, ["file:_C:\\a.zip; webfile:_b", "webfile:_x|y", " a ; b", "", None, "plain"], text.detection_path) == ["C:\\a.zip", "x|y", "a", None, None, "plain"]
    assert column(spark, ["10.0.0.1", "172.31.255.255", "172.32.0.1", "127.9.9.9", "8.8.8.8", "300.1.1.1", "x", None], text.is_private_ipv4) == [True, True, False, True, False, None, None, None]


@pytest.mark.parametrize(("flt", "hit"), [
    ({"field": "name", "op": "eq", "value": "STUN.exe"}, True), ({"field": "name", "op": "eq", "value": "stun.exe"}, False), ({"field": "pid", "op": "eq", "value": 1912.0}, True), ({"field": "pid", "op": "eq", "value": "1912"}, False),
    ({"field": "pid", "op": "gt", "value": 1911}, True), ({"field": "name", "op": "gt", "value": 5}, False), ({"field": "pid", "op": "lt", "value": 1912}, False), ({"field": "name", "op": "contains", "value": "TUN"}, True),
    ({"field": "observed_by", "op": "contains", "value": "pslist"}, True), ({"field": "pid", "op": "contains", "value": "1"}, False), ({"field": "image_path", "op": "exists", "value": True}, False), ({"field": "image_path", "op": "exists", "value": False}, True),
    ({"field": "nope", "op": "exists", "value": 0}, True), ({"field": "nope", "op": "eq", "value": None}, False), ({"field": "image_path", "op": "eq", "value": None}, False), ({"op": "exists", "value": True}, False), ({"field": "start_time", "op": "gt", "value": "2020-01-01"}, False),
])
def test_filters_never_fail_on_types(spark, flt, hit):
    df = spark.createDataFrame([("STUN.exe", 1912, ["pslist"], None, T0)], "name string, pid long, observed_by array<string>, image_path string, start_time timestamp")
    assert (df.where(filters.condition(df, flt)).count() == 1) == hit


def test_filters_reach_the_scan(spark, tmp_path):
    spark.createDataFrame([("a", 1, T0), ("b", 2, None)], "name string, pid long, start_time timestamp").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    flts = [{"field": "name", "op": "eq", "value": "a"}, {"field": "pid", "op": "lt", "value": 2}, {"field": "name", "op": "contains", "value": "a"}, {"field": "start_time", "op": "exists", "value": True}]
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    hit = df.where(filters.all_of(df, flts)).select("pid")
    plan = hit._jdf.queryExecution().toString()
    assert hit.count() == 1 and all(x in plan for x in ("EqualTo(name,a)", "LessThan(pid,2)", "StringContains(name,a)", "IsNotNull(start_time)"))
    never = df.where(filters.all_of(df, [{"field": "pid", "op": "eq", "value": "1"}]))
    assert "FileScan" not in never._jdf.queryExecution().executedPlan().toString()


def test_bad_filter_op_is_named(spark):
    with pytest.raises(filters.BadFilter, match=r"\['contains', 'eq', 'exists', 'gt', 'lt'\]"):
        filters.all_of(spark.range(1), [{"field": "id", "op": "regex", "value": "x"}])


def test_as_of_parent_matches_a_scan(spark):
    rng = random.Random(3)
    starts = [(rng.choice("ab"), rng.randrange(4), None if rng.random() < 0.15 else T0 + timedelta(hours=rng.randrange(30)), f"k{i}") for i in range(60)]
    starts = list({s[:3]: s for s in starts}.values())
    kids = [(rng.choice("ab"), rng.randrange(5), None if rng.random() < 0.1 else T0 + timedelta(hours=rng.randrange(30)), i) for i in range(200)]
    low = datetime(1, 1, 1, tzinfo=UTC)
    want = {}
    for host, pid, at, i in kids:
        good = [(s or low, key) for h, p, s, key in starts if h == host and p == pid and (at is None or s is None or s <= at)]
        want[i] = max(good)[1] if good else None
    nodes = spark.createDataFrame(starts, "host_hostname string, pid long, start_time timestamp, node_key string")
    got = parsers.as_of_parent(spark.createDataFrame(kids, "host string, parent_pid long, child_start timestamp, i long"), nodes).collect()
    assert {r["i"]: r["src_key"] for r in got} == want


def test_detection_parser(spark):
    at = "2023-01-25T15:00:00Z"
    records = spark.createDataFrame([(1116, at, "rd01", "T", 1), (5001, at, "rd01", None, 2), (1000, at, "rd01", "T", 3), (None, at, "rd01", "T", 4), (1117, "never", "rd01", "T", 5), (999, at, "x", "T", 6), (1000, at, "x", "T", 7)], "event_id int, time_created string, computer string, threat_name string, seq long")
    for c in ("action", "file_path", "_evidence_hash", "_derivation"):
        records = records.withColumn(c, F.lit(None).cast("string"))
    obs, stats = parsers.detections(records)
    assert [(r["seq"], r["evidence_hash"]) for r in obs.collect()] == [(1, "f" * 64)]
    assert stats.first().asDict() == {"skipped_event_count": 4, "skipped_event_ids": [1000, 999], "malformed_count": 2}


def test_xml_records(spark):
    good = '<Event xmlns="u"><System><EventID>1116</EventID><TimeCreated SystemTime="2025-04-12 08:21:44.5+00:00"/><Computer>h</Computer><EventRecordID>7</EventRecordID></System><EventData><Data Name="Threat Name">a</Data><Data Name="Threat Name">b</Data><Data>anon</Data><Data Name="Empty"/></EventData></Event>'
    bad = ["<Event>", "", "no xml", good.replace("1116", "x"), good.replace("<Computer>h</Computer>", ""), good.replace(">7<", ">seven<")]
    df = events.parse_records(spark.createDataFrame([(x,) for x in [good, *bad]], "value string"))
    rows = df.collect()
    assert [r["valid"] for r in rows] == [True] + [False] * 6
    assert (rows[0]["event_id"], rows[0]["time_created"], rows[0]["threat_name"], rows[0]["raw_data"], rows[0]["_record_id"]) == (1116, "2025-04-12T08:21:44.5+00:00", "b", {"Threat Name": "b", "Empty": ""}, 7)
    assert events.read_stats(df).first().asDict() == {"records_read": 7, "records_yielded": 1, "records_skipped_malformed": 6}


def test_gate_decision_table(spark):
    nodes = spark.createDataFrame([("p", False), ("q", True), ("lone", False)], "node_key string, disputed boolean")
    edges = spark.createDataFrame([("p", "x", "confirmed"), ("y", "p", "confirmed"), ("p", "p", None)], "src_key string, dst_key string, confidence string")
    cases = {1: ([], "confirmed"), 2: (["p", "bogus"], "suspected"), 3: (["p"], "confirmed"), 4: (["q"], "confirmed"), 5: (["lone"], "suspected"), 6: (["lone"], "inferred"), 7: (["p"], "totally_sure"), 8: (["p"], "disputed"), 9: (["p"], "suspected")}
    claims = spark.createDataFrame([(i, h) for i, (_, h) in cases.items()], "claim_id int, hint string")
    support = spark.createDataFrame([(i, n, k) for i, (keys, _) in cases.items() for n, k in enumerate(keys)], "claim_id int, pos int, node_key string")
    got = {r["claim_id"]: (r["decision"], r["final_confidence"], r["first_missing"]) for r in gate.judge(claims, support, nodes, edges).collect()}
    assert got == {1: ("rejected_empty_support", None, None), 2: ("rejected_missing_node", None, "bogus"), 3: ("accepted", "confirmed", None), 4: ("downgraded_confidence", "disputed", None), 5: ("downgraded_confidence", "inferred", None), 6: ("accepted", "inferred", None), 7: ("bad_confidence_hint", None, None), 8: ("accepted", "disputed", None), 9: ("accepted", "suspected", None)}


def test_walks_end_on_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "a")], "src_key string, dst_key string").withColumn("edge_type", F.lit("Spawned"))
    start = spark.createDataFrame([("a",)], "node_key string")
    assert sorted((r["node_key"], r["depth"]) for r in catalogue.execution_chains(edges, start, 9).collect()) == [("a", 0), ("b", 1), ("c", 2)]
    assert sorted((r["node_key"], r["depth"]) for r in graph.neighbourhood(edges, start, 1).collect()) == [("a", 0), ("b", 1), ("c", 1)]


def test_store_keeps_one_copy_and_survives(spark, tmp_path):
    a, b = tmp_path / "a.log", tmp_path / "b.log"
    a.write_bytes(b"same"), b.write_bytes(b"same")
    store = EvidenceStore(spark, tmp_path / "store")
    sha = store.ingest(a)
    assert store.ingest(b) == sha and len(store) == 1 and store.read(sha) == b"same"
    again = EvidenceStore(spark, tmp_path / "store")
    assert again.get_metadata(sha)["original_name"] == "a.log" and again.has(sha)
    assert [r["evidence_hash"] for r in again.contents().collect()] == [sha]
    assert again.list_all().columns == ["evidence_hash", "original_name", "size_bytes", "ingested_at"]
    with pytest.raises(FileNotFoundError):
        store.ingest(tmp_path / "none")
    with pytest.raises(ValueError, match="regular"):
        store.ingest(tmp_path)
    with pytest.raises(KeyError):
        store.read("0")


@pytest.fixture
def session(spark, tmp_path):
    root = tmp_path / "evidence"
    root.mkdir()
    records = [(1116 if i % 3 else 1000, f"2023-01-25 15:{i:02d}:00+00:00", "rd01", f"T{i % 2}") for i in range(12)]
    df = spark.createDataFrame(records, "e int, t string, c string, n string")
    xml = [r[0] for r in df.select(events.to_xml(F.col("e"), F.col("t"), F.col("c"), {"Threat Name": F.col("n"), "Action Name": F.lit("Quarantined")})).collect()]
    (root / "log.xml").write_text("\n".join([*xml, "<broken"]))
    return Session(spark, tmp_path / "store", root)


def test_session_from_file_to_finding(session, tmp_path):
    path = str(session.evidence_root / "log.xml")
    first = session.ingest_artifact(path, "defender_evtx")
    assert (first["status"], first["records_read"], first["nodes_added"], first["nodes_merged"], first["skipped_event_count"]) == ("ok", 12, 8, 0, 4)
    again = session.ingest_artifact(path, "defender_evtx")
    assert (again["nodes_added"], again["nodes_merged"], again["graph_totals"]["nodes"]) == (0, 8, 8)
    found = session.query_graph("AntivirusDetection", [{"field": "threat_name", "op": "eq", "value": "T1"}], limit=2)
    assert (found["total_matched"], found["returned"], found["truncated"]) == (4, 2, True)
    assert found["nodes"][0]["canonical_key"][3].startswith("2023-01-25T15:")
    key = found["nodes"][0]["node_key"]
    source = session.get_node_provenance(key)
    assert source["source_evidence"]["original_name"] == "log.xml" and source["derivation"] == "defender_evtx log.xml"
    assert session.store.read(source["evidence_hash"]).endswith(b"<broken")
    assert session.get_node_provenance("no")["error"] == "node_not_found"
    listed = found["nodes"][0]["canonical_key"]
    assert session.get_node_provenance(listed)["node_key"] == key
    assert session.get_node_provenance([*listed[:-1], 5])["error"] == "node_not_found"
    done = session.commit_finding("seen", [key], "confirmed")
    assert (done["decision"], done["final_confidence"], done["total_findings"]) == ("downgraded_confidence", "inferred", 1)
    assert session.commit_finding("x", [key, "bogus"], "confirmed")["decision"] == "rejected_missing_node"
    assert session.commit_finding("x", [], "confirmed")["decision"] == "rejected_empty_support"
    assert session.commit_finding("x", [key], "totally_sure")["error"] == "bad_confidence_hint"
    assert session.commit_finding("", [key], "inferred")["error"] == "empty_claim"
    assert session.report.table().count() == 1 and "## Finding 1 — `inferred`" in session.report.to_markdown()
    assert session.list_evidence()["evidence_count"] == 1
    assert session.stats() == {"evidence_count": 1, "node_count": 8, "edge_count": 0, "ingest_runs": 2, "findings": 1}
    assert session.query_graph(None, [{"field": "x", "op": "like", "value": 1}])["error"] == "bad_filter_op"
    assert session.query_graph(limit=0)["nodes"] == []
    outside = tmp_path / "outside.xml"
    outside.write_text("x")
    (session.evidence_root / "link.xml").symlink_to(outside)
    assert [session.ingest_artifact(p, t)["error"] for p, t in ((path, "pcap"), ("/no/such", "defender_evtx"), (str(session.evidence_root), "defender_evtx"), (str(session.evidence_root / "../outside.xml"), "defender_evtx"), (str(session.evidence_root / "link.xml"), "defender_evtx"))] == ["unsupported_source_type", "file_not_found", "not_a_file", "path_outside_allowlist", "path_outside_allowlist"]


def test_session_processes(session, spark):
    ddl = "pid long, name string, image_path string, command_line string, parent_pid long, start_time string, exit_time string, _evidence_hash string, _derivation string, _host_hostname string, seq long"
    row = lambda pid, name, start, seq: (pid, name, None, None, None, start, None, HASH, "vol", "rd01", seq)
    scan = spark.createDataFrame([row(1244, "svchost.exe", "2023-01-25T08:00:00Z", 1), row(1912, "STUN.exe", "2023-01-25T14:52:04Z", 2), row(9999, "hidden.exe", None, 3), row(5, None, None, 4)], ddl)
    listed = spark.createDataFrame([row(1244, "svchost.exe", "2023-01-25T08:00:00Z", 1), row(1912, "STUN.exe", "2023-01-25T14:52:04Z", 2)], ddl)
    rel = spark.createDataFrame([(1244, 1912, "2023-01-25T14:52:04Z", HASH, "vol", "rd01", 1), (99999, 1912, "2023-01-25T14:52:04Z", HASH, "vol", "rd01", 2), (1244, 7, None, HASH, "vol", "rd01", 3)], "parent_pid long, child_pid long, child_start_time string, _evidence_hash string, _derivation string, _host_hostname string, seq long")
    run = session.run_processes(scan, listed, rel)
    assert (run.nodes_added, run.edges_added, run.parser_stats) == (3, 1, {"psscan_count": 3, "pslist_count": 0, "pstree_failures": 2})
    nodes = session.graph.by_type["Process"]
    assert [r["name"] for r in catalogue.hidden(nodes, "psscan", "pslist").collect()] == ["hidden.exe"]
    (edge,) = session.graph.edges.collect()
    assert (edge["confirmed_by"], edge["confidence"]) == (["pstree"], "suspected")
    up = catalogue.parents_of(nodes.where("pid = 1912").select("node_key", "pid"), session.graph.edges, nodes.select("node_key", "pid", "name")).first()
    assert (up["parent_pid"], up["parent_name"]) == (1244, "svchost.exe")
    assert session.graph.incoming_edges(edge["dst_key"], "Spawned").count() == 1 and session.graph.outgoing_edges(edge["dst_key"]).count() == 0
    with pytest.raises(KeyError):
        session.graph.incoming_edges("none")
    with pytest.raises(KeyError):
        session.add_edges(session.graph.edges.select("src_key", F.lit("none").alias("dst_key"), "edge_type", "ts", "confirmed_by", "evidence_hash", "derivation", F.lit(1).alias("seq")), strict=True)
    assert session.commit_finding("c", [edge["src_key"]], "confirmed")["final_confidence"] == "suspected"
    assert session.summary()["edges_added"] == 1


def test_streaming_fold_equals_batch_fold(spark, tmp_path):
    from factloom.streaming.ingest import StreamingFold

    ddl = "evidence_hash string, derivation string, observed_at timestamp, sid string, username string, domain string, account_type string, seq long"
    rows = [(HASH, "d", T0, f"S-1-5-{i % 5}", None if i % 3 else f"u{i}", None, ["domain", "service", "local", "x"][i % 4], i) for i in range(40)]
    all_ = spark.createDataFrame(rows, ddl)
    source = tmp_path / "in"
    for part in ([30, 40], [0, 10], [10, 30]):  # out of order
        all_.where(f"seq >= {part[0]} and seq < {part[1]}").coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(all_.schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    fold = StreamingFold(spark, str(tmp_path / "out"), S.USER)
    fold.start(stream, str(tmp_path / "checkpoint")).awaitTermination()
    columns = ["sid", "username", "account_type", "first_seq", "n_observations"]
    assert sorted(map(tuple, fold.canonical().select(*columns).collect())) == sorted(map(tuple, folds.fold(all_, S.USER).select(*columns).collect()))


def test_keys_hold_microseconds_and_read_by_position(spark):
    rows = [(HASH, "d", T0, "20230125", 1116, T0 + timedelta(microseconds=i), "T", i) for i in range(50)]
    df = spark.createDataFrame(rows, "evidence_hash string, derivation string, observed_at timestamp, host_hostname string, event_id int, detection_time timestamp, threat_name string, seq long")
    nodes = folds.fold(df, S.DETECTION)
    assert nodes.count() == 50
    third = nodes.where("first_seq = 3").first()["node_key"]
    assert graph.node_key_of(spark, ["AntivirusDetection", "20230125", 1116, (T0 + timedelta(microseconds=3)).isoformat(), "T"]) == third
    assert graph.node_key_of(spark, ["AntivirusDetection", "h", "x", None, "T"]) is None and graph.node_key_of(spark, ["Nothing"]) is None
    g = graph.Graph({"AntivirusDetection": nodes})
    shown = g.query(limit=10_000)
    assert (shown["returned"], shown["truncated"]) == (50, False) and [n["detection_time"] for n in shown["nodes"]] == sorted(n["detection_time"] for n in shown["nodes"])


def test_records_in_memory_and_runs(spark):
    from factloom.operators.reports import IngestRun, runs_summary, runs_table
    from factloom.sources.registry import records_frame

    got = records_frame(spark, [{"pid": 1, "name": "a"}, "no record", {"pid": 2}], "pid long, name string").collect()
    assert [tuple(r) for r in got] == [(1, "a"), (2, None)]
    with pytest.raises(NotImplementedError):
        records_frame(spark, "some/path", "pid long")
    with pytest.raises(TypeError):
        records_frame(spark, 5, "pid long")
    runs = [IngestRun("p", nodes_added=2, finished_at=T0, started_at=T0 - timedelta(seconds=3)), IngestRun("q", nodes_merged=1)]
    assert runs[0].duration_seconds == 3 and runs_summary(runs) == {"runs": 2, "nodes_added": 2, "nodes_merged": 1, "edges_added": 0, "edges_merged": 0}
    assert runs_table(spark, runs).count() == 2


def test_catalogue_on_small_tables(spark):
    services = spark.createDataFrame([("pssdnsvc", "C:\\x\\pssdnsvc.exe"), ("a", "C:\\b.exe"), ("n", None)], "service_name string, image_path string")
    assert [r["image_stem"] for r in catalogue.service_mismatch(services).collect()] == ["b"]
    files = spark.createDataFrame([("f", False, ["autoruns"]), ("g", True, ["x"]), ("h", False, [])], "node_key string, on_disk boolean, referenced_by array<string>")
    assert [r["node_key"] for r in catalogue.absent_files(files).collect()] == ["f"]
    edges = spark.createDataFrame([("a", "b", "Spawned", T0)], "src_key string, dst_key string, edge_type string, ts timestamp")
    window = (F.lit(T0), F.lit(T0 + timedelta(seconds=1)))
    assert graph.stated(edges, F.lit("a"), "Spawned", F.lit("b"), *window).first()["found"] and not graph.stated(edges, F.lit("b"), "Spawned", F.lit("a"), *window).first()["found"]
    nodes = spark.createDataFrame([("a", "Process"), ("b", "File")], "node_key string, node_type string")
    assert graph.endpoint_lint(edges, nodes).count() == 1
    empty = edges.limit(0)
    assert catalogue.accuracy(empty.select("src_key"), empty.select("src_key"), "src_key").first().asDict() == {"tp": 0, "unfounded": 0, "missed": 0, "precision": None, "recall": None, "f1": None}

"""Sessions over several runs, the service and command line on them, log files in ranges, and paths."""

from __future__ import annotations

import json
import random
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from factloom import cli
from factloom.operators import graph
from factloom.operators.service import Service, build_server
from factloom.operators.session import Session
from factloom.sources import events
from factloom.sources.eventlog import read_binary_log

T0 = datetime(2024, 1, 1, tzinfo=UTC)
HASH = "a" * 64
LISTED = "pid long, name string, image_path string, command_line string, parent_pid long, start_time string, exit_time string, _evidence_hash string, _derivation string, _host_hostname string, seq long"


def test_the_first_run_wins_whatever_its_plugin_and_partition(spark, tmp_path):
    row = lambda name, seq: (7, name, None, None, None, "2024-01-01T00:00:00Z", None, HASH, "vol", "h", seq)
    far = spark.createDataFrame([row("first.exe", 0)], LISTED).withColumn("seq", F.lit((1 << 48) + 5))
    session = Session(spark, tmp_path)
    none = far.limit(0)
    session.run_processes(none, far)
    session.run_processes(spark.createDataFrame([row("second.exe", 1)], LISTED), none)
    (node,) = session.graph.by_type["Process"].collect()
    assert node["name"] == "first.exe" and node["observed_by"] == ["pslist", "psscan"]
    assert [e["value"] for e in node["disagreements"]["name"]] == ["second.exe"]
    many = spark.range(0, 300, 1, 300).select((F.col("id") + 100).alias("pid"), F.lit("third.exe").alias("name"), *(F.lit(None).cast("string").alias(c) for c in ("image_path", "command_line")), F.lit(None).cast("long").alias("parent_pid"), F.lit(None).cast("string").alias("start_time"), F.lit(None).cast("string").alias("exit_time"), F.lit(HASH).alias("_evidence_hash"), F.lit("vol").alias("_derivation"), F.lit("h").alias("_host_hostname"), F.monotonically_increasing_id().alias("seq"))
    session.run_processes(many.withColumn("pid", F.col("pid") % 150), none)
    session.run_processes(many.withColumn("name", F.lit("fourth.exe")), none)
    nodes = session.graph.by_type["Process"]
    assert nodes.where("pid >= 150 and name = 'third.exe'").count() == 0
    assert nodes.where("pid between 100 and 149").select("name").distinct().collect()[0][0] == "third.exe"


def test_edges_of_several_runs_unite(spark, tmp_path):
    session = Session(spark, tmp_path)
    obs = spark.createDataFrame([(HASH, "d", T0, f"S-1-5-{i}", i) for i in range(3)], "evidence_hash string, derivation string, observed_at timestamp, sid string, seq long")
    session.add_observations("User", obs)
    keys = [r["node_key"] for r in session.graph.nodes().orderBy("node_key").collect()]
    edge = lambda source, seq: spark.createDataFrame([(keys[0], keys[1], "Read", None, [source], HASH, "d", seq)], "src_key string, dst_key string, edge_type string, ts timestamp, confirmed_by array<string>, evidence_hash string, derivation string, seq long")
    assert session.add_edges(edge("p", 1)) == (1, 0)
    session.runs.append(None)
    assert session.add_edges(edge("q", 0)) == (0, 1)
    (one,) = session.graph.edges.collect()
    assert one["confirmed_by"] == ["p", "q"] and one["confidence"] == "confirmed"


def test_service_calls(spark, tmp_path):
    service = build_server(Session(spark, tmp_path))
    assert isinstance(service, Service) and {t["name"] for t in service.listing()} == {"ingest_artifact", "query_graph", "get_node_provenance", "commit_finding", "list_evidence"}
    query = next(t for t in service.listing() if t["name"] == "query_graph")["inputSchema"]["properties"]
    assert query["limit"] == {"type": "integer", "default": 100} and query["node_type"]["type"] == ["string", "null"]
    assert service.call("query_graph", {"limit": True})["error"] == "bad_arguments" == service.call("commit_finding", {})["error"] == service.call("list_evidence", {"x": 1})["error"]
    assert service.call("nothing")["error"] == "unknown_tool"
    assert service.call("list_evidence")["evidence_count"] == 0 and service.call("query_graph")["nodes"] == []
    assert service.call("query_graph", {"filters": [{"field": "a", "op": "matches"}]})["error"] == "bad_filter_op"

    class Server:
        def __init__(self):
            self.tools = {}

        def tool(self, name, description):
            return lambda f: self.tools.setdefault(name, f)

    assert build_server(Session(spark, tmp_path), Server()).tools["list_evidence"]()["status"] == "ok"


def logged(spark, n):
    df = spark.range(n).select(events.to_xml(F.lit(1116), F.lit("2024-01-01 00:00:00+00:00"), F.concat(F.lit("h"), "id"), {"Threat Name": F.repeat(F.lit("t"), (F.col("id") % 50).cast("int"))}))
    return [r[0] for r in df.collect()]


@pytest.mark.parametrize(("chunk", "chunks"), [(64, 1), (100, 3), (1 << 16, 256)])
def test_log_files_in_ranges(spark, tmp_path, chunk, chunks):
    texts = logged(spark, 60)
    (tmp_path / "a.log").write_text("\n".join([*texts[:40], "<broken", ""]))
    (tmp_path / "b.log").write_text("\n".join(texts[40:]))
    got = read_binary_log(spark, str(tmp_path), chunk=chunk, chunks=chunks)
    assert sorted(r["computer"] for r in got.where("valid").collect()) == sorted(f"h{i}" for i in range(60)) and got.where("not valid").count() == 1
    assert read_binary_log(spark, str(tmp_path / "b.log"), chunk=chunk, chunks=chunks).count() == 20


def test_small_ranges_share_tasks(spark, tmp_path):
    texts = logged(spark, 200)
    for i in range(20):
        (tmp_path / f"{i:02d}.log").write_text("\n".join(texts[i * 10 : i * 10 + 10]))
    got = read_binary_log(spark, str(tmp_path), chunk=32, chunks=1)
    assert got.rdd.getNumPartitions() <= 2 * 64 and got.select("computer").distinct().count() == got.count() == 200


def test_logs_in_chunks_with_a_decoder(spark, tmp_path, monkeypatch):
    texts = logged(spark, 5)
    data = bytes(16) + b"".join("\n".join([t, t]).encode().ljust(1024, b"\0") for t in texts)
    (tmp_path / "log.bin").write_bytes(data)
    (tmp_path / "chunked_log.py").write_text("def decode(chunk):\n    return chunk.rstrip(b'\\0').decode().split('\\n')\n")
    spark.sparkContext.addPyFile(str(tmp_path / "chunked_log.py"))
    monkeypatch.syspath_prepend(str(tmp_path))
    got = read_binary_log(spark, str(tmp_path / "log.bin"), decoder="chunked_log:decode", header=16, chunk=1024, chunks=2)
    assert sorted(r["computer"] for r in got.collect()) == sorted(f"h{i}" for i in range(5) for _ in range(2))
    with pytest.raises(Exception, match="FileNotFound"):
        read_binary_log(spark, str(tmp_path / "none")).count()


def test_command_line(spark, tmp_path, capsys):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.xml").write_text("\n".join(logged(spark, 9)))
    assert cli.main(["version"]) == 0 and capsys.readouterr().out.startswith("factloom ")
    assert cli.main(["investigate", str(tmp_path / "none")]) == 2
    assert cli.main(["investigate", str(folder), "--output", str(tmp_path / "out")]) == 0
    assert json.loads((tmp_path / "out/summary.json").read_text())["node_count"] == 9
    assert spark.read.parquet(str(tmp_path / "out/nodes/AntivirusDetection")).count() == 9
    assert (tmp_path / "out/report.md").read_text().startswith("# Investigation Report")


def test_paths_are_shortest_and_first(spark):
    rng = random.Random(4)
    edges = {(rng.randrange(25), rng.randrange(25)) for _ in range(45)}
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
    want = {}
    for start in range(25):
        front = [(start,)]
        seen = {start: (start,)}
        for _ in range(5):
            level = {}
            for p in front:
                for n in out.get(p[-1], ()):
                    if n not in seen:
                        level[n] = min(level.get(n, (*p, n)), (*p, n))
            seen |= level
            front = list(level.values())
        want |= {(start, goal): list(p) for goal, p in seen.items()}
    pairs = spark.createDataFrame([(a, b) for a in range(25) for b in range(25)], "start long, goal long")
    df = spark.createDataFrame(sorted(edges), "src_key long, dst_key long")
    got = graph.paths_between(df, pairs, 5).collect()
    assert {(r["start"], r["goal"]): r["path"] for r in got} == want and all(len(r["path"]) == r["depth"] + 1 for r in got)

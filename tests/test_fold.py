"""Fold policies against a sequential model: rows are merged one by one, as an in-memory graph would."""

from __future__ import annotations

import random
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from factloom.plans import fold as folds
from factloom.plans import schema as S

T0 = datetime(2024, 1, 1, tzinfo=UTC)
HASH = "a" * 64
FROM = "evidence_hash string, derivation string, observed_at timestamp, seq long"


def merged(rows, key, start, step):
    """{key: state} after folding rows in order of seq."""
    state = {}
    for r in sorted(rows, key=lambda r: r["seq"]):
        k = key(r)
        if k in state:
            step(state[k], r)
        else:
            state[k] = start(r)
    return state


def frame(spark, rows, ddl):
    from pyspark.sql.types import StructType

    kind = StructType.fromDDL(ddl)
    return spark.createDataFrame([tuple(r.get(f.name) for f in kind) for r in rows], kind)


def base(i, source):
    return {"evidence_hash": HASH, "derivation": source, "observed_at": T0, "seq": i}


def maybe(rng, values, p=0.3):
    return None if rng.random() < p else rng.choice(values)


def test_process_fold_matches_one_by_one_merging(spark):
    rng = random.Random(1)
    rows = []
    for i in range(900):
        rows.append({**base(i, rng.choice(["pslist", "psscan", "evtx"])), "host_hostname": rng.choice("ab"), "pid": rng.randrange(20), "start_time": maybe(rng, [T0, T0 + timedelta(hours=1)]), "name": rng.choice(["x", "y"]), "image_path": maybe(rng, ["p", "q"]), "command_line": maybe(rng, ["c", "d", "e"]), "parent_pid": maybe(rng, [1, 2]), "exit_time": maybe(rng, [T0, T0 + timedelta(days=1)]), "sha256": None, "observed_by": [rng.choice("abc") for _ in range(rng.randrange(3))], "disagreements": {"name": [("z", "before")]} if rng.random() < 0.1 else None})
    rng.shuffle(rows)
    logged = ("image_path", "command_line", "parent_pid", "sha256")

    def start(r):
        return {**r, "observed_by": list(r["observed_by"]), "log": {k: list(v) for k, v in (r["disagreements"] or {}).items()}}

    def step(s, r):
        for c in (*logged, "name"):
            if s[c] is None:
                s[c] = r[c]
            elif r[c] is not None and s[c] != r[c]:
                s["log"].setdefault(c, []).append((str(r[c]), r["derivation"]))
        s["exit_time"] = max((x for x in (s["exit_time"], r["exit_time"]) if x), default=None)
        s["observed_by"] += [o for o in dict.fromkeys(r["observed_by"]) if o not in s["observed_by"]]
        for c, entries in (r["disagreements"] or {}).items():
            s["log"].setdefault(c, []).extend(entries)

    # within one row a difference is logged before what the row brought along; the model above does the same per column
    want = merged(rows, lambda r: (r["host_hostname"], r["pid"], r["start_time"]), start, step)
    ddl = FROM + ", host_hostname string, pid long, start_time timestamp, name string, image_path string, command_line string, parent_pid long, exit_time timestamp, sha256 string, observed_by array<string>, disagreements map<string,array<struct<value:string,source:string>>>"
    got = folds.fold(frame(spark, rows, ddl), S.PROCESS).collect()
    assert len(got) == len(want)
    for r in got:
        s = want[(r["host_hostname"], r["pid"], r["start_time"].replace(tzinfo=UTC) if r["start_time"] else None)]
        assert (r["name"], r["image_path"], r["command_line"], r["parent_pid"], r["observed_by"], r["derivation"]) == (s["name"], s["image_path"], s["command_line"], s["parent_pid"], s["observed_by"], s["derivation"])
        assert (r["exit_time"].replace(tzinfo=UTC) if r["exit_time"] else None) == s["exit_time"]
        own = s["log"]
        assert {c: [(e["value"], e["source"]) for e in v] for c, v in (r["disagreements"] or {}).items()} == own


def test_registry_takes_the_newest_write(spark):
    rng = random.Random(2)
    rows = [{**base(i, "reg"), "host_hostname": "h", "hive_name": "SYSTEM", "key_path": rng.choice(["\\A\\B\\", "a/b", "A\\C"]), "value_name": maybe(rng, ["v"]), "value_str": maybe(rng, ["1", "2", "3"]), "value_bin": None, "value_type": maybe(rng, ["REG_SZ", "REG_DWORD"]), "last_write_time": maybe(rng, [T0 + timedelta(days=d) for d in range(4)])} for i in range(60)]

    def step(s, r):
        newer = r["last_write_time"] is not None and (s["last_write_time"] is None or r["last_write_time"] > s["last_write_time"])
        for c in ("value_str", "value_type"):
            s[c] = r[c] if newer or s[c] is None else s[c]
        s["last_write_time"] = r["last_write_time"] if newer else s["last_write_time"]

    for seed in range(6):
        part = random.Random(seed).sample(rows, 12)
        want = merged(part, lambda r: (r["key_path"].replace("\\", "/").strip("/").lower(), r["value_name"]), dict, step)
        ddl = FROM + ", host_hostname string, hive_name string, key_path string, value_name string, value_str string, value_bin binary, value_type string, last_write_time timestamp"
        for r in folds.fold(frame(spark, part, ddl), S.REGISTRY).collect():
            s = want[(r["k_path"], r["value_name"])]
            assert (r["value_str"], r["value_type"]) == (s["value_str"], s["value_type"])


@pytest.mark.parametrize(("values", "expected"), [([("registry", False), ("svcscan", True)], True), ([("svcscan", True), ("registry", False)], True), ([("x", None), ("y", True)], True), ([("x", True), ("SVCSCAN y", False)], False), ([("x", None)], None)])
def test_memory_source_decides_running(spark, values, expected):
    rows = [{**base(i, source), "host_hostname": "h", "service_name": "s", "is_running": v} for i, (source, v) in enumerate(values)]
    (row,) = folds.fold(frame(spark, rows, FROM + ", host_hostname string, service_name string, is_running boolean"), S.SERVICE).collect()
    assert row["is_running"] == expected


def test_conflicting_hashes_fail_or_are_flagged(spark):
    rows = [{**base(i, "d"), "host_hostname": "h", "full_path": "C:\\X", "sha256": sha} for i, sha in enumerate(["1", "", "2"])]
    df = frame(spark, rows, FROM + ", host_hostname string, full_path string, sha256 string")
    assert folds.fold(df, S.FILE, strict=False).first()["conflicts"] == ["sha256"]
    with pytest.raises(Exception, match="conflicting values of sha256"):
        folds.fold(df, S.FILE).collect()


def test_two_level_fold_logs_once_a_run(spark):
    rows = [{**base(i, "d"), "run_id": run, "host_hostname": "h", "task_path": "t", "command": c} for i, (run, c) in enumerate([("r1", "a"), ("r1", "b"), ("r2", "b"), ("r2", "b")])]
    df = frame(spark, rows, FROM + ", run_id string, host_hostname string, task_path string, command string")
    (one,) = folds.fold(df.drop("run_id"), S.TASK).collect()
    (two,) = folds.fold_by_run(df, S.TASK).collect()
    assert [e["value"] for e in one["disagreements"]["command"]] == ["b", "b", "b"]
    assert [e["value"] for e in two["disagreements"]["command"]] == ["b", "b"]


def test_edges_fold_with_null_times_and_confidence(spark):
    rows = [("a", "b", "Spawned", None, ["p", "p"], 1), ("a", "b", "Spawned", None, ["p"], 2), ("a", "b", "Spawned", T0, ["p"], 3), ("a", "c", "Spawned", T0, [], 4), ("a", "d", "References", T0, [], 5)]
    df = spark.createDataFrame(rows, "src_key string, dst_key string, edge_type string, ts timestamp, confirmed_by array<string>, seq long")
    got = {(r["dst_key"], r["ts"] is None): (r["confirmed_by"], r["confidence"]) for r in folds.fold_edges(df).collect()}
    assert got == {("b", True): (["p", "p"], "confirmed"), ("b", False): (["p"], "suspected"), ("c", False): ([], "inferred"), ("d", False): ([], None)}
    with pytest.raises(Exception, match="References has no confirming sources"):
        folds.fold_edges(df.withColumn("confirmed_by", F.array(F.lit("p")))).collect()


def test_rows_of_another_type_are_not_merged(spark):
    rows = [{**base(i, "d"), "sid": "S-1-5-1", "node_type": t} for i, t in enumerate(["User", "Host", None])]
    df = frame(spark, rows, FROM + ", sid string, node_type string")
    assert folds.fold(df.where("node_type = 'User'"), S.USER).first()["n_observations"] == 1
    assert folds.foreign(df, S.USER).count() == 2
    with pytest.raises(Exception, match="cannot merge Host into User"):
        folds.fold(df.where("node_type = 'Host'"), S.USER).collect()


def test_folding_in_batches_equals_folding_at_once(spark):
    rng = random.Random(9)
    ddl = FROM + ", host_hostname string, pid long, start_time timestamp, name string, image_path string, exit_time timestamp, observed_by array<string>"
    rows = [{**base(i, rng.choice("pq")), "host_hostname": "h", "pid": rng.randrange(6), "name": rng.choice("xy"), "image_path": maybe(rng, ["a", "b"]), "exit_time": maybe(rng, [T0, T0 + timedelta(days=1)]), "observed_by": [rng.choice("abc")]} for i in range(90)]
    nodes = None
    for a in range(0, 90, 30):
        nodes = folds.merge(nodes, frame(spark, rows[a : a + 30], ddl), S.PROCESS)
    whole = folds.fold(frame(spark, rows, ddl), S.PROCESS)
    shown = [c for c in whole.columns if c != "disagreements"]
    log = F.to_json("disagreements").alias("log")
    assert sorted(map(str, nodes.select(*shown, log).collect())) == sorted(map(str, whole.select(*shown, log).collect()))
    service = FROM + ", host_hostname string, service_name string, is_running boolean"
    more = [{**base(i, rng.choice(["svcscan", "registry"])), "host_hostname": "h", "service_name": rng.choice("st"), "is_running": maybe(rng, [True, False])} for i in range(40)]
    nodes = None
    for a in range(0, 40, 10):
        nodes = folds.merge(nodes, frame(spark, more[a : a + 10], service), S.SERVICE)
    assert sorted(map(str, nodes.select("service_name", "is_running", "n_observations").collect())) == sorted(map(str, folds.fold(frame(spark, more, service), S.SERVICE).select("service_name", "is_running", "n_observations").collect()))


def test_counters_and_empty_tables(spark):
    a = spark.createDataFrame([("x",), ("x",), ("y",)], "k string")
    assert folds.counters(a, None, "k").first().asDict() == {"added": 2, "merged": 1}
    assert folds.counters(a, a.where("k = 'x'"), "k").first().asDict() == {"added": 1, "merged": 2}
    assert folds.counters(a.limit(0), a, "k").first().asDict() == {"added": 0, "merged": 0}
    empty = frame(spark, [], FROM + ", sid string, account_type string")
    assert folds.fold(empty, S.USER).count() == 0


def test_schema_is_closed_and_checked(spark):
    df = spark.createDataFrame([("S-1-5", HASH, "d", T0), ("S-1", "x", "", None)], "sid string, evidence_hash string, derivation string, observed_at timestamp")
    problems = [r["problems"] for r in S.checked(df, S.USER).orderBy(F.length("sid").desc()).collect()]
    assert problems == [[], ["evidence_hash", "derivation", "observed_at", "sid_length"]]
    with pytest.raises(ValueError, match="outside the schema"):
        S.checked(df.withColumn("colour", F.lit(1)), S.USER)


def test_long_logs_in_segments_hold_what_maps_hold(spark):
    ddl = "evidence_hash string, derivation string, observed_at timestamp, host_hostname string, pid long, start_time timestamp, name string, command_line string, seq long"
    rows = [("a" * 64, f"d{i}", None, "h", i % 2 if i < 100 else 0, None, f"n{i % 4}", None if i % 3 else f"c{i % 5}", i) for i in range(900)]
    obs = spark.createDataFrame(rows, ddl).repartition(3)
    nodes, segments = folds.fold_in_segments(obs, S.PROCESS, segment=50)
    want = {(r["node_key"], f): [tuple(e) for e in log] for r in folds.fold(obs, S.PROCESS).collect() for f, log in (r["disagreements"] or {}).items()}
    got: dict = {}
    for r in sorted(segments.collect(), key=lambda r: r["segment"]):
        assert len(r["entries"]) <= 50
        got.setdefault((r["node_key"], r["field"]), []).extend(tuple(e) for e in r["entries"])
    assert got == want
    assert {r["node_key"]: r["n_disagreements"] for r in nodes.collect()} == {k: sum(len(v) for (n, _), v in want.items() if n == k) for k in {n for n, _ in want}}


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_united_lists_are_folded_aside_and_only_if_asked_for(spark):
    rows = [{**base(i, "d"), "host_hostname": "h", "full_path": p, "size_bytes": i, "on_disk": False, "referenced_by": lists} for i, (p, lists) in enumerate([("C:\\A", None), ("c:/a", ["x", "x"]), ("c:/b", ["y", "y"]), ("c:/b", ["y", "z"]), ("c:/b", ["y", "y"]), ("c:/c", None)])]
    df = frame(spark, rows, FROM + ", host_hostname string, full_path string, size_bytes long, on_disk boolean, referenced_by array<string>")
    nodes = folds.fold(df, S.FILE)
    assert {r["k_path"]: (r["referenced_by"], r["host_hostname"], r["full_path"]) for r in nodes.collect()} == {"c:/a": (["x"], "h", "C:\\A"), "c:/b": (["y", "y", "z"], "h", "c:/b"), "c:/c": ([], "h", "c:/c")}
    plain = nodes.select("host_hostname", "k_path", "size_bytes", "on_disk")
    assert shuffles(plain) == 1
    assert "derivation" not in plain._jdf.queryExecution().optimizedPlan().toString().split("LogicalRDD")[0]
    assert shuffles(nodes.select("k_path", "referenced_by", "observed_at")) == 3


def test_the_newest_write_takes_one_shuffle(spark):
    ddl = FROM + ", host_hostname string, hive_name string, key_path string, value_name string, value_str string, value_type string, last_write_time timestamp"
    rows = [{**base(i, "reg"), "host_hostname": "h", "hive_name": "S", "key_path": "k", "value_name": "v", "value_str": v, "value_type": k, "last_write_time": t and T0 + timedelta(days=t)} for i, (v, k, t) in enumerate([("a", None, 1), (None, "x", None), (None, None, 3), ("b", None, 2), ("c", "y", 3)])]
    nodes = folds.fold(frame(spark, rows, ddl), S.REGISTRY)
    assert shuffles(nodes) == 1
    (row,) = nodes.collect()
    assert (row["value_str"], row["value_type"], row["n_observations"], row["first_seq"]) == ("b", "y", 5, 0)

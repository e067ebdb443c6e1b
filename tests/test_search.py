"""Chains, paths and claims against plain searches, on dense graphs and hot triples too."""

from __future__ import annotations

import random
from datetime import UTC, datetime, timedelta

from pyspark.sql import functions as F

from factloom.operators import graph
from factloom.plans.lineage import cut_lineage
from factloom.plans.prefix import running_sums

T0 = datetime(2024, 1, 1, tzinfo=UTC)


def test_chain_levels_count_walks_and_unfold_asked_ends(spark):
    rng = random.Random(1)
    edges = {(rng.randrange(12), rng.randrange(12)) for _ in range(30)}
    starts = [0, 3, 99]
    df = spark.createDataFrame(sorted(edges), "src_key long, dst_key long")
    levels = graph.chains(df, spark.createDataFrame([(s,) for s in starts], "node_key long"), 5)
    want, walks = {}, {s: {(s,): 1} for s in starts}
    for s in starts:
        front = [(s,)]
        for depth in range(6):
            for p in front:
                want[s, p[-1], depth] = want.get((s, p[-1], depth), 0) + 1
                walks[s][p] = 1
            front = [(*p, b) for p in front for a, b in edges if a == p[-1]]
    assert {(r["start"], r["node_key"], r["depth"]): int(r["n_walks"]) for r in levels.collect()} == want
    asked = spark.createDataFrame([(0, n, d) for n in range(6) for d in range(6)] + [(3, 3, 0), (3, 77, 2)], "start long, node_key long, depth int")
    got = sorted((r["start"], r["depth"], tuple(r["path"])) for r in graph.unfolded(df, levels, asked).collect())
    simple = [(s, len(p) - 1, p) for s in starts for p in walks[s] if len(set(p)) == len(p)]
    assert got == sorted(x for x in simple if (x[0] == 0 and x[2][-1] < 6) or (x[0] == 3 and len(x[2]) == 1))


def test_walks_write_each_path_once(spark, monkeypatch):
    rng = random.Random(3)
    edges = {(rng.randrange(15), rng.randrange(15)) for _ in range(40)}
    df = spark.createDataFrame(sorted(edges), "src_key long, dst_key long")
    written = []

    def counted(rows, name="step", by=()):
        out = cut_lineage(rows, name, by)
        written.append(out.count())
        return out

    monkeypatch.setattr(graph, "cut_lineage", counted)
    got = [(r["start"], r["depth"], tuple(r["path"])) for r in graph.walk(df, spark.createDataFrame([(0,), (4,), (4,), (None,)], "node_key long"), 5).collect()]
    want, front = [], [(0,), (4,)]
    for depth in range(6):
        want += [(p[0], depth, p) for p in front]
        front = [(*p, b) for p in front for a, b in edges if a == p[-1] and b not in p]
    assert sorted(got) == sorted(want)
    assert sum(written) <= len(edges) + len(want)


def test_searches_for_paths_send_no_table_through_the_driver(spark, monkeypatch):
    df = spark.createDataFrame([(i, (i * 3 + 1) % 40) for i in range(40)], "src_key long, dst_key long")
    plans = []

    def noted(rows, name="step", by=()):
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        return cut_lineage(rows, name, by)

    monkeypatch.setattr(graph, "cut_lineage", noted)
    found = graph.paths_between(df, spark.createDataFrame([(1, 13), (2, 2), (5, 0)], "start long, goal long"), 4)
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert {(r["start"], r["goal"]): r["path"] for r in found.collect()} == {(1, 13): [1, 4, 13], (2, 2): [2]}
    assert any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)


def test_a_dense_graph_has_a_row_a_node_and_level(spark):
    n = 10_000
    df = spark.range(n * 12).select((F.col("id") % n).alias("src_key"), F.pmod(F.xxhash64("id"), F.lit(n)).alias("dst_key"))
    levels = graph.chains(df, spark.createDataFrame([(0,)], "node_key long"), 6)
    rows = {r["depth"]: (r["n"], r["w"]) for r in levels.groupBy("depth").agg(F.count("*").alias("n"), F.sum("n_walks").alias("w")).collect()}
    assert max(m for m, _ in rows.values()) <= n and rows[6][1] > 20 * n


def test_claims_equal_a_scan(spark):
    rng = random.Random(2)
    when = lambda: None if rng.random() < 0.15 else T0 + timedelta(hours=rng.randrange(20))
    edges = [(f"s{rng.randrange(3)}", f"o{rng.randrange(3)}", rng.choice(["A", "B"]), when(), rng.choice(["confirmed", "suspected", "inferred", "disputed", None])) for _ in range(300)]
    claims = [(i, rng.choice(["s0", "s1", "s2", "s9", None]), rng.choice(["A", "B"]), f"o{rng.randrange(3)}", when() if rng.random() < 0.8 else None, when() if rng.random() < 0.8 else None) for i in range(200)]
    ranks = {"disputed": 0, "inferred": 1, "suspected": 2, "confirmed": 3}
    want = {}
    for i, s, p, o, a, b in claims:
        hits = [e for e in edges if (e[0], e[2], e[1]) == (s, p, o) and (a is None or (e[3] is not None and e[3] >= a)) and (b is None or (e[3] is not None and e[3] < b))]
        known = [e[4] for e in hits if e[4]]
        want[i] = (bool(hits), len(hits), max(known, key=ranks.get) if known else None)
    e = spark.createDataFrame(edges, "src_key string, dst_key string, edge_type string, ts timestamp, confidence string")
    c = spark.createDataFrame(claims, "claim_id int, subject string, predicate string, object string, start timestamp, end timestamp")
    assert {r["claim_id"]: (r["found"], r["n_edges"], r["confidence"]) for r in graph.verify_claims(e, c).collect()} == want


def test_many_claims_of_one_hot_triple(spark):
    n = 1_000_000
    e = spark.range(n).select(F.lit("s").alias("src_key"), F.lit("o").alias("dst_key"), F.lit("A").alias("edge_type"), F.timestamp_micros(F.col("id")).alias("ts"), F.when(F.col("id") % 1000 == 7, "confirmed").otherwise("inferred").alias("confidence"))
    c = spark.range(3000).select(F.col("id").alias("claim_id"), F.lit("s").alias("subject"), F.lit("A").alias("predicate"), F.lit("o").alias("object"), F.timestamp_micros(F.col("id") * 100).alias("start"), F.timestamp_micros(F.col("id") * 100 + 500).alias("end"))
    row = graph.verify_claims(e, c).agg(F.min("n_edges"), F.max("n_edges"), F.count_if(F.col("confidence") == "confirmed"), F.count("*")).first()
    assert tuple(row) == (500, 500, sum((7 - i * 100) % 1000 < 500 for i in range(3000)), 3000)


def test_running_sums_of_hot_keys(spark):
    df = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, F.col("id") % 50).otherwise(-1).alias("k"), F.xxhash64("id").alias("o"), (F.col("id") % 7).alias("v"))
    got = running_sums(df, ["k"], ["o"], {"total": F.col("v"), "n": F.lit(1)}).toPandas().sort_values(["k", "o"])
    assert (got["total"] == got.groupby("k")["v"].cumsum()).all() and (got["n"] == got.groupby("k").cumcount() + 1).all() and len(got) == 20_000

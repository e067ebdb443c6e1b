"""The prefix trie and the centroid clusters against plain Python, on odd tables and on the given ones."""

from __future__ import annotations

import hashlib
import math
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import centroids, conversations

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def sha(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


def in_order(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((x is None, x) for x in r))


# -- op11

def ordered(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append(((turn is not None, turn or 0, sha(f"{len(role or '')}:{role or ''}{text or ''}")), (role or "", text or "")))
    return {c: [t for _, t in sorted(own[c])] for c in own}


def rebuilt(own):
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + turns[h:]
    return out


def trie(convs):
    nodes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for p, members in nodes.items():
        below = [q for q in nodes if q[: len(p)] == p]
        children = [q for q in below if len(q) == len(p) + 1]
        leaves = [q for q in below if not any(len(x) == len(q) + 1 and x[: len(q)] == q for x in below)]
        saved = sum((len(nodes[q]) - 1) * len(q[-1][1]) for q in below if q)
        ends = sorted(c for c in members if len(convs[c]) == len(p))
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), len(children), len(leaves), saved, sha(",".join(map(str, ends)))))
    return in_order(out)


def frame(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_trie_of_rebuilt_conversations(spark):
    rng = random.Random(1)
    rows = []
    for c in [*range(40), *range(95, 130), -5, -103, 1000, 1001, 5000]:
        for t in range(rng.choice([1, 2, 3, 8])):
            rows.append((c, rng.choice([t, t, None]), rng.choice(["user", None, ""]), rng.choice(["a", "bb", "é\U0001f600", None, ""])))
    rows += rows[:20] + [(None, 1, "user", "no conversation")]
    got = conversations.grafted_trie(frame(spark, rows).withColumn("pos", F.lit("own")).withColumn("CLS", F.lit(1)).repartition(5)).collect()
    assert in_order(got) == trie(rebuilt(ordered(rows)))


def test_trie_with_long_shared_beginnings(spark, monkeypatch):
    monkeypatch.setattr(conversations, "MOST_BLOCK", 4)
    monkeypatch.setattr(conversations, "_CHAIN", 3)
    rng = random.Random(2)
    trunk = [("user", rng.choice("abc")) for _ in range(45)]
    rows = []
    for c in range(14):
        turns = trunk[: rng.randrange(46)] + [("user", rng.choice("xy")) for _ in range(rng.randrange(4))]
        rows += [(c, i, *t) for i, t in enumerate(turns)]
    rows += [(c, i, *t) for c in (50, 51, 52) for i, t in enumerate(trunk)]
    assert in_order(conversations.conversation_trie(frame(spark, rows)).collect()) == trie(ordered(rows))


def test_blocks_cover_turns_in_order(spark, monkeypatch):
    monkeypatch.setattr(conversations, "MOST_BLOCK", 4)
    blocks = [r[0] for r in spark.range(1, 40).orderBy("id").select(conversations.block_of(F.col("id"))).collect()]
    for pos, block in enumerate(blocks, 1):
        assert conversations.block_end(block) >= pos > (conversations.block_end(block - 1) if block else 0)


def test_one_conversation_and_none(spark):
    rows = [(7, 1, "user", "a"), (7, 2, "user", "b")]
    assert in_order(conversations.conversation_trie(frame(spark, rows)).collect()) == trie(ordered(rows))
    assert conversations.grafted_trie(frame(spark, [])).collect() == []
    turnless = [(101, 0, "u", "x"), (102, 0, "u", "y")]  # as their first turns are lent by a conversation that is not there
    assert in_order(conversations.grafted_trie(frame(spark, turnless)).collect()) == trie(rebuilt(ordered(turnless)))


@needs_tables
def test_trie_of_the_table(spark):
    df = spark.read.parquet(f"{SF}/conversations.parquet")
    assert in_order(conversations.grafted_trie(df).collect()) == trie(rebuilt(ordered(df.select("conv_id", "turn", "role", "text").collect())))


# -- op12

def lloyd(rows, k=16, rounds=3, scale=64, dims=64):
    kept = [(i, [max(-(1 << 26), min(1 << 26, math.floor(scale * x))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    cs = [v for _, _, v in sorted((sha(f"1:{'' if i is None else i}"), str(i), v) for i, v in kept)][:k]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(cs))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for j in range(len(cs)):
            mine = [v for (_, v), o in zip(kept, own, strict=True) if o == j]
            cs[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)] if mine else cs[j]
    last = [(i, *near(v)) for i, v in kept]
    total = sum(d for _, d, _ in last)
    return in_order((i, j, d, sum(y for _, y, o in last if o == j), total, sha(",".join(map(str, cs[j])))) for i, d, j in last)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("own") for c in ("v", "owner", "distance", "before", "cluster")}).repartition(3)


def test_clusters_of_odd_vectors(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(0, 1, 64) + (i % 5)]) for i in range(120)]
    rows += [(i, rows[3][1]) for i in range(200, 260)] + rows[:9] + [(None, rows[5][1]), (None, rows[6][1])]  # copies, repeated rows, null ids
    rows += [(300, None), (301, []), (302, [0.0] * 63), (303, [float("nan")] * 64), (304, [float("inf")] + [0.0] * 63), (305, [None] + [0.0] * 63), (306, [1e30, -1e30] * 32)]
    got = centroids.cluster_digests(vectors(spark, rows)).collect()
    assert in_order(got) == lloyd(rows)


def test_ties_go_to_the_smaller_number(spark):
    rows = [(i, [float(i % 2)] * 64) for i in range(40)]
    assert in_order(centroids.cluster_digests(vectors(spark, rows)).collect()) == lloyd(rows)


def test_few_vectors_and_none(spark):
    rows = [(1, [0.5] * 64), (2, [-0.5] * 64)]
    assert in_order(centroids.cluster_digests(vectors(spark, rows)).collect()) == lloyd(rows)
    assert centroids.cluster_digests(vectors(spark, [])).collect() == []
    assert centroids.cluster_digests(vectors(spark, [(1, None)])).collect() == []


def test_delta_rounds_equal_whole_ones():
    rng = np.random.default_rng(1)
    v, cs = rng.integers(-50, 50, (500, 8)), rng.integers(-50, 50, (9, 8))
    owner, distance = centroids.reassign(v, np.full(500, -1), np.zeros(500, np.int64), cs, np.ones(9, bool))
    for _ in range(20):
        changed = rng.random(9) < 0.4
        cs = np.where(changed[:, None], cs + rng.integers(-3, 4, cs.shape), cs)
        owner, distance = centroids.reassign(v, owner, distance, cs, changed)
        whole = ((v[:, None] - cs[None]) ** 2).sum(2)
        assert (owner == whole.argmin(1)).all() and (distance == whole.min(1)).all()
    big = np.array([[1 << 26, -(1 << 26)] * 32])
    assert centroids.distances(big, -big)[0, 0] == 64 << 54


@needs_tables
def test_clusters_of_the_table(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    assert in_order(centroids.cluster_digests(df).collect()) == lloyd([(r["vec_id"], r["embedding"]) for r in df.collect()])

"""Runs that cost their own size, and look-ups that read their own buckets."""

from __future__ import annotations

import random
import time
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from factloom.operators.session import Session
from factloom.plans import fold as folds
from factloom.plans import schema as S
from factloom.plans.buckets import edge_store, node_store
from factloom.plans.lineage import cut_lineage
from factloom.plans.states import rendered, states, united
from factloom.streaming.ingest import StreamingFold

T0 = datetime(2023, 1, 25, 8, tzinfo=UTC)
HASH = "a" * 64
SEQ = "struct<run:int,rank:int,row:long>"


def process_rows(run, n, rng):
    return [(HASH, f"d{run}", T0, f"h{rng.randrange(4)}", rng.randrange(30), T0 + timedelta(days=rng.randrange(2)) if rng.random() < 0.8 else None, rng.choice(["a", "b", None]), rng.choice([None, "x", "y"]), rng.choice([["p"], ["q", "p"], None]), (run, 0, i)) for i in range(n)]


PROCESS = f"evidence_hash string, derivation string, observed_at timestamp, host_hostname string, pid long, start_time timestamp, name string, image_path string, observed_by array<string>, seq {SEQ}"
REGISTRY = f"evidence_hash string, derivation string, observed_at timestamp, host_hostname string, hive_name string, key_path string, value_name string, value_str string, last_write_time timestamp, seq {SEQ}"


def registry_rows(run, n, rng):
    return [(HASH, f"d{run}", T0, "h", "SYSTEM", f"k{rng.randrange(25)}", None, rng.choice([None, "1", "2"]), T0 + timedelta(days=rng.randrange(5)) if rng.random() < 0.7 else None, (run, 0, i)) for i in range(n)]


@pytest.mark.parametrize(("spec", "ddl", "make", "slack"), [(S.PROCESS, PROCESS, process_rows, 0.5), (S.REGISTRY, REGISTRY, registry_rows, 100)])
def test_ten_runs_equal_one_fold(spark, spec, ddl, make, slack):
    rng = random.Random(1)
    store, all_ = node_store(spark, spec, buckets=3, fanout=3, slack=slack), []
    for run in range(10):
        rows = make(run, rng.choice([3, 12, 40]), rng)
        known = len({tuple(r[3:7]) if spec is S.REGISTRY else r[3:6] for r in all_})
        all_ += rows
        added, merged = store.add(spark.createDataFrame(rows, ddl), run)
        now = len({tuple(r[3:7]) if spec is S.REGISTRY else r[3:6] for r in all_})
        assert (added, merged) == (now - known, len(rows) - (now - known)) and store.added == now
    want = folds.fold(spark.createDataFrame(all_, ddl), spec)
    columns = want.columns
    as_rows = lambda df: sorted(map(repr, df.select(*columns).collect()))
    assert as_rows(store.rows()) == as_rows(want)
    assert len(store.later) < 6 and (slack < 1 or any(x.level for x in store.later))
    store.vacuum()
    assert as_rows(store.rows()) == as_rows(want)


def test_a_small_run_writes_its_own_size(spark):
    def obs(run, ids):
        return ids.select(F.lit(HASH).alias("evidence_hash"), F.lit("d").alias("derivation"), F.lit(T0).alias("observed_at"), F.concat(F.lit("S-1-5-"), "id").alias("sid"), F.concat(F.lit("u"), "id").alias("username"), F.struct(F.lit(run).alias("run"), F.lit(0).alias("rank"), F.col("id").alias("row")).alias("seq"))

    store = node_store(spark, S.USER, buckets=8)
    assert store.add(obs(0, spark.range(5000)), 0) == (5000, 0)
    before = store.rows_written
    for run in range(1, 11):
        assert store.add(obs(run, spark.range(run * 10, run * 10 + 50)), run) == (0, 50)
    assert store.rows_written - before <= 3 * 500 and store.rows().count() == 5000
    assert store.rows().agg(F.sum("n_observations")).first()[0] == 5500


def test_edges_of_runs(spark):
    rng, ddl = random.Random(2), f"src_key string, dst_key string, edge_type string, ts timestamp, confirmed_by array<string>, state string, seq {SEQ}"
    store, all_ = edge_store(spark, buckets=4, fanout=2), []
    for run in range(6):
        rows = [(f"n{rng.randrange(9)}", f"n{rng.randrange(9)}", "Connected", rng.choice([T0, None]), [rng.choice("xyz")], rng.choice("ab"), (run, 0, i)) for i in range(25)]
        all_ += rows
        store.add(spark.createDataFrame(rows, ddl), run)
    want = folds.fold_edges(spark.createDataFrame(all_, ddl))
    as_rows = lambda df: sorted(map(repr, df.select(*want.columns).collect()))
    assert as_rows(store.rows()) == as_rows(want) and store.added == want.count()
    assert as_rows(store.lookup(["n3", "n4", "nothing"])) == as_rows(want.where("src_key in ('n3', 'n4')"))


def files_read(df):
    """Files that the scans of a plan have chosen."""
    total, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
            continue
        metrics = node.metrics()
        if metrics.contains("numFiles"):
            total += metrics.apply("numFiles").value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
        if hasattr(node, "plan") and node.nodeName().startswith(("ShuffleQueryStage", "ResultQueryStage", "BroadcastQueryStage")):
            todo.append(node.plan())
    return total


def test_lookups_read_their_buckets(spark):
    ids = spark.range(20000)
    obs = ids.select(F.lit(HASH).alias("evidence_hash"), F.lit("d").alias("derivation"), F.lit(T0).alias("observed_at"), F.concat(F.lit("S-1-5-"), "id").alias("sid"), F.struct(F.lit(0).alias("run"), F.lit(0).alias("rank"), F.col("id").alias("row")).alias("seq"))
    store = node_store(spark, S.USER)
    store.add(obs, 0)
    keys = [r["node_key"] for r in S.USER.keyed(obs).where("seq.row in (5, 77, 19999)").select("node_key").collect()]
    found = store.lookup([*keys, '{"t":"User","k0":"none"}'])
    assert sorted(r["sid"] for r in found.collect()) == ["S-1-5-19999", "S-1-5-5", "S-1-5-77"]
    whole = store.rows()
    whole.collect()
    assert 0 < files_read(found) <= 8 < files_read(whole)
    many = S.USER.keyed(obs).where("seq.row % 100 = 0").select("node_key")
    assert store.lookup_table(many.unionAll(many)).count() == 200 and store.lookup([]) is None


def test_session_totals_are_those_of_a_count(spark, tmp_path):
    session, rng = Session(spark, tmp_path / "store"), random.Random(3)
    ddl = PROCESS.replace(SEQ, "long")
    for run in range(4):
        rows = [(*r[:9], r[9][2]) for r in process_rows(run, 20, rng)]
        rows = [(*r[:6], r[6] or "n", *r[7:]) for r in rows]
        session.add_observations("Process", spark.createDataFrame(rows, ddl))
        ends = [r["node_key"] for r in session.graph.by_type["Process"].select("node_key").orderBy("node_key").limit(4).collect()]
        session.add_edges(spark.createDataFrame([(a, b, "Spawned", None, ["s"], HASH, "d", i) for i, (a, b) in enumerate(zip(ends, ends[1:], strict=False))], "src_key string, dst_key string, edge_type string, ts timestamp, confirmed_by array<string>, evidence_hash string, derivation string, seq long"))
        session.runs.append(None)
        assert session.totals() == session.graph.counts()
    key = session.graph.by_type["Process"].first()["node_key"]
    assert session.graph.has_node(key) and not session.graph.has_node("x") and session.graph.get_node(key)["node_key"] == key
    out = {r["dst_key"] for r in session.graph.edges.where(F.col("src_key") == ends[0]).collect()}
    assert {r["dst_key"] for r in session.graph.outgoing_edges(ends[0]).collect()} == out
    session.vacuum()
    assert session.totals() == session.graph.counts()


FILE = "evidence_hash string, derivation string, observed_at timestamp, host_hostname string, full_path string, sha256 string, size_bytes long, mtime timestamp, is_deleted boolean, referenced_by array<string>, seq long"


def test_states_unite_in_any_order(spark):
    rng = random.Random(4)
    rows = [(HASH, f"d{i}", T0, "h", f"C:\\f{rng.randrange(8)}", None, rng.choice([None, 1, 2]), rng.choice([None, T0, T0 + timedelta(days=1)]), rng.choice([None, True, False]), rng.choice([None, ["a"], ["b", "a"], ["c"]]), i) for i in range(80)]
    parts = [rows[i::4] for i in (2, 0, 3, 1)]
    made = [states(spark.createDataFrame(p, FILE), S.FILE) for p in parts]
    together = united(united(made[0].unionByName(made[1]), S.FILE).unionByName(united(made[2].unionByName(made[3]), S.FILE)), S.FILE)
    columns = ["node_key", "full_path", "size_bytes", "mtime", "is_deleted", "referenced_by", "first_seq", "n_observations", "derivation", "conflicts"]
    as_rows = lambda df: sorted(map(repr, df.select(*columns).collect()))
    assert as_rows(rendered(together, S.FILE)) == as_rows(folds.fold(spark.createDataFrame(rows, FILE), S.FILE))


def test_a_batch_costs_its_own_size_and_can_run_again(spark, tmp_path):
    def batch(ids, n):
        return ids.select(F.lit(HASH).alias("evidence_hash"), F.lit("d").alias("derivation"), F.lit(T0).alias("observed_at"), F.concat(F.lit("S-1-5-"), "id").alias("sid"), F.lit(f"u{n}").alias("username"), (F.col("id") + n * 10_000).alias("seq"))

    fold = StreamingFold(spark, str(tmp_path / "out"), S.USER, buckets=8)
    fold.apply(batch(spark.range(3000), 0), 0)
    sizes = []
    for n in range(1, 13):
        before = sum(p.stat().st_size for p in (tmp_path / "out/rows").rglob("*.parquet"))
        fold.apply(batch(spark.range(n, n + 20), n), n)
        sizes.append(sum(p.stat().st_size for p in (tmp_path / "out/rows").rglob("*.parquet")) - before)
    assert sizes[11] <= 1.2 * sizes[1] and sum(sizes) <= 2.5 * 12 * sizes[1]
    fold.apply(batch(spark.range(12, 32), 12), 12)  # again, as after a failure
    got = fold.canonical()
    assert got.count() == 3000 and got.agg(F.sum("n_observations")).first()[0] == 3000 + 12 * 20 and got.where("username <> 'u0'").count() == 0


def test_logs_are_folded_in_order_of_arrival(spark, tmp_path):
    ddl, rng = PROCESS.replace(SEQ, "long"), random.Random(6)
    fold, all_ = StreamingFold(spark, str(tmp_path / "out"), S.PROCESS, buckets=4), []
    for n in range(3):
        rows = [(*r[:9], r[9][2]) for r in process_rows(n, 25, rng)]
        fold.apply(spark.createDataFrame(rows, ddl), n)
        all_ += [(*r[:9], (n, 0, r[9])) for r in rows]
    want = folds.fold(spark.createDataFrame(all_, PROCESS), S.PROCESS).drop("first_seq")
    as_rows = lambda df: sorted(map(repr, df.select(*want.columns).collect()))
    assert as_rows(fold.canonical()) == as_rows(want)


def test_runs_that_nobody_reads_cost_no_fold(spark):
    rng, folds_made = random.Random(7), []
    store = node_store(spark, S.PROCESS, buckets=3)
    fold_in = store.fold_in
    store.fold_in = lambda base, later: folds_made.append(1) or fold_in(base, later)
    for run in range(5):
        store.add(spark.createDataFrame(process_rows(run, 30, rng), PROCESS), run)
    keys = store.keys(store.known_buckets()).distinct()
    assert not folds_made and store.rows_written == 150 and store.added == keys.count()
    some = keys.orderBy("node_key").limit(4)
    asked = store.lookup_table(some.unionAll(some.select(F.concat("node_key", F.lit("?")).alias("node_key"))))
    assert asked.count() == 4 and len(folds_made) == 1 and not store.base  # what is asked for is folded, not all that is known
    assert store.rows().count() == store.added and len(store.base) == 3


def test_steps_leave_no_shuffle_files(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: {f for f in disk.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in f}
    before, setting = shuffled(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(setting, None)
    step = cut_lineage(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.sum("id").alias("n")))
    assert spark.conf.get(setting, None) == was
    for _ in range(50):  # files are deleted in the background
        if not (left := shuffled() - before):
            break
        time.sleep(0.2)
    assert not left
    assert dict(map(tuple, step.collect())) == {k: sum(range(k, 1000, 7)) for k in range(7)}


def test_long_rows_are_written_in_small_pages(spark):
    """Rows of 400 KB: a row group ends when it is full, not after a hundred rows."""
    import pyarrow.parquet as pq

    rows = spark.range(0, 60, 1, 1).select("id", F.transform(F.sequence(F.lit(1), F.lit(50_000)), lambda x: F.xxhash64(x, "id")).alias("a"))
    step = cut_lineage(rows, long_rows=True)
    (path,) = (p.removeprefix("file://") for p in step.inputFiles())
    file = pq.ParquetFile(path).metadata
    groups = [file.row_group(i) for i in range(file.num_row_groups)]
    assert max(g.column(1).total_uncompressed_size for g in groups) < 20 << 20
    assert sum(g.total_byte_size for g in groups) > 20 << 20
    assert step.select(F.sum("id"), F.sum(F.size("a"))).first() == (sum(range(60)), 60 * 50_000)

"""Binary logs record by record and in byte ranges; the store that executors fill."""

from __future__ import annotations

import hashlib
import random
import struct
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from factloom.operators.session import Session
from factloom.sources import binxml, events
from factloom.sources.eventlog import BINARY_XML, read_binary_log
from factloom.sources.vault import Vault, VaultWriter

NAMES = ["Threat Name", "Action Name", "Path"]
T0 = datetime(2023, 1, 25, 8, tzinfo=UTC)


def rows(n):
    return [{"number": i, "event_id": 1116 if i % 3 else 1000, "time": T0 + timedelta(seconds=i, microseconds=i), "computer": f"host{i % 9}", "Threat Name": f"T<{i % 5}> & \"é\U0001f600\"", "Action Name": None if i % 4 else "Quarantined", "Path": "file:_C:\\x" * (i % 7)} for i in range(1, n + 1)]


def log_file(records):
    chunks = list(binxml.encode_events(records, NAMES))
    return binxml.file_header(len(chunks), len(records) + 1) + b"".join(chunks), chunks


def test_records_come_back():
    _, chunks = log_file(rows(700))
    assert len(chunks) > 1 and all(len(c) == binxml.CHUNK_SIZE for c in chunks)
    texts = [t for c in chunks for t in binxml.decode(c)]
    assert len(texts) == 700 and all(f"<EventRecordID>{i}</EventRecordID>" in t for i, t in enumerate(texts, 1))
    assert 'SystemTime="2023-01-25T08:00:01.000001+00:00"' in texts[0] and '<Data Name="Threat Name">T&lt;1&gt; &amp; &quot;é\U0001f600&quot;</Data>' in texts[0] and '<Data Name="Action Name"/>' in texts[0]


@pytest.mark.parametrize(("kind", "raw", "text"), [
    (binxml.INT8, b"\xff", "-1"), (binxml.UINT64, b"\xff" * 8, str(2**64 - 1)), (binxml.BOOL, b"\1\0\0\0", "true"), (binxml.BINARY, b"\x0a\xff", "0AFF"), (binxml.GUID, bytes(range(16)), "{03020100-0504-0706-0809-0A0B0C0D0E0F}"), (binxml.HEX32, b"\x10\0\0\0", "0x10"),
    (binxml.FILETIME, struct.pack("<Q", binxml.ticks_of(T0)), "2023-01-25T08:00:00.000000+00:00"), (binxml.SYSTEMTIME, struct.pack("<8H", 2023, 1, 3, 25, 8, 0, 0, 5), "2023-01-25T08:00:00.005000+00:00"), (binxml.SID, b"\1\2\0\0\0\0\0\5" + struct.pack("<2I", 32, 544), "S-1-5-32-544"),
    (binxml.ANSI, b"caf\xe9\0", "café"), (binxml.STRING, "x\0".encode("utf-16-le"), "x"), (binxml.NULL, b"", None), (binxml.UINT16, b"", None), (binxml.REAL64, struct.pack("<d", 0.5), "0.5"),
])
def test_values(kind, raw, text):
    assert binxml.value_text(kind, raw) == text


def test_arrays_repeat_their_element_and_fragments_nest():
    assert binxml.array_texts(binxml.STRING, "a\0b\0".encode("utf-16-le")) == ["a", "b"] and binxml.array_texts(binxml.UINT16, b"\1\0\2\0") == ["1", "2"]
    assert binxml.xml_text([binxml.Element("Data", [("Name", ["n"])], [["a", "<b>"]])]) == '<Data Name="n">a</Data><Data Name="n">&lt;b&gt;</Data>'
    inner = binxml.Element("Inner", [("Gone", [None])], ["x"])
    assert binxml.xml_text([binxml.filled(binxml.Element("Outer", [], [binxml.Gap(0, True)]), [[inner]])]) == "<Outer><Inner>x</Inner></Outer>"


def test_damage_costs_the_records_that_it_meets():
    _, (chunk, *_) = log_file(rows(100))
    whole = list(binxml.decode(chunk))
    rng = random.Random(5)
    starts = [i for i in range(512, len(chunk)) if chunk[i : i + 4] == binxml.RECORD_MAGIC]
    for _ in range(200):
        bad = bytearray(chunk)
        n = rng.randrange(1, len(starts))  # not the first, which holds the template and the names
        at = rng.randrange(starts[n], starts[n + 1] if n + 1 < len(starts) else starts[n] + 200)
        bad[at : at + 4] = rng.randbytes(4)
        got = list(binxml.decode(bytes(bad)))
        assert sum(g == w for g, w in zip(got[:n], whole[:n], strict=False)) == n and len(set(whole[:n] + whole[n + 1 :]) - set(got)) <= 1
    for _ in range(100):  # anything may stand there, and nothing fails
        bad = bytearray(chunk)
        for _ in range(30):
            at = rng.randrange(len(bad))
            bad[at : at + 8] = rng.randbytes(8)
        list(binxml.decode(bytes(bad[: rng.randrange(len(bad))])))
    assert list(binxml.decode(b"")) == [] and list(binxml.decode(bytes(65536))) == [] and list(binxml.decode(b"x" * 100)) == [""]
    broken = bytearray(chunk)
    broken[starts[50] + 4 : starts[50] + 8] = b"\xff" * 4  # a size that cannot be: the next record is found
    assert list(binxml.decode(bytes(broken))) == [*whole[:50], "", *whole[51:]]


@pytest.mark.parametrize("chunks", [1, 3, 256])
def test_byte_ranges_equal_one_pass(spark, tmp_path, chunks):
    records = rows(1500)
    for r in records[::100]:
        r["ticks"] = (1 << 63) - 1
    data, _ = log_file(records)
    (tmp_path / "a.evtx").write_bytes(data)
    got = read_binary_log(spark, str(tmp_path), BINARY_XML, chunks=chunks)
    good = [r for i, r in enumerate(records) if i % 100]
    assert events.read_stats(got).first().asDict() == {"records_read": 1500, "records_yielded": 1485, "records_skipped_malformed": 15}
    want = sorted((r["number"], r["event_id"], r["computer"], r["Threat Name"], r["Action Name"] or "") for r in good)
    assert sorted(tuple(r) for r in got.where("valid").select("_record_id", "event_id", "computer", "threat_name", "action").collect()) == want


def test_a_session_reads_a_binary_log(spark, tmp_path):
    root = tmp_path / "in"
    root.mkdir()
    data, _ = log_file(rows(300))
    (root / "log.evtx").write_bytes(data)
    session = Session(spark, tmp_path / "store", root)
    got = session.ingest_artifact(str(root / "log.evtx"), "defender_evtx")
    assert (got["status"], got["records_read"], got["nodes_added"], got["skipped_event_count"]) == ("ok", 300, 200, 100)
    assert got["evidence_hash"] == hashlib.sha256(data).hexdigest()


# -- the store

def test_vault_keeps_one_copy_of_each_content(spark, tmp_path):
    texts = [(i, f"content {i % 40}" * (i % 40)) for i in range(200)] + [(500, None)]
    df = spark.createDataFrame(texts, "id long, body string").repartition(4)
    vault = Vault(spark, str(tmp_path / "vault"), pack_bytes=500)
    vault.store_table(df.where("id < 60"), content="body", path=F.concat(F.lit("a/doc"), "id"), order=F.col("id"))
    vault.store_table(df, content="body", path=F.concat(F.lit("b/doc"), "id"), order=F.col("id"))
    vault.store_table(df, content="body", path=F.lit("c"))  # nothing new: no job
    assert len(vault.jobs()) == 1 and vault.manifest().count() == 40 == len({t for _, t in texts if t is not None})
    want = {hashlib.sha256(t.encode()).hexdigest(): t for _, t in texts if t is not None}
    assert {r["evidence_hash"]: r["content"].decode() for r in vault.contents().collect()} == want
    assert {r["evidence_hash"]: r["original_name"] for r in vault.list_all().collect()} == {hashlib.sha256((f"content {i}" * i).encode()).hexdigest(): f"doc{i}" for i in range(40)}
    packs = list((tmp_path / "vault/jobs" / vault.jobs()[0] / "packs").iterdir())
    assert len(packs) > 4 and sum(p.stat().st_size for p in packs) == sum(len(t) for t in want.values())
    some = spark.createDataFrame([(h,) for h in list(want)[:3]] * 2, "evidence_hash string")
    assert {r["evidence_hash"] for r in vault.contents(some).collect()} == set(list(want)[:3])
    again = Vault(spark, str(tmp_path / "vault"))
    again.store_table(spark.createDataFrame([(1, "new"), (2, "new")], "id long, body string"), content="body", path=F.col("id"))
    assert len(again.jobs()) == 2 and again.manifest().count() == 41 and again.manifest().where("evidence_hash = sha2('new', 256)").first()["original_path"] == "1"


def test_vault_stores_files(spark, tmp_path):
    folder = tmp_path / "files"
    folder.mkdir()
    for i in range(12):
        (folder / f"{i:02d}.bin").write_bytes(bytes([i % 5]) * (1 << 16))
    paths = spark.createDataFrame([(str(p),) for p in sorted(folder.iterdir())], "path string").repartition(3)
    vault = Vault(spark, str(tmp_path / "vault"))
    found = vault.store_files(paths)
    assert found.count() == 12 and sorted(r["original_name"] for r in vault.list_all().collect()) == [f"{i:02d}.bin" for i in range(5)]
    assert {(r["evidence_hash"], len(r["content"])) for r in vault.contents().collect()} == {(r["evidence_hash"], 1 << 16) for r in found.collect()}
    with pytest.raises(Exception, match="none.bin"):
        vault.store_files(spark.createDataFrame([(str(folder / "none.bin"),)], "path string"))


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    vault = Vault(spark, str(tmp_path / "vault"))
    df = spark.range(100).select("id", F.concat(F.lit("text "), "id").alias("body")).repartition(4)
    bad = df.withColumn("evidence_hash", F.when(F.col("id") == 77, "0" * 64).otherwise(F.sha2(F.col("body").cast("binary"), 256)))
    with pytest.raises(Exception, match="changed while it was stored"):
        vault._write(bad.select("evidence_hash", F.concat(F.lit("d"), "id").alias("original_path"), F.col("body").cast("binary").alias("content")))
    assert vault.jobs() == [] and not any(p.is_file() for p in (tmp_path / "vault").rglob("*")) and vault.manifest().count() == 0


def test_what_is_not_committed_is_not_published(tmp_path):
    writer = VaultWriter({"path": str(tmp_path / "vault"), "job": "j"})
    import pyarrow as pa

    def batch(text):
        return pa.RecordBatch.from_pylist([{"evidence_hash": hashlib.sha256(text).hexdigest(), "original_path": "p", "original_name": "p", "content": text}])

    kept, _lost = writer.write(iter([batch(b"kept")])), writer.write(iter([batch(b"from an attempt that was given up")]))
    writer.commit([kept, None])
    files = [p for p in (tmp_path / "vault").rglob("*") if p.is_file()]
    assert {p.name for p in files} == {*kept.packs, *kept.parts} and not (tmp_path / "vault/_staging/j").exists()


def test_templates_are_written_without_filling_them_anew(monkeypatch):
    gap = lambda n: binxml.Gap(n, True)
    element = binxml.Element
    template = element("A", [("x", ["k", gap(0)]), ("y", [gap(1)])], [element("B", [], [gap(2)]), element("C", [], [element("D", [], [gap(3)]), element("E", [("n", ["1"])], [gap(3)])])])
    writer = binxml.ChunkWriter(1)
    string = lambda t: (binxml.STRING, t.encode("utf-16-le"))
    empty, none, many = (binxml.STRING | binxml.ARRAY, b""), (binxml.NULL, b""), (binxml.STRING | binxml.ARRAY, "p\0q\0".encode("utf-16-le"))
    cases = [[string("a&"), none, string("<"), string("v")], [none, string(""), many, empty], [none, none, string(""), many], []]
    for values in cases:
        assert writer.record(1, 5, template, values)
    want = [
        '<A x="ka&amp;"><B>&lt;</B><C><D>v</D><E n="1">v</E></C></A>', '<A x="k" y=""><B>p</B><B>q</B><C/></A>',
        '<A x="k"><B/><C><D>p</D><D>q</D><E n="1">p</E><E n="1">q</E></C></A>', '<A x="k"><B/><C><D/><E n="1"/></C></A>',
    ]
    assert list(binxml.decode(writer.bytes())) == want
    called, filled = [], binxml.filled
    monkeypatch.setattr(binxml, "filled", lambda part, values: called.append(part) if isinstance(part, element) else filled(part, values))
    rows = [{"number": i, "event_id": 1, "ticks": 10 * i, "computer": "c", "K": None if i % 2 else "v"} for i in range(50)]
    assert sum(len(list(binxml.decode(c))) for c in binxml.encode_events(rows, ["K"])) == 50 and not called

"""The pipeline: each stage on the smallest tables and on odd rows."""

from __future__ import annotations

import importlib.util
import os

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def pipeline():
    import corpus_pipeline

    return corpus_pipeline


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stages_keep_the_columns_and_clean_documents(spark, pipeline, tmp_path):
    docs = start = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for name, stage in pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = docs.count()
        if name != "packing":
            assert docs.columns == start.columns and docs.count() == docs.select("doc_id").distinct().count()
    assert kept["language_id"] > 0.97 * start.count() and kept["line_dedup"] == kept["language_id"] and kept["secret_scan"] == kept["near_dedup"]
    assert docs.select("doc_id").distinct().count() == kept["secret_scan"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_dedup_stages_match_brute_force(spark, pipeline):
    from factloom.llm import lines, neardup
    from factloom.plans.lineage import cut_lineage

    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(40)
    passage = "\n".join(" ".join(f"p{i}.{j}" for j in range(20)) for i in range(4))
    k = F.col("doc_id")
    copies = docs.limit(20).withColumns({"doc_id": k + 1_000_000, "text": F.concat("text", F.lit(" changed"))})
    tagged = cut_lineage(docs.withColumn("text", F.when(k % 4 == 0, F.concat("text", F.lit("\n" + passage))).otherwise(F.col("text"))).unionByName(copies))
    rows = [(r["doc_id"], r["text"]) for r in tagged.select("doc_id", "text").collect()]
    got = {r["doc_id"]: r["text"] for r in pipeline.drop_repeated_lines(spark, tagged, SF).collect()}
    want = lines.brute_force(rows)
    assert got == want and want != dict(rows)
    sets = {d: neardup.shingle_set(t) for d, t in rows}
    group = {d: d for d, _ in rows}
    for a, x in sets.items():
        for b, y in sets.items():
            if a < b and group[a] != group[b] and len(x & y) >= 0.8 * len(x | y):
                low, high = sorted((group[a], group[b]))
                group = {d: low if g == high else g for d, g in group.items()}
    kept = {r["doc_id"] for r in pipeline.drop_near_duplicates(spark, tagged, SF).collect()}
    assert kept == set(group.values()) and len(kept) < len(rows)


def test_stages_take_odd_and_empty_tables(spark, pipeline, odd, empty):
    for df in (odd, empty):
        for name, stage in pipeline.STAGES:
            out = stage(spark, df, "")
            assert out.count() >= 0 and (name == "packing" or out.columns == df.columns)
            if name != "packing" and df is odd:
                assert {r["_id"] for r in out.collect()} == {"own"}


def test_entry_works_with_the_pipeline(spark):
    import __spark_entry__ as entry

    assert importlib.util.find_spec("corpus_pipeline") is not None
    names = entry.queries()
    assert "pipeline" in names and all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11))
    assert F is not None

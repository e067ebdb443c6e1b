from __future__ import annotations

import pytest

ODD = [(1, ""), (1, ""), (2, None), (None, "one two"), (3, "x" * 70000), (4, "same words here again"), (5, "same words here again"), (5, "other text under the same id"), (6, "\n\n \t\n"), (7, "日本語 \U0001f600 é\x00")]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows and ids, and columns with names that operators use themselves."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ODD, "doc_id long, text string")
    extra = {"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.lit(0).cast("long"), "key": F.lit(1), "hash": F.lit("h"), "marks": F.lit(2), "score": F.lit(0.5), "bucket": F.lit("b")}
    own = ("_id", "_h", "__id", "__h", "_runs", "__runs", "n_lines", "__n_lines", "n_removed", "n_runs", "_spans", "__spans", "_kept_id", "_kept_key", "_key", "_stays", "_way", "_owner", "_repo", "_text", "_base", "_found", "_q", "first", "component", "class_id", "represents", "shard", "anchor", "_N_Lines")
    extra |= {c: F.lit("own") for c in own}
    return df.withColumns(extra).repartition(3)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)

"""Toxicity: the decoder against all readings, the counts against a loop, disguises that the channel was not written from, held-out labels."""

from __future__ import annotations

import itertools
import os
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import toxicity
from factloom.llm.queries import op13_toxicity

SF = "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
N = toxicity.SYMBOLS


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="module")
def prices(docs):
    return toxicity.language_model(docs)


@pytest.fixture(scope="module")
def scorer(docs, labels, prices):
    return toxicity.train(docs, labels, prices)


def price(words, prices):
    total = 0.0
    for w in words:
        codes = [0, 0, 0, *map(toxicity.symbol, w), 0]
        total += sum(float(prices[((a * N + b) * N + c) * N + d]) for a, b, c, d in zip(codes, codes[1:], codes[2:], codes[3:], strict=False))
    return total


def test_decoder_finds_the_cheapest_of_all_readings():
    rng = np.random.default_rng(0)
    prices = rng.gamma(2.0, 1.0, N**4).astype(np.float32)
    reader = toxicity.Reader.of(prices)
    seen = random.Random(0)
    for _ in range(150):
        token = "".join(seen.choice(["a", "b", "cc", "ddd", "1", "0", "@", "-", ".", "é", "x*y", "$$"]) for _ in range(seen.randrange(1, 6)))
        best = None
        for way in itertools.product(*toxicity.lattice(token)):
            written = "".join(" " if meant == "" else "".join(meant or "") for meant, _ in way)
            cost = sum(c for _, c in way) + price(written.split(), prices)
            best = cost if best is None else min(best, cost)
        got = toxicity.decoded(toxicity.lattice(token), reader.prices)
        ways = [sum(c for _, c in way) for way in itertools.product(*toxicity.lattice(token)) if "".join(" " if m == "" else "".join(m or "") for m, _ in way).split() == list(got)]
        assert ways and abs(min(ways) + price(got, prices) - best) < 1e-3


def test_counts_are_those_of_a_loop(spark):
    texts = ["The cat, the CAT. café ß", None, "", "a1b x-y zz naïve 日本", "the the"]
    words = Counter(w for t in texts for w in (x.strip(toxicity._EDGES) for x in toxicity.folded(t or "").split()) if w.isalpha())
    want = Counter()
    for w, n in words.items():
        codes = [0, 0, 0, *map(toxicity.symbol, w), 0]
        for a, b, c, d in zip(codes, codes[1:], codes[2:], codes[3:], strict=False):
            want[((a * N + b) * N + c) * N + d] += n
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    assert {r["gram"]: r["n"] for r in toxicity.counted_grams(df).collect()} == want


@needs_tables
def test_plain_words_stay(prices):
    reader = toxicity.Reader.of(prices)
    assert reader.words("This, that. (other) 2024 e.g. \n x") >= {"this", "that", "other", "x"}
    assert reader.restored("One two.\nThree") == "one two\nthree"
    assert reader.words("") == set() and reader.words("12 3 4 !!! ...") == set()


#: Ways to write a word, thought up apart from the channel's tables.
DISGUISES = [
    lambda w: w.upper() + "!!", lambda w: " ".join(w), lambda w: ".".join(w), lambda w: "-".join(w), lambda w: "_".join(w), lambda w: "  ".join(w.upper()),
    lambda w: w.replace("o", "0").replace("i", "1"), lambda w: w.replace("s", "$").replace("a", "@"), lambda w: w.replace("e", "3").replace("t", "7"), lambda w: "".join(c * 4 if c in "aiou" else c for c in w),
    lambda w: w[0] + "​" + w[1:], lambda w: w.replace("o", "о").replace("e", "е"), lambda w: "".join(chr(ord(c) + 0xFEE0) for c in w), lambda w: w.replace("o", "ö").replace("i", "í"), lambda w: f"***{w}***", lambda w: w[:2] + w[1] * 5 + w[2:], lambda w: w + w[-1] * 4, lambda w: f"so,{w},yes",
]


@needs_tables
def test_disguised_words_are_found_and_clean_texts_left(spark, docs, labels, prices, scorer):
    known = [w for w, x in scorer.weights.items() if x > 1]
    assert len(known) >= 8
    clean = [r["text"] for r in docs.join(labels.where("toxic = 0"), "doc_id").where("length(text) between 200 and 3000").orderBy("doc_id").limit(200).collect()]
    reader = toxicity.Reader.of(prices)
    flagged = [scorer.score(reader.words(t)) >= 0.3 for t in clean]
    assert sum(flagged) <= 0.05 * len(clean)
    clean = [t for t, f in zip(clean, flagged, strict=True) if not f]
    rng, missed, n = random.Random(3), [], 0
    for word in known:
        for k, way in enumerate(DISGUISES):
            words = rng.choice(clean).split(" ")
            words.insert(rng.randrange(1, len(words)), way(word))
            n += 1
            if scorer.score(reader.words(" ".join(words))) < 0.3:
                missed.append((word, k, way(word)))
    assert len(missed) <= 0.08 * n, missed


@needs_tables
def test_held_out_labels(spark, docs, labels):
    got = op13_toxicity(spark, SF)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.count() == docs.count()
    rows = got.join(labels, "doc_id").where("held_out and toxic = 1").count(), got.join(labels, "doc_id").where("held_out and toxic = 0").count()
    hits = got.join(labels, "doc_id").where("held_out and toxic = 1 and predicted = 1").count(), got.join(labels, "doc_id").where("held_out and toxic = 0 and predicted = 1").count()
    # One label in twenty is wrong: it marks texts without a toxic word.
    assert hits[0] >= 0.5 * rows[0] and hits[1] <= 0.06 * rows[1]
    assert {(r["doc_id"], r["held_out"]) for r in got.select("doc_id", "held_out").collect()} == {(r[0], zlib.crc32(str(r[0]).encode()) % 4 == 2) for r in docs.select("doc_id").collect()}


@needs_tables
def test_labels_of_the_held_out_fold_are_not_looked_at(docs, labels, prices, scorer):
    turned = labels.withColumn("toxic", F.when(toxicity.fold_of() == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.train(docs, turned, prices) == scorer


def test_stems_count_where_no_single_word_is_frequent(spark):
    rng = random.Random(5)
    part = lambda n: "".join(rng.choice("abdefgiklmnoprstu") for _ in range(n))
    common, ends = [part(rng.randrange(3, 9)) for _ in range(300)], [part(rng.randrange(2, 5)) for _ in range(400)]
    rows = []
    for i in range(600):
        words = rng.choices(common, k=30)
        bad = i % 10 == 0
        words[3:3] = [f"zorbl{rng.choice(ends)}"] if bad else [f"zo{rng.choice(ends)}"]
        rows.append((i, " ".join(words), int(bad)))
    rows = [(i, t, 1 - y if i in (7, 77) else y) for i, t, y in rows]  # two wrong labels
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    prices = toxicity.language_model(table)
    scorer = toxicity.train(table, table.select("doc_id", "toxic"), prices)
    assert list(scorer.stems) == ["zorbl"]
    got = {r["doc_id"]: r["predicted"] for r in toxicity.scores(table, prices, scorer).collect()}
    assert got == {i: int(i % 10 == 0) for i in range(600)}
    assert scorer.score({"zorblunseen"}) > 0.3 > scorer.score({"zorb", "zorunseen"})


def test_odd_tables(spark, odd, empty):
    prices = toxicity.language_model(odd)
    labels = spark.createDataFrame([(1, 1), (4, 0), (4, 1), (5, None), (None, 1), (6, 7)], "doc_id long, toxic int")
    for few in (labels, labels.limit(0)):
        scorer = toxicity.train(odd, few, prices)
        rows = toxicity.scores(odd, prices, scorer).collect()
        assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    assert toxicity.scores(empty, toxicity.language_model(empty), toxicity.train(empty, labels, prices)).collect() == []
    kept = toxicity.without_toxic(odd, prices, toxicity.Scorer({"same": 5.0}, 0.01))
    assert kept.columns == odd.columns and kept.count() == odd.where("text not like '%same%' or text is null").count()
    assert toxicity.restored_texts(odd, prices).count() == odd.count()

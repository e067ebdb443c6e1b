"""Near-duplicate documents by DartMinHash signatures, banded joins and exact checks.

A document is its set of five-word shingles. Each shingle owns a region as large as its weight;
darts fall into regions at ranks given by hashes (a Poisson process along the rank axis), each
dart is hashed to one of K coordinates, and a coordinate keeps its earliest dart. Two documents
agree in a coordinate with the probability of their (weighted) Jaccard similarity. Only darts
before a rank of about K (ln K + 3) / total weight are ever thrown, so the cost hardly depends
on K.

Weights are 1 (sets of shingles) or, with weighted, how often a shingle stands in the text; then the
similarity is the sum of the smaller weights over that of the larger ones.

Equal texts are joined first, so that copies are never compared. Distinct texts whose bands agree
meet in buckets. Never are all pairs of a bucket compared, unless it is small: each text first meets
the bucket's hubs (the text with most company over all its buckets, and the smallest) and
its neighbours in an order in which texts that agree in the next band as well stand together.
Each comparison is an exact similarity of whole texts. Classes are the connected components of the
links. Hubs and neighbours only make this cheap; what they leave open is settled exactly:

Texts of a large bucket that are still in different components are joined by prefixes. Of two sets
with a Jaccard similarity of at least s, in any one order of all elements, the smaller one x has an
element of the other among its first |x| - ceil(2 s |x| / (1 + s)) + 1, and the larger one y among
its first |y| - ceil(s |y|) + 1. Rare shingles go first: texts of a family that share a core, but
too little of it, then bring no pair together. Every similar pair that shares a bucket is thereby
in one class, whatever the number of partitions, and however large the bucket.

A text of one to four words is one shingle. Null and empty texts are equal texts of no shingles.
Rows with equal ids are kept apart by their texts; a null id sorts before all others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import attach, cut_lineage, fresh, slices, texts_of
from .components import components

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 32, 5
#: In a bucket of at most so many texts all are compared with each other.
SMALL_BUCKET = 8
#: Counters that tell rare shingles from frequent ones; they only choose an order.
RARITY_BINS = 1 << 18
_MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(texts: list[str], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' shingles end to end, repeats included, and how many each text has."""
    all_: list[str] = []
    counts = []
    for t in texts:
        found = t.split()
        counts.append(len(found))
        all_ += found
    table = {w: i for i, w in enumerate(set(all_))}
    own = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in table), np.uint64, len(table))
    n = np.array(counts, np.int64)
    if not all_:
        return np.zeros(0, np.uint64), n
    h = own[np.fromiter(map(table.__getitem__, all_), np.int64, len(all_))]
    padded = np.concatenate([h, np.zeros(words, np.uint64)])
    acc = np.full(len(h), np.uint64(words))
    first = np.cumsum(n) - n
    end = np.repeat(first + n, n)
    at = np.arange(len(h))
    for k in range(words):
        inside = at + k < end  # a short text's only shingle ends early
        acc = np.where(inside, mixed((acc + _MIX) ^ padded[k : k + len(h)]), acc)
    size = np.where(n == 0, 0, np.maximum(1, n - words + 1))
    keep = at < np.repeat(first + size, n)
    return acc[keep], size


def signatures(hashes: np.ndarray, counts: np.ndarray, coordinates: int, weights: np.ndarray | None = None) -> np.ndarray:
    """The earliest dart of each coordinate, by document: (document, coordinate) 64-bit dart names.

    hashes: elements, document by document; an element may repeat. weights: how large each
    element's region is (1 if not given). Documents without elements have zeros.
    """
    docs = np.repeat(np.arange(len(counts)), counts)
    if weights is not None:  # whole units are regions of their own; a dart in the last must fall within its part
        units = np.maximum(1, np.ceil(weights)).astype(np.int64)
        of = np.repeat(np.arange(len(hashes)), units)
        unit = np.arange(len(of)) - np.repeat(np.cumsum(units) - units, units)
        part = np.minimum(1.0, weights[of] - unit)
        hashes, docs = mixed(hashes[of] + _MIX * (unit + 1).astype(np.uint64)), docs[of]
        total = np.bincount(docs, part, len(counts))
    else:
        part, total = None, counts.astype(float)
    name = np.zeros((len(counts), coordinates), np.uint64)
    best = np.full((len(counts), coordinates), np.inf)
    limit = coordinates * (np.log(coordinates) + 3) / np.maximum(total, 1e-9)
    open_ = np.flatnonzero(total > 0)
    state, mine, share = mixed(hashes + _MIX), docs, part
    while len(open_):
        live, rank, seed, inside = mine, np.zeros(len(mine)), state, share
        while len(live):
            seed = mixed(seed + _MIX)
            u = ((seed >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
            rank = rank - np.log(u)
            go = rank < limit[live]
            if not go.all():
                live, rank, seed = live[go], rank[go], seed[go]
                inside = None if inside is None else inside[go]
            dart = mixed(seed ^ np.uint64(0xD1B54A32D192ED03))
            lane = ((dart >> np.uint64(32)) % np.uint64(coordinates)).astype(np.int64)
            d, r, g, c = live, rank, dart, lane
            if inside is not None:
                hit = ((dart & np.uint64(0xFFFFFFFF)).astype(np.float64) + 0.5) * 2.0**-32 < inside
                d, r, g, c = d[hit], r[hit], g[hit], c[hit]
            cell = d * coordinates + c
            np.minimum.at(best.ravel(), cell, r)
            won = best.ravel()[cell] == r
            name.ravel()[cell[won]] = g[won]
        open_ = open_[np.isinf(best[open_]).any(1)]
        if len(open_):  # a coordinate without a dart: throw on from the start, twice as far
            limit[open_] *= 2
            again = np.isin(docs, open_)
            state, mine = mixed(hashes[again] + _MIX), docs[again]
            share = None if part is None else part[again]
            best[open_], name[open_] = np.inf, 0
    return name


def band_hashes(names: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """(document, band): each band's coordinates and its number in one hash."""
    acc = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(names), bands)).copy()
    for k in range(rows):
        acc = mixed((acc + _MIX) ^ names[:, k : bands * rows : rows])
    return acc


def elements(texts: list[str], weighted: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Hashes of each text's shingles end to end, how many each text has, and their weights (then each shingle once)."""
    hashes, counts = shingle_hashes(texts)
    if not weighted:
        return hashes, counts, None
    parts = [np.unique(own, return_counts=True) for own in np.split(hashes, np.cumsum(counts)[:-1])] if len(counts) else []
    weights = np.concatenate([p[1] for p in parts]).astype(float) if parts else np.zeros(0)
    return np.concatenate([p[0] for p in parts] or [hashes]), np.array([len(p[0]) for p in parts], np.int64), weights


def unit_hashes(own: np.ndarray, weighted: bool) -> np.ndarray:
    """A text's elements as a set: its shingles or, weighted, each occurrence of a shingle by its number."""
    if not weighted:
        return np.unique(own)
    values, times = np.unique(own, return_counts=True)
    number = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    return np.unique(mixed(np.repeat(values, times) + _MIX * (number + 1).astype(np.uint64)))


def text_key(text: str = "text") -> Column:
    return F.unhex(F.md5(F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")))


def with_bands(texts: DataFrame, bands: int, rows: int, weighted: bool = False) -> DataFrame:
    """(key, _id, bands) for (key, _id, text): what the bucket join needs. Texts without words have no
    bands, and of equal texts in a task only the first is signed: the others have null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for part in slices(batches, limit=1 << 20):
            keys = part.column(0).to_pylist()
            new = [k for k, key in enumerate(keys) if not (key in seen or seen.add(key))]
            hashes, counts, weights = elements(texts_of(part.take(pa.array(new, pa.int64()))), weighted)
            found = band_hashes(signatures(hashes, counts, bands * rows, weights), bands, rows).astype(np.int64)
            size = np.zeros(len(keys), np.int64)
            size[new] = np.where(counts > 0, bands, 0)
            mask = np.ones(len(keys), bool)
            mask[new] = False
            at = np.concatenate([[0], np.cumsum(size)])
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(found[counts > 0].ravel()), mask=pa.array(mask))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists], names=["key", "_id", "bands"])

    return texts.select("key", "_id", "text").mapInArrow(run, "key binary, _id long, bands array<long>")


def shingle_set(text: str, words: int = WORDS) -> set[tuple[str, ...]]:
    w = text.split()
    return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def shingle_bag(text: str, words: int = WORDS) -> set[tuple]:
    """Each occurrence of a shingle, with its number."""
    w = text.split()
    times: dict[tuple[str, ...], int] = {}
    out = set()
    for i in range(max(1, len(w) - words + 1)) if w else ():
        x = tuple(w[i : i + words])
        times[x] = times.get(x, 0) + 1
        out.add((x, times[x]))
    return out


def similar(pairs: DataFrame, texts: DataFrame, least: float, weighted: bool = False) -> DataFrame:
    """The pairs (a, b) whose texts' shingle sets (or bags) have a Jaccard similarity of at least `least`."""
    shingles = shingle_bag if weighted else shingle_set

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, set()
        for part in slices(batches, text="text_b"):
            b, a = part.column(1).to_pylist(), part.column(0).to_pylist()
            good = []
            for key, x, y in zip(b, part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                if key != last:
                    last, held = key, shingles(y)
                other = shingles(x)
                common = len(other & held)
                good.append(common >= least * (len(other) + len(held) - common) - 1e-9)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    one = pairs.join(texts.select(F.col("key").alias("a"), F.col("text").alias("text_a")), "a")
    two = one.join(texts.select(F.col("key").alias("b"), F.col("text").alias("text_b")), "b")
    return two.select("a", "b", "text_a", "text_b").mapInArrow(run, "a binary, b binary")


def candidates(members: DataFrame) -> DataFrame:
    """Distinct pairs (a, b), a < b, to be compared first, from members (bucket, key, company).

    Per bucket: every text with two hubs (most company, and smallest); all pairs if there are
    at most SMALL_BUCKET texts. Across a bucket: neighbours in the order of another hash of the
    bucket's texts, in a range-partitioned sort, so that a hot bucket spreads over tasks.
    """
    low, main = F.min("key"), F.max(F.struct("company", "key"))["key"]
    hubs = members.groupBy("bucket").agg(F.count("*").alias("n"), F.array_distinct(F.array(main, low)).alias("hubs")).where("n > 1")
    with_hubs = members.join(cut_lineage(hubs, "hubs"), "bucket")
    starred = with_hubs.select(F.col("key").alias("x"), F.explode(F.filter("hubs", lambda h: h != F.col("key"))).alias("y"))
    small = with_hubs.where((F.col("n") > 2) & (F.col("n") <= SMALL_BUCKET)).groupBy("bucket").agg(F.array_sort(F.collect_list("key")).alias("keys"))
    pairs = F.flatten(F.transform("keys", lambda x, i: F.transform(F.slice(F.col("keys"), i + 2, F.size("keys")), lambda y: F.struct(x.alias("x"), y.alias("y")))))
    every = small.select(F.inline(pairs))
    beside = with_hubs.where(F.col("n") > SMALL_BUCKET).select("bucket", "next", "key").repartitionByRange("bucket", "next", "key").sortWithinPartitions("bucket", "next", "key").mapInArrow(_neighbours, "x binary, y binary")
    all_ = starred.unionByName(every).unionByName(beside)
    return all_.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, next, key) in order; each with the one before it in its bucket."""
    last = None
    for batch in batches:
        rows = list(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True))
        x, y = [], []
        for bucket, key in rows:
            if last and last[0] == bucket:
                x.append(last[1])
                y.append(key)
            last = (bucket, key)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()), pa.array(y, pa.binary())], names=["x", "y"])


def unsettled(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, component) of the texts that share a bucket too large for all pairs with a text of another component."""
    large = members.where(F.col("n") > SMALL_BUCKET).select("bucket", "key").join(labels.withColumnRenamed("node", "key"), "key", "left")
    named = cut_lineage(large.withColumn("component", F.coalesce("component", "key")), "named")
    mixed_ = named.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("bucket")
    return named.join(cut_lineage(mixed_, "mixed"), "bucket", "left_semi").select("key", "component").distinct()


def remainder(texts: DataFrame, least: float, weighted: bool = False) -> DataFrame:
    """Distinct pairs (a, b), a < b, of texts (key, component, text) of different components: all that can be similar, and few others.

    The smaller text comes with its short prefix, the larger one with its long one.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(RARITY_BINS, np.int64)
        for part in slices(batches):
            hashes, counts = shingle_hashes(texts_of(part))
            if weighted:  # marks are occurrences by number then, and so is what is counted
                hashes = np.concatenate([unit_hashes(own, True) for own in np.split(hashes, np.cumsum(counts)[:-1])] or [hashes])
            total += np.bincount((hashes % np.uint64(RARITY_BINS)).astype(np.int64), minlength=RARITY_BINS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["bin", "n"])

    counted = texts.select("text").mapInArrow(count, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).toArrow()
    often = np.zeros(RARITY_BINS, np.int64)
    often[counted["bin"].to_numpy()] = counted["n"].to_numpy()

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, limit=1 << 20):
            hashes, counts = shingle_hashes(texts_of(part))
            marks, sizes, leads = [], [], []
            for own in np.split(hashes, np.cumsum(counts)[:-1]):
                own = unit_hashes(own, weighted)
                own = own[np.lexsort((own, often[(own % np.uint64(RARITY_BINS)).astype(np.int64)]))]
                sizes.append(len(own))
                leads.append(len(own) - int(np.ceil(2 * least / (1 + least) * len(own) - 1e-9)) + 1)
                marks.append(own[: len(own) - int(np.ceil(least * len(own) - 1e-9)) + 1].astype(np.int64))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sizes, pa.int32()), pa.array(leads, pa.int32()), pa.array(marks, pa.list_(pa.int64()))], names=["key", "component", "size", "leads", "marks"])

    held = cut_lineage(texts.select("key", "component", "text").mapInArrow(first, "key binary, component binary, size int, leads int, marks array<long>"), "prefixes")
    each = held.select("key", "component", "size", "leads", F.posexplode("marks").alias("place", "mark"))
    # A mark within one component brings no pair.
    shared = each.groupBy("mark").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("mark")
    each = cut_lineage(each.join(cut_lineage(shared, "shared"), "mark"), "meeting")
    x = each.where(F.col("place") < F.col("leads")).select("mark", *[F.col(c).alias(f"{c}_a") for c in ("key", "component", "size", "place")])
    y = each.select("mark", *[F.col(c).alias(f"{c}_b") for c in ("key", "component", "size", "place")])
    # At the first mark that both have, all they can have in common is it and what follows.
    ahead = F.least(F.col("size_a") - F.col("place_a"), F.col("size_b") - F.col("place_b"))
    enough = ahead * (1 + least) >= least * (F.col("size_a") + F.col("size_b")) - 1e-6
    alike = (F.col("size_a") <= F.col("size_b")) & (F.col("size_a") >= least * F.col("size_b") - 1e-6)
    met = x.join(y, "mark").where((F.col("component_a") != F.col("component_b")) & alike & enough)
    return met.select(F.least("key_a", "key_b").alias("a"), F.greatest("key_a", "key_b").alias("b")).distinct()


def classes(members: DataFrame, weighed: DataFrame, texts: DataFrame, least: float, weighted: bool = False) -> DataFrame:
    """(node, component) of all texts that are similar to another one."""
    labels = components(similar(candidates(weighed), texts, least, weighted))
    open_ = cut_lineage(unsettled(members, labels), "unsettled")
    left = cut_lineage(texts.join(open_, "key"), "left")
    links = cut_lineage(similar(remainder(left, least, weighted), texts, least, weighted), "links")
    if links.limit(1).count() == 0:
        return labels
    of = open_.select("key", "component")
    between = links.join(of.withColumnsRenamed({"key": "a", "component": "x"}), "a").join(of.withColumnsRenamed({"key": "b", "component": "y"}), "b")
    over = components(between.select(F.col("x").alias("a"), F.col("y").alias("b"))).select(F.col("node").alias("component"), F.col("component").alias("_over"))
    alone = links.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(labels, "node", "left_anti").select("node", F.col("node").alias("component"))
    return labels.unionByName(alone).join(over, "component", "left").select("node", F.coalesce("_over", "component").alias("component"))


def near_duplicates(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", least: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, weighted: bool = False) -> DataFrame:
    """One row for each row of df: doc_id, key (hash of the text), class_id (smallest id of its
    class), and whether it is the one that represents the class. Columns of df are not carried."""
    docs = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{doc_id}`"), F.lit(-(1 << 63))).alias("_id"), text_key(text).alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    signed = cut_lineage(with_bands(docs, bands, rows, weighted), "signed")
    # Copies in a task carry no bands, and which row comes first is not known.
    distinct = signed.groupBy("key").agg(F.min("_id").alias("first"), F.any_value("bands", ignoreNulls=True).alias("bands"))
    # Beside each band goes the next one: texts that agree in both are neighbours in the bucket's order.
    beside = F.transform("bands", lambda b, i: F.struct(b.alias("bucket"), F.element_at("bands", (i + 1) % bands + 1).alias("next")))
    banded = distinct.select("key", F.inline(beside))
    full = banded.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    # Written down first, the join has two plain shuffles, of which the adaptive engine splits a hot bucket's part.
    full = cut_lineage(full, "buckets")
    members = cut_lineage(banded.join(full, "bucket").select("bucket", "next", "key", "n"), "members")
    weight = members.groupBy("key").agg(F.sum("n").alias("company"))
    weighed = members.select("bucket", "next", "key").join(weight, "key")
    needed = weight.select("key")
    # One text of many copies is chosen before the shuffle.
    once = docs.select("key", "text").groupBy("key").agg(F.any_value("text").alias("text"))
    texts = cut_lineage(once.join(needed, "key", "left_semi"), "texts")
    labels = classes(members, weighed, texts, least, weighted)
    class_of = distinct.join(labels.withColumnRenamed("node", "key"), "key", "left").select("key", "first", F.coalesce("component", "key").alias("component"))
    class_of = cut_lineage(class_of, "classes")
    first = class_of.groupBy("component").agg(F.min(F.struct("first", "key")).alias("_head"))
    named = attach(class_of, first, ["component"], F.col("key")).select("key", "first", F.col("_head.first").alias("class_id"), (F.col("_head.key") == F.col("key")).alias("_leads"))
    out = attach(signed.select("key", "_id"), named, ["key"], F.col("_id"))
    lowest = F.lit(-(1 << 63))
    return out.select(
        F.when(F.col("_id") != lowest, F.col("_id")).alias("doc_id"),
        F.when(F.col("class_id") != lowest, F.col("class_id")).alias("class_id"),
        (F.col("_leads") & (F.col("_id") == F.col("first"))).alias("represents"),
        F.col("key").alias("text_key"),
    )


def one_of_each(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of df, all columns as they are, that represent their class. Of rows with equal id and text one stays."""
    id_, key = fresh(df.columns, "_id", "_key")
    kept = near_duplicates(df, doc_id=doc_id, text=text).where("represents").select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias(id_), F.col("text_key").alias(key)).distinct()
    tagged = df.withColumns({id_: F.coalesce(F.col(f"`{doc_id}`"), F.lit(-(1 << 63))), key: text_key(text)})
    stay = tagged.join(cut_lineage(kept, "kept"), [id_, key], "left_semi")
    return stay.dropDuplicates([id_, key]).select(*[F.col(f"`{c}`") for c in df.columns])

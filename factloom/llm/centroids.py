"""Centroid clustering by Lloyd rounds that look only at what changed, exactly, on integer vectors.

A vector is kept if it has exactly `dims` components, none null or non-finite; a component x becomes
floor(scale * x), x as a double, held within +-LARGEST (so that squared distances fit a long).

The assignments (owner and distance of every vector) are a written table, and each centroid's count
and component sums are global state of k * dims integers. A round compares a vector with the changed
centroids alone, unless its own owner is one of them; then with all. Vectors whose owner moved send
signed transfers: their components and a count of one, minus to the old owner and plus to the new one.
A task adds up its transfers before they are shuffled, so a round moves k rows a task, and a vector that
is repeated any number of times costs no more than others. A new centroid is floor(sum / count) by component;
an empty one stays. All sums are integers, so results do not depend on partitions.

Null vec_ids count as empty text in the hash that chooses the first centroids; of equal hashes (repeated ids)
the smaller vector goes first. Every kept row has a row in the result, repeated ones included; rows that are
not kept have none, and a table of which nothing is kept gives no rows. With fewer than k kept rows each is a
centroid. Columns other than the id and the vector are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import lineage
from .common import cut_lineage, merged

CLUSTERS, ROUNDS, SCALE, DIMS = 16, 3, 64, 64
#: Components beyond this, of either sign, count as this.
LARGEST = 1 << 26
_BATCH_BYTES = 4 << 20
_STATE = "vec_id long, v array<int>, owner int, distance long, before int"


def integer_vectors(df: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = SCALE, dims: int = DIMS) -> DataFrame:
    """(vec_id, v): the kept rows of df, components as integers."""
    x = F.col(f"`{embedding}`")
    good = (F.size(x) == dims) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) != float("inf")))
    whole = F.transform(x, lambda c: F.greatest(F.least(F.floor(c.cast("double") * scale), F.lit(LARGEST)), F.lit(-LARGEST)).cast("int"))
    return df.where(F.coalesce(good, F.lit(False))).select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), whole.alias("v"))


def first_centroids(vectors: DataFrame, k: int, salt: str = "1:") -> np.ndarray:
    """The vectors with the k smallest hashes of their ids."""
    named = vectors.select(F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256).alias("h"), "v")
    return np.array([r["v"] for r in named.orderBy("h", "v").limit(k).collect()], np.int64)


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def distances(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances (vector, centroid), exact."""
    largest = max(int(np.abs(v).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    if 4 * largest * largest * v.shape[1] < 1 << 53:  # every step is a whole number that a double holds
        v, centroids = v.astype(np.float64), centroids.astype(np.float64)
    return ((v * v).sum(1)[:, None] - 2 * (v @ centroids.T) + (centroids * centroids).sum(1)[None]).astype(np.int64)


def reassign(v: np.ndarray, owner: np.ndarray, distance: np.ndarray, centroids: np.ndarray, changed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owners and distances after the centroids with `changed` moved; an owner of -1 has not been found yet."""
    owner, distance = owner.copy(), distance.copy()
    lost = (owner < 0) | changed[owner]
    if lost.any():
        d = distances(v[lost], centroids)
        owner[lost] = d.argmin(1)  # the first of equal ones: the smaller number
        distance[lost] = d.min(1)
    moved, stay = np.flatnonzero(changed), np.flatnonzero(~lost)
    if len(moved) and len(stay):
        d = distances(v[stay], centroids[moved])
        j, best = moved[d.argmin(1)], d.min(1)
        better = (best < distance[stay]) | ((best == distance[stay]) & (j < owner[stay]))
        owner[stay[better]], distance[stay[better]] = j[better], best[better]
    return owner, distance


def assigned(state: DataFrame, centroids: np.ndarray, changed: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in merged(batches, _BATCH_BYTES):
            before = b.column(2).to_numpy(zero_copy_only=False)
            owner, distance = reassign(matrix(b.column(1)), before.astype(np.int64), b.column(3).to_numpy(zero_copy_only=False), centroids, changed)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(owner, pa.int32()), pa.array(distance, pa.int64()), pa.array(before, pa.int32())], names=["vec_id", "v", "owner", "distance", "before"])

    return state.select("vec_id", "v", "owner", "distance").mapInArrow(run, _STATE)


def transfers(state: DataFrame, k: int, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """What each cluster's count and component sums gain (signed), from the vectors whose owner moved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, dims + 1), np.int64)
        for b in merged(batches, _BATCH_BYTES):
            own = np.concatenate([np.ones((len(b), 1), np.int64), matrix(b.column(0))], 1)
            new, old = (b.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            np.add.at(total, new, own)
            np.subtract.at(total, old[old >= 0], own[old >= 0])
        at = np.argwhere(total)
        yield pa.RecordBatch.from_arrays([pa.array(at[:, 0], pa.int32()), pa.array(at[:, 1], pa.int32()), pa.array(total[tuple(at.T)], pa.int64())], names=["cluster", "place", "n"])

    sent = state.where("owner <> before").select("v", "owner", "before").mapInArrow(run, "cluster int, place int, n long")
    gained = np.zeros((k, dims + 1), np.int64)
    for r in sent.groupBy("cluster", "place").agg(F.sum("n").alias("n")).collect():  # at most k * (dims + 1) rows
        gained[r["cluster"], r["place"]] = r["n"]
    return gained[:, 0], gained[:, 1:]


def centroid_clusters(df: DataFrame, *, k: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE, dims: int = DIMS, vec_id: str = "vec_id", embedding: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of every kept vector after `rounds` rounds and one more assignment, and the final centroids."""
    spark = df.sparkSession
    vectors = integer_vectors(df, vec_id=vec_id, embedding=embedding, scale=scale, dims=dims)
    centroids = first_centroids(vectors, k)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long"), np.zeros((0, dims), np.int64)
    n = len(centroids)
    count, total = np.zeros(n, np.int64), np.zeros((n, dims), np.int64)
    changed = np.ones(n, bool)
    state = vectors.select("vec_id", "v", F.lit(-1).alias("owner"), F.lit(0).cast("long").alias("distance"))
    at = lineage.mark()
    for done in range(rounds + 1):
        state = cut_lineage(assigned(state, centroids, changed), f"round{done}")
        if done:
            lineage.discard(spark, at, at + 1)  # the round before
        if done == rounds:
            break
        gain, sums = transfers(state, n, dims)
        count, total = count + gain, total + sums
        moved = np.where(count[:, None] > 0, total // np.maximum(1, count)[:, None], centroids)
        changed = (moved != centroids).any(1)
        centroids = moved
    return state.select("vec_id", F.col("owner").alias("cluster"), "distance"), centroids


def cluster_digests(df: DataFrame, **options) -> DataFrame:
    """centroid_clusters with the summed distances by cluster and over all, and a digest of each final centroid."""
    found, centroids = centroid_clusters(df, **options)
    sums = {r["cluster"]: r["n"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("n")).collect()}  # at most k rows
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    of = lambda values, kind: F.element_at(F.array(*(F.lit(v).cast(kind) for v in values)), F.col("cluster") + 1) if len(values) else F.lit(None).cast(kind)
    return found.select("vec_id", "cluster", "distance", of([sums.get(i, 0) for i in range(len(centroids))], "long").alias("cluster_inertia"), F.lit(sum(sums.values())).cast("long").alias("inertia"), of(digests, "string").alias("centroid_sha256"))


def cluster_sql(k: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE, dims: int = DIMS) -> str:
    """The same from whole rounds, for DuckDB."""
    parts = [
        f"""kept AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: greatest(least(CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT), {LARGEST}), -{LARGEST})) AS v
        FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(CAST(x AS DOUBLE)))) = {dims})""",
        f"""c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS k, v FROM (SELECT sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, v FROM kept ORDER BY h, v LIMIT {k}))""",
    ]
    for r in range(rounds + 1):
        parts.append(f"""a{r} AS MATERIALIZED (SELECT rid, any_value(kept.vec_id) AS vec_id, any_value(kept.v) AS v, min([list_sum(list_transform(list_zip(kept.v, c{r}.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), c{r}.k]) AS m
            FROM kept CROSS JOIN c{r} GROUP BY rid)""")
        if r < rounds:
            parts.append(f"""s{r} AS (SELECT m[2] AS k, place, sum(x) AS s, count(*) AS n FROM (SELECT m, unnest(v) AS x, unnest(range({dims})) AS place FROM a{r}) GROUP BY 1, 2)""")
            parts.append(f"""c{r + 1} AS MATERIALIZED (SELECT c{r}.k, coalesce(any_value(t.v), any_value(c{r}.v)) AS v FROM c{r} LEFT JOIN
                (SELECT k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY place) AS v FROM s{r} GROUP BY k) t ON t.k = c{r}.k GROUP BY c{r}.k)""")
    return f"""WITH {", ".join(parts)}
        SELECT vec_id, CAST(m[2] AS INTEGER) AS cluster, CAST(m[1] AS BIGINT) AS distance, CAST(sum(m[1]) OVER (PARTITION BY m[2]) AS BIGINT) AS cluster_inertia,
        CAST(sum(m[1]) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c{rounds}.v, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} ON c{rounds}.k = m[2]"""

"""Shared plumbing of the corpus operators: reading, batching and checkpoint folders."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import cut_lineage, scratch

__all__ = ["cut_lineage", "scratch"]

#: Rows that Spark hands to Python at a time; long texts would make larger batches heavy.
BATCH_ROWS = 1000
_LIBC = ctypes.CDLL(None)

#: Text bytes that one Python step works on at a time; bounds a worker's memory.
SLICE_BYTES = 4 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def small_batches(spark: SparkSession) -> None:
    """For whole texts in Python: fewer rows in an Arrow batch than Spark's 10,000."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def fresh(columns: Iterable[str], *names: str) -> list[str]:
    """Names for helper columns that none of `columns` has, in any case."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def only(df: DataFrame, **columns: str) -> DataFrame:
    """df with the columns named, under these names, and no others: what an operator needs of a table that may have any."""
    return df.select(*(F.col(f"`{c}`").alias(n) for n, c in columns.items()))


#: The one model that a Python worker keeps between tasks.
_resident: dict = {}


def resident(key: tuple, make: Callable):
    """A model that stays in the worker until another operator's task runs in it."""
    if key not in _resident:
        _resident.clear()
        _resident[key] = make()
    return _resident[key]


def settle(keep: str | None = None) -> None:
    """Gives memory back: another operator's model, and what the allocators hold on to."""
    if any(key[0] != keep for key in _resident):
        _resident.clear()
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def merged(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Small batches put together up to about `limit` bytes."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= limit:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES, keep: str | None = None) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds about `limit` bytes of text, or one row."""
    settle(keep)
    for batch in merged(batches, limit):
        column = batch.column(batch.schema.get_field_index(text))
        sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
        at = total = 0
        for i, n in enumerate(sizes):
            if total and total + n > limit:
                yield batch.slice(at, i - at)
                at, total = i, 0
            total += n
        if len(sizes) > at:
            yield batch.slice(at)


def texts_of(batch: pa.RecordBatch, text: str = "text") -> list[str]:
    return [x or "" for x in batch.column(batch.schema.get_field_index(text)).to_pylist()]


def utf8_of(batch: pa.RecordBatch, text: str = "text") -> list[bytes]:
    column = batch.column(batch.schema.get_field_index(text))
    return [x or b"" for x in column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()]


def map_texts(df: DataFrame, schema: str, names: list[str], work: Callable[[pa.RecordBatch], list], *, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), limit: int = SLICE_BYTES, model: str | None = None) -> DataFrame:
    """One output row for each document: its id, then what `work` computes for a slice of documents.

    `work` gets a record batch with doc_id, text and the columns of `keep`, and returns one array or list per name.
    """
    types = [f.type for f in pa_schema(df.sparkSession, schema)]
    kept = [("doc_id", doc_id), ("text", text), *((k, k) for k in keep)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, limit=limit, keep=model):
            out = [part.column(0), *work(part)]
            yield pa.RecordBatch.from_arrays([x.cast(t) if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(out, types, strict=True)], names=["doc_id", *names])

    return df.select(*(F.col(f"`{c}`").alias(a) for a, c in kept)).mapInArrow(run, schema)


def pa_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def row_key(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """What tells documents apart where ids are null or repeated: the id, and a hash of the text."""
    return [F.coalesce(F.col(f"`{doc_id}`"), F.lit(-(1 << 63))).alias("_id"), F.xxhash64(F.col(f"`{text}`")).alias("_h")]


def attach(rows: DataFrame, stats: DataFrame, key: list[str], spread: Column, ways: int = 32) -> DataFrame:
    """rows left-joined with stats (one row a key), however many rows share a key.

    Each key's rows are dealt over `ways` sub-keys by `spread`; stats is copied only to the
    sub-keys that occur, at most `ways` times. No task gets all rows of a key.
    """
    (way,) = fresh([*rows.columns, *stats.columns], "_way")
    salted = rows.withColumn(way, F.pmod(F.xxhash64(spread), F.lit(ways)).cast("int"))
    used = salted.select(*key, way).distinct().join(stats, key)
    return salted.join(used, [*key, way], "left").drop(way)

"""Cutting lineage with written tables, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir.

    Without the setting, local runs (tests) get a temporary folder; on a cluster that is an error,
    as each executor would write to a disk of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='factloom-')}"
    return f"{root.rstrip('/')}/factloom-{uuid.uuid4().hex}"


#: With it, Spark deletes the shuffle files of a query as that ends; without, when the driver happens to collect its garbage,
#: which a large heap may never do.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """What is written in here leaves no shuffle files."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


#: For tables with rows of up to some MB. Parquet looks at the size of pages and row groups after a hundred rows; such pages would be
#: a hundred MB, which compression and reading hold several times, outside of the heap too.
LONG_ROWS = {"parquet.page.size.row.check.min": "1", "parquet.block.size.row.check.min": "1", "parquet.block.size": str(16 << 20)}


def cut_lineage(df: DataFrame, name: str = "step", by: Sequence[str] = (), long_rows: bool = False) -> DataFrame:
    """Writes df below the shared folder (in folders by the columns `by`) and reads it back: a lost executor costs no recomputation."""
    path = f"{scratch(df.sparkSession)}/{name}"
    with shuffles_deleted(df.sparkSession):
        df.write.options(**(LONG_ROWS if long_rows else {})).partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Folders that a thread of this driver has named, oldest first: what runs in another thread has marks of its own.
_own = threading.local()


def _named() -> list[str]:
    if not hasattr(_own, "named"):
        _own.named = []
    return _own.named


def scratch(spark: SparkSession) -> str:
    """A shared_folder() that this thread's discard() knows of."""
    _named().append(shared_folder(spark))
    return _named()[-1]


def mark() -> int:
    """How many scratch folders this thread has; discard(spark, mark) deletes those made after it."""
    return len(_named())


def discard(spark: SparkSession, since: int = 0, before: int | None = None) -> None:
    """Deletes this thread's scratch folders (those from one mark to another), once what was read from them is written elsewhere."""
    gone = _named()[since:before]
    del _named()[since:before]
    for name in gone:
        delete(spark, name)


def delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file on any storage that Spark knows, whole or not at all."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    draft, final = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp"), jvm.org.apache.hadoop.fs.Path(path)
    system = final.getFileSystem(conf)
    out = system.create(draft)
    out.write(bytearray(text.encode()))
    out.close()
    system.delete(final, False)
    if not system.rename(draft, final):
        raise OSError(f"cannot write {path}")


def names_in(spark: SparkSession, folder: str) -> list[str]:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(x.getPath().getName() for x in system.listStatus(path)) if system.exists(path) else []

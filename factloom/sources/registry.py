"""Which kinds of source can be ingested, from where, and in which form records may come."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from .binxml import FILE_MAGIC
from .eventlog import BINARY_XML, read_binary_log
from .events import read_event_log


def read_detection_log(spark: SparkSession, path: str) -> DataFrame:
    """A log file of either form: binary ones are known by their first bytes."""
    with open(path, "rb") as f:
        binary = f.read(len(FILE_MAGIC)) == FILE_MAGIC
    return read_binary_log(spark, path, BINARY_XML) if binary else read_event_log(spark, path)


#: Source type -> reader of a path into records. Register more readers here.
READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {"defender_evtx": read_detection_log}


def check_path(path: str, source_type: str, root: Path | None) -> tuple[Path | None, dict | None]:
    """The file to read, or an error: the type is checked first, then existence, kind, and place."""

    def error(code: str, message: str) -> tuple[None, dict]:
        return None, {"status": "error", "error": code, "message": message}

    if source_type not in READERS:
        return error("unsupported_source_type", f"cannot read sources of type {source_type!r}, only {sorted(READERS)}")
    file = Path(path).expanduser()
    if not file.exists():
        return error("file_not_found", f"nothing there: {path}")
    if not file.is_file():
        return error("not_a_file", f"no plain file: {path}")
    if root is not None and not file.resolve().is_relative_to(root):
        return error("path_outside_allowlist", f"{file.resolve()} does not lie in {root}")
    return file, None


def records_frame(spark: SparkSession, records: object, schema: str) -> DataFrame:
    """Records in memory as a DataFrame: a DataFrame or a list of dicts. A path is not records."""
    if isinstance(records, DataFrame):
        return records
    if isinstance(records, (str, Path)):
        raise NotImplementedError("give records, not a path")
    if not isinstance(records, list):
        raise TypeError(f"records must be a list of dicts or a DataFrame, not {type(records).__name__}")
    from pyspark.sql.types import StructType

    kind = StructType.fromDDL(schema)
    return spark.createDataFrame([tuple(r.get(f.name) for f in kind) for r in records if isinstance(r, dict)], kind)

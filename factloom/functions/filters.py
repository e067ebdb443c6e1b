"""Declarative filters {"field", "op", "value"} as typed Columns.

A filter never fails on types: where the field's type cannot be compared with the value, it is
the constant false, which the optimizer folds away. Where the field is null a comparison is null,
which selects no row; it is left bare so that it reaches the scan.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPS = frozenset({"eq", "contains", "gt", "lt", "exists"})


class BadFilter(ValueError):
    def __init__(self, op: object) -> None:
        super().__init__(f"no filter operation {op!r}; there are {sorted(OPS)}")


def comparable(kind: T.DataType, value: object, coerce_temporal: bool) -> bool:
    if isinstance(kind, T.StringType):
        return isinstance(value, str)
    if isinstance(kind, (T.NumericType, T.BooleanType)):  # truth values count as 0 and 1
        return isinstance(value, (int, float))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return isinstance(value, datetime) or coerce_temporal and isinstance(value, str)
    if isinstance(kind, T.BinaryType):
        return isinstance(value, bytes)
    return False


def _operands(column: Column, kind: T.DataType, value: object) -> tuple[Column, Column]:
    if isinstance(kind, T.BooleanType) and not isinstance(value, bool) or isinstance(kind, T.NumericType) and isinstance(value, bool):
        return column.cast("double"), F.lit(float(value))
    if isinstance(value, str) and not isinstance(kind, T.StringType):
        return column, F.try_to_timestamp(F.lit(value)).cast(kind)
    return column, F.lit(value)


def condition(df: DataFrame, flt: dict, *, coerce_temporal: bool = False) -> Column:
    field, op, value = flt.get("field"), flt.get("op"), flt.get("value")
    if op not in OPS:
        raise BadFilter(op)
    if field is None:
        return F.lit(False)
    present = field in df.columns
    if op == "exists":
        return (F.col(f"`{field}`").isNotNull() if value else F.col(f"`{field}`").isNull()) if present else F.lit(not value)
    if not present:
        return F.lit(False)
    column, kind = F.col(f"`{field}`"), df.schema[field].dataType
    if op == "contains":
        if isinstance(kind, T.StringType) and isinstance(value, str):
            found = F.contains(column, F.lit(value))
        elif isinstance(kind, T.ArrayType) and comparable(kind.elementType, value, False):
            found = F.array_contains(column, F.lit(value).cast(kind.elementType))
        elif isinstance(kind, T.MapType) and comparable(kind.keyType, value, False):
            found = F.map_contains_key(column, F.lit(value))
        else:
            return F.lit(False)
        return found
    if not comparable(kind, value, coerce_temporal):
        return F.lit(False)
    a, b = _operands(column, kind, value)
    return {"eq": a == b, "gt": a > b, "lt": a < b}[op]


def check_ops(filters: Sequence[dict]) -> None:
    for f in filters:
        if f.get("op") not in OPS:
            raise BadFilter(f.get("op"))


def all_of(df: DataFrame, filters: Sequence[dict], *, coerce_temporal: bool = False) -> Column:
    """All filters together. Operations are checked before any plan is built."""
    check_ops(filters)
    return reduce(lambda a, b: a & b, (condition(df, f, coerce_temporal=coerce_temporal) for f in filters), F.lit(True))

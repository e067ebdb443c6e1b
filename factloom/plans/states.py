"""What a fold has come to so far, as rows that can be put together in any order.

A state row holds, for each column, the (order, value) that wins so far, and for united lists each list that differs with its
first place. Winners are minima and maxima, so states of parts of an identity's rows, early or late, unite to
the state of all of them. Types whose canonical rows need a second look at the rows (logs of
differences, newest writes) have no such state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import schema as S
from .fold import guarded, ordered_union, planned

_LIST = "_l_{}"


def has_states(spec: S.NodeType) -> bool:
    return not spec.logs and spec.newest_by is None


def whole(obs: DataFrame, spec: S.NodeType) -> DataFrame:
    """obs with every column of the type, so that all states have the same ones."""
    return guarded(obs, spec.name).withColumns({c: F.lit(None).cast(t) for c, t in spec.all_columns().items() if c not in obs.columns})


def states(obs: DataFrame, spec: S.NodeType, seq: str = "seq") -> DataFrame:
    """node_key, the identity's columns, and the state of each identity's rows."""
    keyed = spec.keyed(whole(obs, spec))
    f, unions, _ = planned(list(spec.all_columns()), spec, seq)
    id_ = ["node_key", *(k for k in spec.key)]
    lists = [F.coalesce(F.col(c), F.array().cast("array<string>")).alias(f"_u_{c}") for c in unions]
    rows = keyed.select(*id_, *f.rows(), *lists)
    once = rows.groupBy(*id_, *(f"_u_{c}" for c in unions)).agg(*f.aggregates())
    if not unions:
        return once
    kept = [F.collect_list(F.struct(F.col("first_seq").alias("s"), F.col(f"_u_{c}").alias("v"))).alias(_LIST.format(c)) for c in unions]
    return once.groupBy(*id_).agg(*f.aggregates(), *kept)


def firsts(lists: Column) -> Column:
    """Of (order, list) structs each list once, at its first place."""
    ordered = F.array_sort(lists)
    values = F.transform(ordered, lambda x: x["v"])
    return F.filter(ordered, lambda x, i: F.array_position(values, x["v"]) == i + 1)


def united(rows: DataFrame, spec: S.NodeType) -> DataFrame:
    f, unions, _ = planned(list(spec.all_columns()), spec)
    id_ = ["node_key", *(k for k in spec.key)]
    lists = [firsts(F.flatten(F.collect_list(_LIST.format(c)))).alias(_LIST.format(c)) for c in unions]
    return rows.groupBy(*id_).agg(*f.aggregates(), *lists)


def rendered(rows: DataFrame, spec: S.NodeType) -> DataFrame:
    """Canonical rows of united states; where a column must not differ, `conflicts` names those that do."""
    f, unions, _ = planned(list(spec.all_columns()), spec)
    results = f.results | {c: ordered_union(F.col(_LIST.format(c))) for c in unions}
    rest = [c.alias(n) for n, c in results.items() if n not in spec.key]
    return rows.select("node_key", *spec.key, *rest, F.lit(spec.name).alias("node_type"))

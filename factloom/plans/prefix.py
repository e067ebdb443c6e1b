"""Running sums by key in an order, however many rows a key has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut_lineage


def running_sums(df: DataFrame, key: list[str], order: list[str], sums: dict[str, Column]) -> DataFrame:
    """df with columns `sums`: each expression added up over the rows of the key so far, the row itself included.

    Rows are dealt over tasks by ranges of key and order, so a key with many rows lies in several parts; a part's
    sums are added to what the parts before it came to. Rows that are equal in key and order stay in one part, in any order.
    """
    part = "_part"
    dealt = cut_lineage(df.withColumns({f"_{n}": c for n, c in sums.items()}).repartitionByRange(*key, *order).withColumn(part, F.spark_partition_id()), "dealt")
    totals = dealt.groupBy(*key, part).agg(*(F.sum(f"_{n}").alias(f"_{n}") for n in sums))
    earlier = Window.partitionBy(*key).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*key, part, *(F.coalesce(F.sum(f"_{n}").over(earlier), F.lit(0)).alias(f"_before_{n}") for n in sums))
    within = Window.partitionBy(*key, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = dealt.withColumns({f"_own_{n}": F.sum(f"_{n}").over(within) for n in sums}).join(before, [*key, part])
    return rows.select(*df.columns, *((F.col(f"_own_{n}") + F.col(f"_before_{n}")).alias(n) for n in sums))

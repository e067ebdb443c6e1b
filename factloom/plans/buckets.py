"""Canonical rows kept in hash buckets, so that a run costs its own size and not that of all that is known.

A bucket is a base (canonical rows, folded up to some run) and the rows of later runs, as they came. A run
is written as one table of rows, in folders by bucket. Runs are put together as they pile up: FANOUT tables of one level become one of the next,
so a row is moved a logarithm of times. When a bucket's later rows have outgrown SLACK of its base, the next read folds the two into a new base; that bucket
alone is rewritten. Runs between two reads thus share one fold, and runs that nobody reads cost none. Reading folds only buckets that have later rows.

Folding a base with later rows equals folding all rows at once as long as a later run's rows come later in order
(factloom.plans.fold): their seq is a struct that begins with `run`.

The driver keeps numbers by bucket and names of folders, never rows. Old folders stay readable until vacuum().
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .fold import EDGE_KEY, counters, fold, fold_edges, merge
from .lineage import delete, shared_folder
from .schema import NodeType
from .states import united

BUCKETS = 64
FANOUT = 8
SLACK = 0.5
#: Bases are written with filters of their keys, as large as the keys of a row group need.
_FILTERS = {"parquet.bloom.filter.enabled#{}": "true", "parquet.bloom.filter.adaptive.enabled": "true", "parquet.bloom.filter.max.bytes": str(128 << 10), "parquet.block.size": str(16 << 20)}


@dataclass
class Later:
    """Rows of runs first..last as they came, and how many each bucket has."""

    path: str
    level: int
    first: int
    last: int
    rows: dict[int, int]


@dataclass
class BucketStore:
    """rows by `key`; bucketed by the column `by`. fold_in(base or None, later rows) gives canonical rows."""

    spark: SparkSession
    key: list[str]
    by: str
    fold_in: Callable[[DataFrame | None, DataFrame], DataFrame]
    keyed: Callable[[DataFrame], DataFrame] = lambda df: df
    buckets: int = BUCKETS
    slack: float = SLACK
    fanout: int = FANOUT
    base: dict[int, tuple[str, int]] = field(default_factory=dict)  # bucket: folder of its base, rows in it
    floor: dict[int, int] = field(default_factory=dict)  # bucket: the last run that its base has
    later: list[Later] = field(default_factory=list)
    root: str | None = None  # where tables are written; a scratch folder each, if not given
    added: int = 0  # canonical rows there are: what runs added
    merged: int = 0
    rows_written: int = 0
    _made: list[str] = field(default_factory=list)

    # -- writing

    def bucket_of(self, key: str) -> int:
        return zlib.crc32(key.encode()) % self.buckets

    def _bucket(self, df: DataFrame) -> DataFrame:
        return df.withColumn("_bucket", (F.crc32(F.coalesce(F.col(self.by), F.lit("")).cast("binary")) % self.buckets).cast("int"))

    def _write(self, df: DataFrame, filters: bool = False) -> tuple[str, dict[int, int]]:
        """Rows (with _bucket), sorted in files of their bucket; large buckets in several files."""
        path = f"{self.root.rstrip('/')}/{uuid.uuid4().hex}" if self.root else shared_folder(self.spark)
        self._made.append(path)
        writer = df.hint("rebalance", "_bucket").sortWithinPartitions("_bucket", self.by).write.partitionBy("_bucket")
        for name, value in _FILTERS.items() if filters else ():
            writer = writer.option(name.format(self.by), value)
        writer.parquet(path)
        rows = {r["_bucket"]: r["n"] for r in self._read(path, df).groupBy("_bucket").agg(F.count("*").alias("n")).collect()}  # at most `buckets` rows
        self.rows_written += sum(rows.values())
        return path, rows

    def _read(self, path: str, like: DataFrame | None = None) -> DataFrame:
        reader = self.spark.read
        return (reader if like is None else reader.schema(like.schema)).parquet(path)

    def add(self, rows: DataFrame, run: int, *, count: bool = True, settle: bool = False) -> tuple[int, int]:
        """Takes in the rows of a run, later than all before it; returns how many canonical rows are new, and how many rows
        met one, which reads the keys of the buckets that the run touches (without count: nothing, and (0, 0)). With settle,
        buckets are folded as they fall due, not by the next read."""
        path, held = self._write(self._bucket(self.keyed(rows)))
        if not held:
            return 0, 0
        counts = counters(self._read(path), self.keys(list(held)), self.key).first() if count else {"added": 0, "merged": 0}
        self.added += counts["added"]
        self.merged += counts["merged"]
        self.later.append(Later(path, 0, run, run, held))
        if settle:
            self._settle(list(held))
        self._pile_up()
        return counts["added"], counts["merged"]

    def _waiting(self, bucket: int) -> int:
        """Later rows of a bucket; of tables that reach back before its base an upper bound."""
        return sum(x.rows.get(bucket, 0) for x in self.later if x.last > self.floor.get(bucket, -1))

    def _settle(self, touched: Sequence[int]) -> None:
        """Folds the buckets whose later rows have outgrown their base."""
        due = [b for b in touched if self._waiting(b) > self.slack * max(1, self.base.get(b, ("", 0))[1])]  # no base counts as a row
        if not due:
            return
        last = max(x.last for x in self.later)
        path, rows = self._write(self._bucket(self._folded(due)), filters=True)
        for b in due:
            self.base[b], self.floor[b] = (path, rows.get(b, 0)), last
        self.later = [x for x in self.later if any(x.last > self.floor.get(b, -1) for b in x.rows)]

    def _pile_up(self) -> None:
        """As many tables of one level as fanout become one of the next. A table that has more rows than the level's others together waits until they have as many."""
        size = lambda x: sum(x.rows.values())
        for level in range(64):
            same = sorted((x for x in self.later if x.level == level), key=size)
            while same and size(same[-1]) > sum(map(size, same[:-1])):
                same.pop()
            if len(same) < self.fanout:
                return
            path, rows = self._write(self._later_rows(None, same))
            done = {x.path for x in same}
            self.later = [x for x in self.later if x.path not in done] + [Later(path, level + 1, min(x.first for x in same), max(x.last for x in same), rows)]

    def vacuum(self) -> None:
        """Deletes what neither the store nor, any more, a table that was read from it needs."""
        live = {path for path, _ in self.base.values()} | {x.path for x in self.later}
        for path in self._made:
            if path not in live:
                delete(self.spark, path)
        self._made = [p for p in self._made if p in live]

    # -- state

    def state(self) -> str:
        """All that the driver knows, as text: restored() goes on from it."""
        return json.dumps({"base": [[b, *x] for b, x in self.base.items()], "floor": list(self.floor.items()), "later": [[x.path, x.level, x.first, x.last, list(x.rows.items())] for x in self.later], "added": self.added, "merged": self.merged, "made": self._made})

    def restored(self, text: str) -> BucketStore:
        old = json.loads(text)
        self.base, self.floor = {b: (path, n) for b, path, n in old["base"]}, dict(map(tuple, old["floor"]))
        self.later = [Later(path, level, first, last, dict(map(tuple, rows))) for path, level, first, last, rows in old["later"]]
        self.added, self.merged, self._made = old["added"], old["merged"], old["made"]
        return self

    # -- reading

    def _later_rows(self, buckets: Sequence[int] | None, tables: Sequence[Later] | None = None) -> DataFrame | None:
        """Rows as they came that are in no base yet."""
        parts = []
        for x in self.later if tables is None else tables:
            want = [b for b in x.rows if (buckets is None or b in set(buckets)) and x.last > self.floor.get(b, -1)]
            if want:
                df = self._read(x.path).where(F.col("_bucket").isin(want))
                over = [b for b in want if self.floor.get(b, -1) >= x.first]  # of which some runs are in the base
                if over:
                    floor = F.create_map(*(F.lit(v) for b in over for v in (b, self.floor[b])))
                    df = df.where(F.col("seq.run") > F.coalesce(F.try_element_at(floor, F.col("_bucket")), F.lit(-1)))
                parts.append(df)
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) if parts else None

    def _base_rows(self, buckets: Sequence[int]) -> DataFrame | None:
        by_path: dict[str, list[int]] = {}
        for b in buckets:
            if b in self.base:
                by_path.setdefault(self.base[b][0], []).append(b)
        parts = [self._read(path).where(F.col("_bucket").isin(mine)) for path, mine in by_path.items()]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) if parts else None

    def _folded(self, buckets: Sequence[int]) -> DataFrame | None:
        base, later = self._base_rows(buckets), self._later_rows(buckets)
        drop = lambda df: None if df is None else df.drop("_bucket")
        return drop(base) if later is None else self.fold_in(drop(base), drop(later))

    def known_buckets(self) -> list[int]:
        return sorted({*self.base, *(b for x in self.later for b in x.rows)})

    def keys(self, buckets: Sequence[int]) -> DataFrame | None:
        """The key columns of what these buckets hold; nothing else is read."""
        parts = [df.select(*self.key) for df in (self._base_rows(buckets), self._later_rows(buckets)) if df is not None]
        return reduce(DataFrame.unionAll, parts) if parts else None

    def rows(self, buckets: Sequence[int] | None = None) -> DataFrame | None:
        """Canonical rows, of some buckets or all."""
        chosen = self.known_buckets() if buckets is None else [b for b in buckets if b in set(self.known_buckets())]
        self._settle(chosen)
        open_ = [b for b in chosen if self._waiting(b)]
        settled = [b for b in chosen if b not in set(open_)]
        base = self._base_rows(settled)
        parts = [*([base.drop("_bucket")] if base is not None else []), *([self._folded(open_)] if open_ else [])]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) if parts else None

    def lookup(self, values: Sequence[str], where: Column | None = None) -> DataFrame | None:
        """Canonical rows whose `by` column is one of a few values: only their buckets are read, and of those the row groups that may have them."""
        buckets = sorted({self.bucket_of(v) for v in values} & set(self.known_buckets()))
        if not buckets:
            return None
        self._settle(buckets)
        hit = F.col(self.by).isin(list(dict.fromkeys(values)))
        base, later = self._base_rows(buckets), self._later_rows(buckets)
        base = None if base is None else base.where(hit).drop("_bucket")
        later = None if later is None else later.where(hit).drop("_bucket")
        found = base if later is None else self.fold_in(base, later)
        return found if where is None else found.where(where)

    def lookup_table(self, keys: DataFrame) -> DataFrame | None:
        """Canonical rows for a table of keys (a column named as `by`) of any size: of the keys' buckets, the rows that are asked for are folded and no others."""
        asked = self._bucket(keys.select(self.by).distinct())
        chosen = [r["_bucket"] for r in asked.select("_bucket").distinct().collect()]  # at most `buckets` numbers
        hit = lambda df: None if df is None else df.drop("_bucket").join(asked.select(self.by), self.by, "left_semi")
        base, later = hit(self._base_rows(chosen)), hit(self._later_rows(chosen))
        return base if later is None else self.fold_in(base, later)


def node_store(spark: SparkSession, spec: NodeType, **options) -> BucketStore:
    def fold_in(base: DataFrame | None, later: DataFrame) -> DataFrame:
        later = later.drop("node_key", *(k for k in spec.key if k not in spec.raw))
        return fold(later, spec) if base is None else merge(base, later, spec)

    return BucketStore(spark, ["node_key"], "node_key", fold_in, spec.keyed, **options)


def state_store(spark: SparkSession, spec: NodeType, **options) -> BucketStore:
    """Of states (factloom.plans.states): rows() has united ones, whatever the order of runs."""
    def fold_in(base: DataFrame | None, later: DataFrame) -> DataFrame:
        later = later.drop("seq")
        return united(later if base is None else base.unionByName(later), spec)

    return BucketStore(spark, ["node_key"], "node_key", fold_in, **options)


def edge_store(spark: SparkSession, **options) -> BucketStore:
    def fold_in(base: DataFrame | None, later: DataFrame) -> DataFrame:
        rows = later if base is None else base.drop("confidence").withColumnRenamed("first_seq", "seq").unionByName(later, allowMissingColumns=True)
        return fold_edges(rows.drop("confidence"))

    return BucketStore(spark, EDGE_KEY, "src_key", fold_in, **options)

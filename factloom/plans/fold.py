"""Folding: many observations of an identity into one canonical row, in order of `seq`.

`seq` is any column that can be ordered: a number, or a struct such as (run, rank, row).

Every policy is a minimum or maximum of (order, value) structs, so that parts of an identity can
be folded in any grouping: before the shuffle, by source list, or into a row that is canonical
already. An identity is grouped by its typed columns; its key text is rendered once, at the end.
Differences to a baseline need a second look: the baseline is aggregated first and joined back, so that
only rows which matter are collected. For values of the newest write a window finds where they begin, and united
lists are folded aside.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import MEMORY_SOURCE, account_rank, edge_confidence, key_text
from . import schema as S
from .lineage import cut_lineage
from .prefix import running_sums

LOG = "array<struct<value:string,source:string>>"
#: Entries of a log in one row.
SEGMENT = 1000
#: An identity, and before it a hash of it: sorting and shuffling look at the number first.
_ID = ["_hash", "_identity"]


class MergeConflict(ValueError):
    """Two observations of one identity that must not differ do."""


# -- policies: what a row offers, which offer wins, and where the value lies in it

Policy = tuple[Callable[[str, str], Column], Callable[[Column], Column]]


def _at(c: str, seq: str) -> Column:
    return F.struct(F.col(seq).alias("s"), F.col(c).alias("v"))


def _memory(c: str, seq: str) -> Column:
    """Known values of the memory source come last and win; of others the first wins, so their order is turned round by two fields."""
    return F.when(F.contains(F.lower("derivation"), F.lit(MEMORY_SOURCE)) & F.col(c).isNotNull(), _at(c, seq))


OFFERS: dict[str, Policy] = {
    S.KNOWN: (lambda c, seq: F.when(F.col(c).isNotNull(), _at(c, seq)), F.min),
    S.RANKED: (lambda c, seq: F.struct((-account_rank(F.col(c))).alias("r"), F.col(seq).alias("s"), F.col(c).alias("v")), F.min),
}
OFFERS |= {S.LOGGED: OFFERS[S.KNOWN], S.UNIQUE: OFFERS[S.KNOWN]}
PLAIN: dict[str, tuple[Callable[[str], Column], Callable[[Column], Column]]] = {
    S.LATEST: (F.col, F.max),
    S.EARLIEST: (F.col, F.min),
    S.ANY: (lambda c: F.coalesce(F.col(c), F.lit(False)), F.bool_or),
    S.ALL: (lambda c: F.coalesce(F.col(c), F.lit(True)), F.bool_and),
}


class _Fold:
    """Columns that rows offer, how they are aggregated (once or in steps), and what comes out."""

    def __init__(self) -> None:
        self.offers: dict[str, tuple[Column, Callable[[Column], Column]]] = {}
        self.results: dict[str, Column] = {}

    def add(self, name: str, policy: str, seq: str) -> None:
        if policy in OFFERS:
            offer, how = OFFERS[policy]
            self.offers[f"_{name}"] = offer(name, seq), how
            self.results[name] = F.col(f"_{name}.v")
        elif policy == S.MEMORY:
            self.offers[f"_{name}"] = _memory(name, seq), F.max
            self.offers[f"_f_{name}"] = OFFERS[S.KNOWN][0](name, seq), F.min
            self.results[name] = F.coalesce(F.col(f"_{name}.v"), F.col(f"_f_{name}.v"))
        else:
            offer, how = PLAIN[policy]
            self.offers[f"_{name}"] = offer(name), how
            self.results[name] = F.col(f"_{name}")

    def rows(self) -> list[Column]:
        return [c.alias(n) for n, (c, _) in self.offers.items()]

    def aggregates(self) -> list[Column]:
        return [how(F.col(n)).alias(n) for n, (_, how) in self.offers.items()]


def ordered_union(lists: Column) -> Column:
    """Of (order, list) structs: the first list as it is, then what later ones add, each element once."""
    ordered = F.array_sort(lists)
    head = F.element_at(ordered, 1)["v"]
    return F.concat(head, F.array_except(F.flatten(F.transform(ordered, lambda x: x["v"])), head))


def differs(column: str) -> Column:
    """A known value (an empty string counts as unknown)."""
    return F.when(F.col(column).cast("string") != "", F.col(column))


def planned(columns: list[str], spec: S.NodeType, seq: str = "seq", given: dict[str, Column] | None = None) -> tuple[_Fold, list[str], list[str]]:
    """What rows with these columns offer, the columns that are united, and those that must not differ. Columns in `given` are taken from there."""
    given = given or {}
    present = {c: p for c, (_, p) in spec.columns.items() if c in columns}
    f = _Fold()
    head = [c for c in [*S.PROVENANCE, *spec.raw] if c in columns] + [c for c, p in present.items() if p == S.FIRST]
    f.offers["_head"] = F.struct(F.col(seq).alias("s"), *(c for c in head if c not in given)), F.min
    f.results |= {c: given[c] if c in given else F.col(f"_head.{c}") for c in head}
    for c, p in present.items():
        if p not in (S.NEWEST, S.UNION, S.FIRST):
            f.add(c, p, seq)
    f.offers["first_seq"] = F.col(seq), F.min
    f.offers["n_observations"] = (F.col("n_observations") if "n_observations" in columns else F.lit(1).cast("long")), F.sum
    f.results |= {"first_seq": F.col("first_seq"), "n_observations": F.col("n_observations")}
    unique = [c for c, p in present.items() if p == S.UNIQUE]
    for c in unique:
        f.offers[f"_low_{c}"], f.offers[f"_high_{c}"] = (differs(c), F.min), (differs(c), F.max)
    if unique:
        f.results["conflicts"] = F.array_compact(F.array(*(F.when(F.coalesce(F.col(f"_low_{c}") != F.col(f"_high_{c}"), F.lit(False)), F.lit(c)) for c in unique)))
    return f, [c for c, p in present.items() if p == S.UNION], unique


def fold(obs: DataFrame, spec: S.NodeType, *, strict: bool = True, seq: str = "seq", logs: bool = True) -> DataFrame:
    """One row for each identity. With strict, a conflict of a UNIQUE column fails the job; else it is flagged in `conflicts`.

    Canonical rows may be folded again together with later observations: with `seq` set to their
    first_seq they count as the observations that they stand for (n_observations is added up).
    Rows that carry another node_type are an error. Without logs, types that log differences have none: fold_in_segments() has them as a table.
    """
    obs = guarded(obs, spec.name)
    keyed = obs.withColumns({name: make() for name, (_, make) in spec.key.items()}).withColumns({"_hash": F.xxhash64(*spec.key), "_identity": F.struct(*spec.key)})
    present = {c: p for c, (_, p) in spec.columns.items() if c in obs.columns}
    f, unions, unique = planned(obs.columns, spec, seq, {c: F.col(f"_identity.{k}") for c, k in spec.given().items()})
    if spec.newest_by:
        keyed = anchored(keyed, spec.newest_by, seq)
        for c in (c for c, p in present.items() if p == S.NEWEST):
            f.offers[f"_{c}"] = F.when(F.col(seq) >= F.col("_anchor"), OFFERS[S.KNOWN][0](c, seq)), F.min
            f.results[c] = F.col(f"_{c}.v")
    nodes = keyed.select(*_ID, *f.rows()).groupBy(*_ID).agg(*f.aggregates())
    if unions:
        nodes = nodes.join(united(keyed, unions, seq), _ID, "left")
        f.results |= {c: F.col(f"_u_{c}") for c in unions}
    nodes = nodes.select(*_ID, *(c.alias(n) for n, c in f.results.items()))
    if unique and strict:
        guard = F.assert_true(F.size("conflicts") == 0, F.concat(F.lit("conflicting values of "), F.array_join("conflicts", ", "), F.lit(" for "), F.to_json("_identity")))
        nodes = nodes.where(guard.isNull())
    if spec.logs:
        logged = [c for c, p in present.items() if p == S.LOGGED]
        if logged and logs:
            nodes = nodes.join(disagreements(keyed, nodes.select(*_ID, *logged), logged, seq), _ID, "left")
        else:
            nodes = nodes.withColumn("disagreements", F.lit(None).cast(f"map<string,{LOG}>"))
    keys = [F.col(f"_identity.{k}") for k in spec.key]
    rest = [c for c in nodes.columns if c not in (*_ID, *spec.key)]
    return nodes.select(key_text(spec.name, *keys).alias("node_key"), *keys, *rest, F.lit(spec.name).alias("node_type"))


def united(keyed: DataFrame, columns: list[str], seq: str) -> DataFrame:
    """(identity, _u_ and each column): the lists of an identity's rows, united in order.

    Aside from all other columns: only identity, list and order are shuffled by (identity, list) and then by identity; and
    nothing at all where no united column is asked for, as the optimizer drops an outer join that gives a row one partner at most.
    """
    # Equal lists of an identity are folded first: what is collected is as long as its lists are different.
    lists = [f"_u_{c}" for c in columns]
    rows = keyed.select(*_ID, F.col(seq).alias("_s"), *(F.coalesce(F.col(c), F.array().cast("array<string>")).alias(f"_u_{c}") for c in columns))
    once = rows.groupBy(*_ID, *lists).agg(F.min("_s").alias("_s"))
    return once.groupBy(*_ID).agg(*(ordered_union(F.collect_list(F.struct(F.col("_s").alias("s"), F.col(u).alias("v")))).alias(u) for u in lists))


def guarded(obs: DataFrame, name: str) -> DataFrame:
    """Rows of one node type may not be folded as another: where rows say their type, it must be `name`."""
    if "node_type" not in obs.columns:
        return obs
    wrong = F.concat(F.lit("cannot merge "), F.coalesce(F.col("node_type"), F.lit("null")), F.lit(f" into {name}"))
    return obs.where(F.assert_true(F.coalesce(F.col("node_type") == name, F.lit(False)), wrong).isNull()).drop("node_type")


def foreign(obs: DataFrame, spec: S.NodeType) -> DataFrame:
    """The rows that `fold` would refuse because they say that they are of another type."""
    return obs.where(~F.coalesce(F.col("node_type") == spec.name, F.lit(False)))


def anchored(keyed: DataFrame, by: str, seq: str) -> DataFrame:
    """keyed with _anchor: the order of its identity's first row that has the newest time (of the first row if no time is known).

    What counts from the anchor on is known once all rows of the identity are, so rows are shuffled by identity as they are, once, for
    this and all else that is folded. A hot identity's rows pass one task, which holds them on disk.
    """
    order = F.struct(F.col(by).isNull().alias("unknown"), (-F.unix_micros(F.col(by).cast("timestamp"))).alias("age"), F.col(seq).alias("s"))
    return keyed.withColumn("_anchor", F.min(order).over(Window.partitionBy(*_ID))["s"])


def disagreement_rows(keyed: DataFrame, baseline: DataFrame, columns: list[str], seq: str) -> DataFrame:
    """Long form, one row for each difference: (identity, order, place in the row, field, value, source). Nothing is collected."""
    base = baseline.select(*_ID, *(F.col(c).alias(f"_b_{c}") for c in columns))
    has_own = "disagreements" in keyed.columns
    empty = F.array().cast(LOG)

    def entries(c: str) -> Column:
        found = F.when(F.col(c) != F.col(f"_b_{c}"), F.array(F.struct(F.col(c).cast("string").alias("value"), F.col("derivation").alias("source"))).cast(LOG)).otherwise(empty)
        own = F.coalesce(F.try_element_at(F.col("disagreements"), F.lit(c)), empty) if has_own else empty
        return F.struct(F.lit(c).alias("field"), F.concat(found, own).alias("entries"))

    needed = keyed.select(*_ID, F.col(seq).alias("_s"), *columns, "derivation", *(["disagreements"] if has_own else []))
    rows = needed.join(base, _ID).select(*_ID, "_s", F.explode(F.filter(F.array(*map(entries, columns)), lambda e: F.size(e["entries"]) > 0)).alias("e"))
    return rows.select(*_ID, "_s", F.col("e.field").alias("field"), F.posexplode("e.entries").alias("place", "entry")).select(*_ID, "_s", "place", "field", "entry.value", "entry.source")


def disagreements(keyed: DataFrame, baseline: DataFrame, columns: list[str], seq: str) -> DataFrame:
    """(identity, disagreements): by column the known values that differ from the baseline, with their sources, in order; then what rows brought along.

    A column's log is collected on its own; where logs may outgrow a row, fold_in_segments() has them as a table.
    """
    rows = disagreement_rows(keyed, baseline, columns, seq)
    logs = rows.groupBy(*_ID, "field").agg(F.array_sort(F.collect_list(F.struct("_s", "place", F.struct("value", "source").alias("entry")))).alias("log"))
    logs = logs.select(*_ID, "field", F.transform("log", lambda x: x["entry"]).cast(LOG).alias("log"))
    order = F.array(*map(F.lit, columns))
    per_field = F.array_sort(F.collect_list(F.struct(F.array_position(order, F.col("field")).alias("n"), "field", "log")))
    return logs.groupBy(*_ID).agg(per_field.alias("_f")).select(*_ID, F.map_from_entries(F.transform("_f", lambda x: F.struct(x["field"].alias("key"), x["log"].alias("value")))).alias("disagreements"))


def fold_in_segments(obs: DataFrame, spec: S.NodeType, *, seq: str = "seq", segment: int = SEGMENT) -> tuple[DataFrame, DataFrame]:
    """fold() of a type that logs differences, for identities with logs of any length: nodes without the log but with
    n_disagreements, and the log as a table of bounded rows (node_key, field, segment, entries), at most `segment` entries a row.

    The place of an entry in its log is a running count over parts of the log, so a long one is no single task's.
    """
    obs = guarded(obs, spec.name)
    logged = [c for c, (_, p) in spec.columns.items() if p == S.LOGGED and c in obs.columns]
    nodes = cut_lineage(fold(obs, spec, seq=seq, logs=False), "nodes")
    ids = lambda df: df.withColumns({"_hash": F.xxhash64(*spec.key), "_identity": F.struct(*spec.key)})
    keyed = ids(obs.withColumns({name: make() for name, (_, make) in spec.key.items()}))
    rows = disagreement_rows(keyed, ids(nodes).select(*_ID, *logged), logged, seq)
    named = rows.select(key_text(spec.name, *(F.col(f"_identity.{k}") for k in spec.key)).alias("node_key"), "field", "_s", "place", "value", "source")
    placed = running_sums(named, ["node_key", "field"], ["_s", "place"], {"n": F.lit(1).cast("long")})
    entry = F.struct("n", F.struct("value", "source").alias("entry"))
    kept = placed.groupBy("node_key", "field", F.floor((F.col("n") - 1) / segment).cast("long").alias("segment")).agg(F.array_sort(F.collect_list(entry)).alias("e"))
    segments = cut_lineage(kept.select("node_key", "field", "segment", F.transform("e", lambda x: x["entry"]).alias("entries")), "segments")
    counts = segments.groupBy("node_key").agg(F.sum(F.size("entries")).alias("n_disagreements"))
    out = nodes.drop("disagreements").join(counts, "node_key", "left").withColumn("n_disagreements", F.coalesce("n_disagreements", F.lit(0).cast("long")))
    return out, segments


def canonical_columns(spec: S.NodeType, columns: list[str]) -> list[str]:
    """What of canonical rows goes into a fold together with later observations."""
    return [c for c in [*S.PROVENANCE, *spec.raw, *spec.columns, "n_observations", *(["disagreements"] if spec.logs else [])] if c in columns]


def fold_by_run(obs: DataFrame, spec: S.NodeType, **how) -> DataFrame:
    """Two-level fold: within each run first, then the runs' results in order, as sources that fold on their own are merged."""
    parts = obs.withColumn("_run", F.coalesce("run_id", F.lit("")))
    per_run = fold(parts, replace(spec, key=spec.key | {"k_run": ("string", lambda: F.col("_run"))}), **how)
    return fold(per_run.select(*canonical_columns(spec, per_run.columns), F.col("first_seq").alias("seq")), spec, **how)


def merge(nodes: DataFrame | None, batch: DataFrame, spec: S.NodeType, **how) -> DataFrame:
    """Canonical rows and later observations folded into new canonical rows: a batch costs its own size and that of the nodes, not of all history."""
    if nodes is None:
        return fold(batch, spec, **how)
    old = nodes.select(*canonical_columns(spec, nodes.columns), F.col("first_seq").alias("seq"))
    return fold(old.unionByName(batch, allowMissingColumns=True).withColumn("n_observations", F.coalesce("n_observations", F.lit(1).cast("long"))), spec, **how)


EDGE_KEY = ["src_key", "dst_key", "edge_type", "ts"]


def fold_edges(edges: DataFrame, *, seq: str = "seq", columns: list[str] | None = None) -> DataFrame:
    """One row for each (src_key, dst_key, edge_type, ts), a null time counting as one; lists of confirming sources unite, all else is the first row's.

    Edge types without sources take no list: one that has elements is an error.
    """
    rest = columns if columns is not None else [c for c in edges.columns if c not in (*EDGE_KEY, seq, "confirmed_by", "confidence", "first_seq")]
    multi = "confirmed_by" in edges.columns
    plain = [e.name for e in S.EDGE_TYPES.values() if not e.multi]
    offers = F.struct(F.col(seq).alias("s"), *rest).alias("_r")
    if not multi:
        out = edges.select(*EDGE_KEY, offers).groupBy(*EDGE_KEY).agg(F.min("_r").alias("_r"))
        return out.select(*EDGE_KEY, *(F.col(f"_r.{c}").alias(c) for c in rest), F.col("_r.s").alias("first_seq"))
    wrong = F.col("edge_type").isin(plain) & (F.size("confirmed_by") > 0)
    checked = edges.where(F.assert_true(~F.coalesce(wrong, F.lit(False)), F.concat(F.lit("an edge of type "), F.col("edge_type"), F.lit(" has no confirming sources"))).isNull())
    rows = checked.select(*EDGE_KEY, F.coalesce("confirmed_by", F.array().cast("array<string>")).alias("_u"), offers)
    once = rows.groupBy(*EDGE_KEY, "_u").agg(F.min("_r").alias("_r"))
    out = once.groupBy(*EDGE_KEY).agg(F.min("_r").alias("_r"), F.collect_list(F.struct(F.col("_r.s").alias("s"), F.col("_u").alias("v"))).alias("_l"))
    out = out.select(*EDGE_KEY, *(F.col(f"_r.{c}").alias(c) for c in rest), F.col("_r.s").alias("first_seq"), ordered_union(F.col("_l")).alias("confirmed_by"))
    return out.withColumn("confidence", F.when(~F.col("edge_type").isin(plain), edge_confidence(F.col("confirmed_by"))))


def counters(batch: DataFrame, existing: DataFrame | None, key: str | list[str]) -> DataFrame:
    """(added, merged) of a batch: keys that are new, and rows that met an existing key."""
    keys = [key] if isinstance(key, str) else key
    rows = batch.select(*keys, F.lit(1).alias("n"), F.lit(0).alias("old"))
    if existing is not None:
        rows = rows.unionAll(existing.select(*keys, F.lit(0).alias("n"), F.lit(1).alias("old")))
    flagged = rows.groupBy(*keys).agg(F.sum("n").alias("n"), F.max("old").alias("old"))
    added = F.count_if((F.col("old") == 0) & (F.col("n") > 0))
    return flagged.agg(added.alias("added"), (F.coalesce(F.sum("n"), F.lit(0)) - added).alias("merged"))

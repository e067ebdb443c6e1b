"""The graph: canonical nodes and edges as DataFrames, and the queries on them."""

from __future__ import annotations

import json
from collections.abc import Sequence
from datetime import UTC, datetime
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.filters import BadFilter, all_of, check_ops
from ..functions.text import CONFIDENCE_RANKS, confidence_name, confidence_rank, key_text, utc_text
from ..plans.buckets import BucketStore
from ..plans.lineage import cut_lineage
from ..plans.prefix import running_sums
from ..plans.schema import NODE_TYPES, NodeType

DEFAULT_LIMIT = 100
#: A page of a query's rows goes to the driver: never more than this at once, whatever limit is asked for.
MOST_RETURNED = 10_000
# What a node's summary shows where it has it.
SUMMARY_FIELDS = ("name", "threat_name", "pid", "hostname", "host_hostname", "action_taken", "detection_time")


def resolved_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose two ends exist."""
    keys = nodes.select("node_key").distinct()
    return edges.join(keys.withColumnRenamed("node_key", "src_key"), "src_key", "left_semi").join(keys.withColumnRenamed("node_key", "dst_key"), "dst_key", "left_semi")


def orphan_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with an end that does not exist, and which."""
    keys = nodes.select("node_key").distinct()
    src = keys.select(F.col("node_key").alias("src_key"), F.lit(True).alias("_s"))
    dst = keys.select(F.col("node_key").alias("dst_key"), F.lit(True).alias("_d"))
    marked = edges.join(src, "src_key", "left").join(dst, "dst_key", "left")
    return marked.where("_s is null or _d is null").withColumn("missing_end", F.when(F.col("_s").isNotNull(), "target").when(F.col("_d").isNotNull(), "source").otherwise("both")).drop("_s", "_d")


def endpoint_lint(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose ends are of types that the schema does not name for them. Such edges are allowed; this lists them."""
    from ..plans.schema import EDGE_TYPES

    kinds = nodes.select("node_key", "node_type")
    typed = edges.join(kinds.select(F.col("node_key").alias("src_key"), F.col("node_type").alias("src_type")), "src_key").join(kinds.select(F.col("node_key").alias("dst_key"), F.col("node_type").alias("dst_type")), "dst_key")
    ok = F.lit(False)
    for e in EDGE_TYPES.values():
        ok = ok | ((F.col("edge_type") == e.name) & F.col("src_type").isin(*e.sources) & F.col("dst_type").isin(*e.targets))
    return typed.where(~ok)


def out_edges(edges: DataFrame, keys: DataFrame, edge_type: str | None = None) -> DataFrame:
    return _beside(edges, keys, "src_key", edge_type)


def in_edges(edges: DataFrame, keys: DataFrame, edge_type: str | None = None) -> DataFrame:
    return _beside(edges, keys, "dst_key", edge_type)


def _beside(edges: DataFrame, keys: DataFrame, end: str, edge_type: str | None) -> DataFrame:
    chosen = edges if edge_type is None else edges.where(F.col("edge_type") == edge_type)
    return chosen.join(keys.select(F.col("node_key").alias(end)).distinct(), end, "left_semi")


def touching_edges(edges: DataFrame, keys: DataFrame) -> DataFrame:
    """(node_key, edge columns) for each end of an edge in `keys`; an edge between two of them, or from one to itself, counts at both ends."""
    out = edges.withColumn("node_key", F.col("src_key"))
    into = edges.withColumn("node_key", F.col("dst_key"))
    return out.unionAll(into).join(keys.select("node_key").distinct(), "node_key", "left_semi")


def chains(edges: DataFrame, starts: DataFrame, most_steps: int) -> DataFrame:
    """(start, node_key, depth, n_walks): for each start the nodes at the end of a walk of `depth` steps along edges, and by how
    many walks. Walks may meet a node again; on a tree there is one. A level has a row a start and node, however many walks there are.

    Each level is written down, so that the next one starts from it instead of walking there again.
    """
    step = cut_lineage(edges.select("src_key", "dst_key").distinct(), "steps")
    one = F.lit(1).cast("decimal(38,0)")
    front = starts.select(F.col("node_key").alias("start"), "node_key").distinct().select("start", "node_key", F.lit(0).alias("depth"), one.alias("n_walks"))
    found = front
    for depth in range(1, most_steps + 1):
        on = front.join(step, front["node_key"] == step["src_key"]).groupBy("start", F.col("dst_key").alias("node_key")).agg(F.sum("n_walks").cast("decimal(38,0)").alias("n_walks"))
        front = cut_lineage(on.select("start", "node_key", F.lit(depth).alias("depth"), "n_walks"), f"level{depth}")
        if front.isEmpty():
            break
        found = found.unionAll(front)
    return found


def unfolded(edges: DataFrame, levels: DataFrame, ends: DataFrame) -> DataFrame:
    """(start, node_key, depth, path): the paths without a repeated node that lead to asked ends (start, node_key, depth) of chains().

    Goes back from the ends over the levels, so only walks that end where it was asked are ever laid out.
    """
    step = cut_lineage(edges.select("src_key", "dst_key").distinct(), "steps")
    held = cut_lineage(levels.select("start", "node_key", "depth"), "levels")
    front = ends.select("start", "node_key", "depth").distinct().join(held, ["start", "node_key", "depth"], "left_semi")
    front = front.select("start", "node_key", "depth", F.col("depth").alias("at"), F.col("node_key").alias("head"), F.array("node_key").alias("path"))
    done = front.where("at = 0 and head = start")
    front = front.where("at > 0")
    while not front.isEmpty():
        back = front.join(step, front["head"] == step["dst_key"]).where(~F.array_contains("path", F.col("src_key")))
        back = back.select("start", "node_key", "depth", (F.col("at") - 1).alias("at"), F.col("src_key").alias("head"), F.concat(F.array("src_key"), "path").alias("path"))
        near = held.select("start", F.col("node_key").alias("head"), F.col("depth").alias("at"))
        front = cut_lineage(back.join(near, ["start", "head", "at"], "left_semi"), "back")
        done = done.unionByName(front.where("at = 0 and head = start"))
        front = front.where("at > 0")
    return done.select("start", "node_key", "depth", "path")


def walk(edges: DataFrame, starts: DataFrame, most_steps: int) -> DataFrame:
    """Paths (start, node_key, depth, path) along edges from starts, without meeting a node twice, up to most_steps: all of
    them, so as many as there are; chains() has a row a node and level.

    Paths grow forward by one join a step. A level is written once and is part of the result, so nothing is laid out that is not asked for.
    """
    step = cut_lineage(edges.select("src_key", "dst_key").distinct(), "steps")
    first = starts.where("node_key is not null").select(F.col("node_key").alias("start"), "node_key").distinct()
    front = first.select("start", "node_key", F.lit(0).alias("depth"), F.array("node_key").alias("path"))
    found = front
    for depth in range(1, most_steps + 1):
        on = front.join(step, front["node_key"] == step["src_key"]).where(~F.array_contains("path", F.col("dst_key")))
        front = cut_lineage(on.select("start", F.col("dst_key").alias("node_key"), F.lit(depth).alias("depth"), F.concat("path", F.array("dst_key")).alias("path")), f"walk{depth}")
        if front.isEmpty():
            break
        found = found.unionAll(front)
    return found


def neighbourhood(edges: DataFrame, starts: DataFrame, most_steps: int) -> DataFrame:
    """(start, node_key, depth): nodes within most_steps of starts in either direction, at their least distance."""
    both = cut_lineage(edges.select("src_key", "dst_key").unionAll(edges.select(F.col("dst_key").alias("src_key"), F.col("src_key").alias("dst_key"))).distinct(), "steps")
    front = starts.select(F.col("node_key").alias("start"), "node_key", F.lit(0).alias("depth")).distinct()
    seen = front
    for depth in range(1, most_steps + 1):
        near = front.join(both, front["node_key"] == both["src_key"]).select("start", F.col("dst_key").alias("node_key")).distinct()
        front = cut_lineage(near.join(seen.select("start", "node_key"), ["start", "node_key"], "left_anti").withColumn("depth", F.lit(depth)), f"level{depth}")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def paths_between(edges: DataFrame, pairs: DataFrame, most_steps: int = 8) -> DataFrame:
    """(start, goal, depth, path): for each pair (start, goal) a shortest path along edges, the first in order if there are several.

    Searches meet in the middle: levels go forward from the starts and back from the goals, the shorter front first, and are
    shared by all pairs with the same start or goal. A pair has met once a node is in the newest levels of both;
    then its shortest paths are those from level to level, of which one node a step is followed. Joins are by shuffles at any size,
    as there are some for each level, and a broadcast passes the driver.
    """
    step = cut_lineage(edges.select("src_key", "dst_key").distinct(), "steps")
    back = step.select(F.col("dst_key").alias("src_key"), F.col("src_key").alias("dst_key"))
    open_ = cut_lineage(pairs.select("start", "goal").distinct(), "pairs")
    ways = {"start": step, "goal": back}
    levels = {side: [cut_lineage(open_.select(side, F.col(side).alias("node_key")).distinct(), f"{side}0")] for side in ways}
    seen = {side: levels[side][0] for side in ways}
    sizes = {side: levels[side][0].count() for side in ways}
    met_at: list[tuple[int, int, DataFrame]] = []
    for depth in range(most_steps + 1):
        if depth:
            side = min(ways, key=lambda s: (sizes[s], s != "start"))
            front = levels[side][-1].join(open_.select(side).distinct().hint("merge"), side, "left_semi")
            on = front.join(ways[side].hint("merge"), front["node_key"] == ways[side]["src_key"]).select(side, F.col("dst_key").alias("node_key")).distinct()
            new = cut_lineage(on.join(seen[side].hint("merge"), [side, "node_key"], "left_anti"), f"{side}{len(levels[side])}")
            levels[side].append(new)
            seen[side] = seen[side].unionByName(new)
            sizes[side] = new.count()
        met = open_.join(levels["goal"][-1].hint("merge"), "goal").join(levels["start"][-1].hint("merge"), ["start", "node_key"]).select("start", "goal", "node_key").distinct()
        met = cut_lineage(met, f"met{depth}")
        met_at.append((len(levels["start"]) - 1, len(levels["goal"]) - 1, met))
        open_ = cut_lineage(open_.join(met.select("start", "goal").distinct().hint("merge"), ["start", "goal"], "left_anti"), f"open{depth}")
        if not min(sizes.values()) or open_.isEmpty():
            break
    return reduce(DataFrame.unionByName, [_first_paths(step, levels, *m) for m in met_at])


def _first_paths(step: DataFrame, levels: dict[str, list[DataFrame]], forward: int, backward: int, met: DataFrame) -> DataFrame:
    """Of pairs that met (start, goal, node_key) after so many levels, the first of their shortest paths."""
    # From the meetings back to the start: which nodes of each level lead to one.
    leads = [met]
    for i in range(forward - 1, -1, -1):
        last = leads[-1]
        near = last.join(step.hint("merge"), last["node_key"] == step["dst_key"]).select("start", "goal", F.col("src_key").alias("node_key")).distinct()
        leads.append(cut_lineage(near.join(levels["start"][i].hint("merge"), ["start", "node_key"], "left_semi"), f"leads{i}"))
    leads.reverse()
    at = leads[0].select("start", "goal", "node_key", F.array("node_key").alias("path"))
    for i in range(1, forward + 1):
        at = _smallest_step(at, step, leads[i], ["start", "goal", "node_key"])
    for i in range(backward - 1, -1, -1):
        at = _smallest_step(at, step, levels["goal"][i], ["goal", "node_key"])
    return at.select("start", "goal", F.lit(forward + backward).alias("depth"), "path")


def _smallest_step(at: DataFrame, step: DataFrame, into: DataFrame, key: list[str]) -> DataFrame:
    """One step on, to the smallest node of a level; a row a pair, before and after."""
    on = at.join(step.hint("merge"), at["node_key"] == step["src_key"]).select("start", "goal", "path", F.col("dst_key").alias("node_key")).join(into.hint("merge"), key, "left_semi")
    chosen = on.groupBy("start", "goal").agg(F.min("node_key").alias("node_key"), F.any_value("path").alias("path"))
    return cut_lineage(chosen.select("start", "goal", "node_key", F.array_append("path", F.col("node_key")).alias("path")), "path")


def timeline(edges: DataFrame, start: Column, end: Column) -> DataFrame:
    return edges.where((F.col("ts") >= start) & (F.col("ts") < end)).orderBy("ts", "src_key", "dst_key", "edge_type")


def stated(edges: DataFrame, subject: Column, edge_type: str, target: Column, start: Column, end: Column) -> DataFrame:
    """Whether an edge of that type between two nodes exists in a time window, and how many do."""
    hit = edges.where((F.col("src_key") == subject) & (F.col("dst_key") == target) & (F.col("edge_type") == edge_type) & (F.col("ts") >= start) & (F.col("ts") < end))
    return hit.agg((F.count("*") > 0).alias("found"), F.count("*").alias("n_edges"))


def verify_claims(edges: DataFrame, claims: DataFrame) -> DataFrame:
    """claims (claim_id, subject, predicate, object, start, end), an open time being null, with found, n_edges and the best confidence.

    Edges of a triple are counted in order of time, by confidence; a claim is what the count has come to before its end less what it
    had before its start. So a claim costs two rows in that order, however many edges its triple has. Edges
    without a time count where both times are open. A null in a claim's triple finds nothing.
    """
    triple = ["subject", "predicate", "object"]
    c = claims.select("claim_id", *triple, "start", "end")
    e = edges.select(F.col("src_key").alias("subject"), F.col("edge_type").alias("predicate"), F.col("dst_key").alias("object"), F.col("ts").cast("timestamp").alias("at"), confidence_rank(F.col("confidence")).alias("rank"))
    e = e.join(c.select(*triple).distinct(), triple, "left_semi")
    # Order: by reach (a time; behind all times; no time; behind everything), time, and what is asked before what is counted.
    edge = e.select(*triple, F.when(F.col("at").isNull(), 2).otherwise(0).alias("reach"), "at", F.lit(1).alias("turn"), F.lit(None).cast(c.schema["claim_id"].dataType).alias("claim_id"), F.lit(0).alias("sign"), "rank")
    asked = c.where("subject is not null and predicate is not null and object is not null")
    bound = lambda rows, reach, at, sign: rows.select(*triple, reach.alias("reach"), at.cast("timestamp").alias("at"), F.lit(0).alias("turn"), "claim_id", F.lit(sign).alias("sign"), F.lit(None).cast("int").alias("rank"))
    until = F.when(F.col("end").isNotNull(), 0).when(F.col("start").isNotNull(), 1).otherwise(3)
    ends = bound(asked, until, F.col("end"), 1)
    starts = bound(asked.where("start is not null"), F.lit(0), F.col("start"), -1)
    counted = F.col("turn") == 1
    sums = {"n_any": counted.cast("long")} | {f"n_{r}": (counted & F.coalesce(F.col("rank") == r, F.lit(False))).cast("long") for r in CONFIDENCE_RANKS.values()}
    placed = running_sums(edge.unionByName(ends).unionByName(starts), triple, ["reach", "at", "turn"], sums)
    per = placed.where("turn = 0").groupBy("claim_id").agg(*(F.sum(F.col("sign") * F.col(n)).alias(n) for n in sums))
    # A window that ends before it starts holds nothing.
    some = lambda n: F.coalesce(F.greatest(F.col(n), F.lit(0)), F.lit(0))
    best = reduce(lambda found, r: F.when(some(f"n_{r}") > 0, F.lit(r)).otherwise(found), sorted(CONFIDENCE_RANKS.values()), F.lit(None).cast("int"))
    out = c.join(per, "claim_id", "left")
    return out.select("claim_id", *triple, (some("n_any") > 0).alias("found"), some("n_any").alias("n_edges"), confidence_name(best).alias("confidence"))


def known(keys: DataFrame, nodes: DataFrame) -> DataFrame:
    """keys (node_key, ...) with `known`: whether the graph has the node."""
    have = nodes.select("node_key").distinct().withColumn("known", F.lit(True))
    return keys.join(have, "node_key", "left").withColumn("known", F.coalesce("known", F.lit(False)))


def summaries(nodes: DataFrame, spec: NodeType, *beside: str) -> DataFrame:
    """node_key, node_type, evidence_hash, identity and display fields of canonical nodes; times as ISO text."""
    shown = dict.fromkeys([*spec.key, *(c for c in SUMMARY_FIELDS if c in nodes.columns)])
    as_text = lambda c: utc_text(F.col(c)).alias(c) if nodes.schema[c].dataType.typeName() == "timestamp" else F.col(c)
    return nodes.select(*beside, "node_key", F.lit(spec.name).alias("node_type"), "evidence_hash", *map(as_text, shown))


def matched(nodes: DataFrame, where: Column, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """(total_matched, returned, truncated) of a query with a limit."""
    n = F.count("*")
    return nodes.where(where).agg(n.alias("total_matched"), F.least(n, F.lit(limit).cast("long")).alias("returned"), (n > limit).alias("truncated"))


def totals(**tables: DataFrame | None) -> DataFrame:
    """One row: how many rows each table has, in one pass over all; a table that is not there has none."""
    ones = [df.select(F.lit(name).alias("what")) for name, df in tables.items() if df is not None]
    if not ones:
        return None
    return reduce(DataFrame.unionAll, ones).agg(*(F.count_if(F.col("what") == name).alias(name) for name in tables))


class Graph:
    """Canonical nodes by type, and edges. Immutable: each ingest makes a new one.

    Where bucketed stores stand behind the tables, look-ups by key read the buckets of the keys alone.
    """

    def __init__(self, nodes: dict[str, DataFrame], edges: DataFrame | None = None, stores: dict[str, BucketStore] | None = None) -> None:
        self.by_type, self.edges, self.stores = nodes, edges, stores or {}

    def nodes(self) -> DataFrame | None:
        """node_key, node_type, first_seq, evidence_hash, derivation, observed_at of all nodes."""
        parts = [df.select("node_key", "node_type", "first_seq", "evidence_hash", "derivation", "observed_at", (F.size("disagreements") > 0 if "disagreements" in df.columns else F.lit(False)).alias("disputed")) for df in self.by_type.values()]
        out = None
        for p in parts:
            out = p if out is None else out.unionByName(p)
        return out

    def find(self, node_type: str | None, where: Column | None = None) -> list[DataFrame]:
        frames = [df for name, df in self.by_type.items() if node_type in (None, name)]
        return [df.where(where) if where is not None else df for df in frames]

    def nodes_of(self, keys: Sequence[str]) -> dict[str, DataFrame]:
        """By type the rows of a few keys. A key's text names its type, so no other type is looked at."""
        by_type: dict[str, list[str]] = {}
        for key in dict.fromkeys(keys):
            if (kind := type_of(key)) in self.by_type:
                by_type.setdefault(kind, []).append(key)
        found = {}
        for kind, mine in by_type.items():
            if kind not in self.stores:
                found[kind] = self.by_type[kind].where(F.col("node_key").isin(mine))
            elif (rows := self.stores[kind].lookup(mine)) is not None:
                found[kind] = rows
        return found

    def has_node(self, key: str) -> bool:
        return any(df.limit(1).count() > 0 for df in self.nodes_of([key]).values())

    def get_node(self, key: str) -> dict:
        for df in self.nodes_of([key]).values():
            if row := df.first():
                return row.asDict(recursive=True)
        raise KeyError(key)

    def outgoing_edges(self, key: str, edge_type: str | None = None) -> DataFrame:
        return self._edges_at(key, edge_type, "src_key")

    def incoming_edges(self, key: str, edge_type: str | None = None) -> DataFrame:
        return self._edges_at(key, edge_type, "dst_key")

    def _edges_at(self, key: str, edge_type: str | None, end: str) -> DataFrame:
        if not self.has_node(key):
            raise KeyError(key)
        rows = self.stores["edges"].lookup([key]) if end == "src_key" and "edges" in self.stores else self.edges
        found = (self.edges.limit(0) if rows is None else rows).where(F.col(end) == key)
        return found if edge_type is None else found.where(F.col("edge_type") == edge_type)

    def counts(self) -> tuple[int, int]:
        """Nodes and edges."""
        row = totals(nodes=self.nodes(), edges=self.edges)
        row = row.first() if row is not None else {"nodes": 0, "edges": 0}
        return row["nodes"], row["edges"]

    def node_count(self) -> int:
        return self.counts()[0]

    def edge_count(self) -> int:
        return self.counts()[1]

    def matches(self, node_type: str | None = None, filters: Sequence[dict] | None = None, *, coerce_temporal: bool = False) -> DataFrame | None:
        """All matches of a query, however many, as a table: first_seq, node_key, node_type, evidence_hash, and the display fields as JSON."""
        filters = list(filters or [])
        check_ops(filters)
        parts = []
        for name, df in self.by_type.items():
            if node_type in (None, name):
                typed = df.withColumn("node_type", F.lit(name))
                shown = summaries(typed.where(all_of(typed, filters, coerce_temporal=coerce_temporal)).select(*df.columns), NODE_TYPES[name], "first_seq")
                fields = [c for c in shown.columns if c not in ("first_seq", "node_key", "node_type", "evidence_hash")]
                parts.append(shown.select("first_seq", "node_key", "node_type", "evidence_hash", F.to_json(F.struct(*fields)).alias("fields")))
        return reduce(DataFrame.unionAll, parts) if parts else None

    def query(self, node_type: str | None = None, filters: Sequence[dict] | None = None, limit: int = DEFAULT_LIMIT, *, coerce_temporal: bool = False, after: Sequence | None = None) -> dict:
        """Filters over canonical nodes: a page of the first `limit` matches by arrival (at most MOST_RETURNED, as
        they go to the driver), and how many match in all. `next` of a page that leaves some out is the `after` of the
        following one. One job a node type: matches are counted as they pass on their way to the first ones."""
        filters = list(filters or [])
        try:
            check_ops(filters)
        except BadFilter as e:
            return {"status": "error", "error": "bad_filter_op", "message": str(e)}
        total, rows, most = 0, [], min(max(0, limit), MOST_RETURNED)
        for name, df in self.by_type.items():
            if node_type not in (None, name):
                continue
            typed = df.withColumn("node_type", F.lit(name))
            hit = typed.where(all_of(typed, filters, coerce_temporal=coerce_temporal))
            shown = ["node_key", "node_type", "evidence_hash", "first_seq", *NODE_TYPES[name].key, *(c for c in SUMMARY_FIELDS if c in df.columns)]
            counted = Observation()
            seen = hit.select(*dict.fromkeys(shown)).observe(counted, F.count("*").alias("n"))
            left = seen if after is None else seen.where(F.struct("first_seq", "node_key") > self._place(df, after))
            rows += left.orderBy("first_seq", "node_key").limit(max(1, most + 1)).collect()
            total += counted.get["n"]
        rows = sorted(rows, key=lambda r: (r["first_seq"], r["node_key"]))
        more, rows = len(rows) > most, rows[:most]
        nodes = [summary(r.asDict()) for r in rows]
        out = {"status": "ok", "node_type": node_type, "filters_applied": filters, "total_matched": total, "returned": len(nodes), "truncated": total > len(nodes), "nodes": nodes}
        if more and rows:
            last = rows[-1]["first_seq"]
            out["next"] = [*(last if isinstance(last, tuple) else (last,)), rows[-1]["node_key"]]
        return out

    @staticmethod
    def _place(df: DataFrame, after: Sequence) -> Column:
        """The place in the order of arrival that `next` of a page names."""
        kind = df.schema["first_seq"].dataType
        *seq, key = after
        if isinstance(kind, StructType):
            first = F.struct(*(F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(seq, kind, strict=True)))
        else:
            first = F.lit(seq[0]).cast(kind)
        return F.struct(first.alias("first_seq"), F.lit(key).alias("node_key"))


def type_of(key: str | None) -> str | None:
    """The node type that a key's text begins with."""
    try:
        found = json.loads(key)
    except (TypeError, ValueError):
        return None
    return found.get("t") if isinstance(found, dict) else None


def node_key_of(spark: SparkSession, key: str | Sequence) -> str | None:
    """A node's key from its identity as a list, [type, ...]: each element is read by the type that the
    schema gives its position, so that a name which looks like a time stays a name. None if it cannot be read."""
    if isinstance(key, str):
        return key
    spec = NODE_TYPES.get(key[0]) if key else None
    if spec is None or len(key) != len(spec.key) + 1:
        return None
    values = []
    for value, (kind, _) in zip(key[1:], spec.key.values(), strict=True):
        try:
            if value is None or kind == "string" and isinstance(value, str):
                values.append(value)
            elif kind == "timestamp":
                values.append(value if isinstance(value, datetime) else datetime.fromisoformat(value))
            elif kind in ("int", "long") and isinstance(value, int):
                values.append(value)
            elif kind.startswith("decimal"):
                values.append(Decimal(value))
            else:
                return None
        except (TypeError, ValueError, ArithmeticError):
            return None
    ddl = ", ".join(f"`{name}` {kind}" for name, (kind, _) in spec.key.items())
    return spark.createDataFrame([tuple(values)], ddl).select(key_text(spec.name, *(F.col(c) for c in spec.key))).first()[0]


def plain(value: object) -> object:
    """A time as ISO text in UTC (times without a zone are the driver's local ones, as collect() gives them)."""
    return value.astimezone(UTC).isoformat() if isinstance(value, datetime) else value


def summary(row: dict) -> dict:
    """Compact and JSON-safe: identity as a list, type, source, and display fields that are known."""
    spec = NODE_TYPES[row["node_type"]]
    out = {"canonical_key": [spec.name, *(plain(row[k]) for k in spec.key)], "node_key": row["node_key"], "node_type": spec.name, "evidence_hash": row["evidence_hash"], "first_seq": list(row["first_seq"]) if isinstance(row["first_seq"], tuple) else row["first_seq"]}
    return out | {c: plain(row[c]) for c in SUMMARY_FIELDS if row.get(c) is not None}

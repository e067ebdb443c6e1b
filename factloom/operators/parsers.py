"""Records to observations: detections, processes, parent relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import key_text, parse_time

# Fixed values.
DETECTION_EVENTS = (1116, 1117, 1118, 1119, 5001)
UNKNOWN_HASH = "f" * 64
DETECTION_RECORD = "event_id int, time_created string, computer string, threat_name string, action string, file_path string, _record_id long, _evidence_hash string, _derivation string, seq long"
PROCESS_RECORD = "pid long, name string, image_path string, command_line string, parent_pid long, start_time string, exit_time string, _evidence_hash string, _derivation string, _host_hostname string, seq long"
RELATION_RECORD = "parent_pid long, child_pid long, child_start_time string, _evidence_hash string, _derivation string, _host_hostname string, seq long"


def derivation(source_type: str, name: str | None) -> Column:
    return F.concat_ws(" ", F.lit(source_type), F.lit(name).cast("string"))


def with_provenance(records: DataFrame, evidence_hash: str, text: Column) -> DataFrame:
    """Fills in where records come from; what a record says itself wins."""
    own = lambda c, v: F.coalesce(F.col(c), v) if c in records.columns else v
    return records.withColumn("_evidence_hash", own("_evidence_hash", F.lit(evidence_hash))).withColumn("_derivation", own("_derivation", text))


def is_detection(event_id: str = "event_id") -> Column:
    return F.coalesce(F.col(event_id).isin(*DETECTION_EVENTS), F.lit(False))


def detections(records: DataFrame, observed_at: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(observations, stats). Records of other events are counted; detections that lack a required field are dropped and counted as malformed."""
    at = parse_time(F.col("time_created")) if dict(records.dtypes)["time_created"] == "string" else F.col("time_created")
    good = is_detection() & at.isNotNull() & F.col("computer").isNotNull() & F.col("threat_name").isNotNull()
    marked = records.withColumn("_at", at).withColumn("_good", good)
    observations = marked.where("_good").select(
        F.coalesce("_evidence_hash", F.lit(UNKNOWN_HASH)).alias("evidence_hash"), F.coalesce("_derivation", F.lit("defender")).alias("derivation"),
        (observed_at if observed_at is not None else F.current_timestamp()).alias("observed_at"),
        F.col("computer").alias("host_hostname"), F.col("event_id").cast("int").alias("event_id"), F.col("_at").alias("detection_time"), "threat_name",
        F.col("action").alias("action_taken"), "file_path", "seq",
    )
    return observations, skip_stats(marked)


def skip_stats(marked: DataFrame) -> DataFrame:
    """Skipped and malformed records, and the distinct skipped event ids by first appearance. Ids are aggregated before they are listed."""
    per_id = marked.groupBy("event_id").agg(F.count_if(~is_detection()).alias("skipped"), F.count_if(is_detection() & ~F.col("_good")).alias("malformed"), F.min(F.when(~is_detection(), F.col("seq"))).alias("at"))
    ids = F.transform(F.array_sort(F.collect_list(F.when((F.col("skipped") > 0) & F.col("event_id").isNotNull(), F.struct("at", "event_id")))), lambda x: x["event_id"])
    return per_id.agg(F.coalesce(F.sum("skipped"), F.lit(0)).alias("skipped_event_count"), ids.alias("skipped_event_ids"), F.coalesce(F.sum("malformed"), F.lit(0)).alias("malformed_count"))


def process_observations(records: DataFrame, plugin: str, rank: int, observed_at: Column | None = None) -> DataFrame:
    """Process observations of one listing plugin; rows without a required field are dropped. seq becomes (rank, row): plugins first, rows second."""
    required = ["_evidence_hash", "_derivation", "_host_hostname", "pid", "name"]
    usable = records.where(" and ".join(f"`{c}` is not null" for c in required) + " and pid >= 0")
    ts = lambda c: parse_time(F.col(c)) if dict(records.dtypes)[c] == "string" else F.col(c)
    return usable.select(
        F.col("_evidence_hash").alias("evidence_hash"), F.col("_derivation").alias("derivation"), (observed_at if observed_at is not None else F.current_timestamp()).alias("observed_at"),
        F.col("_host_hostname").alias("host_hostname"), "pid", ts("start_time").alias("start_time"), "name", "image_path", "command_line", "parent_pid", ts("exit_time").alias("exit_time"),
        F.array(F.lit(plugin)).alias("observed_by"), F.lit(plugin).alias("_plugin"), F.struct(F.lit(rank).alias("rank"), F.col("seq").cast("long").alias("row")).alias("seq"),
    )


def plugin_counts(observations: DataFrame, identity: list[str]) -> DataFrame:
    """How many identities each plugin was the first to name."""
    return observations.groupBy(*identity).agg(F.min_by("_plugin", "seq").alias("plugin")).groupBy("plugin").agg(F.count("*").alias("n_new"))


def spawned(relations: DataFrame, processes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, stats): parent to child edges from process-tree rows.

    The child is the process of that host, pid and start. The parent is the latest process of its
    pid on the host that started no later than the child; an unknown start counts as earliest.
    A busy pid costs sorts of its time buckets, not a product.
    """
    start = parse_time(F.col("child_start_time")) if dict(relations.dtypes)["child_start_time"] == "string" else F.col("child_start_time")
    rel = relations.where("child_pid is not null and parent_pid is not null and _host_hostname is not null").select(F.col("_host_hostname").alias("host"), "parent_pid", "child_pid", start.alias("child_start"), "_evidence_hash", "_derivation", "seq")
    nodes = processes.select(F.col("host_hostname").alias("host"), "pid", "start_time", F.col("node_key").alias("child_key"))
    child = rel.join(nodes, (rel["host"] == nodes["host"]) & (rel["child_pid"] == nodes["pid"]) & rel["child_start"].eqNullSafe(nodes["start_time"])).select(rel["*"], "child_key")
    edges = as_of_parent(child, processes).where("src_key is not null").select("src_key", F.col("child_key").alias("dst_key"), F.lit("Spawned").alias("edge_type"), F.col("child_start").alias("ts"), F.array(F.lit("pstree")).alias("confirmed_by"), F.col("_evidence_hash").alias("evidence_hash"), F.col("_derivation").alias("derivation"), "seq")
    one = relations.select(F.lit(1).alias("r"), F.lit(0).alias("e")).unionAll(edges.select(F.lit(0), F.lit(1)))
    stats = one.agg(F.coalesce(F.sum("r"), F.lit(0)).alias("n_relations"), F.coalesce(F.sum("e"), F.lit(0)).alias("n_edges"))
    stats = stats.withColumn("failures", F.col("n_relations") - F.col("n_edges"))
    return edges, stats


#: Seconds of a time bucket of the as-of join.
BUCKET = 86_400


def as_of_parent(children: DataFrame, processes: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """children (host, parent_pid, child_start, ...) with src_key: the parent as of child_start (the latest of all if that is null).

    Both sides are laid in one sequence per (host, pid) and time bucket. What a bucket hands on to
    later ones is its last process alone, so that a busy pid is as many tasks as it has buckets.
    """
    low = F.lit("0001-01-01 00:00:00").cast("timestamp")
    high = F.lit("9999-12-31 23:59:59").cast("timestamp")
    rest = [c for c in children.columns]
    left = children.select(F.col("host").alias("_h"), F.col("parent_pid").alias("_p"), F.coalesce(F.col("child_start").cast("timestamp"), high).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast("string").alias("_key"), F.struct(*rest).alias("_row"))
    right = processes.where(F.col("host_hostname").isNotNull() & F.col("pid").isNotNull()).select(F.col("host_hostname").alias("_h"), F.col("pid").alias("_p"), F.coalesce(F.col("start_time").cast("timestamp"), low).alias("_t"), F.lit(0).alias("_side"), F.col("node_key").alias("_key"), F.lit(None).cast(left.schema["_row"].dataType).alias("_row"))
    number = F.floor(F.unix_seconds("_t") / bucket).alias("_b")
    every = left.unionByName(right).select("*", number)
    within = Window.partitionBy("_h", "_p", "_b").orderBy("_t", "_side", "_key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = every.withColumn("_near", F.last("_key", ignorenulls=True).over(within)).where("_side = 1")
    last = F.max(F.when(F.col("_side") == 0, F.struct("_t", "_key")))["_key"]
    before = Window.partitionBy("_h", "_p").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = every.groupBy("_h", "_p", "_b").agg(last.alias("_last")).withColumn("_far", F.last("_last", ignorenulls=True).over(before)).where("_far is not null").select("_h", "_p", "_b", "_far")
    return found.join(carried, ["_h", "_p", "_b"], "left").select("_row.*", F.coalesce("_near", "_far").alias("src_key"))


def process_key(host: Column, pid: Column, start: Column) -> Column:
    return key_text("Process", host, pid, start)

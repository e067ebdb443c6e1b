"""Named anomaly queries. Judgements are queries over nodes and edges, never stored columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import base_name, is_private_ipv4
from .graph import walk

# Where Windows keeps these programs, from its public documentation.
KNOWN_PROGRAMS = {
    "csrss.exe": "c:/windows/system32",
    "explorer.exe": "c:/windows",
    "lsass.exe": "c:/windows/system32",
    "msedge.exe": "c:/program files (x86)/microsoft/edge/application",
    "services.exe": "c:/windows/system32",
    "smss.exe": "c:/windows/system32",
    "spoolsv.exe": "c:/windows/system32",
    "svchost.exe": "c:/windows/system32",
    "taskhostw.exe": "c:/windows/system32",
    "wininit.exe": "c:/windows/system32",
    "winlogon.exe": "c:/windows/system32",
}


def parents_of(children: DataFrame, edges: DataFrame, nodes: DataFrame, edge_type: str = "Spawned") -> DataFrame:
    """Children with their parents' columns (prefix parent_)."""
    up = edges.where(F.col("edge_type") == edge_type).select("src_key", F.col("dst_key").alias("node_key"), F.col("ts").alias("spawned_at"))
    parent = nodes.select(*(F.col(c).alias("src_key" if c == "node_key" else f"parent_{c}") for c in nodes.columns))
    return children.join(up, "node_key").join(parent, "src_key").withColumnRenamed("src_key", "parent_key")


def execution_chains(edges: DataFrame, starts: DataFrame, most_steps: int = 8) -> DataFrame:
    """Paths along Executed and Spawned edges from tasks, users or services."""
    return walk(edges.where(F.col("edge_type").isin("Executed", "Spawned")), starts, most_steps)


def masquerading(processes: DataFrame, known: dict[str, str] | None = None) -> DataFrame:
    """Processes named like a known program whose image has another name or lies elsewhere."""
    name, path = F.lower("name"), F.lower(F.translate("image_path", "\\", "/"))
    place = F.lit(None).cast("string")
    for program, folder in (KNOWN_PROGRAMS if known is None else known).items():
        place = F.when(name == program, F.lit(folder)).otherwise(place)
    folder = F.regexp_replace(path, "/[^/]*$", "")
    return processes.withColumn("expected_folder", place).where(place.isNotNull() & F.col("image_path").isNotNull() & ((base_name(F.col("image_path")) != name) | (folder != place)))


def service_mismatch(services: DataFrame) -> DataFrame:
    """Services whose program is not called like the service."""
    stem = F.regexp_replace(base_name(F.col("image_path")), r"\.[^.]*$", "")
    return services.where(F.col("image_path").isNotNull() & (stem != F.lower("service_name"))).withColumn("image_stem", stem)


def absent_files(files: DataFrame) -> DataFrame:
    """Files that other artifacts name but that no file system showed."""
    return files.where(~F.col("on_disk") & (F.size("referenced_by") > 0))


def references_to_absent(edges: DataFrame, files: DataFrame) -> DataFrame:
    gone = files.where(~F.col("on_disk")).select(F.col("node_key").alias("dst_key"), "full_path")
    return edges.where("edge_type = 'References'").join(gone, "dst_key")


def lateral_movement(processes: DataFrame, edges: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Processes connected to an internal endpoint whose address stands in their command line."""
    internal = endpoints.where(F.col("is_internal") | F.coalesce(is_private_ipv4(F.col("remote_addr")), F.lit(False))).select(F.col("node_key").alias("dst_key"), "remote_addr", "remote_port")
    link = edges.where("edge_type = 'Connected'").select("src_key", "dst_key")
    return processes.withColumnRenamed("node_key", "src_key").join(link, "src_key").join(internal, "dst_key").where(F.contains("command_line", F.col("remote_addr")))


def hidden(nodes: DataFrame, seen_by: str, not_by: str) -> DataFrame:
    """Nodes that one source saw and another, which should have, did not."""
    return nodes.where(F.array_contains("observed_by", seen_by) & ~F.array_contains("observed_by", not_by))


def repeated_detections(detections: DataFrame, least: int = 2) -> DataFrame:
    return detections.groupBy("host_hostname", "threat_name").agg(F.count("*").alias("n_detections"), F.min("detection_time").alias("first_time"), F.max("detection_time").alias("last_time")).where(F.col("n_detections") >= least)


def private_endpoints(endpoints: DataFrame) -> DataFrame:
    return endpoints.withColumn("is_private", is_private_ipv4(F.col("remote_addr")))


def logons(edges: DataFrame, logon_type: int | None = None, success: bool | None = None) -> DataFrame:
    found = edges.where("edge_type = 'Logon'")
    if logon_type is not None:
        found = found.where(F.col("logon_type") == logon_type)
    return found if success is None else found.where(F.col("success") == success)


def cross_host(edges: DataFrame, hosts: DataFrame, least: int = 2) -> DataFrame:
    """Targets reached from processes on several hosts. hosts: node_key, host. (target, host) pairs are made distinct before they are counted."""
    pairs = edges.join(hosts.select(F.col("node_key").alias("src_key"), "host"), "src_key").groupBy("dst_key", "host").agg(F.lit(1).alias("one"))
    return pairs.groupBy("dst_key").agg(F.count("*").alias("n_hosts")).where(F.col("n_hosts") >= least)


def recycled_pids(processes: DataFrame) -> DataFrame:
    """(host, pid) with several start times. Identities are distinct already, so they are only counted."""
    return processes.groupBy("host_hostname", "pid").agg(F.count("start_time").alias("n_starts")).where("n_starts > 1")


def disputed(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.size("disagreements") > 0)


def accuracy(findings: DataFrame, truth: DataFrame, key: str, confidence: Column | None = None) -> DataFrame:
    """Precision, recall, F1 and unfounded findings of findings against truth; of each confidence if it is given."""
    f = findings.groupBy(key).agg(F.lit(1).alias("_f"))
    t = truth.groupBy(key).agg(F.lit(1).alias("_t"))
    c = f.join(t, key, "full").agg(F.count_if(F.col("_f").isNotNull() & F.col("_t").isNotNull()).alias("tp"), F.count_if(F.col("_t").isNull()).alias("unfounded"), F.count_if(F.col("_f").isNull()).alias("missed"))
    p = F.col("tp") / F.nullif(F.col("tp") + F.col("unfounded"), F.lit(0))
    r = F.col("tp") / F.nullif(F.col("tp") + F.col("missed"), F.lit(0))
    return c.select("tp", "unfounded", "missed", p.alias("precision"), r.alias("recall"), (2 * p * r / F.nullif(p + r, F.lit(0.0))).alias("f1"))


def calibration(findings: DataFrame, truth: DataFrame, key: str) -> DataFrame:
    """How often findings of each confidence are true."""
    t = truth.select(key).distinct().withColumn("_t", F.lit(1))
    return findings.join(t, key, "left").groupBy("confidence").agg(F.count("*").alias("n"), F.count("_t").alias("n_true"))

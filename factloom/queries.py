"""One query for each operator over the driver's tables, and the same in SQL.

The tables stand for evidence: events are detection-log records, orders are process listings,
line items are registry, service, task, module and connection observations, customers are
accounts, documents are files, pages are endpoints.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import filters, text
from .operators import catalogue, gate, graph, parsers, provenance
from .plans import fold as folds
from .plans import schema as S
from .plans.lineage import cut_lineage
from .sources import events as event_source
from .sources.evidence import dedup_blobs, stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

HASH = "a" * 64
NIGHT = "2024-01-01 00:00:00"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def stamp(c: str | Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def sourced(df: DataFrame, derivation: Column | None = None) -> DataFrame:
    return df.withColumns({"evidence_hash": F.lit(HASH), "derivation": derivation if derivation is not None else F.lit("test"), "observed_at": F.lit(NIGHT).cast("timestamp")})


def joined(c: Column | str) -> Column:
    return F.array_join(c, ",")


# -- the tables as observations, and the same as SQL

DET = """det AS (SELECT event_id AS seq, 'h' || user_id AS host, CASE event_type WHEN 'error' THEN 1116 WHEN 'purchase' THEN 1117 WHEN 'signup' THEN 1118 WHEN 'view' THEN 5001 ELSE 1000 END AS eid,
 ts, CASE WHEN k % 10 <> 0 THEN 'T:' || (k % 7) END AS threat, CASE WHEN value > 50 THEN 'Quarantined' WHEN value > 20 THEN 'Blocked' END AS action, event_type
 FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events))"""
GOOD_DET = DET + ", good AS (SELECT *, date_trunc('day', ts) AS day FROM det WHERE eid <> 1000 AND threat IS NOT NULL)"


def detection_records(spark: SparkSession, sf: str, by_day: bool = True) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    eid = F.when(F.col("event_type") == "error", 1116).when(F.col("event_type") == "purchase", 1117).when(F.col("event_type") == "signup", 1118).when(F.col("event_type") == "view", 5001).otherwise(1000)
    ts = F.col("ts").cast("timestamp")
    return table(spark, sf, "events").select(
        F.col("event_id").alias("seq"), F.concat(F.lit("h"), "user_id").alias("computer"), eid.alias("event_id"), (F.date_trunc("day", ts) if by_day else ts).alias("time_created"),
        F.when(k % 10 != 0, F.concat(F.lit("T:"), k % 7)).alias("threat_name"), F.when(F.col("value") > 50, "Quarantined").when(F.col("value") > 20, "Blocked").alias("action"),
        F.lit(None).cast("string").alias("file_path"), F.lit(HASH).alias("_evidence_hash"), F.col("event_type").alias("_derivation"),
    )


def detection_obs(spark: SparkSession, sf: str, by_day: bool = True) -> DataFrame:
    return parsers.detections(detection_records(spark, sf, by_day), F.lit(NIGHT).cast("timestamp"))[0]


def detection_nodes(spark: SparkSession, sf: str, by_day: bool = True) -> DataFrame:
    return folds.fold(detection_obs(spark, sf, by_day), S.DETECTION)


PROC = """proc AS (SELECT o_orderkey AS seq, 'n' || (o_custkey % 25) AS host, o_custkey AS pid, CASE WHEN o_orderkey % 50 <> 0 THEN date_trunc('year', o_orderdate) END AS start, o_orderpriority AS name,
 CASE WHEN o_orderkey % 3 <> 0 THEN 'C:\\Windows\\' || o_orderstatus || '.exe' END AS image, CASE WHEN o_orderkey % 4 <> 0 THEN 'run ' || o_orderstatus END AS cmd, (o_custkey * 7) % 1000 AS parent,
 o_orderdate AS exit, 'src' || (o_orderkey % 3) AS deriv, o_orderstatus AS obs FROM orders)"""


def process_obs(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("o_orderkey")
    return sourced(
        table(spark, sf, "orders").select(
            key.alias("seq"), F.concat(F.lit("n"), F.col("o_custkey") % 25).alias("host_hostname"), F.col("o_custkey").alias("pid"), F.when(key % 50 != 0, F.date_trunc("year", "o_orderdate")).alias("start_time"), F.col("o_orderpriority").alias("name"),
            F.when(key % 3 != 0, F.concat(F.lit("C:\\Windows\\"), "o_orderstatus", F.lit(".exe"))).alias("image_path"), F.when(key % 4 != 0, F.concat(F.lit("run "), "o_orderstatus")).alias("command_line"), ((F.col("o_custkey") * 7) % 1000).alias("parent_pid"),
            F.col("o_orderdate").cast("timestamp").alias("exit_time"), F.array("o_orderstatus").alias("observed_by"), F.concat(F.lit("src"), key % 3).alias("d"),
        ),
        F.col("d"),
    ).drop("d")


def process_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return folds.fold(process_obs(spark, sf), S.PROCESS)


ITEM = """item AS (SELECT *, (l_partkey * 1000000 + l_suppkey) * 100 + CAST(l_quantity AS BIGINT) AS seq, 'h' || (l_orderkey % 10) AS host, 'k' || l_orderkey || '/' || l_linenumber AS name,
 CASE WHEN l_partkey % 3 <> 0 THEN l_returnflag || l_linestatus END AS val, CASE WHEN l_suppkey % 4 <> 0 THEN l_shipdate END AS seen, CASE l_partkey % 2 WHEN 0 THEN 'svcscan' ELSE 'registry' END AS deriv FROM lineitem)"""


def items(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "lineitem")
    return df.select(
        "*", ((F.col("l_partkey") * 1000000 + F.col("l_suppkey")) * 100 + F.col("l_quantity").cast("long")).alias("seq"), F.concat(F.lit("h"), F.col("l_orderkey") % 10).alias("host_hostname"),
        F.concat(F.lit("k"), "l_orderkey", F.lit("/"), "l_linenumber").alias("thing"), F.when(F.col("l_partkey") % 3 != 0, F.concat("l_returnflag", "l_linestatus")).alias("val"),
        F.when(F.col("l_suppkey") % 4 != 0, F.col("l_shipdate").cast("timestamp")).alias("at"), F.when(F.col("l_partkey") % 2 == 0, "svcscan").otherwise("registry").alias("deriv"),
    )


def item_obs(spark: SparkSession, sf: str, **columns: Column) -> DataFrame:
    df = items(spark, sf)
    return sourced(df.select("seq", "host_hostname", *(c.alias(n) for n, c in columns.items()), "deriv"), F.col("deriv")).drop("deriv")


# -- T: parsing and keys

@query(f"WITH {GOOD_DET} SELECT host AS host_hostname, eid AS event_id, strftime(day, '%Y-%m-%d %H:%M:%S.%f') AS detection_time, threat AS threat_name, action AS action_taken, seq FROM good")
def t01_supported_events(spark: SparkSession, sf: str) -> DataFrame:
    return detection_obs(spark, sf).select("host_hostname", "event_id", stamp("detection_time").alias("detection_time"), "threat_name", "action_taken", "seq")


@query(f"WITH {DET} SELECT CAST(count(*) FILTER (WHERE eid = 1000) AS BIGINT) AS skipped_event_count, CAST(count(*) FILTER (WHERE eid <> 1000 AND threat IS NULL) AS BIGINT) AS malformed_count, string_agg(DISTINCT CAST(eid AS VARCHAR), ',') FILTER (WHERE eid = 1000) AS skipped_ids FROM det")
def t01_skip_stats(spark: SparkSession, sf: str) -> DataFrame:
    return parsers.detections(detection_records(spark, sf))[1].select("skipped_event_count", "malformed_count", joined("skipped_event_ids").alias("skipped_ids"))


@query(f"WITH {GOOD_DET} SELECT host AS host_hostname, eid AS event_id, strftime(day, '%Y-%m-%d') AS day, threat AS threat_name, min(seq) AS first_seq, count(*) AS n_observations, min_by(action, seq) FILTER (WHERE action IS NOT NULL) AS action_taken, min_by(event_type, seq) AS derivation FROM good GROUP BY 1, 2, 3, 4")
def t02_detection_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return detection_nodes(spark, sf).select("host_hostname", "event_id", F.date_format("detection_time", "yyyy-MM-dd").alias("day"), "threat_name", "first_seq", "n_observations", "action_taken", "derivation")


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE strftime(ts, '%Y-%m-%d %H:%M:%S.%f') END AS parsed FROM events")
def t03_time_parse(spark: SparkSession, sf: str) -> DataFrame:
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    raw = F.when(F.col("event_id") % 6 == 0, F.lit("")).when(F.col("event_id") % 6 == 3, F.lit("no time")).otherwise(F.concat(iso, F.when(F.col("event_id") % 2 == 0, "Z").otherwise("+00:00")))
    return table(spark, sf, "events").select("event_id", stamp(text.parse_time(raw)).alias("parsed"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || ' +x' WHEN 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || ' y z' ELSE 'plain' END AS iso FROM events")
def t04_time_text(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.when(F.col("event_id") % 3 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss' +x'")).when(F.col("event_id") % 3 == 1, F.date_format("ts", "yyyy-MM-dd HH:mm:ss' y z'")).otherwise(F.lit("plain"))
    return table(spark, sf, "events").select("event_id", text.iso_time_text(raw).alias("iso"))


@query("SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'C:\\' || lang || '\\' || doc_id WHEN 2 THEN 'C:\\' || doc_id || '|x' WHEN 3 THEN lang || '\\' || doc_id ELSE NULL END AS path FROM documents")
def t05_detection_path(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("doc_id")
    raw = F.when(d % 5 == 0, F.lit("")).when(d % 5 == 1, F.concat(F.lit(" file:_C:\\"), "lang", F.lit("\\"), d, F.lit(" ; webfile:_z"))).when(d % 5 == 2, F.concat(F.lit("webfile:_C:\\"), d, F.lit("|x"))).when(d % 5 == 3, F.concat("lang", F.lit("\\"), d))
    return table(spark, sf, "documents").select("doc_id", text.detection_path(raw).alias("path"))


@query(f"WITH {PROC} SELECT host AS host_hostname, pid, name, obs AS observed_by, CAST(seq % 2 AS INT) AS rank, seq FROM proc WHERE seq % 7 <> 0")
def t06_process_observations(spark: SparkSession, sf: str) -> DataFrame:
    scan, listed = listings(spark, sf)
    return scan.unionByName(listed).select("host_hostname", "pid", "name", F.col("extra").alias("observed_by"), F.col("seq.rank").alias("rank"), F.col("seq.row").alias("seq"))


def listings(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    obs = process_obs(spark, sf)
    raw = obs.select("pid", F.when(F.col("seq") % 7 != 0, F.col("name")).alias("name"), "image_path", "command_line", "parent_pid", "start_time", "exit_time", F.col("evidence_hash").alias("_evidence_hash"), F.col("derivation").alias("_derivation"), F.col("host_hostname").alias("_host_hostname"), "seq", F.element_at("observed_by", 1).alias("extra"))
    made = []
    for rank, plugin in enumerate(("psscan", "pslist")):
        part = raw.where(F.col("seq") % 2 == rank)
        out = parsers.process_observations(part.drop("extra"), plugin, rank, F.lit(NIGHT).cast("timestamp"))
        extra = part.select(F.struct(F.lit(rank).alias("rank"), F.col("seq").cast("long").alias("row")).alias("seq"), "extra")
        made.append(out.join(extra, "seq"))
    return made[0], made[1]


@query(f"WITH {PROC}, p AS (SELECT host, pid, start, CASE WHEN seq % 2 = 0 THEN seq ELSE seq + 281474976710656 END AS seq, CASE WHEN seq % 2 = 0 THEN 'psscan' ELSE 'pslist' END AS plugin FROM proc WHERE seq % 7 <> 0) SELECT plugin, count(*) AS n_new FROM (SELECT min_by(plugin, seq) AS plugin FROM p GROUP BY host, pid, start) GROUP BY plugin")
def t07_in_parse_fold(spark: SparkSession, sf: str) -> DataFrame:
    scan, listed = listings(spark, sf)
    return parsers.plugin_counts(scan.unionByName(listed), ["host_hostname", "pid", "start_time"])


SPAWN = f"{PROC}, node AS (SELECT DISTINCT host, pid, start FROM proc), rel AS (SELECT o_orderkey AS seq, 'n' || (o_custkey % 25) AS host, (o_custkey + 25 * (o_orderkey % 3)) % 1600 AS parent, o_custkey AS pid, date_trunc('year', o_orderdate) AS cs FROM orders)"
SPAWN_EDGES = SPAWN + ", child AS (SELECT rel.* FROM rel JOIN node ON rel.host = node.host AND rel.pid = node.pid AND rel.cs = node.start), edge AS (SELECT c.seq, c.host, c.pid, c.cs, c.parent, p.start AS parent_start FROM child c JOIN node p ON p.host = c.host AND p.pid = c.parent AND (p.start IS NULL OR p.start <= c.cs) QUALIFY row_number() OVER (PARTITION BY c.seq ORDER BY p.start DESC NULLS LAST) = 1)"


def relations(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("seq"), F.concat(F.lit("n"), F.col("o_custkey") % 25).alias("_host_hostname"), ((F.col("o_custkey") + 25 * (F.col("o_orderkey") % 3)) % 1600).alias("parent_pid"), F.col("o_custkey").alias("child_pid"), F.date_trunc("year", "o_orderdate").alias("child_start_time"), F.lit(HASH).alias("_evidence_hash"), F.lit("pstree").alias("_derivation"))


@query(f"WITH {SPAWN_EDGES} SELECT seq, host, pid AS child_pid, parent AS parent_pid, strftime(parent_start, '%Y') AS parent_year FROM edge")
def t08_spawned_edges(spark: SparkSession, sf: str) -> DataFrame:
    nodes = process_nodes(spark, sf)
    edges, _ = parsers.spawned(relations(spark, sf), nodes)
    end = lambda p: nodes.select(F.col("node_key").alias(f"{p}_key"), F.col("pid").alias(f"{p}_pid"), F.col("start_time").alias(f"{p}_start"), F.col("host_hostname").alias(f"{p}_host"))
    both = edges.join(end("src"), "src_key").join(end("dst"), "dst_key")
    return both.select("seq", F.col("dst_host").alias("host"), F.col("dst_pid").alias("child_pid"), F.col("src_pid").alias("parent_pid"), F.date_format("src_start", "yyyy").alias("parent_year"))


@query(f"WITH {SPAWN_EDGES} SELECT CAST((SELECT count(*) FROM rel) AS BIGINT) AS n_relations, CAST((SELECT count(*) FROM edge) AS BIGINT) AS n_edges, CAST((SELECT count(*) FROM rel) - (SELECT count(*) FROM edge) AS BIGINT) AS failures")
def t08_spawn_stats(spark: SparkSession, sf: str) -> DataFrame:
    return parsers.spawned(relations(spark, sf), process_nodes(spark, sf))[1]


@query("SELECT event_id AS seq, CASE WHEN event_id % 2 = 0 THEN 'own' ELSE repeat('b', 64) END AS evidence_hash, CASE WHEN event_id % 3 = 0 THEN 'mine' ELSE 'defender_evtx log.xml' END AS derivation FROM events")
def t09_provenance_injection(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(F.col("event_id").alias("seq"), F.when(F.col("event_id") % 2 == 0, "own").alias("_evidence_hash"), F.when(F.col("event_id") % 3 == 0, "mine").alias("_derivation"))
    return parsers.with_provenance(e, "b" * 64, parsers.derivation("defender_evtx", "log.xml")).select("seq", F.col("_evidence_hash").alias("evidence_hash"), F.col("_derivation").alias("derivation"))


@query("SELECT CASE WHEN k = 0 THEN '' WHEN k = 1 THEN 'sid_length' WHEN k = 2 THEN 'evidence_hash' ELSE 'sid_missing,sid_length' END AS problems, count(*) AS n FROM (SELECT c_custkey % 4 AS k FROM customer) GROUP BY 1")
def t12_validation(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey") % 4
    raw = table(spark, sf, "customer").select(F.when(k == 1, "S-1").when(k != 3, F.concat(F.lit("S-1-5-21-"), "c_custkey")).alias("sid"), F.col("c_name").alias("username"), F.when(k == 2, "short").otherwise(HASH).alias("evidence_hash"), F.lit("t").alias("derivation"), F.lit(NIGHT).cast("timestamp").alias("observed_at"))
    return S.checked(raw, S.USER).groupBy(joined("problems").alias("problems")).agg(F.count("*").alias("n"))


@query(f"WITH {PROC} SELECT '{{\"t\":\"Process\",\"k0\":\"' || host || '\",\"k1\":' || pid || ',\"k2\":' || coalesce('\"' || strftime(start, '%Y-%m-%dT%H:%M:%S.000000') || 'Z\"', 'null') || '}}' AS node_key, count(*) AS n FROM proc GROUP BY 1")
def t13_process_keys(spark: SparkSession, sf: str) -> DataFrame:
    return S.PROCESS.keyed(process_obs(spark, sf)).groupBy("node_key").agg(F.count("*").alias("n"))


@query("SELECT doc_id, lower(regexp_replace(regexp_replace(translate(p, '\\', '/'), '^/', ''), '^\\?\\?/', '')) AS path FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '\\??\\C:\\' WHEN 1 THEN '\\\\srv\\' WHEN 2 THEN '??/' ELSE '/' END || upper(lang) || '\\' || doc_id || '.TXT' AS p FROM documents)")
def t14_path_norm(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("doc_id") % 4
    raw = F.concat(F.when(k == 0, "\\??\\C:\\").when(k == 1, "\\\\srv\\").when(k == 2, "??/").otherwise("/"), F.upper("lang"), F.lit("\\"), "doc_id", F.lit(".TXT"))
    return table(spark, sf, "documents").select("doc_id", text.file_path_key(raw).alias("path"))


@query("SELECT doc_id, lower(trim(translate(p, '\\', '/'), '/')) AS path FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '\\\\' WHEN 1 THEN '/' ELSE '' END || 'Current\\Services\\' || upper(lang) || doc_id || CASE doc_id % 2 WHEN 0 THEN '\\/' ELSE '' END AS p FROM documents)")
def t15_registry_norm(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("doc_id")
    raw = F.concat(F.when(d % 3 == 0, "\\\\").when(d % 3 == 1, "/").otherwise(""), F.lit("Current\\Services\\"), F.upper("lang"), d, F.when(d % 2 == 0, "\\/").otherwise(""))
    return table(spark, sf, "documents").select("doc_id", text.registry_path_key(raw).alias("path"))


@query("SELECT p_partkey, CAST(p_size AS DOUBLE) * 3600 + 0.25 AS seconds FROM part")
def t17_duration(spark: SparkSession, sf: str) -> DataFrame:
    start = F.lit(NIGHT).cast("timestamp")
    end = start + F.make_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(0), F.col("p_size"), F.lit(0), F.lit(0.25))
    return table(spark, sf, "part").select("p_partkey", text.seconds_between(start, end).alias("seconds"))


@query(f"WITH {DET} SELECT seq, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f+00:00') AS time_created, eid AS event_id, host AS computer, coalesce(threat, '') AS threat_name, seq % 11 <> 0 AS valid FROM det WHERE seq % 11 <> 0 UNION ALL SELECT seq, NULL, NULL, NULL, NULL, false FROM det WHERE seq % 11 = 0")
def s02_xml_records(spark: SparkSession, sf: str) -> DataFrame:
    return event_source.parse_records(xml_records(spark, sf)).select("seq", "time_created", "event_id", "computer", "threat_name", "valid")


def xml_records(spark: SparkSession, sf: str) -> DataFrame:
    r = detection_records(spark, sf, by_day=False)
    xml = event_source.to_xml(F.col("event_id"), F.date_format("time_created", "yyyy-MM-dd HH:mm:ss.SSSSSS'+00:00'"), F.col("computer"), {"Threat Name": F.col("threat_name"), "Action Name": F.col("action")})
    return r.select("seq", F.when(F.col("seq") % 11 == 0, F.concat(F.lit("<broken>"), xml)).otherwise(xml).alias("value"))


@query("SELECT count(*) AS records_read, CAST(count(*) FILTER (WHERE event_id % 11 <> 0) AS BIGINT) AS records_yielded, CAST(count(*) FILTER (WHERE event_id % 11 = 0) AS BIGINT) AS records_skipped_malformed FROM events")
def s03_read_stats(spark: SparkSession, sf: str) -> DataFrame:
    return event_source.read_stats(event_source.checked_records(xml_records(spark, sf)))


@query("SELECT doc_id, sha256(text) AS evidence_hash FROM documents")
def s05_content_hash(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("evidence_hash"))


MANIFEST = "manifest AS (SELECT sha256(text) AS evidence_hash, min(doc_id) AS doc_id, count(*) AS n_copies FROM documents GROUP BY 1)"


def manifest(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", "source", "n_chars")
    return dedup_blobs(docs, "text", "doc_id")


@query(f"WITH {MANIFEST} SELECT m.evidence_hash, m.doc_id, m.n_copies, d.source, d.n_chars FROM manifest m JOIN documents d USING (doc_id)")
def s04_u05_content_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return manifest(spark, sf)


@query(f"WITH {MANIFEST}, probe AS (SELECT doc_id, false AS altered, sha256(text) AS h FROM documents UNION ALL SELECT doc_id, true, sha256(text || 'x') FROM documents) SELECT doc_id, altered, h IN (SELECT evidence_hash FROM manifest) AS stored FROM probe")
def s07_has(spark: SparkSession, sf: str) -> DataFrame:
    docs, changed = table(spark, sf, "documents"), F.concat("text", F.lit("x"))
    probe = docs.select("doc_id", F.lit(False).alias("altered"), F.sha2("text", 256).alias("evidence_hash")).unionAll(docs.select("doc_id", F.lit(True), F.sha2(changed, 256)))
    return stored(probe, manifest(spark, sf)).select("doc_id", "altered", "stored")


@query(f"WITH {MANIFEST} SELECT m.evidence_hash, 'doc' || m.doc_id AS original_name, d.n_chars AS size_bytes FROM manifest m JOIN documents d USING (doc_id)")
def s09_l02_list_evidence(spark: SparkSession, sf: str) -> DataFrame:
    m = manifest(spark, sf).select("evidence_hash", F.concat(F.lit("doc"), "doc_id").alias("original_name"), F.col("n_chars").alias("size_bytes"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("2024-"), "doc_id")).alias("ingested_at"))
    return provenance.evidence_listing(m).select("evidence_hash", "original_name", "size_bytes")


# -- A: folds

@query("SELECT 'n' || n_nationkey AS hostname, CASE WHEN n_nationkey % 3 <> 0 THEN 'g' || n_nationkey ELSE NULL END AS machine_guid, min_by(os, seq) FILTER (WHERE os IS NOT NULL) AS os_version, min_by(tz, seq) AS timezone, count(*) AS n_observations FROM (SELECT n_nationkey, c_custkey AS seq, CASE WHEN c_custkey % 4 = 0 THEN c_mktsegment END AS os, 'TZ' || (c_custkey % 3) AS tz FROM customer JOIN nation ON c_nationkey = n_nationkey) GROUP BY n_nationkey")
def a01_a02_hosts(spark: SparkSession, sf: str) -> DataFrame:
    c, n = table(spark, sf, "customer"), table(spark, sf, "nation")
    k = F.col("n_nationkey")
    obs = sourced(c.join(n, F.col("c_nationkey") == k).select(F.col("c_custkey").alias("seq"), F.concat(F.lit("n"), k).alias("hostname"), F.when(k % 3 != 0, F.concat(F.lit("g"), k)).alias("machine_guid"), F.when(F.col("c_custkey") % 4 == 0, F.col("c_mktsegment")).alias("os_version"), F.concat(F.lit("TZ"), F.col("c_custkey") % 3).alias("timezone"), F.lit(None).cast("string").alias("network_subnet")))
    return folds.fold(obs, S.HOST).select("hostname", "machine_guid", "os_version", "timezone", "n_observations")


FILE_SQL = """SELECT host, 'c:/' || name AS path, min(seen) AS mtime, max(seen) AS atime, bool_or(l_linenumber = 3) AS on_disk, bool_or(l_partkey % 5 = 0) AS is_deleted, min_by(l_suppkey, seq) FILTER (WHERE l_suppkey % 2 = 0) AS size_bytes, count(*) AS n FROM item GROUP BY 1, 2"""


def file_obs(spark: SparkSession, sf: str) -> DataFrame:
    return item_obs(spark, sf, full_path=F.concat(F.lit("\\C:\\"), F.upper("thing")), mtime=F.col("at"), atime=F.col("at"), ctime=F.lit(None).cast("timestamp"), btime=F.lit(None).cast("timestamp"), sha256=F.lit(None).cast("string"), md5=F.lit(None).cast("string"), size_bytes=F.when(F.col("l_suppkey") % 2 == 0, F.col("l_suppkey")), mft_record_number=F.lit(None).cast("long"), is_deleted=F.col("l_partkey") % 5 == 0, is_orphan=F.lit(False), on_disk=F.col("l_linenumber") == 3, referenced_by=F.array("l_returnflag"))


@query(f"WITH {ITEM} SELECT host AS host_hostname, path, strftime(mtime, '%Y-%m-%d') AS mtime, strftime(atime, '%Y-%m-%d') AS atime, on_disk, is_deleted, size_bytes, n AS n_observations FROM ({FILE_SQL})")
def a03_a04_a05_files(spark: SparkSession, sf: str) -> DataFrame:
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return folds.fold(file_obs(spark, sf), S.FILE).select("host_hostname", F.col("k_path").alias("path"), day("mtime"), day("atime"), "on_disk", "is_deleted", "size_bytes", "n_observations")


@query(f"WITH {ITEM} SELECT host AS host_hostname, name AS task_path, bool_and(l_partkey % 3 <> 0) AS is_enabled, strftime(max(seen), '%Y-%m-%d') AS last_run_time, min_by(val, seq) FILTER (WHERE val IS NOT NULL) AS command FROM item GROUP BY 1, 2")
def a06_tasks(spark: SparkSession, sf: str) -> DataFrame:
    obs = item_obs(spark, sf, task_path=F.col("thing"), author=F.lit(None).cast("string"), command=F.col("val"), arguments=F.lit(None).cast("string"), trigger_type=F.lit(None).cast("string"), is_enabled=F.col("l_partkey") % 3 != 0, last_run_time=F.col("at"))
    return folds.fold(obs, S.TASK).select("host_hostname", "task_path", "is_enabled", F.date_format("last_run_time", "yyyy-MM-dd").alias("last_run_time"), "command")


@query(f"WITH {PROC}, f AS (SELECT host, pid, start, obs, min(seq) AS s FROM proc GROUP BY ALL) SELECT host AS host_hostname, pid, strftime(start, '%Y') AS year, string_agg(obs, ',' ORDER BY s) AS observed_by FROM f GROUP BY host, pid, start")
def a07_observed_union(spark: SparkSession, sf: str) -> DataFrame:
    return process_nodes(spark, sf).select("host_hostname", "pid", F.date_format("start_time", "yyyy").alias("year"), joined("observed_by").alias("observed_by"))


LOGGED = ", ".join(f"min_by({c}, seq) FILTER (WHERE {c} IS NOT NULL) OVER (PARTITION BY host, pid, start) AS b_{c}" for c in ("name", "image", "cmd"))


@query(f"WITH {PROC}, b AS (SELECT *, {LOGGED} FROM proc) SELECT host AS host_hostname, pid, strftime(start, '%Y') AS year, min(b_image) AS image_path, string_agg(cmd || '@' || deriv, ';' ORDER BY seq) FILTER (WHERE cmd <> b_cmd) AS command_log, string_agg(name || '@' || deriv, ';' ORDER BY seq) FILTER (WHERE name <> b_name) AS name_log FROM b GROUP BY host, pid, start")
def a08_disagreements(spark: SparkSession, sf: str) -> DataFrame:
    log = lambda c: F.array_join(F.transform(F.try_element_at("disagreements", F.lit(c)), lambda e: F.concat(e["value"], F.lit("@"), e["source"])), ";")
    return process_nodes(spark, sf).select("host_hostname", "pid", F.date_format("start_time", "yyyy").alias("year"), "image_path", log("command_line").alias("command_log"), log("name").alias("name_log"))


LONG_LOG = "proc AS (SELECT o_orderkey AS seq, 'n' || (o_custkey % 3) AS host, 'C' || o_orderpriority AS name, o_orderstatus AS cmd, 'src' || (o_orderkey % 3) AS deriv FROM orders), b AS (SELECT *, min_by(name, seq) OVER (PARTITION BY host) AS b_name, min_by(cmd, seq) OVER (PARTITION BY host) AS b_cmd FROM proc), d AS (SELECT host, seq, deriv, 'name' AS field, name AS value FROM b WHERE name <> b_name UNION ALL SELECT host, seq, deriv, 'command_line', cmd FROM b WHERE cmd <> b_cmd), p AS (SELECT *, (row_number() OVER (PARTITION BY host, field ORDER BY seq) - 1) // 100 AS segment FROM d)"


@query(f"WITH {LONG_LOG} SELECT host AS host_hostname, field, CAST(segment AS BIGINT) AS segment, count(*) AS n_entries, string_agg(value || '@' || deriv, ';' ORDER BY seq) AS log FROM p GROUP BY 1, 2, 3")
def a08_log_segments(spark: SparkSession, sf: str) -> DataFrame:
    """All orders as observations of three processes, whose logs grow with the table, in rows of a hundred entries."""
    key = F.col("o_orderkey")
    raw = table(spark, sf, "orders").select(key.alias("seq"), F.concat(F.lit("n"), F.col("o_custkey") % 3).alias("host_hostname"), F.lit(1).cast("long").alias("pid"), F.lit(None).cast("timestamp").alias("start_time"), F.concat(F.lit("C"), "o_orderpriority").alias("name"), F.col("o_orderstatus").alias("command_line"), F.concat(F.lit("src"), key % 3).alias("d"))
    _, segments = folds.fold_in_segments(sourced(raw, F.col("d")).drop("d"), S.PROCESS, segment=100)
    log = F.array_join(F.transform("entries", lambda e: F.concat(e["value"], F.lit("@"), e["source"])), ";")
    return segments.select(F.get_json_object("node_key", "$.k0").alias("host_hostname"), "field", "segment", F.size("entries").cast("long").alias("n_entries"), log.alias("log"))


@query(f"WITH {ITEM}, a AS (SELECT *, max(seen) OVER w AS m FROM item WINDOW w AS (PARTITION BY host, name)), b AS (SELECT *, min(CASE WHEN m IS NULL OR seen = m THEN seq END) OVER (PARTITION BY host, name) AS anchor FROM a) SELECT host AS host_hostname, name AS value_name, strftime(max(seen), '%Y-%m-%d') AS last_write_time, min_by(val, seq) FILTER (WHERE val IS NOT NULL AND seq >= anchor) AS value_data, min_by(l_linestatus, seq) FILTER (WHERE seq >= anchor) AS value_type FROM b GROUP BY host, name")
def a09_registry_latest(spark: SparkSession, sf: str) -> DataFrame:
    obs = item_obs(spark, sf, hive_name=F.lit("SYSTEM"), key_path=F.lit("\\Current\\Services\\"), value_name=F.col("thing"), value_str=F.col("val"), value_bin=F.lit(None).cast("binary"), value_type=F.col("l_linestatus"), last_write_time=F.col("at"))
    return folds.fold(obs, S.REGISTRY).select("host_hostname", "value_name", F.date_format("last_write_time", "yyyy-MM-dd").alias("last_write_time"), F.col("value_str").alias("value_data"), "value_type")


@query(f"WITH {ITEM}, v AS (SELECT *, CASE WHEN l_suppkey % 3 <> 0 THEN l_returnflag = 'A' END AS running FROM item) SELECT host AS host_hostname, name AS service_name, coalesce(max_by(running, seq) FILTER (WHERE running IS NOT NULL AND deriv = 'svcscan'), min_by(running, seq) FILTER (WHERE running IS NOT NULL)) AS is_running, min_by(val, seq) FILTER (WHERE val IS NOT NULL) AS display_name FROM v GROUP BY 1, 2")
def a10_service_memory(spark: SparkSession, sf: str) -> DataFrame:
    return service_nodes(spark, sf).select("host_hostname", "service_name", "is_running", "display_name")


def service_nodes(spark: SparkSession, sf: str) -> DataFrame:
    none = F.lit(None).cast("string")
    image = F.concat(F.lit("C:\\bin\\"), F.when(F.col("l_suppkey") % 2 == 0, F.col("thing")).otherwise(F.lit("x")), F.lit(".exe"))
    obs = item_obs(spark, sf, service_name=F.col("thing"), display_name=F.col("val"), image_path=image, start_type=none, service_account=none, is_running=F.when(F.col("l_suppkey") % 3 != 0, F.col("l_returnflag") == "A"))
    return folds.fold(obs, S.SERVICE)


@query("SELECT 'S-1-5-21-' || (c_custkey % 100) AS sid, min_by(kind, 1000000 * (3 - rank) + c_custkey) AS account_type, min_by(c_name, c_custkey) AS username FROM (SELECT *, CASE c_custkey % 7 WHEN 0 THEN 'domain' WHEN 1 THEN 'local' WHEN 2 THEN 'service' WHEN 3 THEN 'well-known' ELSE 'guest' END AS kind, CASE c_custkey % 7 WHEN 0 THEN 3 WHEN 1 THEN 3 WHEN 2 THEN 2 WHEN 3 THEN 1 ELSE 0 END AS rank FROM customer) GROUP BY 1")
def a11_account_rank(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey") % 7
    kind = F.when(k == 0, "domain").when(k == 1, "local").when(k == 2, "service").when(k == 3, "well-known").otherwise("guest")
    obs = sourced(table(spark, sf, "customer").select(F.col("c_custkey").alias("seq"), F.concat(F.lit("S-1-5-21-"), F.col("c_custkey") % 100).alias("sid"), F.col("c_name").alias("username"), F.lit(None).cast("string").alias("domain"), kind.alias("account_type")))
    return folds.fold(obs, S.USER).select("sid", "account_type", "username")


@query(f"WITH {ITEM} SELECT host AS host_hostname, name AS path, coalesce(count(DISTINCT CASE WHEN l_suppkey % 3 <> 0 THEN l_returnflag END) > 1, false) AS hash_conflict, coalesce(count(DISTINCT l_linestatus) > 1, false) AS kernel_conflict FROM item GROUP BY 1, 2")
def a12_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    obs = item_obs(spark, sf, image_path=F.col("thing"), base_address=F.lit(0).cast("decimal(20,0)"), size=F.col("l_suppkey"), sha256=F.when(F.col("l_suppkey") % 3 == 0, F.lit("")).otherwise(F.col("l_returnflag")), is_kernel=F.col("l_linestatus") == "F", observed_by=F.array("l_returnflag"))
    return folds.fold(obs, S.MODULE, strict=False).select("host_hostname", F.col("k_path").alias("path"), F.array_contains("conflicts", "sha256").alias("hash_conflict"), F.array_contains("conflicts", "is_kernel").alias("kernel_conflict"))


EDGE = """e AS (SELECT *, 'n' || (l_orderkey % 500) AS src, 'u' || (l_suppkey % 40) AS dst, CASE WHEN l_partkey % 6 <> 0 THEN date_trunc('year', l_shipdate) END AS ts,
 (l_orderkey * 10 + l_linenumber) * 1000000 + (l_partkey * 31 + l_suppkey) % 1000000 AS s FROM lineitem), first AS (SELECT src, dst, ts, l_returnflag AS f, min(s) AS s FROM e GROUP BY ALL),
 edge AS (SELECT src, dst, ts, string_agg(f, ',' ORDER BY s) AS confirmed_by, CASE WHEN count(*) >= 2 THEN 'confirmed' ELSE 'suspected' END AS confidence, count(*) AS n_sources FROM first GROUP BY src, dst, ts)"""


def edge_obs(spark: SparkSession, sf: str, edge_type: str = "Connected") -> DataFrame:
    df = table(spark, sf, "lineitem")
    seq = (F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1000000 + (F.col("l_partkey") * 31 + F.col("l_suppkey")) % 1000000
    return df.select(F.concat(F.lit("n"), F.col("l_orderkey") % 500).alias("src_key"), F.concat(F.lit("u"), F.col("l_suppkey") % 40).alias("dst_key"), F.lit(edge_type).alias("edge_type"), F.when(F.col("l_partkey") % 6 != 0, F.date_trunc("year", "l_shipdate")).alias("ts"), F.array("l_returnflag").alias("confirmed_by"), F.col("l_linestatus").alias("state"), F.col("l_quantity").cast("int").alias("logon_type"), seq.alias("seq"))


def edge_table(spark: SparkSession, sf: str, edge_type: str = "Connected") -> DataFrame:
    return folds.fold_edges(edge_obs(spark, sf, edge_type))


@query(f"WITH {EDGE} SELECT src AS src_key, dst AS dst_key, strftime(ts, '%Y') AS year, min_by(l_linestatus, s) AS state, count(*) AS n FROM e GROUP BY src, dst, ts")
def a13_t16_plain_edges(spark: SparkSession, sf: str) -> DataFrame:
    obs = edge_obs(spark, sf, "AuthenticatedAs").drop("confirmed_by")
    n = obs.groupBy("src_key", "dst_key", "ts").agg(F.count("*").alias("n"))
    folded = folds.fold_edges(obs)
    both = folded.join(n, (folded["src_key"] == n["src_key"]) & (folded["dst_key"] == n["dst_key"]) & folded["ts"].eqNullSafe(n["ts"]))
    return both.select(folded["src_key"], folded["dst_key"], F.date_format(folded["ts"], "yyyy").alias("year"), "state", "n")


@query(f"WITH {EDGE} SELECT src AS src_key, dst AS dst_key, strftime(ts, '%Y') AS year, confirmed_by, confidence FROM edge")
def a14_g01_multi_edges(spark: SparkSession, sf: str) -> DataFrame:
    return edge_table(spark, sf).select("src_key", "dst_key", F.date_format("ts", "yyyy").alias("year"), joined("confirmed_by").alias("confirmed_by"), "confidence")


@query("WITH old AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_shipdate < '1998-01-01'), new AS (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem WHERE l_shipdate >= '1998-01-01' GROUP BY 1, 2) SELECT CAST(count(*) FILTER (WHERE old.l_orderkey IS NULL) AS BIGINT) AS added, CAST(sum(n) - count(*) FILTER (WHERE old.l_orderkey IS NULL) AS BIGINT) AS merged FROM new LEFT JOIN old USING (l_orderkey, l_linenumber)")
def a15_added_merged(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return folds.counters(li.where("l_shipdate >= timestamp_ntz'1998-01-01'"), li.where("l_shipdate < timestamp_ntz'1998-01-01'"), ["l_orderkey", "l_linenumber"])


@query(f"WITH {GOOD_DET}, {PROC} SELECT 'AntivirusDetection' AS node_type, (SELECT count(*) FROM (SELECT DISTINCT host, eid, day, threat FROM good)) AS n UNION ALL SELECT 'Process', (SELECT count(*) FROM (SELECT DISTINCT host, pid, start FROM proc))")
def a16_a17_u01_node_counts(spark: SparkSession, sf: str) -> DataFrame:
    return evidence_graph(spark, sf).nodes().groupBy("node_type").agg(F.count("*").alias("n"))


def evidence_graph(spark: SparkSession, sf: str) -> graph.Graph:
    return graph.Graph({"AntivirusDetection": detection_nodes(spark, sf), "Process": process_nodes(spark, sf)})


@query(f"WITH {PROC} SELECT CAST(0 AS BIGINT) AS added, (SELECT count(*) FROM orders) AS merged, (SELECT count(*) FROM (SELECT DISTINCT host, pid, start FROM proc)) AS n_nodes, 2 * (SELECT count(*) FROM orders) AS n_observations")
def u04_idempotent_reingest(spark: SparkSession, sf: str) -> DataFrame:
    """The same observations folded into the nodes that they made: nothing is added, and no node changes but for the count."""
    obs, nodes = process_obs(spark, sf), process_nodes(spark, sf)
    counts = folds.counters(S.PROCESS.keyed(obs), nodes, "node_key")
    again = folds.merge(nodes, obs.withColumn("seq", F.col("seq") + (1 << 40)), S.PROCESS)
    after = again.agg(F.count("*").alias("n_nodes"), F.sum("n_observations").alias("n_observations"))
    return counts.crossJoin(after)


@query(f"WITH {GOOD_DET}, d AS (SELECT DISTINCT host, eid, day, threat FROM good) SELECT host AS host_hostname, threat AS threat_name, count(*) AS n_detections, strftime(min(day), '%Y-%m-%d') AS first_day FROM d GROUP BY 1, 2 HAVING count(*) >= 2")
def a18_q10_repeat_detections(spark: SparkSession, sf: str) -> DataFrame:
    return catalogue.repeated_detections(detection_nodes(spark, sf)).select("host_hostname", "threat_name", "n_detections", F.date_format("first_time", "yyyy-MM-dd").alias("first_day"))


# -- F and L: filters, queries

def filtered(name: str, sql: str, *flts: dict) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        df = detection_nodes(spark, sf)
        return df.where(filters.all_of(df, flts)).select("host_hostname", "event_id", "threat_name", "action_taken", "first_seq")

    run.__name__ = name
    query(f"WITH {GOOD_DET}, d AS (SELECT host AS host_hostname, eid AS event_id, day, threat AS threat_name, min_by(action, seq) FILTER (WHERE action IS NOT NULL) AS action_taken, min(seq) AS first_seq FROM good GROUP BY 1, 2, 3, 4) SELECT host_hostname, event_id, threat_name, action_taken, first_seq FROM d WHERE {sql}")(run)


filtered("f02_eq", "threat_name = 'T:3'", {"field": "threat_name", "op": "eq", "value": "T:3"})
filtered("f02_eq_number", "event_id = 1116", {"field": "event_id", "op": "eq", "value": 1116.0})
filtered("f02_eq_type_mismatch", "false", {"field": "event_id", "op": "eq", "value": "1116"})
filtered("f03_contains", "contains(action_taken, 'aran')", {"field": "action_taken", "op": "contains", "value": "aran"})
filtered("f04_gt", "event_id > 1117", {"field": "event_id", "op": "gt", "value": 1117})
filtered("f05_lt", "host_hostname < 'h2'", {"field": "host_hostname", "op": "lt", "value": "h2"})
filtered("f05_lt_time_text", "false", {"field": "detection_time", "op": "lt", "value": "2030-01-01T00:00:00"})
filtered("f06_exists", "action_taken IS NOT NULL", {"field": "action_taken", "op": "exists", "value": True})
filtered("f06_not_exists", "action_taken IS NULL", {"field": "action_taken", "op": "exists", "value": False}, {"field": "unknown_field", "op": "exists", "value": False})
filtered("f07_and", "threat_name = 'T:3' AND event_id < 2000 AND action_taken IS NOT NULL", {"field": "threat_name", "op": "eq", "value": "T:3"}, {"field": "event_id", "op": "lt", "value": 2000}, {"field": "action_taken", "op": "exists", "value": 1})
filtered("f07_no_field", "false", {"op": "eq", "value": "T:3"})


@query(f"WITH {PROC}, f AS (SELECT host, pid, start, list(DISTINCT obs) AS o FROM proc GROUP BY ALL) SELECT host AS host_hostname, pid, strftime(start, '%Y') AS year FROM f WHERE list_contains(o, 'P')")
def f03_contains_list(spark: SparkSession, sf: str) -> DataFrame:
    df = process_nodes(spark, sf)
    return df.where(filters.condition(df, {"field": "observed_by", "op": "contains", "value": "P"})).select("host_hostname", "pid", F.date_format("start_time", "yyyy").alias("year"))


@query(f"WITH {PROC} SELECT DISTINCT 'Process' AS node_type, pid FROM proc WHERE pid < 50")
def f01_find_nodes(spark: SparkSession, sf: str) -> DataFrame:
    (found,) = evidence_graph(spark, sf).find("Process", F.col("pid") < 50)
    return found.select("node_type", "pid").distinct()


@query(f"WITH {GOOD_DET} SELECT host AS host_hostname, eid AS event_id, threat AS threat_name, min(seq) AS first_seq FROM good GROUP BY host, eid, day, threat ORDER BY first_seq LIMIT 100")
def l01_query_limit(spark: SparkSession, sf: str) -> DataFrame:
    """Four pages of the service's answer, each asked for after the one before."""
    g, rows, after = graph.Graph({"AntivirusDetection": cut_lineage(detection_nodes(spark, sf), "detections")}), [], None
    for _ in range(4):
        page = g.query("AntivirusDetection", limit=graph.DEFAULT_LIMIT // 4, after=after)
        rows += [(*n["canonical_key"][1:3], n["threat_name"], n["first_seq"]) for n in page["nodes"]]
        after = page.get("next")
        if after is None:
            break
    return spark.createDataFrame(rows, "host_hostname string, event_id int, threat_name string, first_seq long")  # at most DEFAULT_LIMIT rows


@query(f"WITH {GOOD_DET} SELECT 'AntivirusDetection' AS node_type, host AS host_hostname, threat AS threat_name, min(seq) AS first_seq FROM good WHERE threat = 'T:3' GROUP BY host, eid, day, threat")
def l01_all_matches(spark: SparkSession, sf: str) -> DataFrame:
    """The same answer without a limit, as a table."""
    found = graph.Graph({"AntivirusDetection": detection_nodes(spark, sf)}).matches(None, [{"field": "threat_name", "op": "eq", "value": "T:3"}])
    return found.select("node_type", F.get_json_object("fields", "$.host_hostname").alias("host_hostname"), F.get_json_object("fields", "$.threat_name").alias("threat_name"), "first_seq")


@query(f"WITH {GOOD_DET}, d AS (SELECT DISTINCT host, eid, day, threat FROM good WHERE threat = 'T:3') SELECT count(*) AS total_matched, least(count(*), 100) AS returned, count(*) > 100 AS truncated FROM d")
def l01_total_matched(spark: SparkSession, sf: str) -> DataFrame:
    return graph.matched(detection_nodes(spark, sf), F.col("threat_name") == "T:3")


@query(f"WITH {GOOD_DET} SELECT 'AntivirusDetection' AS node_type, repeat('a', 64) AS evidence_hash, threat AS threat_name, host AS host_hostname, min_by(action, seq) FILTER (WHERE action IS NOT NULL) AS action_taken, replace(strftime(ts, '%Y-%m-%dT%H:%M:%S.%f+00:00'), '.000000', '') AS detection_time FROM good GROUP BY host, eid, ts, threat")
def f08_f09_summary(spark: SparkSession, sf: str) -> DataFrame:
    return graph.summaries(detection_nodes(spark, sf, by_day=False), S.DETECTION).select("node_type", "evidence_hash", "threat_name", "host_hostname", "action_taken", "detection_time")


@query("SELECT c_custkey, c_custkey % 3 = 0 AS known FROM customer")
def f11_f12_has_node(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    keyed = c.select("c_custkey", text.key_text("User", F.col("c_custkey")).alias("node_key"))
    return graph.known(keyed, keyed.where("c_custkey % 3 = 0")).select("c_custkey", "known")


def chosen(spark: SparkSession, step: int) -> DataFrame:
    return spark.range(0, 500, step).select(F.concat(F.lit("n"), "id").alias("node_key"))


@query(f"WITH {EDGE} SELECT src AS src_key, dst AS dst_key, strftime(ts, '%Y') AS year, confidence FROM edge WHERE CAST(substr(src, 2) AS BIGINT) % 50 = 0")
def f13_out_edges(spark: SparkSession, sf: str) -> DataFrame:
    return graph.out_edges(edge_table(spark, sf), chosen(spark, 50), "Connected").select("src_key", "dst_key", F.date_format("ts", "yyyy").alias("year"), "confidence")


@query(f"WITH {EDGE} SELECT src AS src_key, dst AS dst_key, strftime(ts, '%Y') AS year, confidence FROM edge WHERE dst IN ('u0', 'u7')")
def f13_in_edges(spark: SparkSession, sf: str) -> DataFrame:
    keys = spark.createDataFrame([("u0",), ("u7",)], "node_key string")
    return graph.in_edges(edge_table(spark, sf), keys).select("src_key", "dst_key", F.date_format("ts", "yyyy").alias("year"), "confidence")


# -- J: joins

NODES = "nodes AS (SELECT 'n' || (o_custkey % 400) AS k FROM orders UNION SELECT 'u' || (s_suppkey % 30) FROM supplier)"


def end_nodes(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "orders").select(F.concat(F.lit("n"), F.col("o_custkey") % 400).alias("node_key"))
    return a.union(table(spark, sf, "supplier").select(F.concat(F.lit("u"), F.col("s_suppkey") % 30))).distinct()


@query(f"WITH {EDGE}, {NODES} SELECT src AS src_key, dst AS dst_key, strftime(ts, '%Y') AS year, confirmed_by FROM edge WHERE src IN (SELECT k FROM nodes) AND dst IN (SELECT k FROM nodes)")
def j01_endpoint_semi(spark: SparkSession, sf: str) -> DataFrame:
    edges = folds.fold_edges(graph.resolved_edges(edge_obs(spark, sf), end_nodes(spark, sf)))
    return edges.select("src_key", "dst_key", F.date_format("ts", "yyyy").alias("year"), joined("confirmed_by").alias("confirmed_by"))


@query(f"WITH {EDGE}, {NODES}, m AS (SELECT src IN (SELECT k FROM nodes) AS s, dst IN (SELECT k FROM nodes) AS d FROM e) SELECT CASE WHEN s THEN 'target' WHEN d THEN 'source' ELSE 'both' END AS missing_end, count(*) AS n FROM m WHERE NOT (s AND d) GROUP BY 1")
def j01_orphans(spark: SparkSession, sf: str) -> DataFrame:
    return graph.orphan_edges(edge_obs(spark, sf), end_nodes(spark, sf)).groupBy("missing_end").agg(F.count("*").alias("n"))


@query(f"WITH {PROC}, node AS (SELECT DISTINCT host, pid, start FROM proc) SELECT o_orderkey AS seq FROM orders WHERE EXISTS (SELECT 1 FROM node WHERE host = 'n' || (o_custkey % 25) AND pid = o_custkey AND start IS NOT DISTINCT FROM CASE WHEN o_orderkey % 4 <> 0 THEN date_trunc('year', o_orderdate) END)")
def j02_child_exact(spark: SparkSession, sf: str) -> DataFrame:
    nodes = process_nodes(spark, sf).select("host_hostname", "pid", "start_time")
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("seq"), F.concat(F.lit("n"), F.col("o_custkey") % 25).alias("host"), F.col("o_custkey").alias("p"), F.when(F.col("o_orderkey") % 4 != 0, F.date_trunc("year", "o_orderdate")).alias("s"))
    return o.join(nodes, (F.col("host") == F.col("host_hostname")) & (F.col("p") == F.col("pid")) & F.col("s").eqNullSafe(F.col("start_time")), "left_semi").select("seq")


@query("SELECT e.event_id AS error_id, s.event_id AS signup_id FROM (SELECT * FROM events WHERE event_type = 'error') e ASOF JOIN (SELECT * FROM events WHERE event_type = 'signup') s ON e.user_id = s.user_id AND e.ts >= s.ts")
def j03_parent_asof(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    children = e.where("event_type = 'error'").select(F.lit("h").alias("host"), F.col("user_id").alias("parent_pid"), F.col("ts").cast("timestamp").alias("child_start"), F.col("event_id").alias("error_id"))
    nodes = e.where("event_type = 'signup'").select(F.lit("h").alias("host_hostname"), F.col("user_id").alias("pid"), F.col("ts").cast("timestamp").alias("start_time"), F.col("event_id").cast("string").alias("node_key"))
    return parsers.as_of_parent(children, nodes).where("src_key is not null").select("error_id", F.col("src_key").cast("long").alias("signup_id"))


@query("SELECT e.event_id AS error_id, max_by(s.event_id, s.ts) AS signup_id FROM events e JOIN events s ON e.user_id = s.user_id AND s.event_type = 'signup' WHERE e.event_type = 'error' GROUP BY 1")
def j04_parent_of_unknown_start(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    children = e.where("event_type = 'error'").select(F.lit("h").alias("host"), F.col("user_id").alias("parent_pid"), F.lit(None).cast("timestamp").alias("child_start"), F.col("event_id").alias("error_id"))
    nodes = e.where("event_type = 'signup'").select(F.lit("h").alias("host_hostname"), F.col("user_id").alias("pid"), F.col("ts").cast("timestamp").alias("start_time"), F.col("event_id").cast("string").alias("node_key"))
    return parsers.as_of_parent(children, nodes).where("src_key is not null").select("error_id", F.col("src_key").cast("long").alias("signup_id"))


CLAIMS = f"""{EDGE}, claim AS (SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'suspected' WHEN 2 THEN 'inferred' ELSE 'confirmed' END AS hint FROM orders),
 cite AS (SELECT o_orderkey AS id, 0 AS pos, 'n' || (o_custkey % 520) AS k FROM orders WHERE o_orderkey % 10 >= 1 UNION ALL SELECT o_orderkey, 1, 'u' || (o_orderkey % 44) FROM orders WHERE o_orderkey % 10 >= 2 AND o_orderkey % 3 = 0),
 node AS (SELECT 'n' || range AS k, range % 97 = 0 AS disputed FROM range(500) UNION ALL SELECT 'u' || range, false FROM range(41)),
 touch AS (SELECT src AS k, confidence FROM edge UNION ALL SELECT dst, confidence FROM edge),
 ev AS (SELECT id, count(confidence) AS n_edges, bool_and(confidence = 'confirmed') AS all_c FROM cite JOIN touch USING (k) GROUP BY id),
 c AS (SELECT id, count(*) AS n_cited, count(*) FILTER (WHERE node.k IS NULL) AS n_missing, min_by(cite.k, pos) FILTER (WHERE node.k IS NULL) AS first_missing, coalesce(bool_or(disputed), false) AS disputed FROM cite LEFT JOIN node ON cite.k = node.k GROUP BY id),
 j AS (SELECT claim.id, hint, coalesce(n_cited, 0) AS n_cited, coalesce(n_missing, 0) AS n_missing, first_missing, coalesce(disputed, false) AS disputed, coalesce(n_edges, 0) AS n_edges, CASE WHEN n_edges IS NULL THEN 'inferred' WHEN all_c THEN 'confirmed' ELSE 'suspected' END AS evidence FROM claim LEFT JOIN c USING (id) LEFT JOIN ev USING (id)),
 r AS (SELECT *, CASE WHEN disputed THEN 'disputed' WHEN hint = 'inferred' OR evidence = 'inferred' THEN 'inferred' WHEN hint = 'suspected' OR evidence = 'suspected' THEN 'suspected' ELSE 'confirmed' END AS final FROM j)"""


def claims(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    made = o.select(k.alias("claim_id"), F.when(k % 4 == 1, "suspected").when(k % 4 == 2, "inferred").otherwise("confirmed").alias("hint"))
    one = o.where(k % 10 >= 1).select(k.alias("claim_id"), F.lit(0).alias("pos"), F.concat(F.lit("n"), F.col("o_custkey") % 520).alias("node_key"))
    two = o.where((k % 10 >= 2) & (k % 3 == 0)).select(k.alias("claim_id"), F.lit(1).alias("pos"), F.concat(F.lit("u"), k % 44).alias("node_key"))
    nodes = spark.range(500).select(F.concat(F.lit("n"), "id").alias("node_key"), (F.col("id") % 97 == 0).alias("disputed")).union(spark.range(41).select(F.concat(F.lit("u"), "id"), F.lit(False)))
    return made, one.union(two), nodes, edge_table(spark, sf)


@query(f"WITH {CLAIMS} SELECT cite.id AS claim_id, pos, cite.k AS node_key FROM cite LEFT JOIN node ON cite.k = node.k WHERE node.k IS NULL")
def j05_missing_keys(spark: SparkSession, sf: str) -> DataFrame:
    _, cite, nodes, _ = claims(spark, sf)
    return gate.missing_keys(cite, nodes).select("claim_id", "pos", "node_key")


@query(f"WITH {EDGE}, k AS (SELECT 'n' || range AS k FROM range(0, 500, 25)), touch AS (SELECT src AS k, confidence FROM edge UNION ALL SELECT dst, confidence FROM edge) SELECT k AS node_key, confidence, count(*) AS n FROM touch JOIN k USING (k) GROUP BY 1, 2")
def j06_u03_touching_edges(spark: SparkSession, sf: str) -> DataFrame:
    return graph.touching_edges(edge_table(spark, sf), chosen(spark, 25)).groupBy("node_key", "confidence").agg(F.count("*").alias("n"))


@query(f"WITH {MANIFEST}, n AS (SELECT doc_id AS id, sha256(text) AS evidence_hash FROM documents) SELECT n.id AS doc_id, n.evidence_hash, 'doc' || m.doc_id AS original_name FROM n LEFT JOIN manifest m USING (evidence_hash)")
def j07_p01_provenance(spark: SparkSession, sf: str) -> DataFrame:
    nodes = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("evidence_hash"))
    m = manifest(spark, sf).select("evidence_hash", F.concat(F.lit("doc"), "doc_id").alias("original_name"), F.col("n_chars").alias("size_bytes"), F.lit("t").alias("ingested_at"))
    return provenance.with_source(nodes, m).select("doc_id", "evidence_hash", "original_name")


@query("SELECT (SELECT count(*) FROM (SELECT DISTINCT sha256(text) FROM documents)) AS evidence_count, (SELECT count(*) FROM customer) AS node_count, (SELECT count(*) FROM orders) AS edge_count")
def p04_session_stats(spark: SparkSession, sf: str) -> DataFrame:
    return graph.totals(evidence_count=manifest(spark, sf), node_count=table(spark, sf, "customer"), edge_count=table(spark, sf, "orders"))


# -- G: the gate

@query(f"WITH {CLAIMS} SELECT id AS claim_id, n_edges, CASE WHEN n_edges = 0 THEN 'inferred' ELSE evidence END AS evidence FROM j WHERE n_cited > 0")
def g05_evidence_confidence(spark: SparkSession, sf: str) -> DataFrame:
    _, cite, _, edges = claims(spark, sf)
    return gate.evidence_by_claim(cite, edges).select("claim_id", "n_edges", gate.evidence_confidence().alias("evidence"))


@query(f"WITH {CLAIMS} SELECT id AS claim_id, hint, n_cited, n_missing, first_missing, n_edges, CASE WHEN n_cited = 0 THEN 'rejected_empty_support' WHEN n_missing > 0 THEN 'rejected_missing_node' WHEN final <> hint THEN 'downgraded_confidence' ELSE 'accepted' END AS decision, CASE WHEN n_cited > 0 AND n_missing = 0 THEN final END AS final_confidence FROM r")
def g02_g07_decisions(spark: SparkSession, sf: str) -> DataFrame:
    return gate.judge(*claims(spark, sf))


@query(f"WITH {CLAIMS}, o AS (SELECT id, CASE WHEN id % 13 = 0 THEN 'bad_confidence_hint' WHEN n_cited = 0 THEN 'rejected_empty_support' WHEN n_missing > 0 THEN 'rejected_missing_node' WHEN id % 7 < 2 THEN 'empty_claim' WHEN final <> hint THEN 'downgraded_confidence' ELSE 'accepted' END AS outcome, final FROM r) SELECT id AS claim_id, outcome, CASE WHEN outcome IN ('accepted', 'downgraded_confidence') THEN final END AS final_confidence FROM o")
def g08_g09_commits(spark: SparkSession, sf: str) -> DataFrame:
    """A finding an order: some with a hint that there is not, some with a claim that is empty or null."""
    made, support, nodes, edges = claims(spark, sf)
    k = F.col("claim_id")
    made = made.withColumns({"hint": F.when(k % 13 == 0, "certain").otherwise(F.col("hint")), "claim": F.when(k % 7 == 0, "").when(k % 7 != 1, F.concat(F.lit("claim "), k))})
    return gate.commits(made, support, nodes, edges).select("claim_id", "outcome", "final_confidence")


@query(f"WITH {CLAIMS} SELECT CASE WHEN n_cited = 0 THEN 'rejected_empty_support' WHEN n_missing > 0 THEN 'rejected_missing_node' WHEN final <> hint THEN 'downgraded_confidence' ELSE 'accepted' END AS decision, count(*) AS n FROM r GROUP BY 1")
def g07_decision_counts(spark: SparkSession, sf: str) -> DataFrame:
    return gate.judge(*claims(spark, sf)).groupBy("decision").agg(F.count("*").alias("n"))


@query("SELECT h AS hint, e AS evidence, CASE WHEN h = 'disputed' OR e = 'disputed' THEN 'disputed' WHEN h = 'inferred' OR e = 'inferred' THEN 'inferred' WHEN h = 'suspected' OR e = 'suspected' THEN 'suspected' ELSE 'confirmed' END AS final_confidence FROM (SELECT unnest(['disputed', 'inferred', 'suspected', 'confirmed']) AS h), (SELECT unnest(['disputed', 'inferred', 'suspected', 'confirmed']) AS e)")
def g04_g06_final_confidence(spark: SparkSession, sf: str) -> DataFrame:
    names = F.array(*map(F.lit, text.CONFIDENCE_RANKS))
    pairs = spark.range(1).select(F.explode(names).alias("hint")).select("hint", F.explode(names).alias("evidence"))
    return pairs.select("hint", "evidence", gate.final_confidence(F.col("hint"), F.col("evidence")).alias("final_confidence"))


# -- Q: the catalogue

def spawn_graph(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    nodes = process_nodes(spark, sf)
    return nodes, folds.fold_edges(parsers.spawned(relations(spark, sf), nodes)[0])


@query(f"WITH {SPAWN_EDGES}, u AS (SELECT DISTINCT host, pid, cs, parent, parent_start FROM edge) SELECT host AS host_hostname, pid, parent AS parent_pid, strftime(parent_start, '%Y') AS parent_year FROM u")
def q01_j08_parent_of(spark: SparkSession, sf: str) -> DataFrame:
    nodes, edges = spawn_graph(spark, sf)
    n = nodes.select("node_key", "host_hostname", "pid", "start_time")
    return catalogue.parents_of(n.select("node_key", "host_hostname", "pid"), edges, n).select("host_hostname", "pid", "parent_pid", F.date_format("parent_start_time", "yyyy").alias("parent_year"))


HOPS = "n AS (SELECT max(c_custkey) AS n FROM customer), e AS (SELECT DISTINCT o_custkey AS a, (o_custkey * 7 + 1 + 50 * (o_orderkey % 2)) % n + 1 AS b FROM orders, n)"


def hops(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, int]:
    """Edges between customers, at most two from each; every twentieth customer; and how many customers there are."""
    n = table(spark, sf, "customer").agg(F.max("c_custkey")).first()[0]
    k = F.col("o_custkey")
    e = table(spark, sf, "orders").select(k.alias("src_key"), ((k * 7 + 1 + 50 * (F.col("o_orderkey") % 2)) % n + 1).alias("dst_key")).distinct().withColumn("edge_type", F.lit("Spawned"))
    return e, table(spark, sf, "customer").where("c_custkey % 20 = 0").select(F.col("c_custkey").alias("node_key")), n


WALKS = f"{HOPS}, w AS (SELECT c_custkey AS start, c_custkey AS node, 0 AS depth, ',' || c_custkey || ',' AS path FROM customer WHERE c_custkey % 20 = 0 UNION ALL SELECT start, b, depth + 1, path || b || ',' FROM w JOIN e ON w.node = e.a WHERE depth < 6"


@query(f"WITH RECURSIVE {WALKS} AND NOT contains(path, ',' || b || ',')) SELECT start AS start_node, node, depth FROM w")
def q02_j09_chains(spark: SparkSession, sf: str) -> DataFrame:
    e, starts, _ = hops(spark, sf)
    return catalogue.execution_chains(e, starts, 6).select(F.col("start").alias("start_node"), F.col("node_key").alias("node"), F.col("depth"))


@query(f"WITH RECURSIVE {WALKS}) SELECT start AS start_node, node, depth, count(*) AS n_walks FROM w GROUP BY 1, 2, 3")
def q02_chain_levels(spark: SparkSession, sf: str) -> DataFrame:
    """A row a start, node and level, with the number of walks instead of the walks."""
    e, starts, _ = hops(spark, sf)
    return graph.chains(e, starts, 6).select(F.col("start").alias("start_node"), F.col("node_key").alias("node"), "depth", F.col("n_walks").cast("long").alias("n_walks"))


@query("SELECT p_partkey, lower(n) AS name FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'svchost.exe' WHEN 1 THEN 'Explorer.exe' ELSE 'other.exe' END AS n, p_size FROM part) WHERE n <> 'other.exe' AND NOT ((n = 'svchost.exe' AND p_size % 2 = 0) OR (n = 'Explorer.exe' AND p_size % 5 = 0 AND p_size % 2 <> 0))")
def q03_masquerade(spark: SparkSession, sf: str) -> DataFrame:
    k, s = F.col("p_partkey") % 3, F.col("p_size")
    df = table(spark, sf, "part").select("p_partkey", F.when(k == 0, "svchost.exe").when(k == 1, "Explorer.exe").otherwise("other.exe").alias("name"), F.concat(F.when(s % 2 == 0, "C:\\Windows\\System32\\").when(s % 5 == 0, "C:\\Windows\\").otherwise("C:\\Temp\\"), F.when(k == 0, "svchost.exe").otherwise("EXPLORER.EXE")).alias("image_path"))
    return catalogue.masquerading(df).select("p_partkey", F.lower("name").alias("name"))


@query(f"WITH {ITEM}, s AS (SELECT host, name, min_by(l_suppkey, seq) % 2 = 0 AS same FROM item GROUP BY 1, 2) SELECT host AS host_hostname, name AS service_name, CASE WHEN same THEN regexp_replace(name, '^.*/', '') ELSE 'x' END AS image_stem FROM s")
def q04_service_mismatch(spark: SparkSession, sf: str) -> DataFrame:
    return catalogue.service_mismatch(service_nodes(spark, sf)).select("host_hostname", "service_name", "image_stem")


@query(f"WITH {ITEM} SELECT host AS host_hostname, path FROM ({FILE_SQL}) WHERE NOT on_disk")
def q05_absent_file(spark: SparkSession, sf: str) -> DataFrame:
    return catalogue.absent_files(folds.fold(file_obs(spark, sf), S.FILE)).select("host_hostname", F.col("k_path").alias("path"))


@query("SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'f' || s_nationkey END AS file FROM supplier WHERE s_suppkey % 2 = 0 AND s_nationkey % 3 <> 0")
def j10_references_to_absent(spark: SparkSession, sf: str) -> DataFrame:
    edges = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("f"), "s_nationkey").alias("dst_key"), F.when(F.col("s_suppkey") % 2 == 0, "References").otherwise("Read").alias("edge_type"))
    files = table(spark, sf, "nation").select(F.concat(F.lit("f"), "n_nationkey").alias("node_key"), (F.col("n_nationkey") % 3 == 0).alias("on_disk"), F.concat(F.lit("f"), "n_nationkey").alias("full_path"))
    return catalogue.references_to_absent(edges, files).select("id", F.col("full_path").alias("file"))


ADDRESS = "CASE s_suppkey % 5 WHEN 0 THEN '10.1.' WHEN 1 THEN '172.16.' WHEN 2 THEN '8.8.' WHEN 3 THEN '192.168.' ELSE '172.32.' END || s_nationkey || '.' || s_suppkey % 250"


def endpoints(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey") % 5
    addr = F.concat(F.when(k == 0, "10.1.").when(k == 1, "172.16.").when(k == 2, "8.8.").when(k == 3, "192.168.").otherwise("172.32."), "s_nationkey", F.lit("."), F.col("s_suppkey") % 250)
    return table(spark, sf, "supplier").select(F.col("s_suppkey"), F.concat(F.lit("e"), "s_suppkey").alias("node_key"), addr.alias("remote_addr"), F.lit(445).alias("remote_port"), F.lit(False).alias("is_internal"))


@query(f"SELECT s_suppkey, {ADDRESS} AS remote_addr, s_suppkey % 5 IN (0, 1, 3) AS is_private FROM supplier")
def q11_private_addresses(spark: SparkSession, sf: str) -> DataFrame:
    return catalogue.private_endpoints(endpoints(spark, sf)).select("s_suppkey", "remote_addr", "is_private")


@query(f"WITH a AS (SELECT s_suppkey, {ADDRESS} AS addr FROM supplier) SELECT DISTINCT l_orderkey AS orderkey, addr AS remote_addr FROM lineitem JOIN a ON l_suppkey = s_suppkey WHERE l_suppkey % 5 IN (0, 1, 3) AND l_partkey % 2 = 0")
def q06_lateral_movement(spark: SparkSession, sf: str) -> DataFrame:
    ends = endpoints(spark, sf)
    li = table(spark, sf, "lineitem").join(ends.select("s_suppkey", "remote_addr"), F.col("l_suppkey") == F.col("s_suppkey"))
    key = F.concat_ws("/", "l_orderkey", "l_suppkey", "l_partkey")
    procs = li.select(key.alias("node_key"), F.col("l_orderkey").alias("orderkey"), F.when(F.col("l_partkey") % 2 == 0, F.concat(F.lit("net use \\\\"), "remote_addr")).otherwise("dir").alias("command_line")).distinct()
    edges = li.select(key.alias("src_key"), F.concat(F.lit("e"), "l_suppkey").alias("dst_key"), F.lit("Connected").alias("edge_type")).distinct()
    return catalogue.lateral_movement(procs, edges, ends).select("orderkey", "remote_addr").distinct()


@query(f"WITH {PROC}, f AS (SELECT host, pid, start, list(DISTINCT obs) AS o FROM proc GROUP BY ALL) SELECT host AS host_hostname, pid, strftime(start, '%Y') AS year FROM f WHERE list_contains(o, 'P') AND NOT list_contains(o, 'F')")
def q08_q09_u06_hidden(spark: SparkSession, sf: str) -> DataFrame:
    return catalogue.hidden(process_nodes(spark, sf), "P", "F").select("host_hostname", "pid", F.date_format("start_time", "yyyy").alias("year"))


@query(f"WITH {EDGE}, l AS (SELECT src, dst, ts, min_by(CAST(floor(l_quantity) AS INT), s) AS logon_type FROM e GROUP BY src, dst, ts) SELECT src AS src_key, dst AS dst_key, strftime(ts, '%Y') AS year FROM l WHERE logon_type = 10")
def q12_logons(spark: SparkSession, sf: str) -> DataFrame:
    return catalogue.logons(edge_table(spark, sf, "Logon"), logon_type=10).select("src_key", "dst_key", F.date_format("ts", "yyyy").alias("year"))


@query(f"WITH {EDGE} SELECT dst AS dst_key, count(DISTINCT CAST(substr(src, 2) AS BIGINT) % 60) AS n_hosts FROM edge GROUP BY 1 HAVING count(DISTINCT CAST(substr(src, 2) AS BIGINT) % 60) >= 2")
def q13_j11_cross_host(spark: SparkSession, sf: str) -> DataFrame:
    hosts = spark.range(500).select(F.concat(F.lit("n"), "id").alias("node_key"), (F.col("id") % 60).alias("host"))
    return catalogue.cross_host(edge_table(spark, sf), hosts)


@query(f"WITH {PROC} SELECT host AS host_hostname, pid, count(DISTINCT start) AS n_starts FROM proc GROUP BY 1, 2 HAVING count(DISTINCT start) > 1")
def q14_pid_recycling(spark: SparkSession, sf: str) -> DataFrame:
    return catalogue.recycled_pids(process_nodes(spark, sf))


@query(f"WITH {PROC}, b AS (SELECT *, {LOGGED} FROM proc) SELECT host AS host_hostname, pid, strftime(start, '%Y') AS year FROM b GROUP BY host, pid, start HAVING bool_or(coalesce(name <> b_name, false) OR coalesce(image <> b_image, false) OR coalesce(cmd <> b_cmd, false))")
def q15_disputed(spark: SparkSession, sf: str) -> DataFrame:
    return catalogue.disputed(process_nodes(spark, sf)).select("host_hostname", "pid", F.date_format("start_time", "yyyy").alias("year"))


ACC = "f AS (SELECT doc_id FROM documents WHERE n_chars < 1500), t AS (SELECT doc_id FROM labels WHERE quality = 0), c AS (SELECT count(*) FILTER (WHERE f.doc_id IS NOT NULL AND t.doc_id IS NOT NULL) AS tp, count(*) FILTER (WHERE t.doc_id IS NULL) AS unfounded, count(*) FILTER (WHERE f.doc_id IS NULL) AS missed FROM f FULL JOIN t ON f.doc_id = t.doc_id)"


@query(f"WITH {ACC} SELECT CAST(tp AS BIGINT) AS tp, CAST(unfounded AS BIGINT) AS unfounded, CAST(missed AS BIGINT) AS missed, round(tp / (tp + unfounded), 6) AS precision, round(tp / (tp + missed), 6) AS recall FROM c")
def q16_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    found, truth = table(spark, sf, "documents").where("n_chars < 1500"), table(spark, sf, "labels").where("quality = 0")
    return catalogue.accuracy(found, truth, "doc_id").select("tp", "unfounded", "missed", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query("SELECT CASE WHEN n_chars < 500 THEN 'confirmed' WHEN n_chars < 1000 THEN 'suspected' ELSE 'inferred' END AS confidence, count(*) AS n, CAST(count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0)) AS BIGINT) AS n_true FROM documents GROUP BY 1")
def q16_calibration(spark: SparkSession, sf: str) -> DataFrame:
    found = table(spark, sf, "documents").select("doc_id", F.when(F.col("n_chars") < 500, "confirmed").when(F.col("n_chars") < 1000, "suspected").otherwise("inferred").alias("confidence"))
    return catalogue.calibration(found, table(spark, sf, "labels").where("quality = 0"), "doc_id")


@query(f"WITH RECURSIVE {EDGE}, both_ AS (SELECT src AS a, dst AS b FROM edge UNION SELECT dst, src FROM edge), w(node, depth) AS (SELECT 'n1', 0 UNION SELECT b, depth + 1 FROM w JOIN both_ ON node = a WHERE depth < 2) SELECT node AS node_key, min(depth) AS depth FROM w GROUP BY 1")
def j12_neighbourhood(spark: SparkSession, sf: str) -> DataFrame:
    return graph.neighbourhood(edge_table(spark, sf), spark.createDataFrame([("n1",)], "node_key string"), 2).select("node_key", "depth")


@query(f"WITH RECURSIVE {HOPS}, p AS (SELECT c_custkey AS start, (c_custkey * 11 + 5) % n + 1 AS goal FROM customer, n WHERE c_custkey % 20 = 0), w(start, goal, node, depth) AS (SELECT start, goal, start, 0 FROM p UNION SELECT w.start, w.goal, e.b, depth + 1 FROM w JOIN e ON w.node = e.a WHERE depth < 8) SELECT start AS start_node, goal AS goal_node, min(depth) AS depth, min(depth) + 1 AS n_nodes FROM w WHERE node = goal GROUP BY 1, 2")
def j12_paths(spark: SparkSession, sf: str) -> DataFrame:
    e, starts, n = hops(spark, sf)
    pairs = starts.select(F.col("node_key").alias("start"), ((F.col("node_key") * 11 + 5) % n + 1).alias("goal"))
    return graph.paths_between(e, pairs, 8).select(F.col("start").alias("start_node"), F.col("goal").alias("goal_node"), "depth", F.size("path").alias("n_nodes"))


@query(f"WITH {EDGE}, c AS (SELECT s_suppkey AS id, 'n' || (s_suppkey % 520) AS s, 'u' || (s_suppkey % 44) AS o FROM supplier), h AS (SELECT id, count(*) AS n, max(confidence = 'confirmed') AS best FROM c JOIN edge ON src = s AND dst = o AND ts >= '1994-01-01' AND ts < '1997-01-01' GROUP BY 1) SELECT id AS claim_id, n IS NOT NULL AS found, coalesce(n, 0) AS n_edges, CASE WHEN best THEN 'confirmed' WHEN n IS NOT NULL THEN 'suspected' END AS confidence FROM c LEFT JOIN h USING (id)")
def j12_claims(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    made = table(spark, sf, "supplier").select(k.alias("claim_id"), F.concat(F.lit("n"), k % 520).alias("subject"), F.lit("Connected").alias("predicate"), F.concat(F.lit("u"), k % 44).alias("object"), F.lit("1994-01-01").cast("timestamp").alias("start"), F.lit("1997-01-01").cast("timestamp").alias("end"))
    return graph.verify_claims(edge_table(spark, sf), made).select("claim_id", "found", "n_edges", "confidence")


@query(f"WITH {EDGE} SELECT src AS src_key, dst AS dst_key, confirmed_by FROM edge WHERE ts >= '1996-01-01' AND ts < '1998-01-01'")
def j12_timeline(spark: SparkSession, sf: str) -> DataFrame:
    return graph.timeline(edge_table(spark, sf), F.lit("1996-01-01").cast("timestamp"), F.lit("1998-01-01").cast("timestamp")).select("src_key", "dst_key", joined("confirmed_by").alias("confirmed_by"))

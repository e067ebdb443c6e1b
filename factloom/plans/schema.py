"""The closed schema: ten node types and twelve edge types, each column with its merge policy.

A node type is data: identity columns, columns with policies, checks. The fold in
factloom.plans.fold turns policies into aggregate expressions.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import file_path_key, key_text, registry_path_key

# Merge policies.
FIRST = "first"  # the first row's value
KNOWN = "first known"  # the first value that is not null
LATEST, EARLIEST = "max", "min"
ANY, ALL = "or", "and"
UNION = "ordered union"
LOGGED = "first known, later differences logged"
NEWEST = "of the newest write, filled up from later rows"
MEMORY = "the last memory source, or the first known"
RANKED = "most specific account"
UNIQUE = "first known, differences are an error"

#: Every observation carries where it comes from, and its place in the order of arrival.
PROVENANCE = {"evidence_hash": "string", "derivation": "string", "observed_at": "timestamp"}


@dataclass(frozen=True)
class NodeType:
    name: str
    key: dict[str, tuple[str, Callable[[], Column]]]  # identity column -> type, expression over raw columns
    raw: dict[str, str]  # raw columns that make up the identity, kept as the first row has them
    columns: dict[str, tuple[str, str]] = field(default_factory=dict)  # column -> type, policy
    required: tuple[str, ...] = ()
    checks: dict[str, str] = field(default_factory=dict)  # name -> SQL condition that must hold
    logs: bool = False
    newest_by: str | None = None

    def key_columns(self) -> list[str]:
        return list(self.key)

    def given(self) -> dict[str, str]:
        """Raw columns that an identity column holds as they are -> that identity column."""
        return {make.column: name for name, (_, make) in self.key.items() if isinstance(make, Same)}

    def keyed(self, df):
        """df with the identity columns and node_key."""
        df = df.withColumns({name: make() for name, (_, make) in self.key.items()})
        return df.withColumn("node_key", key_text(self.name, *(F.col(k) for k in self.key)))

    def all_columns(self) -> dict[str, str]:
        return PROVENANCE | self.raw | {c: t for c, (t, _) in self.columns.items()}


@dataclass(frozen=True)
class Same:
    """A raw column that is an identity column as it stands: all rows of an identity have one value of it."""

    column: str

    def __call__(self) -> Column:
        return F.col(self.column)


def _same(column: str, kind: str) -> tuple[str, Callable[[], Column]]:
    return kind, Same(column)


_LOG = "map<string,array<struct<value:string,source:string>>>"

HOST = NodeType("Host", {"host_id": ("string", lambda: F.coalesce("machine_guid", "hostname"))}, {"hostname": "string", "machine_guid": "string"}, {"os_version": ("string", KNOWN), "timezone": ("string", FIRST), "network_subnet": ("string", KNOWN)}, required=("hostname",))
USER = NodeType("User", {"sid_key": _same("sid", "string")}, {"sid": "string"}, {"username": ("string", KNOWN), "domain": ("string", KNOWN), "account_type": ("string", RANKED)}, required=("sid",), checks={"sid_length": "length(sid) >= 5"})
ENDPOINT = NodeType("NetworkEndpoint", {"k_protocol": _same("protocol", "string"), "k_addr": _same("remote_addr", "string"), "k_port": _same("remote_port", "int")}, {"protocol": "string", "remote_addr": "string", "remote_port": "int"}, {"domain": ("string", KNOWN), "is_internal": ("boolean", FIRST)}, required=("protocol", "remote_addr", "remote_port"), checks={"port": "remote_port between 0 and 65535"})
FILE = NodeType(
    "File",
    {"k_host": _same("host_hostname", "string"), "k_path": ("string", lambda: file_path_key(F.col("full_path")))},
    {"host_hostname": "string", "full_path": "string"},
    {"sha256": ("string", UNIQUE), "md5": ("string", KNOWN), "size_bytes": ("long", KNOWN), "mtime": ("timestamp", EARLIEST), "atime": ("timestamp", LATEST), "ctime": ("timestamp", EARLIEST), "btime": ("timestamp", EARLIEST), "mft_record_number": ("long", KNOWN), "is_deleted": ("boolean", ANY), "is_orphan": ("boolean", ANY), "on_disk": ("boolean", ANY), "referenced_by": ("array<string>", UNION)},
    required=("host_hostname", "full_path"),
    checks={"size": "size_bytes is null or size_bytes >= 0", "mft": "mft_record_number is null or mft_record_number >= 0"},
)
REGISTRY = NodeType(
    "RegistryKey",
    {"k_host": _same("host_hostname", "string"), "k_hive": _same("hive_name", "string"), "k_path": ("string", lambda: registry_path_key(F.col("key_path"))), "k_value": _same("value_name", "string")},
    {"host_hostname": "string", "hive_name": "string", "key_path": "string", "value_name": "string"},
    {"value_str": ("string", NEWEST), "value_bin": ("binary", NEWEST), "value_type": ("string", NEWEST), "last_write_time": ("timestamp", LATEST)},
    required=("host_hostname", "hive_name", "key_path"),
    newest_by="last_write_time",
)
PROCESS = NodeType(
    "Process",
    {"k_host": _same("host_hostname", "string"), "k_pid": _same("pid", "long"), "k_start": _same("start_time", "timestamp")},
    {"host_hostname": "string", "pid": "long", "start_time": "timestamp"},
    {"name": ("string", LOGGED), "image_path": ("string", LOGGED), "command_line": ("string", LOGGED), "parent_pid": ("long", LOGGED), "exit_time": ("timestamp", LATEST), "sha256": ("string", LOGGED), "observed_by": ("array<string>", UNION)},
    required=("host_hostname", "pid", "name"),
    checks={"pid": "pid >= 0", "parent": "parent_pid is null or parent_pid >= 0"},
    logs=True,
)
TASK = NodeType("ScheduledTask", {"k_host": _same("host_hostname", "string"), "k_task": _same("task_path", "string")}, {"host_hostname": "string", "task_path": "string"}, {"author": ("string", LOGGED), "command": ("string", LOGGED), "arguments": ("string", LOGGED), "trigger_type": ("string", LOGGED), "is_enabled": ("boolean", ALL), "last_run_time": ("timestamp", LATEST)}, required=("host_hostname", "task_path"), logs=True)
SERVICE = NodeType("Service", {"k_host": _same("host_hostname", "string"), "k_service": _same("service_name", "string")}, {"host_hostname": "string", "service_name": "string"}, {"display_name": ("string", LOGGED), "image_path": ("string", LOGGED), "start_type": ("string", LOGGED), "service_account": ("string", LOGGED), "is_running": ("boolean", MEMORY)}, required=("host_hostname", "service_name"), logs=True)
MODULE = NodeType(
    "Module",
    {"k_host": _same("host_hostname", "string"), "k_path": ("string", lambda: file_path_key(F.col("image_path"))), "k_base": _same("base_address", "decimal(20,0)")},
    {"host_hostname": "string", "image_path": "string", "base_address": "decimal(20,0)"},
    {"size": ("long", KNOWN), "sha256": ("string", UNIQUE), "is_kernel": ("boolean", UNIQUE), "observed_by": ("array<string>", UNION)},
    required=("host_hostname", "image_path", "base_address"),
    checks={"base": "base_address >= 0"},
)
DETECTION = NodeType("AntivirusDetection", {"k_host": _same("host_hostname", "string"), "k_event": _same("event_id", "int"), "k_time": _same("detection_time", "timestamp"), "k_threat": _same("threat_name", "string")}, {"host_hostname": "string", "event_id": "int", "detection_time": "timestamp", "threat_name": "string"}, {"action_taken": ("string", KNOWN), "file_path": ("string", KNOWN)}, required=("host_hostname", "event_id", "detection_time", "threat_name"))

NODE_TYPES = {t.name: t for t in (HOST, USER, ENDPOINT, FILE, REGISTRY, PROCESS, TASK, SERVICE, MODULE, DETECTION)}


@dataclass(frozen=True)
class EdgeType:
    name: str
    sources: tuple[str, ...]
    targets: tuple[str, ...]
    columns: dict[str, str] = field(default_factory=dict)
    multi: bool = True  # has confirmed_by, and so a confidence


EDGE_TYPES = {
    e.name: e
    for e in (
        EdgeType("Spawned", ("Process",), ("Process",)),
        EdgeType("Executed", ("User", "ScheduledTask", "Service"), ("Process",), {"command_line": "string"}),
        EdgeType("Connected", ("Process",), ("NetworkEndpoint",), {"direction": "string", "local_port": "int", "state": "string"}),
        EdgeType("Wrote", ("Process",), ("File",), {"operation": "string", "bytes_written": "long"}),
        EdgeType("Read", ("Process",), ("File",)),
        EdgeType("Deleted", ("Process",), ("File",)),
        EdgeType("AuthenticatedAs", ("Process",), ("User",), {"logon_type": "int", "is_elevated": "boolean"}, multi=False),
        EdgeType("Logon", ("User",), ("Host",), {"logon_type": "int", "source_ip": "string", "success": "boolean", "failure_reason": "string"}),
        EdgeType("Persisted", ("File",), ("RegistryKey", "ScheduledTask", "Service"), {"mechanism": "string"}),
        EdgeType("Loaded", ("Process", "Host"), ("Module",), {"load_address": "decimal(20,0)"}),
        EdgeType("Modified", ("Process",), ("RegistryKey",), {"operation": "string", "old_str": "string", "old_bin": "binary", "new_str": "string", "new_bin": "binary"}),
        EdgeType("References", ("RegistryKey", "ScheduledTask", "Service"), ("File",), {"reference_type": "string"}, multi=False),
    )
}


def checked(df, spec: NodeType):
    """Rows of df with `problems`: the names of the checks that fail, empty for a valid row.

    Columns outside the schema are an error; missing optional ones become null.
    """
    known = set(spec.all_columns()) | {"disagreements", "seq", "run_id", "host_hostname"}
    if extra := [c for c in df.columns if c not in known]:
        raise ValueError(f"{spec.name}: columns outside the schema: {extra}")
    df = df.withColumns({c: F.lit(None).cast(t) for c, t in spec.all_columns().items() if c not in df.columns})
    conditions = {"evidence_hash": "evidence_hash rlike '^[0-9a-f]{64}$'", "derivation": "length(derivation) >= 1", "observed_at": "observed_at is not null", **{f"{c}_missing": f"{c} is not null" for c in spec.required}, **spec.checks}
    problems = F.array_compact(F.array(*(F.when(~F.coalesce(F.expr(sql), F.lit(False)), F.lit(name)) for name, sql in conditions.items())))
    return df.withColumn("problems", problems)

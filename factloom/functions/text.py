"""Scalar functions on strings, times and keys, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
MEMORY_SOURCE = "svcscan"
ACCOUNT_RANKS = {"domain": 3, "local": 3, "service": 2, "well-known": 1}
CONFIDENCE_RANKS = {"disputed": 0, "inferred": 1, "suspected": 2, "confirmed": 3}
PATH_PREFIXES = ("file:_", "webfile:_")


def file_path_key(path: Column) -> Column:
    """Forward slashes, one leading slash and then a ??/ prefix off, lower case."""
    slashed = F.translate(path, "\\", "/")
    return F.lower(F.regexp_replace(F.regexp_replace(slashed, "^/", ""), r"^\?\?/", ""))


def registry_path_key(path: Column) -> Column:
    """Forward slashes, none at the ends, lower case."""
    return F.lower(F.regexp_replace(F.translate(path, "\\", "/"), "^/+|/+$", ""))


def iso_time_text(ts: Column) -> Column:
    """The first space becomes a T unless there is a T already."""
    return F.when(F.contains(ts, F.lit(" ")) & ~F.contains(ts, F.lit("T")), F.regexp_replace(ts, "^([^ ]*) ", "$1T")).otherwise(ts)


def parse_time(ts: Column) -> Column:
    """An instant, or null where the text is null, empty or no time."""
    return F.try_to_timestamp(F.nullif(ts, F.lit("")))


def detection_path(path: Column) -> Column:
    """The first of several paths, without its source prefix; null for null and empty."""
    first = F.regexp_replace(F.split_part(path, F.lit(";"), F.lit(1)), r"^\s+|\s+$", "")
    return F.when(F.length(path) > 0, F.regexp_replace(first, f"^(?:{'|'.join(PATH_PREFIXES)})", ""))


def key_text(node_type: str, *parts: Column) -> Column:
    """A node's identity as one JSON string in which types and nulls stay distinct."""
    fields = [F.lit(node_type).alias("t"), *(p.alias(f"k{i}") for i, p in enumerate(parts))]
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timeZone": "UTC"})


def utc_text(ts: Column) -> Column:
    """An instant as ISO text in UTC, whatever the session's zone: microseconds only where there are any, and the offset +00:00."""
    text = F.get_json_object(F.to_json(F.struct(ts.alias("t")), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx", "timeZone": "UTC"}), "$.t")
    return F.replace(text, F.lit(".000000"), F.lit(""))


def account_rank(account_type: Column) -> Column:
    rank = F.lit(0)
    for name, r in ACCOUNT_RANKS.items():
        rank = F.when(account_type == name, F.lit(r)).otherwise(rank)
    return rank


def confidence_rank(confidence: Column) -> Column:
    rank = F.lit(None).cast("int")
    for name, r in CONFIDENCE_RANKS.items():
        rank = F.when(confidence == name, F.lit(r)).otherwise(rank)
    return rank


def confidence_name(rank: Column) -> Column:
    return F.when(rank.isNotNull(), F.element_at(F.array(*(F.lit(n) for n in CONFIDENCE_RANKS)), rank.cast("int") + 1))


def edge_confidence(confirmed_by: Column) -> Column:
    """By the length of the list, repeats included."""
    n = F.coalesce(F.size(confirmed_by), F.lit(0))
    return F.when(n >= 2, "confirmed").when(n == 1, "suspected").otherwise("inferred")


def ipv4_number(address: Column) -> Column:
    """A dotted address as a number; null for anything else."""
    part = F.split(address, r"\.")
    octet = [F.try_element_at(part, F.lit(i)).cast("long") for i in (1, 2, 3, 4)]
    value = octet[0] * 16777216 + octet[1] * 65536 + octet[2] * 256 + octet[3]
    return F.when(address.rlike(r"^(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.(?!$)|$)){4}$"), value)


def is_private_ipv4(address: Column) -> Column:
    """10/8, 172.16/12, 192.168/16 and 127/8; null for no IPv4 address."""
    n = ipv4_number(address)
    inside = lambda first, bits: F.shiftrightunsigned(n, 32 - bits) == (first >> (32 - bits))
    return inside(0x0A000000, 8) | inside(0xAC100000, 12) | inside(0xC0A80000, 16) | inside(0x7F000000, 8)


def base_name(path: Column) -> Column:
    return F.lower(F.element_at(F.split(F.translate(path, "\\", "/"), "/"), -1))


def seconds_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 1e6

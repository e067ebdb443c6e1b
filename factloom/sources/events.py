"""Event-log records: XML text to typed rows, with counts of what could not be used."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import detection_path, iso_time_text

# Names in the records.
THREAT, ACTION, PATH = "Threat Name", "Action Name", "Path"
_SYSTEM = "System struct<EventID: struct<_VALUE: string, _Qualifiers: string>, TimeCreated: struct<_SystemTime: string, _VALUE: string>, Computer: string, EventRecordID: string>"
_DATA = "EventData struct<Data: array<struct<_Name: string, _VALUE: string>>>"
EVENT_XML = f"{_SYSTEM}, {_DATA}, _corrupt_record string"
SYSTEM_XML = f"{_SYSTEM}, _corrupt_record string"


def parse_records(records: DataFrame, xml: str = "value") -> DataFrame:
    """Adds `valid` and the record's fields to rows of XML text; invalid rows keep nulls."""
    e = F.from_xml(F.col(xml), EVENT_XML, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    df = records.withColumn("_e", e)
    system = F.col("_e.System")
    event_id = F.expr("try_cast(_e.System.EventID._VALUE as int)")
    record_id = F.expr("try_cast(_e.System.EventRecordID as bigint)")
    time = system["TimeCreated"]["_SystemTime"]
    computer = F.nullif(system["Computer"], F.lit(""))
    valid = usable()
    named = F.filter(F.coalesce(F.col("_e.EventData.Data"), F.array().cast("array<struct<_Name:string,_VALUE:string>>")), lambda d: d["_Name"].isNotNull())
    pairs = F.transform(named, lambda d: F.struct(d["_Name"].alias("k"), F.coalesce(d["_VALUE"], F.lit("")).alias("v")))
    # Of pairs with one name the last counts.
    last = F.filter(F.transform(pairs, lambda p, i: F.struct(p["k"].alias("k"), p["v"].alias("v"), i.alias("i"))), lambda p: ~F.exists(F.slice(pairs, p["i"] + 2, F.size(pairs)), lambda q: q["k"] == p["k"]))
    raw = F.map_from_entries(F.transform(last, lambda p: F.struct(p["k"], p["v"])))
    df = df.withColumn("valid", F.coalesce(valid, F.lit(False))).withColumn("raw_data", F.when(F.col("valid"), raw))
    get = lambda name: F.try_element_at("raw_data", F.lit(name))
    keep = lambda c: F.when(F.col("valid"), c)
    return df.select(
        *[c for c in records.columns], "valid",
        keep(event_id).alias("event_id"), keep(iso_time_text(time)).alias("time_created"), keep(computer).alias("computer"), keep(record_id).alias("_record_id"),
        get(THREAT).alias("threat_name"), get(ACTION).alias("action"), detection_path(get(PATH)).alias("file_path"), "raw_data",
    )


def checked_records(records: DataFrame, xml: str = "value") -> DataFrame:
    """Rows of XML text with `valid` alone: what counting needs, without the named data."""
    e = F.from_xml(F.col(xml), SYSTEM_XML, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    return records.select(e.alias("_e")).select(F.coalesce(usable(), F.lit(False)).alias("valid"))


def usable() -> Column:
    """Whether a parsed record `_e` is whole and has what is required of it."""
    system = F.col("_e.System")
    known_id = F.coalesce(system["EventRecordID"], F.lit("")).isin("") | F.expr("try_cast(_e.System.EventRecordID as bigint)").isNotNull()
    event_id = F.expr("try_cast(_e.System.EventID._VALUE as int)")
    return F.col("_e").isNotNull() & F.col("_e._corrupt_record").isNull() & event_id.isNotNull() & system["TimeCreated"]["_SystemTime"].isNotNull() & F.nullif(system["Computer"], F.lit("")).isNotNull() & known_id


def read_stats(parsed: DataFrame) -> DataFrame:
    return parsed.agg(F.count("*").alias("records_read"), F.count_if("valid").alias("records_yielded"), F.count_if(~F.col("valid")).alias("records_skipped_malformed"))


def read_event_log(spark: SparkSession, path: str) -> DataFrame:
    """A text file with one XML record a line; a file that is not there is an error."""
    if "://" not in path and not Path(path).exists():
        raise FileNotFoundError(path)
    return parse_records(spark.read.text(path))


def to_xml(event_id: Column, time: Column, computer: Column, data: dict[str, Column]) -> Column:
    """A record as XML text; for fixtures and exports."""
    escape = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    items = [F.concat(F.lit(f'<Data Name="{name}">'), F.coalesce(escape(c), F.lit("")), F.lit("</Data>")) for name, c in data.items()]
    return F.concat(F.lit('<Event xmlns="urn:events"><System><EventID>'), event_id.cast("string"), F.lit('</EventID><TimeCreated SystemTime="'), time, F.lit('"/><Computer>'), escape(computer), F.lit("</Computer></System><EventData>"), *items, F.lit("</EventData></Event>"))

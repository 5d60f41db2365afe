"""Field mappings from a parsed journald record to the event schema."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Syslog priority to level; anything else is INFO.
PRIORITY_LEVELS = {
    "0": "FATAL",
    "1": "CRITICAL",
    "2": "CRITICAL",
    "3": "ERROR",
    "4": "WARN",
    "5": "INFO",
    "6": "INFO",
    "7": "DEBUG",
}
DEFAULT_LEVEL = "INFO"
UNKNOWN_SERVICE = "unknown"
# Journald field to metadata key.
META_FIELDS = {"_PID": "pid", "_COMM": "comm", "SYSLOG_FACILITY": "facility", "_HOSTNAME": "hostname"}


def epoch_micros(text: Column) -> Column:
    """Micros since the epoch; a missing field is 0, text that is no integer is null."""
    return F.coalesce(text, F.lit("0")).try_cast("bigint")


def event_time(text: Column) -> Column:
    return F.timestamp_micros(epoch_micros(text))


def level_of(priority: Column) -> Column:
    mapping = F.create_map(*[F.lit(x) for kv in PRIORITY_LEVELS.items() for x in kv])
    return F.coalesce(F.try_element_at(mapping, F.coalesce(priority, F.lit("6"))), F.lit(DEFAULT_LEVEL))


def service_of(unit: Column, identifier: Column) -> Column:
    return F.coalesce(unit, identifier, F.lit(UNKNOWN_SERVICE))


def metadata_json(record: Column) -> Column:
    """JSON object of the optional fields that are present; null when none is."""
    fields = [record[field].alias(key) for field, key in META_FIELDS.items()]
    return F.when(
        F.coalesce(*[record[field] for field in META_FIELDS]).isNotNull(), F.to_json(F.struct(*fields))
    )


def normalise_meta(meta_json: Column) -> Column:
    """An empty object is stored as null."""
    return F.when(F.regexp_replace(meta_json, r"\s", "") != "{}", meta_json)


def meta_map(meta_json: Column) -> Column:
    """Metadata as a map for reading single keys."""
    return F.from_json(meta_json, "map<string,string>")

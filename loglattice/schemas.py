"""Table definitions, value domains and argument bounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# The severity levels, field length bounds and defaults every producer agrees on.
LEVELS = ("DEBUG", "INFO", "WARN", "WARNING", "ERROR", "CRITICAL", "FATAL")
MAX_LENGTHS = {
    "source": 255,
    "service": 255,
    "host": 255,
    "trace_id": 64,
    "span_id": 32,
    "event_type": 100,
    "error_code": 50,
}
MAX_BATCH_EVENTS = 10_000
DEFAULT_CHUNK_VERSION = "v1"

REQUIRED_FIELDS = ("timestamp", "source", "service", "host", "level", "message")

# The twelve columns a log query returns; vectors and keys never leave the store.
EVENT_COLUMNS = (
    "id", "timestamp", "source", "service", "host", "level",
    "trace_id", "span_id", "event_type", "error_code", "message", "meta_json",
)

VECTOR = T.ArrayType(T.FloatType())

RAW_JOURNAL = T.StructType(
    [
        T.StructField(name, T.StringType())
        for name in (
            "__REALTIME_TIMESTAMP", "__CURSOR", "_SYSTEMD_UNIT", "SYSLOG_IDENTIFIER",
            "MESSAGE", "PRIORITY", "_PID", "_COMM", "SYSLOG_FACILITY", "_HOSTNAME",
        )
    ]
)

LOG_EVENTS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("log_hash", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("source", T.StringType()),
        T.StructField("service", T.StringType()),
        T.StructField("host", T.StringType()),
        T.StructField("level", T.StringType()),
        T.StructField("trace_id", T.StringType()),
        T.StructField("span_id", T.StringType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("error_code", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("meta_json", T.StringType()),
        T.StructField("embedding_vector", VECTOR),
        T.StructField("template_id", T.StringType()),
    ]
)

LOG_TEMPLATES = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("template_hash", T.StringType()),
        T.StructField("canonical_text", T.StringType()),
        T.StructField("service", T.StringType()),
        T.StructField("level", T.StringType()),
        T.StructField("embedding_vector", VECTOR),
        T.StructField("embedding_model", T.StringType()),
        T.StructField("embedding_dim", T.IntegerType()),
        T.StructField("canon_version", T.StringType()),
        T.StructField("canon_hash", T.StringType()),
        T.StructField("chunk_version", T.StringType()),
        T.StructField("first_seen", T.TimestampType()),
        T.StructField("last_seen", T.TimestampType()),
        T.StructField("event_count", T.LongType()),
        T.StructField("source_hosts", T.ArrayType(T.StringType())),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)

DEAD_LETTER = T.StructType(
    [
        T.StructField("timestamp", T.StringType()),
        T.StructField("count", T.IntegerType()),
        T.StructField(
            "logs",
            T.ArrayType(
                T.StructType(
                    [T.StructField(c, T.LongType() if c == "id" else T.StringType()) for c in EVENT_COLUMNS]
                    + [T.StructField("raw", T.StringType()), T.StructField("errors", T.ArrayType(T.StringType()))]
                )
            ),
        ),
    ]
)


def check_range(name: str, value: int, low: int, high: int | None = None) -> int:
    """Argument bound shared by every query entry point."""
    if isinstance(value, bool) or not isinstance(value, int):
        raise ValueError(f"{name} must be an integer, got {value!r}")
    if value < low or (high is not None and value > high):
        raise ValueError(f"{name} must be in [{low}, {'∞' if high is None else high}], got {value}")
    return value


def check_level(level: str | None) -> str | None:
    if level and level not in LEVELS:
        raise ValueError(f"unknown level {level!r}; expected one of {LEVELS}")
    return level


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project onto a target table: absent columns become typed nulls, unknown ones are dropped."""
    from pyspark.sql import functions as F

    present = set(df.columns)
    return df.select(
        *[
            F.col(f"`{f.name}`").cast(f.dataType).alias(f.name)
            if f.name in present
            else F.lit(None).cast(f.dataType).alias(f.name)
            for f in schema
        ]
    )


def write_present(df: DataFrame, target: T.StructType) -> DataFrame:
    """Keep only the columns an older target already has, in its order."""
    present = set(df.columns)
    return df.select(*[f"`{f.name}`" for f in target if f.name in present])

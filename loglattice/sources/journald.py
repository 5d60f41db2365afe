"""journald JSON lines, as a batch or as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import journald as J
from ..operators.predicates import TimeLike, instant
from ..schemas import RAW_JOURNAL

CORRUPT = "_corrupt_record"
SOURCE_NAME = "journald"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def stream_lines(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.text(path)


def parse(lines: DataFrame) -> DataFrame:
    """Parse `value`; a line that is no JSON object or has a bad time is kept with its reason."""
    schema = T.StructType([*RAW_JOURNAL.fields, T.StructField(CORRUPT, T.StringType())])
    parsed = lines.select(
        "value",
        F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}).alias("record"),
    )
    is_object = F.ltrim(F.col("value")).startswith("{")
    bad_json = ~is_object | F.col("record").isNull() | F.col("record")[CORRUPT].isNotNull()
    bad_time = J.epoch_micros(F.col("record")["__REALTIME_TIMESTAMP"]).isNull()
    return parsed.withColumn(
        "parse_error", F.when(bad_json, F.lit("not_json")).when(bad_time, F.lit("bad_timestamp"))
    )


def to_events(parsed: DataFrame, host: str) -> DataFrame:
    """Map parsed records of one machine to the event schema."""
    rec = F.col("record")
    return parsed.filter(F.col("parse_error").isNull()).select(
        F.lit(None).cast("bigint").alias("id"),
        J.event_time(rec["__REALTIME_TIMESTAMP"]).alias("timestamp"),
        F.lit(SOURCE_NAME).alias("source"),
        J.service_of(rec["_SYSTEMD_UNIT"], rec["SYSLOG_IDENTIFIER"]).alias("service"),
        F.lit(host).alias("host"),
        J.level_of(rec["PRIORITY"]).alias("level"),
        F.coalesce(rec["MESSAGE"], F.lit("")).alias("message"),
        J.metadata_json(rec).alias("meta_json"),
        rec["__CURSOR"].alias("cursor"),
    )


def quarantined(parsed: DataFrame) -> DataFrame:
    """Lines that could not be read, with the reason."""
    return parsed.filter(F.col("parse_error").isNotNull()).select("value", "parse_error")


def look_back(events: DataFrame, as_of: TimeLike, hours: int = 24) -> DataFrame:
    return events.filter(F.col("timestamp") >= instant(as_of) - F.expr(f"INTERVAL {int(hours)} HOURS"))


def read_events(spark: SparkSession, path: str, host: str, as_of: TimeLike | None = None, hours: int = 24) -> DataFrame:
    """Batch scan of a journal export, optionally only the hours before `as_of`."""
    events = to_events(parse(read_lines(spark, path)), host)
    return events if as_of is None else look_back(events, as_of, hours)

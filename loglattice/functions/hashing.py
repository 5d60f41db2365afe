"""Content hash of a log event."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def timestamp_text(ts: Column) -> Column:
    """UTC text of an instant: micros appear only when non-zero, then the offset."""
    text = ts.cast("string")  # seconds, then the fraction without its trailing zeros
    return F.concat(F.when(F.length(text) == 19, text).otherwise(F.rpad(text, 26, "0")), F.lit("+00:00"))


def log_hash(timestamp: Column, host: Column, service: Column, message: Column) -> Column:
    """16 hex digits over timestamp, host, service and message; needs a UTC session time zone."""
    sep = F.lit("|")
    joined = F.concat(timestamp_text(timestamp), sep, host, sep, service, sep, message)
    return F.substring(F.sha2(joined, 256), 1, 16)


def hash_to_id(hex_hash: Column, digits: int = 15) -> Column:
    """A non-negative bigint from the leading hex digits: an id that survives task retries."""
    return F.conv(F.substring(hex_hash, 1, digits), 16, 10).cast("bigint")

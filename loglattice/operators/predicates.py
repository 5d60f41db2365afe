"""Filters shared by queries, searches and maintenance."""

from __future__ import annotations

from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import check_level

TimeLike = datetime | str


def instant(value: TimeLike) -> Column:
    """A constant UTC timestamp, folded at planning time so that it reaches the Parquet scan."""
    if isinstance(value, datetime):
        utc = value if value.tzinfo is None else value.astimezone(UTC)
        value = utc.replace(tzinfo=None).isoformat(sep=" ")
    return F.lit(value).cast("timestamp")


def event_predicate(
    *,
    service: str | None = None,
    host: str | None = None,
    level: str | None = None,
    start: TimeLike | None = None,
    end: TimeLike | None = None,
    ignore_case: bool = False,
) -> list[Column]:
    """Equality and inclusive time-window conditions; a falsy argument adds none.

    `ignore_case` compares service and host under a case-insensitive collation. Such a
    predicate is evaluated after the scan, so leave it off for large time ranges.
    """
    check_level(level)
    preds: list[Column] = []
    for name, value in (("service", service), ("host", host)):
        if value:
            column = F.collate(F.col(name), "UNICODE_CI") if ignore_case else F.col(name)
            preds.append(column == F.lit(value))
    if level:
        preds.append(F.col("level") == F.lit(level))
    if start:
        preds.append(F.col("timestamp") >= instant(start))
    if end:
        preds.append(F.col("timestamp") <= instant(end))
    return preds


def conjunction(preds: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, preds, F.lit(True))


def select_events(events: DataFrame, **filters) -> DataFrame:
    """Apply the event predicate; on a table laid out by day the time bounds also prune directories."""
    preds = event_predicate(**filters)
    if "event_date" in events.columns:
        if filters.get("start"):
            preds.append(F.col("event_date") >= F.to_date(instant(filters["start"])))
        if filters.get("end"):
            preds.append(F.col("event_date") <= F.to_date(instant(filters["end"])))
    return events.filter(conjunction(preds)) if preds else events


def having_vector(df: DataFrame, column: str = "embedding_vector") -> DataFrame:
    return df.filter(F.col(column).isNotNull())


def orphans(events: DataFrame) -> DataFrame:
    """Events not linked to a template yet."""
    return events.filter(F.col("template_id").isNull())


def expired(df: DataFrame, cutoff: TimeLike, column: str = "timestamp") -> DataFrame:
    """Rows strictly older than the cutoff."""
    return df.filter(F.col(column) < instant(cutoff))


def after_id(df: DataFrame, last_id: int, limit: int | None = None) -> DataFrame:
    """Keyset continuation. Without a limit it is one distributed pass over the remainder."""
    rest = df.filter(F.col("id") > F.lit(last_id))
    return rest if limit is None else rest.orderBy("id").limit(limit)


def in_keys(df: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """IN-list lookup against a key table of any size; the join side is chosen from its statistics."""
    return df.join(keys.select(column), column, "left_semi")

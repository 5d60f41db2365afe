"""Filtered log queries with paging."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.predicates import TimeLike, instant, select_events
from ..schemas import EVENT_COLUMNS, check_range

MAX_LIMIT = 10_000


def query_logs(events: DataFrame, *, limit: int = 100, offset: int = 0, **filters) -> DataFrame:
    """Newest first. Paging by offset re-reads what it skips; deep pages belong to `older_than`."""
    check_range("limit", limit, 1, MAX_LIMIT)
    check_range("offset", offset, 0)
    page = select_events(events, **filters).select(*EVENT_COLUMNS)
    page = page.orderBy(F.col("timestamp").desc(), F.col("id").desc())
    return (page.offset(offset) if offset else page).limit(limit)


def older_than(events: DataFrame, timestamp: TimeLike, event_id: int, *, limit: int = 100, **filters) -> DataFrame:
    """The page after the given last row: constant cost at any depth, and the time bound prunes days."""
    bound = instant(timestamp)
    events = select_events(events, end=timestamp, **filters)
    rest = events.filter((F.col("timestamp") < bound) | ((F.col("timestamp") == bound) & (F.col("id") < event_id)))
    return query_logs(rest, limit=limit)


def latest(events: DataFrame, n: int = 10) -> DataFrame:
    return query_logs(events, limit=n)

"""Duplicate suppression by content hash, within a batch and against stored events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import hash_to_id, log_hash


def with_identity(events: DataFrame) -> DataFrame:
    """Add log_hash and event_date; records without an id get one derived from the hash."""
    hashed = events.withColumn(
        "log_hash", log_hash(F.col("timestamp"), F.col("host"), F.col("service"), F.col("message"))
    ).withColumn("event_date", F.to_date("timestamp"))
    return hashed.withColumn("id", F.coalesce(F.col("id"), hash_to_id(F.col("log_hash"))))


def first_of_each(events: DataFrame, keys: tuple[str, ...] = ("event_date", "log_hash")) -> DataFrame:
    """One record per key, the lowest id wins.

    The rank filter becomes a group limit that runs before the shuffle as well as after it, so
    however many copies a key has, each task sends at most one of them. The keys are those of the
    join with the stored events, which then needs no further shuffle or sort on this side.
    """
    order = Window.partitionBy(*keys).orderBy(F.col("id").asc_nulls_last(), F.xxhash64(*events.columns))
    return events.withColumn("_rank", F.row_number().over(order)).filter("_rank = 1").drop("_rank")


def batch_days(events: DataFrame) -> DataFrame:
    """Calendar days of a batch, from its time column alone."""
    return (
        events.select(F.to_date("timestamp").alias("event_date"))
        # a comparison marks the day list as selective, which lets it prune partitions at run time
        .filter(F.col("event_date") >= F.lit("0001-01-01").cast("date"))
        .distinct()
    )


def not_stored(
    new: DataFrame, stored: DataFrame, days: DataFrame | None = None, few_keys: DataFrame | None = None, reduced: bool = False
) -> DataFrame:
    """Records whose hash is not stored yet.

    The hash covers the timestamp, so a duplicate can only sit in the same day: the stored side
    is first reduced to the days of the batch (dynamic partition pruning on event_date), unless
    it is `reduced` already. For a
    batch checked to be small, `few_keys` holds its keys: they are sent to the stored hashes,
    which are then read but not shuffled.
    """
    if not reduced:
        days = batch_days(new) if days is None else days
        # one row per calendar day: bounded by the calendar, not by the data
        stored = stored.join(F.broadcast(days), "event_date", "left_semi")
    seen = stored.select("event_date", "log_hash")
    if few_keys is not None:
        keys = few_keys.select("event_date", "log_hash")
        seen = seen.join(F.broadcast(keys), ["event_date", "log_hash"], "left_semi")
    return new.join(seen, ["event_date", "log_hash"], "left_anti")


def outcome(total: DataFrame, accepted: DataFrame, failed: DataFrame) -> DataFrame:
    """One row of counters: ingested, duplicates and failed."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n")
        for kind, df in (("total", total), ("accepted", accepted), ("failed", failed))
    ]
    pivoted = counts[0].unionByName(counts[1]).unionByName(counts[2])
    pick = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("n")).otherwise(0))
    return pivoted.agg(
        pick("accepted").alias("ingested"),
        (pick("total") - pick("failed") - pick("accepted")).alias("duplicates"),
        pick("failed").alias("failed"),
    )

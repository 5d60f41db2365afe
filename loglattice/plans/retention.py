"""Retention of events and templates, with dry run; additive schema changes."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import templates as tpl
from ..operators.predicates import expired, instant
from ..schemas import check_range
from ..session import materialise
from ..sources.tables import TAG, LogStore
from .maintenance import end_merge

DEFAULT_DAYS = 90


def cutoff_for(as_of: datetime, days: int = DEFAULT_DAYS) -> datetime:
    """UTC cutoff; `as_of` is explicit so a run can be repeated."""
    return as_of - timedelta(days=check_range("days", days, 1))


def event_stats(events: DataFrame, cutoff: datetime) -> DataFrame:
    """Total, span and number to delete, in one scan of one column."""
    return events.agg(
        F.count(F.lit(1)).alias("total_logs"),
        F.min("timestamp").alias("oldest_log"),
        F.max("timestamp").alias("newest_log"),
        F.count_if(F.col("timestamp") < instant(cutoff)).alias("to_delete"),
    )


def stale_templates(templates: DataFrame, cutoff: datetime) -> DataFrame:
    return expired(templates, cutoff, "last_seen")


def fresh_templates(templates: DataFrame, cutoff: datetime) -> DataFrame:
    return templates.filter(F.col("last_seen") >= instant(cutoff))


def surviving_events(events: DataFrame, cutoff: datetime) -> DataFrame:
    return events.filter(F.col("timestamp") >= instant(cutoff))


def report(events: DataFrame, templates: DataFrame, cutoff: datetime) -> DataFrame:
    """Dry run: what would go, nothing changed."""
    stale = stale_templates(templates, cutoff).agg(F.count(F.lit(1)).alias("n"))
    return event_stats(events, cutoff).withColumn("stale_templates", stale.scalar())


def purge(store: LogStore, as_of: datetime, days: int = DEFAULT_DAYS, dry_run: bool = False) -> DataFrame:
    """Delete expired events and templates; returns the report taken before.

    Whole days before the cutoff are dropped as folders without reading them. Only the day the
    cutoff falls into is rewritten.
    """
    cutoff = cutoff_for(as_of, days)
    before = materialise(report(store.events(), tpl.roll_up(store.count_rows()), cutoff), "retention-report")
    if dry_run:
        return before
    end_merge(store)
    boundary = cutoff.date().isoformat()
    edge_folder = f"{store.events_path}/event_date={boundary}"
    edge_tags = store.children(edge_folder)
    if edge_tags and cutoff.time() != datetime.min.time():
        edge = surviving_events(store.events().filter(F.col("event_date") == F.lit(boundary).cast("date")), cutoff)
        # batch names of one day; taken before the write replaces the files behind them
        surviving = {f"{TAG}={r[0]}" for r in edge.select(TAG).distinct().collect()}
        store.write_events(edge)
        for name in set(edge_tags) - surviving:
            store.drop_folder(f"{edge_folder}/{name}")
    for name in store.children(store.events_path):
        if name.startswith("event_date=") and name.split("=", 1)[1] < boundary:
            store.drop_folder(f"{store.events_path}/{name}")
    purge_templates(store, cutoff)
    return before


def purge_templates(store: LogStore, cutoff: datetime) -> None:
    """New snapshot without templates last seen before the cutoff.

    Counts are added up after the join, on whose key they lie together already.
    """
    pending = store.pending_tags()
    counts = store.count_rows(pending)
    fresh = fresh_templates(
        counts.groupBy("template_hash").agg(F.max("last_seen").alias("last_seen")), cutoff
    )
    kept = counts.join(fresh.select("template_hash"), "template_hash", "left_semi")
    store.write_snapshot(tpl.merge_counts(kept), pending)


def add_columns(df: DataFrame, fields: dict[str, T.DataType]) -> DataFrame:
    """Additive migration: columns that are absent appear as typed nulls, present ones are untouched."""
    absent = {n: F.lit(None).cast(t) for n, t in fields.items() if n not in df.columns}
    return df.withColumns(absent) if absent else df


def drop_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """Rollback of an additive migration."""
    return df.drop(*names)


def read_generations(spark: SparkSession, path: str) -> DataFrame:
    """A stored table whose files were written before and after columns were added; old rows have nulls there."""
    return spark.read.option("mergeSchema", True).parquet(path)


def drop_stored_columns(spark: SparkSession, path: str, names: list[str], key: str) -> int:
    """Rollback on the table: partitions with files that hold one of the columns are rewritten without it.

    Returns how many. A partition is replaced as a whole when the write commits, so a run that died is repeated.
    """
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    parts = [s.getPath().getName() for s in folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)]
    # one name per partition
    wide = [n for n in parts if n.startswith(f"{key}=") and set(names) & set(read_generations(spark, f"{path}/{n}").columns)]
    if wide:
        rows = spark.read.option("mergeSchema", True).option("basePath", path).parquet(*[f"{path}/{n}" for n in wide])
        left = materialise(rows.drop(*names), "rolled-back")
        left.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)
    return len(wide)

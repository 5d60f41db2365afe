"""Continuous ingest: journald files in, deduplicated events and template counts out."""

from __future__ import annotations

import logging
import time
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.canonical import DEFAULT_VERSION
from ..operators import dedup, noise
from ..operators.noise import NoiseConfig
from ..plans.ingest import FEW_ROWS, ingest
from ..session import within_rows
from ..sources import deadletter, journald
from ..sources.tables import TAG, LogStore

RETRY_AFTER_SECONDS = 5
log = logging.getLogger(__name__)


@contextmanager
def kept(batch: DataFrame):
    """Read the source of a micro-batch once; it spills to disk and is read again if an executor is lost.

    A stream with state runs without adaptive execution, which must not change how its state is spread. What is done
    with a batch that has left it may adapt: else each day would be written by every task.
    """
    conf = batch.sparkSession.conf
    before = conf.get("spark.sql.adaptive.enabled")
    batch.persist(StorageLevel.MEMORY_AND_DISK)
    conf.set("spark.sql.adaptive.enabled", "true")
    try:
        yield
    finally:
        conf.set("spark.sql.adaptive.enabled", before)
        batch.unpersist()


def ship_batch(
    events: DataFrame,
    unreadable: DataFrame | None,
    store: LogStore,
    tag: str,
    *,
    config: NoiseConfig | None = None,
    version: str = DEFAULT_VERSION,
    retry_after: float = RETRY_AFTER_SECONDS,
) -> None:
    """Ingest one micro-batch, once more after a pause if it fails, then keep it whole for `recover`.

    Records per noise rule go to the store's statistics under the tag of the batch.
    """
    if unreadable is not None:
        raw = unreadable.select(F.col("value").alias("raw"), F.array("parse_error").alias("errors"))
        store.spool(raw, f"{tag}-unreadable")
    for attempt in (1, 2):
        try:
            few = within_rows(events, FEW_ROWS)
            ingest(events, store, tag, config=config, version=version, few=few)
            classified = noise.classify(events, config) if config else events.withColumn("drop_reason", F.lit(None).cast("string"))
            store.write_stats(noise.batch_stats(classified), tag)
            return
        except Exception as error:
            log.warning("batch %s was not ingested, attempt %d", tag, attempt, exc_info=True)
            failure = f"{type(error).__name__}: {error}"[:2000]
            if attempt == 1:
                time.sleep(retry_after)
    store.spool_failed(events, tag, failure)


def recover(store: LogStore, **options) -> list[str]:
    """Ingest the batches that failed before, each under its own tag, and return the tags that went through.

    Under its tag a batch replaces what its first attempts have written, so events and counts agree however far
    they came. A batch that fails again stays where it is.
    """
    done = []
    for tag in store.failed_tags():
        try:
            ingest(deadletter.unpack(store.failed_batch(tag)), store, tag, **options)
        except Exception:
            log.warning("batch %s failed again", tag, exc_info=True)
            continue
        store.drop_folder(f"{store.failed_path}/{TAG}={tag}")
        done.append(tag)
    return done


def ship_events(
    stream: DataFrame,
    store: LogStore,
    checkpoint: str,
    *,
    name: str = "ship",
    config: NoiseConfig | None = None,
    version: str = DEFAULT_VERSION,
    available_now: bool = True,
    interval: str = "10 seconds",
    distinct_for: str | None = None,
    fold_every: int = 100,
) -> StreamingQuery:
    """Ship a stream of events that are already in the event schema, after batches that failed in an earlier run.

    After every `fold_every` batches their counts are folded, so their folders stay few. With `distinct_for` copies that arrive within that time of each other are dropped before they are shipped.
    """
    recover(store, config=config, version=version)
    if distinct_for is not None:
        stream = distinct_within(stream, distinct_for)

    def handle(batch: DataFrame, batch_id: int) -> None:
        # the tag repeats with the batch id, so a batch run again replaces its own output
        with kept(batch):
            ship_batch(batch, None, store, f"{name}-{batch_id:012d}", config=config, version=version)
        fold(store, batch_id, fold_every)

    return _start(stream, handle, checkpoint, name, available_now, interval)


def ship_journal(
    spark: SparkSession,
    folder: str,
    host: str,
    store: LogStore,
    checkpoint: str,
    *,
    name: str = "journal",
    config: NoiseConfig | None = None,
    version: str = DEFAULT_VERSION,
    available_now: bool = True,
    interval: str = "10 seconds",
    max_files: int | None = None,
    fold_every: int = 100,
) -> StreamingQuery:
    """Follow a folder of journald JSON files; the checkpoint remembers what has been read.

    After every `fold_every` batches their counts are folded, so their folders stay few.
    """
    recover(store, config=config, version=version)
    parsed = journald.parse(journald.stream_lines(spark, folder, max_files))
    counted = parsed.observe(
        f"{name}-lines",
        F.count(F.lit(1)).alias("seen"),
        F.count_if(F.col("parse_error").isNotNull()).alias("unreadable"),
    )

    def handle(batch: DataFrame, batch_id: int) -> None:
        with kept(batch):
            ship_batch(
                journald.to_events(batch, host), journald.quarantined(batch), store, f"{name}-{batch_id:012d}",
                config=config, version=version,
            )
        fold(store, batch_id, fold_every)

    return _start(counted, handle, checkpoint, name, available_now, interval)


def fold(store: LogStore, batch_id: int, every: int) -> None:
    """Fold batch counts after each `every` batches. A batch that is run again was folded and does not count twice."""
    if (batch_id + 1) % every == 0:
        store.compact_templates()


def _start(stream, handle, checkpoint, name, available_now, interval) -> StreamingQuery:
    writer = stream.writeStream.queryName(name).option("checkpointLocation", checkpoint).foreachBatch(handle)
    # availableNow reads all that is there, the last partial batch included, and stops
    trigger = {"availableNow": True} if available_now else {"processingTime": interval}
    return writer.trigger(**trigger).start()


def distinct_within(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Cheap first line against duplicates: state is bounded by the time for which arrivals are remembered.

    The watermark is on the time of arrival, so no record is ever late and none is lost. A copy that arrives
    after its first has been forgotten passes here and is caught against the stored events.
    """
    hashed = dedup.with_identity(stream).withColumn("_arrived", F.current_timestamp())
    first = hashed.withWatermark("_arrived", delay).dropDuplicatesWithinWatermark(["event_date", "log_hash"])
    return first.select(*stream.columns)

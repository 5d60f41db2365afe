"""Ingest: validate, filter, deduplicate, link to templates, append, count."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import DEFAULT_VERSION
from ..operators import dedup, noise, templates, validate
from ..session import materialise
from ..sources import deadletter
from ..sources.tables import MERGED, TAG, LogStore


# a key is a date and 16 characters, so this many take some tens of megabytes
FEW_ROWS = 500_000


@dataclass(frozen=True)
class IngestResult:
    """Handle on a finished batch. Records and rejects were counted while it was stored; the rest is counted when asked for."""

    store: LogStore
    tag: str
    checked: DataFrame
    config: noise.NoiseConfig | None
    days: list[str]
    total: int
    failed: int

    def counters(self) -> DataFrame:
        """One row: ingested, duplicates, failed and dropped."""
        stored = self.store.events_on(self.days, self.tag).agg(F.count(F.lit(1)).alias("ingested"))
        dropped = F.lit(0).cast("long")
        if self.config is not None:
            noisy = validate.valid(self.checked).filter(noise.drop_reason(self.config).isNotNull())
            dropped = noisy.agg(F.count(F.lit(1)).alias("n")).scalar()
        failed = F.lit(self.failed).cast("long")
        return stored.withColumn("failed", failed).withColumn("dropped", dropped).select(
            "ingested", (F.lit(self.total).cast("long") - F.col("failed") - F.col("dropped") - F.col("ingested")).alias("duplicates"), "failed", "dropped"
        )


def per_day(checked: DataFrame) -> DataFrame:
    """(event_date, total, failed) per calendar day, the date as text; null for records without a time."""
    return checked.groupBy(F.to_date("timestamp").alias("day")).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.size("errors") > 0).alias("failed"),
    ).select(F.col("day").cast("string").alias("event_date"), "total", "failed")


def accept(
    checked: DataFrame,
    stored: DataFrame,
    days: DataFrame | None,
    config: noise.NoiseConfig | None = None,
    few: bool = False,
) -> DataFrame:
    """Valid, not noise, new: ready to be linked and appended.

    `days` prunes the stored side; it is None where `stored` holds the days of the batch only.
    """
    good = validate.valid(checked)
    if config is not None:
        good = noise.keep(noise.classify(good, config))
    hashed = dedup.with_identity(good)
    return dedup.not_stored(dedup.first_of_each(hashed), stored, days, hashed if few else None, reduced=days is None)


def linked(events: DataFrame, version: str = DEFAULT_VERSION) -> DataFrame:
    """Events with the template they belong to."""
    return templates.with_template(events, version).withColumn("template_id", F.col("template_hash"))


def ingest(
    events: DataFrame,
    store: LogStore,
    tag: str,
    *,
    config: noise.NoiseConfig | None = None,
    version: str = DEFAULT_VERSION,
    few: bool = False,
) -> IngestResult:
    """Store one batch under `tag`. Running it again with the same input and tag changes nothing.

    Only folders of the batch's own days are listed and read. Counts are its last write: a batch with counts is
    finished, and its days may be merged. Once they are, it is closed and adds nothing.

    Set `few` only for a batch checked to hold at most `FEW_ROWS` records, such as a micro-batch:
    its keys are then broadcast to the stored hashes of its days.
    """
    if tag.startswith(MERGED):
        raise ValueError(f"a batch must not be named {tag!r}")
    checked = validate.validate(events)
    # one row per calendar day of the batch
    seen = per_day(checked).collect()
    days = [r["event_date"] for r in seen if r["event_date"] is not None]
    total, failed = (sum(r[c] for r in seen) for c in ("total", "failed"))
    result = IngestResult(store, tag, checked, config, days, total, failed)
    if store.is_closed(tag):
        return result
    # what an earlier attempt of this very batch wrote does not make its records duplicates
    stored = store.events_on(days).filter(F.col(TAG) != tag)
    # rules run last, on the records that will really be stored, when these have been laid out: canonical texts are not shuffled
    store.write_events(accept(checked, stored, None, config, few), tag, lambda rows: linked(rows, version))
    # the input is read for its rejects only where there are some
    if failed:
        store.spool(validate.rejected(checked), tag)
    # counts come from the rows as stored: no second run of the rules
    written = store.events_on(days, tag).withColumn("template_hash", F.col("template_id"))
    store.write_counts(templates.host_counts(written), tag)
    return result


def replay(store: LogStore, tag: str, **options) -> IngestResult:
    """Ingest the dead letters again under a new tag; what still fails is spooled under that tag.

    The letters are marked as replayed in one small write before their folders are dropped, so a
    run that dies half-way can be repeated with the same tag and one that finished cannot.
    """
    if store.replays().filter(F.col("replayed_by") == tag).limit(1).count():
        raise ValueError(f"replay {tag!r} has already finished")
    records = store.dead_letters().filter(F.col(TAG) != tag)
    letters = materialise(records, "replay")
    result = ingest(deadletter.unpack(letters), store, tag, **options)
    done = letters.select(TAG).distinct()
    store.mark_replayed(done, tag)
    # one name per spooled batch
    for row in done.collect():
        store.drop_folder(f"{store.dead_letter_path}/{TAG}={row[0]}")
    return result

"""Upkeep of a store: days that are over are merged into few files, batch counts are folded.

A batch leaves a folder in each of its days, so a store fed by micro-batches gets many small files. Merging a day
puts the rows of its finished batches into one folder, of files of the advisory size. Parquet folders have no
transactions, so a merge is a plan that is written down first and carried out in two steps:

* planned: the merged folders are being written; readers leave them out and see the batches.
* written: the merged folders are complete; readers leave out the batches, whose folders are then dropped.

A run that died at any point is ended by the next one, from its plan. A batch that has been merged is closed:
run again under its tag it adds nothing. Only batches that are finished are merged, that is, those with counts and
not waiting for a replay, so no row can be stored and never counted. Upkeep jobs (merging, backfill, retention) run
one at a time; ingest may run beside them.
"""

from __future__ import annotations

import uuid
from collections import Counter
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import MERGED, TAG, LogStore


def day_folders(store: LogStore, before: date) -> list[tuple[str, str]]:
    """(day, tag) of every folder of the days before `before`: names only, no file is read."""
    names = [n.split("=", 1)[1] for n in store.children(store.events_path) if n.startswith("event_date=")]
    return [
        (day, folder.split("=", 1)[1])
        for day in names
        if day < before.isoformat()
        for folder in store.children(f"{store.events_path}/event_date={day}")
        if folder.startswith(f"{TAG}=")
    ]


def finished(store: LogStore, folders: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """The folders of batches that will not write again."""
    waiting = set(store.failed_tags())
    counted = store.counted_tags({tag for _, tag in folders})
    return [(day, tag) for day, tag in folders if tag.startswith(MERGED) or (tag in counted and tag not in waiting)]


def merge_days(store: LogStore, before: date) -> int:
    """Merge each day before `before` that has more than one finished batch; returns how many days were merged."""
    end_merge(store)
    if store.open_backfill() is not None:
        raise RuntimeError("a backfill has not ended; run it again before days are merged")
    done = finished(store, day_folders(store, before))
    per_day = Counter(day for day, _ in done)
    sources = [(day, tag) for day, tag in done if per_day[day] > 1]
    if not sources:
        return 0
    _plan(store, sources)
    end_merge(store)
    return len({day for day, _ in sources})


def _plan(store: LogStore, sources: list[tuple[str, str]]) -> None:
    spark, into = store.spark, f"{MERGED}{uuid.uuid4().hex[:12]}"
    parts = spark.createDataFrame(sources, f"event_date string, {TAG} string").withColumn("event_date", F.col("event_date").cast("date"))
    parts.withColumn("merged_into", F.lit(into)).write.mode("overwrite").parquet(f"{store.merge_path}/parts")
    spark.createDataFrame([(into,)], "merged_into string").write.mode("overwrite").parquet(f"{store.merge_path}/planned")


def end_merge(store: LogStore) -> None:
    """Carry out the merge that is open, if any, from wherever it stopped."""
    state = store.merge_state()
    if state is None:
        if store.children(store.merge_path):  # a plan that was never finished
            store.drop_folder(store.merge_path)
        return
    spark = store.spark
    parts = spark.read.parquet(f"{store.merge_path}/parts")
    names = [(str(r["event_date"]), r[TAG], r["merged_into"]) for r in parts.collect()]
    if state == "planned":
        into = names[0][2]
        paths = store.folders_of([(day, tag) for day, tag, _ in names])
        # closed before anything is dropped: a batch run again must not store its rows once more
        closed = parts.select(TAG, "merged_into").distinct()
        closed.write.mode("overwrite").parquet(f"{store.closed_path}/merged_into={into}")
        store.write_events(store.read_folders(paths), into)
        spark.createDataFrame([(into,)], "merged_into string").write.mode("overwrite").parquet(f"{store.merge_path}/written")
    for day, tag, _ in names:
        store.drop_folder(f"{store.events_path}/event_date={day}/{TAG}={tag}")
    store.drop_folder(store.merge_path)


def day_files(store: LogStore) -> DataFrame:
    """Folders and files of each stored day, from the listing alone."""
    rows = []
    for day in [n.split("=", 1)[1] for n in store.children(store.events_path) if n.startswith("event_date=")]:
        folders = [n for n in store.children(f"{store.events_path}/event_date={day}") if n.startswith(f"{TAG}=")]
        files = [f for n in folders for f in store.children(f"{store.events_path}/event_date={day}/{n}") if f.endswith(".parquet")]
        rows.append((day, len(folders), len(files)))
    return store.spark.createDataFrame(rows, "event_date string, folders long, files long")


def maintain(store: LogStore, before: date) -> int:
    """The scheduled job: merge the days that are over, fold batch counts, drop vectors of texts that are gone."""
    merged = merge_days(store, before)
    store.compact_templates()
    store.drop_stale_vectors()
    return merged

"""The stored tables: plain Parquet folders, laid out so that every writer can be retried.

* `events/event_date=D/ingest_tag=T`  log events. A batch replaces its own partitions only.
* `template_counts/ingest_tag=T`      per-batch template counts; adding them up gives the dimension.
* `template_snapshots/version=N`      counts folded together, with the tags they contain.
* `vectors`                           one vector per distinct canonical text and model.
* `dead_letter/ingest_tag=T`          rejected records as JSON lines.
* `dead_letter_replays`               which of those batches have been replayed.
* `failed/ingest_tag=T`               batches that were not ingested, whole, with the error; replayed under their tag.
* `noise_stats/ingest_tag=T`          records per noise rule of each shipped batch.
* `open_backfill`                     what a backfill that has not ended links: partitions, counts, and a mark.
* `open_merge`                        the batches of a merge of days that has not ended, and how far it is.
* `closed/merged_into=M`              batches whose rows have been merged; run again they add nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.canonical import text_hash
from ..operators import templates as tpl
from ..schemas import DEAD_LETTER, LOG_EVENTS, VECTOR
from . import deadletter

STORED_EVENTS = T.StructType(
    [
        *LOG_EVENTS.fields,
        T.StructField("canonical_text", T.StringType()),
        T.StructField("canon_version", T.StringType()),
        T.StructField("event_date", T.DateType()),
        T.StructField("ingest_tag", T.StringType()),
    ]
)
COUNTS = T.StructType(
    [
        *[T.StructField(k, T.StringType()) for k in tpl.KEYS],
        T.StructField("host", T.StringType()),
        T.StructField("event_count", T.LongType()),
        T.StructField("first_seen", T.TimestampType()),
        T.StructField("last_seen", T.TimestampType()),
    ]
)
VECTORS = T.StructType(
    [
        T.StructField("canon_hash", T.StringType()),
        T.StructField("embedding_vector", VECTOR),
        T.StructField("embedding_model", T.StringType()),
    ]
)
TAG = "ingest_tag"
# of events and counts, which are mostly text
CODEC = "zstd"
# tags of folders that hold the merged rows of several batches; no batch may be named so
MERGED = "merged-"
CLOSED = T.StructType([T.StructField(TAG, T.StringType()), T.StructField("merged_into", T.StringType())])
STATS = T.StructType([T.StructField("drop_reason", T.StringType()), T.StructField("n", T.LongType()), T.StructField(TAG, T.StringType())])
REPLAYS = T.StructType([T.StructField(TAG, T.StringType()), T.StructField("replayed_by", T.StringType())])


class LogStore:
    """Readers and retry-safe writers over one root folder on a shared file system."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self.events_path = f"{self.root}/events"
        self.counts_path = f"{self.root}/template_counts"
        self.snapshots_path = f"{self.root}/template_snapshots"
        self.snapshot_tags_path = f"{self.root}/template_snapshot_tags"
        self.vectors_path = f"{self.root}/vectors"
        self.dead_letter_path = f"{self.root}/dead_letter"
        self.replays_path = f"{self.root}/dead_letter_replays"
        self.failed_path = f"{self.root}/failed"
        self.stats_path = f"{self.root}/noise_stats"
        self.backfill_path = f"{self.root}/open_backfill"
        self.merge_path = f"{self.root}/open_merge"
        self.closed_path = f"{self.root}/closed"

    # ---- file system ---------------------------------------------------------------------------

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self):
        return self._path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def children(self, path: str) -> list[str]:
        """Names directly under a folder; empty when it does not exist."""
        fs, p = self._fs(), self._path(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def drop_folder(self, path: str) -> bool:
        return self._fs().delete(self._path(path), True)

    def _read(self, path: str, schema: T.StructType, fmt: str = "parquet") -> DataFrame:
        if not self.children(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).format(fmt).load(path)

    # ---- events --------------------------------------------------------------------------------

    def events(self) -> DataFrame:
        """All stored events. The schema is explicit, so columns added later read as null in old files."""
        return self._once(self._read(self.events_path, STORED_EVENTS))

    def events_of(self, tag: str) -> DataFrame:
        return self.events().filter(F.col(TAG) == tag)

    def events_on(self, days: list[str], tag: str | None = None) -> DataFrame:
        """Events of some days, or those of one batch in them: no folder of another day is listed."""
        stored = {n.split("=", 1)[1] for n in self.children(self.events_path) if n.startswith("event_date=")}
        paths = [f"{self.events_path}/event_date={d}" for d in sorted(stored.intersection(days))]
        if tag is None:
            return self._once(self.read_folders(paths))
        own = [f"{p}/{TAG}={tag}" for p in paths]
        return self.read_folders([p for p in own if self._fs().exists(self._path(p))])

    def folders_of(self, parts: list[tuple[str, str]]) -> list[str]:
        """Folders of (day, tag) pairs, those that exist."""
        paths = [f"{self.events_path}/event_date={day}/{TAG}={tag}" for day, tag in parts]
        return [p for p in paths if self._fs().exists(self._path(p))]

    def read_folders(self, paths: list[str]) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], STORED_EVENTS)
        return self.spark.read.schema(STORED_EVENTS).option("basePath", self.events_path).parquet(*paths)

    def merge_state(self) -> str | None:
        """How far a merge of days that has not ended is: `written` once its folders are complete, `planned` before."""
        for state in ("written", "planned"):
            if "_SUCCESS" in self.children(f"{self.merge_path}/{state}"):
                return state
        return None

    def _once(self, events: DataFrame) -> DataFrame:
        """Each row once while a merge is open: from the batches until the merged folders are complete, then from those."""
        state = self.merge_state()
        if state is None:
            return events
        parts = self.spark.read.parquet(f"{self.merge_path}/parts")
        if state == "planned":
            return events.join(parts.select(F.col("merged_into").alias(TAG)).distinct(), TAG, "left_anti").select(events.columns)
        return events.join(parts.select("event_date", TAG), ["event_date", TAG], "left_anti").select(events.columns)

    def is_closed(self, tag: str) -> bool:
        """Whether rows of the batch have been merged with those of others."""
        if not self.children(self.closed_path):
            return False
        return self._read(self.closed_path, CLOSED).filter(F.col(TAG) == tag).limit(1).count() > 0

    def write_events(
        self, events: DataFrame, tag: str | None = None, link: Callable[[DataFrame], DataFrame] | None = None
    ) -> None:
        """Replace the (day, tag) partitions present in `events`; `link` adds columns of each row as it is written.

        Rebalancing by day lets adaptive execution split a busy day and merge quiet ones into
        files of the advisory size; sorting by service and time makes the min/max statistics of
        the row groups useful to later filters. What `link` adds is neither moved nor sorted.
        """
        tagged = events if tag is None else events.withColumn(TAG, F.lit(tag))
        laid_out = tagged.hint("rebalance", "event_date").sortWithinPartitions("event_date", TAG, "service", "timestamp")
        rows = laid_out if link is None else link(laid_out)
        stored = rows.select(
            *[
                (F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                for f in STORED_EVENTS
            ]
        )
        (
            stored.write.mode("overwrite")
            .option("compression", CODEC)
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("event_date", TAG)
            .parquet(self.events_path)
        )

    # ---- templates -----------------------------------------------------------------------------

    def write_counts(self, counts: DataFrame, tag: str) -> None:
        path = f"{self.counts_path}/{TAG}={tag}"
        counts.select(*[F.col(f.name).cast(f.dataType) for f in COUNTS]).write.mode("overwrite").option("compression", CODEC).parquet(path)

    def snapshot_version(self) -> int:
        """Newest complete snapshot; its tag list is written last and so marks it as complete."""
        done = [
            int(name.split("=")[1])
            for name in self.children(self.snapshot_tags_path)
            if name.startswith("version=")
            and "_SUCCESS" in self.children(f"{self.snapshot_tags_path}/{name}")
        ]
        return max(done, default=0)

    def _snapshot_tags(self, version: int) -> DataFrame:
        schema = T.StructType([T.StructField(TAG, T.StringType())])
        if not version:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.snapshot_tags_path}/version={version}")

    def pending_tags(self) -> list[str]:
        """Batches not folded into a snapshot yet; one short name per batch since the last fold."""
        tags = [n.split("=", 1)[1] for n in self.children(self.counts_path) if n.startswith(f"{TAG}=")]
        absorbed = self._snapshot_tags(self.snapshot_version()).filter(F.col(TAG).isin(tags)) if tags else None
        done = {r[0] for r in absorbed.collect()} if absorbed is not None else set()
        return [t for t in tags if t not in done]

    def counted_tags(self, tags: set[str]) -> set[str]:
        """Those of `tags` whose counts are stored, by themselves or in a snapshot: the last thing a batch writes."""
        names = [n for n in self.children(self.counts_path) if n.startswith(f"{TAG}=")]
        own = {n.split("=", 1)[1] for n in names if "_SUCCESS" in self.children(f"{self.counts_path}/{n}")}
        rest = tags - own
        absorbed = self._snapshot_tags(self.snapshot_version()).filter(F.col(TAG).isin(*rest)).collect() if rest else []
        return (tags & own) | {r[0] for r in absorbed}

    def open_backfill(self):
        """The mark of a backfill that has not ended, or None; it is written after all that belongs to it."""
        path = f"{self.backfill_path}/mark"
        return self.spark.read.parquet(path).first() if "_SUCCESS" in self.children(path) else None

    def counts(self, pending: list[str] | None = None) -> DataFrame:
        """Template counts per host over all batches; `pending` is the list of open batches, if it was taken before."""
        return tpl.merge_counts(self.count_rows(pending))

    def count_rows(self, pending: list[str] | None = None) -> DataFrame:
        """The same not yet added up: a row per batch, template and host, for those who add up or look up themselves."""
        parts = []
        version = self.snapshot_version()
        if version:
            parts.append(self.spark.read.schema(COUNTS).parquet(f"{self.snapshots_path}/version={version}"))
        pending = self.pending_tags() if pending is None else pending
        if pending:
            paths = [f"{self.counts_path}/{TAG}={t}" for t in pending]
            parts.append(self.spark.read.schema(COUNTS).parquet(*paths))
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], COUNTS)

    def templates(self, model: str | None = None) -> DataFrame:
        """The dimension, with the vectors of one model; a text it has not embedded yet has a null vector."""
        vectors = self.vectors(model) if model else self.spark.createDataFrame([], VECTORS)
        return (
            tpl.roll_up(self.count_rows())
            .join(vectors, "canon_hash", "left")
            .withColumn("embedding_dim", F.size("embedding_vector"))
        )

    def write_snapshot(self, counts: DataFrame, tags: list[str]) -> int:
        """Store folded counts as the next version; `tags` are the batches it accounts for."""
        old = self.snapshot_version()
        new = old + 1
        counts.select(*COUNTS.names).write.mode("overwrite").option("compression", CODEC).parquet(f"{self.snapshots_path}/version={new}")
        fresh = self.spark.createDataFrame([(t,) for t in tags], f"{TAG} string")
        all_tags = self._snapshot_tags(old).unionByName(fresh).distinct()
        all_tags.write.mode("overwrite").parquet(f"{self.snapshot_tags_path}/version={new}")
        # the one before stays for readers that have listed it
        for name in self.children(self.snapshots_path):
            if name.startswith("version=") and int(name.split("=")[1]) < old:
                self.drop_folder(f"{self.snapshots_path}/{name}")
                self.drop_folder(f"{self.snapshot_tags_path}/{name}")
        return new

    def compact_templates(self) -> int:
        """Fold pending batches into one snapshot, so reading the dimension stays cheap."""
        # listed once: a batch that lands meanwhile stays pending
        there = {n.split("=", 1)[1] for n in self.children(self.counts_path) if n.startswith(f"{TAG}=")}
        pending = self.pending_tags()
        version = self.write_snapshot(self.counts(pending), pending)
        # with those of batches that were run again after their fold
        for tag in there.union(pending):
            self.drop_folder(f"{self.counts_path}/{TAG}={tag}")
        return version

    # ---- vectors and dead letters --------------------------------------------------------------

    def vectors(self, model: str | None = None) -> DataFrame:
        """Vectors of one model or of all, one for each text and model however often it was appended."""
        swapping = not self.children(self.vectors_path) and "_SUCCESS" in self.children(f"{self.vectors_path}_next")
        found = self._read(f"{self.vectors_path}_next" if swapping else self.vectors_path, VECTORS)
        if model is not None:
            found = found.filter(F.col("embedding_model") == model)
        return found.dropDuplicates(["canon_hash", "embedding_model"])

    def append_vectors(self, vectors: DataFrame) -> None:
        self._end_swap()
        vectors.select(*VECTORS.names).write.mode("append").parquet(self.vectors_path)

    def drop_stale_vectors(self) -> int:
        """Drop vectors of texts that no template has any more; returns how many were dropped.

        What stays is written beside the table first and then takes its place; a run that died in between is ended
        by the next writer, and readers find the rows where they are.
        """
        self._end_swap()
        found = self._read(self.vectors_path, VECTORS)
        texts = self.count_rows().select(text_hash(F.col("canonical_text")).alias("canon_hash")).distinct()
        stale = found.join(texts, "canon_hash", "left_anti").count()
        if stale:
            found.join(texts, "canon_hash", "left_semi").select(*VECTORS.names).write.mode("overwrite").parquet(f"{self.vectors_path}_next")
            self.drop_folder(self.vectors_path)
            self._end_swap()
        return stale

    def _end_swap(self) -> None:
        """Vectors written beside the table are the table where it is gone, and left over where it is not."""
        after = f"{self.vectors_path}_next"
        if "_SUCCESS" in self.children(after) and not self.children(self.vectors_path):
            self.drop_folder(self.vectors_path)
            self._fs().rename(self._path(after), self._path(self.vectors_path))
        elif self.children(after):
            self.drop_folder(after)

    def spool(self, rejected: DataFrame, tag: str) -> None:
        deadletter.spool(rejected, f"{self.dead_letter_path}/{TAG}={tag}", mode="overwrite")

    def spool_failed(self, events: DataFrame, tag: str, error: str) -> None:
        """Keep a batch that could not be ingested, and why."""
        deadletter.spool(events.withColumn("errors", F.array(F.lit(error))), f"{self.failed_path}/{TAG}={tag}", mode="overwrite")

    def failed_tags(self) -> list[str]:
        """Batches to ingest again: rare, so their names are few."""
        names = [n for n in self.children(self.failed_path) if n.startswith(f"{TAG}=")]
        return [n.split("=", 1)[1] for n in names if "_SUCCESS" in self.children(f"{self.failed_path}/{n}")]

    def failed_batch(self, tag: str) -> DataFrame:
        return deadletter.read_spool(self.spark, f"{self.failed_path}/{TAG}={tag}")

    def write_stats(self, stats: DataFrame, tag: str) -> None:
        stats.select("drop_reason", "n").write.mode("overwrite").parquet(f"{self.stats_path}/{TAG}={tag}")

    def stats(self) -> DataFrame:
        """(drop_reason, n, ingest_tag): records of each batch per rule, null for those kept."""
        return self._read(self.stats_path, STATS)

    def replays(self) -> DataFrame:
        """Which batch of dead letters was replayed by which run."""
        return self._read(self.replays_path, REPLAYS)

    def mark_replayed(self, tags: DataFrame, replay: str) -> None:
        tags.select(TAG, F.lit(replay).alias("replayed_by")).write.mode("append").parquet(self.replays_path)

    def dead_letters(self) -> DataFrame:
        """Rejected records not replayed yet."""
        schema = T.StructType([*DEAD_LETTER.fields, T.StructField(TAG, T.StringType())])
        letters = self._read(self.dead_letter_path, schema, "json")
        return letters.join(self.replays().select(TAG), TAG, "left_anti")

    # ---- views -----------------------------------------------------------------------------------

    def register(self, prefix: str = "") -> None:
        """SQL views `log_events`, `log_templates` and `log_vectors` of what the store holds at the time of a query."""
        self.events().createOrReplaceTempView(f"{prefix}log_events")
        self.templates().createOrReplaceTempView(f"{prefix}log_templates")
        self.vectors().createOrReplaceTempView(f"{prefix}log_vectors")

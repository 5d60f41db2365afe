"""The template dimension: one row per service, level and canonical text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.canonical import DEFAULT_VERSION, canon_hash, canonicalize, text_hash
from ..functions.hashing import hash_to_id
from ..schemas import DEFAULT_CHUNK_VERSION, check_range

KEYS = ["template_hash", "service", "level", "canonical_text", "canon_version"]


def with_template(events: DataFrame, version: str = DEFAULT_VERSION) -> DataFrame:
    """Add canonical_text, canon_version and template_hash. Linking needs no lookup: the hash is the key."""
    canonical = events.withColumn("canonical_text", canonicalize(F.col("message"), version))
    key = canon_hash(F.col("canonical_text"), F.col("service"), F.col("level"))
    # Validated records have no null field. Saying so keeps a join on the key from adding a null
    # filter, which would be pushed below and run all rules a second time.
    return canonical.withColumn("canon_version", F.lit(version)).withColumn(
        "template_hash", F.coalesce(key, F.lit(""))
    )


def host_counts(templated: DataFrame) -> DataFrame:
    """Counts and time span per template and host: the additive grain in which the dimension is kept.

    All grouping columns are keys and all aggregates are fixed width, so this is a hash
    aggregate with a map-side step; a template holding most rows shrinks to a row per task and host.
    """
    return templated.groupBy(*KEYS, "host").agg(
        F.count(F.lit(1)).alias("event_count"),
        F.min("timestamp").alias("first_seen"),
        F.max("timestamp").alias("last_seen"),
    )


def merge_counts(*parts: DataFrame) -> DataFrame:
    """Add up counts of the same template and host; order of the parts does not matter."""
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    return merged.groupBy(*KEYS, "host").agg(
        F.sum("event_count").alias("event_count"),
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
    )


def roll_up(counts: DataFrame) -> DataFrame:
    """From the host grain to one row per template; the host list is as long as the fleet at most.

    The digest of the text stands for it as a key, so the text is a value that is not moved where nobody asks for it.
    Counts of several batches need not be merged before.
    """
    keys = ["canon_hash" if k == "canonical_text" else k for k in KEYS]
    return (
        counts.withColumn("canon_hash", text_hash(F.col("canonical_text")))
        .groupBy(*keys)
        .agg(
            F.first("canonical_text").alias("canonical_text"),
            F.sum("event_count").alias("event_count"),
            F.min("first_seen").alias("first_seen"),
            F.max("last_seen").alias("last_seen"),
            F.array_sort(F.collect_set("host")).alias("source_hosts"),
        )
        .select(*KEYS, "event_count", "first_seen", "last_seen", "source_hosts", "canon_hash")
        .withColumn("chunk_version", F.lit(DEFAULT_CHUNK_VERSION))
        .withColumn("id", hash_to_id(F.col("template_hash")))
    )


def build_templates(events: DataFrame, version: str = DEFAULT_VERSION) -> DataFrame:
    """Template dimension of a set of events."""
    return roll_up(host_counts(with_template(events, version)))


def new_templates(candidates: DataFrame, known: DataFrame) -> DataFrame:
    """Candidates whose hash is not in the dimension."""
    return candidates.join(known.select("template_hash"), "template_hash", "left_anti")


def resolve(templated: DataFrame, templates: DataFrame) -> DataFrame:
    """Look up the template id of each event; unresolved events keep a null id.

    No broadcast is forced: the dimension grows with the fleet. Below the broadcast threshold the
    planner broadcasts it from its statistics, above it adaptive execution splits a hot template.
    """
    ids = templates.select("template_hash", F.col("id").alias("template_id"))
    return templated.join(ids, "template_hash", "left")


def first_event(templated: DataFrame) -> DataFrame:
    """Earliest event of each template."""
    order = Window.partitionBy("template_hash").orderBy("timestamp", "id")
    return templated.withColumn("_rank", F.row_number().over(order)).filter("_rank = 1").drop("_rank")


def with_dense_ids(templates: DataFrame, start: int = 0, prefix: int = 3) -> DataFrame:
    """Consecutive integer ids in hash order, without sorting everything in one task.

    The hash is uniform, so its first hex digits cut the table into even pieces: rank inside a
    piece, then add the size of all pieces before it (a table of 16**prefix rows).
    """
    piece = F.substring("template_hash", 1, check_range("prefix", prefix, 1, 4))
    cut = templates.withColumn("_piece", piece)
    sizes = cut.groupBy("_piece").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_piece", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    within = Window.partitionBy("_piece").orderBy("template_hash")
    return (
        cut.withColumn("_rank", F.row_number().over(within))
        .join(F.broadcast(offsets), "_piece")
        .withColumn("dense_id", F.col("_offset") + F.col("_rank") + F.lit(start))
        .drop("_piece", "_rank", "_offset")
    )


def recent_examples(events: DataFrame, keys: DataFrame, k: int, key: str = "template_id") -> DataFrame:
    """The k newest events of each key, as rows. `keys` is joined by its statistics."""
    wanted = events.join(keys.select(key), key, "left_semi")
    order = Window.partitionBy(key).orderBy(F.col("timestamp").desc(), F.col("id").desc())
    return wanted.withColumn("recency", F.row_number().over(order)).filter(F.col("recency") <= k)

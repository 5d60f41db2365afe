"""Backfills: missing template links and missing vectors."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import DEFAULT_VERSION, template_key
from ..operators import templates as tpl
from ..operators.predicates import orphans
from ..schemas import check_range
from ..session import materialise
from ..sources.tables import COUNTS, TAG, LogStore
from .maintenance import end_merge


def link(events: DataFrame, version: str = DEFAULT_VERSION, up_to_id: Column | None = None) -> DataFrame:
    """Fill template_id of unlinked events, all of them or those up to an id; other rows pass unchanged."""
    due = F.col("template_id").isNull()
    if up_to_id is not None:
        due = due & (F.col("id") <= up_to_id)
    flagged = events.withColumn("_due", due)
    # the rules see only rows that need them
    text = F.when(F.col("_due"), F.col("message"))
    keyed = flagged.withColumn("_key", template_key(text, F.col("service"), F.col("level"), version))
    return keyed.withColumns(
        {
            "template_id": F.when(F.col("_due"), F.col("_key.template_hash")).otherwise(F.col("template_id")),
            "canonical_text": F.when(F.col("_due"), F.col("_key.canonical_text")).otherwise(F.col("canonical_text")),
            "canon_version": F.when(F.col("_due"), F.lit(version)).otherwise(F.col("canon_version")),
        }
    ).drop("_due", "_key")


def orphan_cap(events: DataFrame, cap: int) -> Column:
    """Id of the last of the `cap` lowest orphan ids, as a scalar subquery."""
    first = orphans(events).select("id").orderBy("id").limit(check_range("cap", cap, 1))
    return first.agg(F.max("id").alias("id")).scalar()


def backfill_templates(store: LogStore, *, run: str = "backfill", version: str = DEFAULT_VERSION, cap: int | None = None) -> DataFrame:
    """Link stored orphans and add them to the dimension; returns one row of run metrics.

    Only partitions holding an orphan are rewritten. What the run links is counted once, before the rewrite, and
    joins the dimension under a tag of its own: counts of events that retention has removed stay as they are. A
    run that died half-way is ended first, from the plan it has left, so nothing is counted twice or missed.
    """
    end_merge(store)
    if store.open_backfill() is None:
        _plan_backfill(store, run, version, cap)
    mark = store.open_backfill()
    parts = store.spark.read.parquet(f"{store.backfill_path}/parts")
    counts = store.spark.read.schema(COUNTS).parquet(f"{store.backfill_path}/counts")
    limit_id = None if mark["limit_id"] is None else F.lit(mark["limit_id"])
    known = store.count_rows([t for t in store.pending_tags() if t != mark["tag"]]).select("template_hash").distinct()
    new = counts.select("template_hash").distinct().join(known, "template_hash", "left_anti")
    if mark["processed"]:
        touched = store.events().join(parts.select("event_date", TAG), ["event_date", TAG], "left_semi")
        store.write_events(link(touched, mark["version"], limit_id))
    left = orphans(store.events())
    missed = left if limit_id is None else left.filter(F.col("id") <= limit_id)
    missed = missed.join(parts.select("event_date", TAG), ["event_date", TAG], "left_semi")
    count = lambda df: df.agg(F.count(F.lit(1)).alias("n")).scalar()
    metrics = store.spark.range(1).select(
        F.lit(mark["processed"]).cast("long").alias("processed"), count(new).alias("new_templates"),
        (F.lit(mark["processed"]) - count(missed)).alias("linked"), count(missed).alias("failed"), count(left).alias("still_unlinked"),
    )
    done = materialise(metrics, "backfill-metrics")
    if mark["processed"]:
        store.write_counts(counts, mark["tag"])
    store.drop_folder(store.backfill_path)
    return done


def _plan_backfill(store: LogStore, run: str, version: str, cap: int | None) -> None:
    """Write down what a run will link, and its counts; the mark comes last and makes the plan valid."""
    spark, limit_id = store.spark, None
    if cap is not None:
        # a constant from here on: the rewrite must not move it
        limit_id = spark.range(1).select(orphan_cap(store.events(), cap).alias("id")).first()["id"]
    unlinked = orphans(store.events())
    due = unlinked if limit_id is None else unlinked.filter(F.col("id") <= limit_id)
    # as long as the table has (day, batch) folders with orphans
    per_part = due.groupBy("event_date", TAG).agg(F.count(F.lit(1)).alias("processed"))
    per_part.write.mode("overwrite").parquet(f"{store.backfill_path}/parts")
    new = link(due, version).filter(F.col("template_id").isNotNull()).withColumn("template_hash", F.col("template_id"))
    tpl.host_counts(new).select(*COUNTS.names).write.mode("overwrite").parquet(f"{store.backfill_path}/counts")
    total = spark.read.parquet(f"{store.backfill_path}/parts").agg(F.coalesce(F.sum("processed"), F.lit(0)).alias("n")).first()["n"]
    mark = [(f"{run}-{uuid.uuid4().hex[:12]}", version, limit_id, total)]
    spark.createDataFrame(mark, "tag string, version string, limit_id long, processed long").write.mode("overwrite").parquet(f"{store.backfill_path}/mark")


def safety_net(store: LogStore, cap: int = 10_000, version: str = DEFAULT_VERSION, run: str = "safety-net") -> DataFrame:
    """Capped catch-up run over the lowest orphan ids."""
    return backfill_templates(store, run=run, version=version, cap=cap)


def missing_vectors(templates: DataFrame, vectors: DataFrame) -> DataFrame:
    """Distinct canonical texts without a vector: the only texts an embedder has to see."""
    texts = templates.select("canon_hash", "canonical_text").distinct()
    return texts.join(vectors.select("canon_hash"), "canon_hash", "left_anti")


def embed_missing(
    templates: DataFrame, vectors: DataFrame, embed: Callable[[Column], Column], model: str, tasks: int | None = None
) -> DataFrame:
    """Vectors for all texts missing in `vectors`; failed texts are left out and stay missing. `tasks` caps concurrency."""
    todo = missing_vectors(templates, vectors)
    if tasks is not None:
        todo = todo.coalesce(tasks)
    return todo.select(
        "canon_hash", embed(F.col("canonical_text")).alias("embedding_vector"), F.lit(model).alias("embedding_model")
    ).filter(F.col("embedding_vector").isNotNull())


def backfill_vectors(store: LogStore, embed: Callable[[Column], Column], model: str, tasks: int | None = None) -> None:
    """Embed and append what `model` has no vector for; a new model embeds every text, beside the old vectors.

    A run repeated after a failure picks up what is still missing, holes included.
    """
    store.append_vectors(embed_missing(tpl.roll_up(store.count_rows()), store.vectors(model), embed, model, tasks))


def resume_points(events: DataFrame) -> DataFrame:
    """Where an id-ordered backfill would continue, and what is missing, in one pass."""
    unlinked = F.when(F.col("template_id").isNull(), F.col("id"))
    embedded = F.when(F.col("embedding_vector").isNotNull(), F.col("id"))
    return events.agg(
        F.coalesce(F.min(unlinked) - 1, F.lit(0)).alias("template_resume_id"),
        F.coalesce(F.max(embedded), F.lit(0)).alias("embedding_resume_id"),
        F.count_if(F.col("template_id").isNull()).alias("orphans"),
        F.count_if(F.col("embedding_vector").isNull()).alias("missing_vectors"),
    )

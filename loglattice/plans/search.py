"""Vector search over events and over templates."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.canonical import DEFAULT_VERSION, canonicalize, text_hash
from ..operators.predicates import conjunction, event_predicate, having_vector, select_events
from ..operators.templates import recent_examples
from ..schemas import EVENT_COLUMNS, check_range
from ..sources.tables import LogStore

VECTOR = "embedding_vector"


def _unit_literal(one_row: DataFrame) -> Column:
    """The single vector of a one-row frame as a constant: the one value the driver ever holds."""
    row = one_row.first()
    if row is None or row[0] is None:
        raise ValueError("no query vector")
    size = sum(float(x) ** 2 for x in row[0]) ** 0.5
    if size == 0:
        raise ValueError("the query vector is zero")
    return V.literal([float(x) / size for x in row[0]])


def query_vector(
    spark: SparkSession, text: str, embed: Callable[[Column], Column], version: str | None = DEFAULT_VERSION
) -> Column:
    """Unit vector of a query text; canonicalised first unless version is None."""
    row = spark.range(1).select(F.lit(text).alias("text"))
    if version is not None:
        row = row.select(canonicalize(F.col("text"), version).alias("text"))
    return _unit_literal(row.select(embed(F.col("text"))))


def stored_vector(table: DataFrame, condition: Column, column: str = VECTOR) -> Column:
    """Unit vector of one stored row."""
    return _unit_literal(table.filter(condition).select(column).limit(1))


def nearest(df: DataFrame, unit_query: Column, k: int, *, column: str = VECTOR, id_column: str = "id") -> DataFrame:
    """Exact k nearest by cosine distance: one pass, each task keeps its own best k."""
    return (
        having_vector(df, column)
        .withColumn("distance", V.distance_to_unit(F.col(column), unit_query))
        .drop(column)
        .filter(F.col("distance").isNotNull())
        .orderBy("distance", id_column)
        .limit(k)
    )


def search_logs(events: DataFrame, unit_query: Column, *, limit: int = 20, **filters) -> DataFrame:
    """Filter first, then rank: filters prune days and row groups before any vector is read."""
    check_range("limit", limit, 1, 200)
    wanted = select_events(events, **filters).select(*EVENT_COLUMNS, VECTOR)
    hits = nearest(wanted, unit_query, limit)
    return hits.withColumn("similarity_score", V.similarity(F.col("distance"))).drop("distance")


def search_templates(
    templates: DataFrame,
    events: DataFrame,
    unit_query: Column,
    *,
    service: str | None = None,
    level: str | None = None,
    limit: int = 10,
    examples: int = 3,
) -> DataFrame:
    """Nearest templates, each with its newest events; a template without events has an empty array."""
    check_range("limit", limit, 1, 100)
    check_range("examples", examples, 0, 20)
    candidates = templates.filter(conjunction(event_predicate(service=service, level=level)))
    hits = nearest(
        candidates.select("template_hash", "canonical_text", "service", "level", "event_count", VECTOR),
        unit_query, limit, id_column="template_hash",
    ).withColumnRenamed("template_hash", "template_id")
    # at most `limit` <= 100 rows
    keys = F.broadcast(hits.select("template_id"))
    event = F.struct(*EVENT_COLUMNS)
    shown = (
        recent_examples(events.select(*EVENT_COLUMNS, "template_id"), keys, examples)
        .groupBy("template_id")
        .agg(F.array_sort(F.collect_list(F.struct("recency", event.alias("event")))).alias("ranked"))
        .select("template_id", F.transform("ranked", lambda r: r["event"]).alias("example_events"))
    )
    nothing = F.array().cast(shown.schema["example_events"].dataType)
    return hits.join(shown, "template_id", "left").select(
        "template_id",
        "canonical_text",
        "service",
        "level",
        "event_count",
        V.similarity(F.col("distance")).alias("similarity_score"),
        F.coalesce("example_events", nothing).alias("example_events"),
    )


class VectorIndex:
    """A stored table of hash buckets: a query reads the buckets near its own and ranks what they hold exactly.

    Each vector stands in one bucket of each of `tables` tables, with its components, so that a lookup needs
    no other table. Files are laid out by table and bucket; the statistics of their row groups prune the scan.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        meta = spark.read.parquet(f"{self.path}/meta").first()
        self.tables, self.bits, self.dims, self.id_column, self.column = (meta[c] for c in ("tables", "bits", "dims", "id_column", "vector_column"))

    @classmethod
    def build(cls, table: DataFrame, path: str, *, dims: int, column: str = VECTOR, id_column: str = "id", tables: int = 8, bits: int = 10) -> VectorIndex:
        """Store the index of all vectors of `dims` components; null and zero vectors have no direction and are left out.

        `bits` should grow with the logarithm of the rows: 2**bits buckets share a table.
        """
        spark, path = table.sparkSession, path.rstrip("/")
        numbered = having_vector(table, column).withColumn("_buckets", V.bucket_numbers(tables, bits, dims)(F.col(column)))
        some = numbered.filter(F.col("_buckets").isNotNull() & (V.norm(F.col(column)) > 0))
        spread = some.select("*", F.posexplode("_buckets").alias("_table", "_bucket")).drop("_buckets")
        (
            spread.repartitionByRange("_table", "_bucket", F.xxhash64(id_column))
            .sortWithinPartitions("_table", "_bucket")
            .write.mode("overwrite").parquet(f"{path}/buckets")
        )
        meta = spark.createDataFrame([(tables, bits, dims, id_column, column)], "tables int, bits int, dims int, id_column string, vector_column string")
        meta.write.mode("overwrite").parquet(f"{path}/meta")
        return cls(spark, path)

    def near(self, query: Sequence[float], loose: int) -> Column:
        """Rows in a bucket that differs from the query's in its `loose` least certain bits at most."""
        sides = np.einsum("d,tbd->tb", np.asarray(query, dtype=np.float64), V.projections(self.tables, self.bits, self.dims))
        found = F.lit(False)
        for t, side in enumerate(sides):
            free = np.argsort(np.abs(side), kind="stable")[:loose]
            own = int(sum(1 << b for b in range(self.bits) if side[b] > 0 and b not in free))
            buckets = [own]
            for b in free.tolist():
                buckets += [x | 1 << b for x in buckets]
            found = found | ((F.col("_table") == t) & F.col("_bucket").isin(sorted(buckets)))
        return found

    def candidates(self, query: Sequence[float], loose: int) -> DataFrame:
        rows = self.spark.read.parquet(f"{self.path}/buckets").filter(self.near(query, loose))
        return rows.drop("_table", "_bucket").dropDuplicates([self.id_column])

    def nearest(self, query: Sequence[float], k: int, probes: int = 5) -> DataFrame:
        """The k nearest rows in the buckets that differ in the `probes` least certain bits of each table.

        Where these hold fewer than k rows the lookup widens bit by bit, in the end to all buckets.
        """
        if len(query) != self.dims:
            raise ValueError(f"the index holds vectors of {self.dims} components, got {len(query)}")
        size = sum(float(x) ** 2 for x in query) ** 0.5
        if not size:
            raise ValueError("the query vector is zero")
        loose = min(probes, self.bits)
        while loose < self.bits and self.candidates(query, loose).select(self.id_column).limit(k).count() < k:
            loose += 1
        unit = V.literal([float(x) / size for x in query])
        return nearest(self.candidates(query, loose), unit, k, column=self.column, id_column=self.id_column)


def search_stored_logs(store: LogStore, unit_query: Column, model: str, *, limit: int = 20, **filters) -> DataFrame:
    """Filtered log search on a store, over the vectors of one model.

    Events carry no vector: those of one template share that of its text. So each text is compared once,
    and the events that pass the filters take the score of theirs.
    """
    check_range("limit", limit, 1, 200)
    scores = store.vectors(model).select("canon_hash", V.distance_to_unit(F.col(VECTOR), unit_query).alias("distance"))
    wanted = select_events(store.events(), **filters).select(*EVENT_COLUMNS, text_hash(F.col("canonical_text")).alias("canon_hash"))
    hits = wanted.join(scores.filter(F.col("distance").isNotNull()), "canon_hash").orderBy("distance", "id").limit(limit)
    return hits.withColumn("similarity_score", V.similarity(F.col("distance"))).drop("distance", "canon_hash")

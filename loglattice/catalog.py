"""Every operator as a query over the given tables, for checks and benchmarks.

Results are brought to plain column types (bigint, double, string, timestamp without zone) so that
another engine can compute the same rows.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import canonical as C
from .functions import journald as J
from .functions import vectors as V
from .operators import dedup, detect, graph, noise, predicates, validate
from .operators import templates as tpl
from .plans import backfill, ingest, maintenance, query, reports, retention, search
from .schemas import EVENT_COLUMNS, LOG_EVENTS, LOG_TEMPLATES, conform, write_present
from .session import materialise, shared_dir, spread, tune
from .sources import adapters, deadletter, journald
from .sources.adapters import all_logs, document_logs, logs, table
from .sources.tables import LogStore
from .streaming import shipper

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Parameters of the queries; the tables span January 2024, document logs begin in February.
HALF = "2024-01-15 00:00:00"
AS_OF = datetime(2024, 1, 25, 6, 30)
END = "2024-01-31 00:00:00"
SEARCH_TEXT = "connection refused by 10.0.0.1:8080 pid=4242 after 3.5s"
BYTES_PER_ROW = 520
LSH_K = 10
MODEL = "hashed-bow-64"


def plain(df: DataFrame) -> DataFrame:
    """Plain column types: whole numbers as bigint, fractions as double, instants without zone."""
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, (T.FloatType, T.DecimalType)):
            c = c.cast("double")
        elif isinstance(f.dataType, T.TimestampType):
            c = c.cast("timestamp_ntz")
        elif isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StringType):
            c = F.array_join(c, ",")
        out.append(c.alias(f.name))
    return df.select(*out)


def query_of(fn: Query) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return plain(fn(tune(spark), folder))

    QUERIES[fn.__name__] = run
    return fn


def r6(c: Column) -> Column:
    """Six decimals, without negative zero."""
    return F.round(c, 6) + F.lit(0.0)


def config() -> noise.NoiseConfig:
    return noise.NoiseConfig.default()


def templated(spark, folder, source=logs) -> DataFrame:
    return tpl.with_template(spread(source(spark, folder)))


def stored_dimension(spark, folder, source=logs) -> DataFrame:
    """The template dimension as a table, as ingest leaves it."""
    return materialise(tpl.build_templates(spread(source(spark, folder))), "dimension")


def stored_logs(spark, folder) -> DataFrame:
    """Logs linked to their templates, as a table."""
    linked = templated(spark, folder).withColumn("template_id", F.col("template_hash"))
    return materialise(linked, "linked-logs")


def shipped_logs(spark, folder) -> DataFrame:
    """All logs as the files a shipper would leave."""
    return materialise(spread(all_logs(spark, folder)), "shipped-logs")


def partly_linked(spark, folder) -> DataFrame:
    """Logs of which every seventh is not linked to its template yet."""
    t = templated(spark, folder)
    return t.withColumn("template_id", F.when(F.col("id") % 7 != 0, F.col("template_hash")))


def logs_with_vectors(spark, folder) -> DataFrame:
    """Each stored vector with the log event of the same number."""
    vec = table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("embedding_vector"))
    return logs(spark, folder).join(vec, "id")


# ---- sources and sinks ---------------------------------------------------------------------------


@query_of
def scan_journald(spark, folder):
    events = journald.to_events(journald.parse(adapters.journal_lines(logs(spark, folder))), "edge-1")
    return journald.look_back(events, HALF, 240).drop("id", "cursor")


@query_of
def journald_quarantine(spark, folder):
    """Journal lines, some with a broken time, among documents that are no JSON at all."""
    documents = table(spark, folder, "documents").select(F.col("text").alias("value"))
    lines = adapters.journal_lines(logs(spark, folder))
    broken = F.regexp_replace("value", r'("__REALTIME_TIMESTAMP":")(\d*7",)', "$1around $2")
    parsed = journald.parse(lines.select(broken.alias("value")).unionByName(documents))
    return parsed.groupBy(F.coalesce("parse_error", F.lit("ok")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query_of
def resume_after_id(spark, folder):
    return predicates.after_id(logs(spark, folder), 2500).select("id", "service", "message")


@query_of
def events_scan(spark, folder):
    return all_logs(spark, folder).select(*EVENT_COLUMNS)


@query_of
def templates_scan(spark, folder):
    return tpl.build_templates(spread(logs(spark, folder))).select("template_hash", "id")


@query_of
def dead_letter_round_trip(spark, folder):
    """Rejected records are spooled as JSON, read back, mended and validated again."""
    rejected = validate.rejected(validate.validate(damaged_logs(spark, folder)))
    path = shared_dir(spark, "dead-letter")
    deadletter.spool(rejected, path)
    again = deadletter.unpack(deadletter.read_spool(spark, path))
    mended = again.withColumn("level", F.upper("level"))
    return validate.validate(mended).groupBy((F.size("errors") == 0).cast("bigint").alias("accepted")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("message")).alias("chars")
    )


# ---- projections ---------------------------------------------------------------------------------


@query_of
def metadata_values(spark, folder):
    value = J.meta_map(F.col("meta_json"))["k"].cast("bigint")
    return logs(spark, folder).groupBy("level").agg(
        F.sum(value).alias("sum_k"), F.min(value).alias("min_k"), F.max(value).alias("max_k")
    )


@query_of
def conform_to_table(spark, folder):
    """A producer with fewer columns, written to the full schema and to an older, narrower one."""
    narrow = logs(spark, folder).drop("trace_id", "error_code")
    full = conform(narrow, LOG_EVENTS)
    older = T.StructType([f for f in LOG_EVENTS if f.name not in ("embedding_vector", "template_id")])
    return write_present(full, older).drop("log_hash")


@query_of
def vector_codec(spark, folder):
    vec = table(spark, folder, "embeddings").select("vec_id", "label", V.from_text(V.to_text(F.col("embedding"))).alias("v"))
    total = F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    return vec.select("vec_id", F.size("v").alias("dims"), r6(total).alias("total"))


# ---- predicates ----------------------------------------------------------------------------------


@query_of
def query_logs(spark, folder):
    return query.query_logs(
        logs(spark, folder), service="svc-3.service", level="ERROR", host="node-1",
        start="2024-01-02 00:00:00", end="2024-01-28 00:00:00", limit=50, offset=5,
    )


@query_of
def query_logs_next_page(spark, folder):
    return query.older_than(logs(spark, folder), HALF, 0, level="WARN", limit=100)


@query_of
def query_logs_any_case(spark, folder):
    found = predicates.select_events(logs(spark, folder), service="SVC-3.Service", ignore_case=True, start=HALF)
    return found.select("id", "service", "timestamp")


@query_of
def expired_by_day(spark, folder):
    old = predicates.expired(all_logs(spark, folder), HALF)
    return old.groupBy(F.to_date("timestamp").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query_of
def unlinked_events(spark, folder):
    return predicates.orphans(partly_linked(spark, folder)).select("id", "service", "level")


@query_of
def template_key_lookup(spark, folder):
    """Dimension rows whose hash occurs among the severe events."""
    severe = templated(spark, folder).filter(F.col("level") == "ERROR").select("template_hash")
    dimension = tpl.build_templates(spread(logs(spark, folder)))
    return predicates.in_keys(dimension, severe, "template_hash").select("template_hash", "canonical_text", "event_count")


@query_of
def noise_classify(spark, folder):
    return noise.classify(all_logs(spark, folder), config()).select("id", "level", "service", "drop_reason")


def damaged_logs(spark, folder) -> DataFrame:
    """All logs, some of them violating a rule of the schema."""
    n = F.col("id")
    return all_logs(spark, folder).withColumns(
        {
            "service": F.when(n % 11 == 0, F.concat("service", F.lit("/"), "message")).otherwise(F.col("service")),
            "level": F.when(n % 13 == 0, F.lower("level")).otherwise(F.col("level")),
            "source": F.when(n % 17 != 0, F.col("source")),
            "meta_json": F.when(n % 19 == 0, F.lit("no json")).when(n % 23 == 0, F.lit("{ }")).otherwise(F.col("meta_json")),
            "error_code": F.when(n % 29 == 0, F.lpad(F.col("error_code"), 51, "0")).otherwise(F.col("error_code")),
        }
    )


@query_of
def validate_records(spark, folder):
    checked = validate.validate(damaged_logs(spark, folder))
    return checked.select("id", "errors", "meta_json")


# ---- joins, dedup and templates ------------------------------------------------------------------


@query_of
def resolve_templates(spark, folder):
    events = templated(spark, folder)
    known = tpl.roll_up(tpl.host_counts(events.filter(F.col("timestamp") < predicates.instant(HALF))))
    return tpl.resolve(events, known).select("id", "template_hash", "template_id")


@query_of
def new_templates(spark, folder):
    events = templated(spark, folder, all_logs)
    cut = predicates.instant("2024-01-03 00:00:00")
    known = tpl.roll_up(tpl.host_counts(events.filter(F.col("timestamp") < cut)))
    later = tpl.roll_up(tpl.host_counts(events.filter(F.col("timestamp") >= cut)))
    return tpl.new_templates(later, known).select("template_hash", "service", "level", "event_count")


@query_of
def accept_new_events(spark, folder):
    """Content dedup inside the batch and against what is stored already."""
    batch = dedup.with_identity(shipped_logs(spark, folder))
    stored = batch.filter(F.col("timestamp") < predicates.instant(HALF))
    return dedup.not_stored(dedup.first_of_each(batch), stored).select("id", "log_hash")


@query_of
def ingest_outcome(spark, folder):
    checked = validate.validate(damaged_logs(spark, folder))
    unique = dedup.first_of_each(dedup.with_identity(validate.valid(checked)))
    return dedup.outcome(checked, unique, validate.rejected(checked))


@query_of
def ingest_twice(spark, folder):
    """Two runs over the same logs into a store: the second adds nothing. Counts come from the stored tables."""
    store = LogStore(spark, shared_dir(spark, "ingest"))
    events = shipped_logs(spark, folder)
    first = ingest.ingest(events, store, "first", config=config()).counters()
    second = ingest.ingest(events, store, "second", config=config()).counters()
    dimension = store.templates().agg(F.sum("event_count").alias("events"), F.count(F.lit(1)).alias("templates"))
    run = lambda df, n: df.withColumn("run", F.lit(n))
    return (
        run(first, 1)
        .unionByName(run(second, 2))
        .withColumn("counted_events", dimension.select("events").scalar())
        .withColumn("templates", dimension.select("templates").scalar())
    )


@query_of
def first_event_per_template(spark, folder):
    return tpl.first_event(templated(spark, folder)).select("template_hash", "id", "timestamp", "host")


@query_of
def template_batch_counts(spark, folder):
    return tpl.host_counts(templated(spark, folder)).select(
        "template_hash", "host", "event_count", "first_seen", "last_seen"
    )


@query_of
def merge_template_counts(spark, folder):
    """Counts of two batches added up; equals counting both at once."""
    events = templated(spark, folder, all_logs)
    early = tpl.host_counts(events.filter(F.col("timestamp") < predicates.instant(HALF)))
    late = tpl.host_counts(events.filter(F.col("timestamp") >= predicates.instant(HALF)))
    return tpl.roll_up(tpl.merge_counts(early, late)).select(
        "template_hash", "event_count", "first_seen", "last_seen", "source_hosts"
    )


@query_of
def template_dimension(spark, folder):
    """The whole dimension, in the table's own column set."""
    keep = [
        "id", "template_hash", "canonical_text", "service", "level", "canon_version", "canon_hash", "chunk_version",
        "first_seen", "last_seen", "event_count", "source_hosts",
    ]
    return conform(tpl.build_templates(spread(all_logs(spark, folder))), LOG_TEMPLATES).select(*keep)


@query_of
def template_dense_ids(spark, folder):
    return tpl.with_dense_ids(tpl.build_templates(spread(logs(spark, folder))), start=1000).select("template_hash", "dense_id")


@query_of
def recent_examples(spark, folder):
    events = stored_logs(spark, folder)
    keys = tpl.roll_up(tpl.host_counts(events)).filter("level = 'ERROR'").select("template_hash")
    keys = keys.withColumnRenamed("template_hash", "template_id")
    return tpl.recent_examples(events, keys, 3).select("template_id", "recency", "id", "message")


# ---- canonicalisation and hashes -----------------------------------------------------------------


@query_of
def canonicalize_logs(spark, folder):
    return spread(logs(spark, folder)).select("id", C.canonicalize(F.col("message")).alias("canonical_text"))


@query_of
def canonicalize_documents(spark, folder):
    key = C.template_key(F.col("message"), F.col("service"), F.col("level"))
    return spread(document_logs(spark, folder)).select("id", key.alias("key")).select(
        "id", "key.canonical_text", "key.template_hash", "key.canon_version",
        C.text_hash(F.col("key.canonical_text")).alias("canon_hash"),
    )


@query_of
def canonicalize_pages(spark, folder):
    pages = spread(table(spark, folder, "pages"))
    return pages.select("page_id", C.text_hash(C.canonicalize(F.col("html"))).alias("canon_hash"))


@query_of
def rule_hits(spark, folder):
    """How many messages each rule changes, in the order the rules apply."""
    df = spread(all_logs(spark, folder).select("message"))
    # one array per message with the text after every rule: s[0] raw, s[i] after rule i
    grow = "array(m)"
    for rule in C.RULES_V1:
        grow = f"get(transform(array({grow}), s -> concat(s, transform(slice(s, -1, 1), t -> {C.rule_sql(rule)}))), 0)"
    strip = f"transform(slice(s, -1, 1), t -> btrim(t, {C.sql_literal(C.STRIP_CHARS)}))"
    texts = C.bind(F.col("message"), f"m -> get(transform(array({grow}), s -> concat(s, {strip})), 0)")
    names = [*(r.name for r in C.RULES_V1), "R33"]
    counts = df.select(texts.alias("s")).agg(
        *[F.count_if(F.get("s", F.lit(i)) != F.get("s", F.lit(i + 1))).alias(n) for i, n in enumerate(names)]
    )
    pairs = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("hits")) for n in names])
    return counts.select(F.explode(pairs).alias("p")).select("p.rule", "p.hits")


@query_of
def log_hashes(spark, folder):
    return adapters.with_hash(all_logs(spark, folder)).select("id", "log_hash")


# ---- maintenance ---------------------------------------------------------------------------------


@query_of
def resume_points(spark, folder):
    vec = table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("embedding_vector"))
    return backfill.resume_points(partly_linked(spark, folder).join(vec, "id", "left"))


@query_of
def backfill_links(spark, folder):
    return backfill.link(partly_linked(spark, folder)).select("id", "template_id")


@query_of
def safety_net_links(spark, folder):
    """Only the 500 lowest unlinked ids are linked by a capped run."""
    events = partly_linked(spark, folder)
    capped = backfill.link(events, up_to_id=backfill.orphan_cap(events, 500))
    return capped.groupBy(F.col("template_id").isNull().cast("bigint").alias("unlinked")).agg(
        F.count(F.lit(1)).alias("n"), F.max("id").alias("max_id"), F.min("id").alias("min_id")
    )


@query_of
def backfill_stored(spark, folder):
    """A store with unlinked rows is backfilled; the run metrics and the repaired dimension agree."""
    store = legacy_store(spark, folder)
    metrics = backfill.backfill_templates(store)
    total = tpl.roll_up(store.count_rows()).agg(F.sum("event_count").alias("n"))
    return metrics.withColumn("counted_events", total.scalar())


def legacy_store(spark, folder) -> LogStore:
    """A store of which every seventh event is not linked, and so not counted."""
    store = LogStore(spark, shared_dir(spark, "backfill"))
    events = partly_linked(spark, folder)
    linked = F.col("template_id").isNotNull()
    hashed = dedup.with_identity(events).withColumns(
        {c: F.when(linked, F.col(c)) for c in ("canonical_text", "canon_version")}
    )
    store.write_events(hashed, "legacy")
    stored = store.events().filter(linked).withColumn("template_hash", F.col("template_id"))
    store.write_counts(tpl.host_counts(stored), "legacy")
    return store


def _counted(store: LogStore) -> int:
    return store.count_rows().agg(F.coalesce(F.sum("event_count"), F.lit(0)).alias("n")).first()["n"]


@query_of
def backfill_after_purge(spark, folder):
    """After retention a backfill adds what it links; the counts of events that are gone stay, and a second run adds nothing."""
    store = legacy_store(spark, folder)
    retention.purge(store, AS_OF, 10)
    before = _counted(store)
    metrics = backfill.backfill_templates(store)
    after = _counted(store)
    again = backfill.backfill_templates(store)
    return (
        metrics.withColumn("counted_before", F.lit(before)).withColumn("counted_after", F.lit(after))
        .withColumn("second_run", again.select("processed").scalar()).withColumn("counted_at_last", F.lit(_counted(store)))
    )


@query_of
def safety_net_stored(spark, folder):
    """The capped catch-up run on a store: only the 500 lowest orphans are linked and counted."""
    store = legacy_store(spark, folder)
    metrics = backfill.safety_net(store, cap=500)
    return metrics.withColumn("counted_events", F.lit(_counted(store)))


class _CountsAway(LogStore):
    """A store that loses its counts folder between the two writes of a batch."""

    def write_counts(self, counts, tag):
        raise RuntimeError("template counts cannot be written")


@query_of
def failed_batch_replay(spark, folder):
    """A batch fails after its events were written; the next start ingests it under its tag, and counts equal events."""
    root = shared_dir(spark, "failing-store")
    shipper.ship_batch(shipped_logs(spark, folder), None, _CountsAway(spark, root), "b-1", config=config(), retry_after=0)
    store = LogStore(spark, root)
    kept, before = len(store.failed_tags()), _counted(store)
    recovered = shipper.recover(store, config=config())
    stored = store.events().agg(F.count(F.lit(1)).alias("stored"), F.count_distinct("template_id").alias("templates"))
    return stored.select(
        "stored", "templates", F.lit(before).alias("counted_before"), F.lit(_counted(store)).alias("counted"),
        F.lit(kept).alias("kept"), F.lit(len(recovered)).alias("recovered"), F.lit(len(store.failed_tags())).alias("left"),
    )


@query_of
def evolve_stored(spark, folder):
    """A stored table of two generations of files read as one, then rolled back on disk."""
    path = f"{shared_dir(spark, 'generations')}/events"
    old = F.col("timestamp") < predicates.instant(HALF)
    rows = logs(spark, folder).withColumn("event_date", F.to_date("timestamp"))
    rows.filter(old).select("id", "service", "event_date").write.partitionBy("event_date").parquet(path)
    rows.filter(~old).select("id", "service", "error_code", "event_date").write.mode("append").partitionBy("event_date").parquet(path)
    both = materialise(retention.read_generations(spark, path), "both-generations")
    rewritten = retention.drop_stored_columns(spark, path, ["error_code"], "event_date")
    after = retention.read_generations(spark, path)
    left = after.groupBy("id").agg(F.count(F.lit(1)).alias("rows_after"))
    return both.join(left, "id").select(
        "id", "service", "error_code", "event_date", "rows_after", F.lit(rewritten).alias("rewritten"), F.lit(",".join(sorted(after.columns))).alias("columns_after")
    )


@query_of
def catalog_views(spark, folder):
    """What a store holds, read by SQL through its views."""
    store = LogStore(spark, shared_dir(spark, "viewed-store"))
    ingest.ingest(materialise(spread(logs(spark, folder)), "shipped-logs"), store, "load")
    prefix = f"v{store.root[-12:]}_"
    store.register(prefix)
    return spark.sql(f"""SELECT t.level, t.templates, t.counted, e.n FROM
        (SELECT level, count(*) AS templates, sum(event_count) AS counted FROM {prefix}log_templates GROUP BY level) t
        JOIN (SELECT level, count(*) AS n FROM {prefix}log_events GROUP BY level) e ON t.level = e.level""")


@query_of
def embed_missing_texts(spark, folder):
    """Vectors for the canonical texts that have none yet, as non-zero components."""
    dimension = stored_dimension(spark, folder, all_logs)
    have = dimension.filter(F.col("level") == "ERROR").select("canon_hash").distinct()
    new = backfill.embed_missing(dimension, have, V.hashed_bag_of_words(), "hashed-bow-64")
    parts = new.select("canon_hash", F.posexplode("embedding_vector").alias("pos", "x")).filter("x <> 0")
    return parts.select("canon_hash", "pos", F.round(F.col("x").cast("double"), 5).alias("x"))


@query_of
def retention_report(spark, folder):
    events = all_logs(spark, folder)
    cutoff = retention.cutoff_for(AS_OF, 10)
    return retention.report(events, tpl.build_templates(events), cutoff)


@query_of
def retention_survivors(spark, folder):
    kept = retention.surviving_events(all_logs(spark, folder), retention.cutoff_for(AS_OF, 10))
    return kept.groupBy(F.to_date("timestamp").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("min_id"))


@query_of
def fresh_templates(spark, folder):
    dimension = tpl.build_templates(spread(all_logs(spark, folder)))
    return retention.fresh_templates(dimension, retention.cutoff_for(AS_OF, 1)).select("template_hash", "last_seen")


@query_of
def purge_store(spark, folder):
    """Retention on a stored table: expired days go as folders, the boundary day is rewritten."""
    store = LogStore(spark, shared_dir(spark, "purge"))
    ingest.ingest(shipped_logs(spark, folder), store, "load")
    retention.purge(store, AS_OF, 10)
    left = store.events().agg(F.count(F.lit(1)).alias("events"), F.min("timestamp").alias("oldest"))
    fresh = tpl.roll_up(store.count_rows()).agg(F.count(F.lit(1)).alias("n"))
    return left.withColumn("templates", fresh.scalar())


@query_of
def stored_retention_report(spark, folder):
    """The dry run on a store: one time column and the stored counts are read, no rule runs."""
    store = LogStore(spark, shared_dir(spark, "reported-store"))
    ingest.ingest(shipped_logs(spark, folder), store, "load")
    return retention.purge(store, AS_OF, 10, dry_run=True)


@query_of
def stored_query_logs(spark, folder):
    """Filtered page of a stored table: days and row groups outside of the filters are not read."""
    store = LogStore(spark, shared_dir(spark, "queried-store"))
    ingest.ingest(materialise(spread(logs(spark, folder)), "shipped-logs"), store, "load")
    return query.query_logs(
        store.events(), service="svc-3.service", level="ERROR", host="node-1",
        start="2024-01-02 00:00:00", end="2024-01-28 00:00:00", limit=50, offset=5,
    )


@query_of
def merge_day_files(spark, folder):
    """Three batches over the same days; days that are over are merged, and a batch that is run again adds nothing."""
    store = LogStore(spark, shared_dir(spark, "merged-store"))
    shipped = materialise(spread(logs(spark, folder)), "shipped-logs")
    batches = [shipped.filter(F.col("id") % 3 == n) for n in range(3)]
    for n, batch in enumerate(batches):
        ingest.ingest(batch, store, f"b{n}")
    before = maintenance.day_files(store)
    maintenance.maintain(store, datetime.fromisoformat(HALF).date())
    ingest.ingest(batches[1], store, "b1")
    after = maintenance.day_files(store)
    stored = store.events().groupBy(F.col("event_date").cast("string").alias("event_date")).agg(
        F.count(F.lit(1)).alias("n"), F.min("id").alias("min_id"), F.sum("id").alias("ids")
    )
    folders = before.select("event_date", F.col("folders").alias("folders_before")).join(
        after.select("event_date", F.col("folders").alias("folders_after")), "event_date"
    )
    return stored.join(folders, "event_date").withColumn("counted", F.lit(_counted(store)))


@query_of
def evolve_schema(spark, folder):
    """Additive migration and its rollback."""
    added = retention.add_columns(
        logs(spark, folder).select("id", "service"), {"template_id": T.StringType(), "service": T.StringType()}
    )
    rolled_back = retention.drop_columns(added, ["template_id"])
    return added.join(rolled_back, ["id", "service"]).select("id", "service", "template_id")


# ---- vectors -------------------------------------------------------------------------------------


@query_of
def cosine_distances(spark, folder):
    vec = table(spark, folder, "embeddings")
    unit = search.stored_vector(vec, F.col("vec_id") == 0, "embedding")
    return vec.select("vec_id", r6(V.distance_to_unit(F.col("embedding"), unit)).alias("distance"))


@query_of
def search_logs(spark, folder):
    vec = table(spark, folder, "embeddings")
    unit = search.stored_vector(vec, F.col("vec_id") == 0, "embedding")
    hits = search.search_logs(
        logs_with_vectors(spark, folder), unit, level="ERROR", start="2024-01-01 00:00:00", end=END, limit=20
    )
    return hits.select("id", "service", "message", r6(F.col("similarity_score")).alias("similarity_score"))


@query_of
def search_templates(spark, folder):
    """Templates nearest to a query text, with their newest events, one row per example."""
    embed = V.hashed_bag_of_words()
    events = stored_logs(spark, folder)
    dimension = tpl.roll_up(tpl.host_counts(events))
    dimension = materialise(dimension.withColumn("embedding_vector", embed(F.col("canonical_text"))), "dimension")
    unit = search.query_vector(spark, SEARCH_TEXT, embed)
    hits = search.search_templates(dimension, events, unit, limit=10, examples=3)
    return hits.select(
        "template_id", "canonical_text", "event_count", r6(F.col("similarity_score")).alias("similarity_score"),
        F.posexplode("example_events").alias("rank", "example"),
    ).select("template_id", "canonical_text", "event_count", "similarity_score", "rank", F.col("example.id").alias("event_id"))


@query_of
def nearest_by_index(spark, folder):
    """Neighbours of one stored vector through a stored table of hash buckets."""
    vec = table(spark, folder, "embeddings").withColumnRenamed("embedding", "embedding_vector").withColumnRenamed("vec_id", "id")
    index = search.VectorIndex.build(vec, shared_dir(spark, "vector-index"), dims=64)
    target = vec.filter("id = 0").first()["embedding_vector"]
    return index.nearest(target, LSH_K).select("id", "label", r6(F.col("distance")).alias("distance"))


def embedded_store(spark, folder) -> LogStore:
    """All logs of the events table in a store, with the vectors of the offline model."""
    store = LogStore(spark, shared_dir(spark, "embedded-store"))
    ingest.ingest(materialise(spread(logs(spark, folder)), "shipped-logs"), store, "load")
    backfill.backfill_vectors(store, V.hashed_bag_of_words(), MODEL)
    return store


@query_of
def stored_search_logs(spark, folder):
    """Log search on a store: events take the score of their template's text."""
    unit = search.query_vector(spark, SEARCH_TEXT, V.hashed_bag_of_words())
    hits = search.search_stored_logs(
        embedded_store(spark, folder), unit, MODEL, level="ERROR", start="2024-01-05 00:00:00", end=END, limit=20
    )
    return hits.select("id", "service", "message", r6(F.col("similarity_score")).alias("similarity_score"))


@query_of
def stored_search_templates(spark, folder):
    """Template search on a store that was prepared before."""
    store = embedded_store(spark, folder)
    unit = search.query_vector(spark, SEARCH_TEXT, V.hashed_bag_of_words())
    hits = search.search_templates(store.templates(MODEL), store.events(), unit, limit=10, examples=3)
    return hits.select(
        "template_id", "canonical_text", "event_count", r6(F.col("similarity_score")).alias("similarity_score"),
        F.posexplode_outer("example_events").alias("rank", "example"),
    ).select("template_id", "canonical_text", "event_count", "similarity_score", "rank", F.col("example.id").alias("event_id"))


@query_of
def reembed_new_model(spark, folder):
    """A second model embeds every text anew, beside the vectors of the first; run twice it adds nothing."""
    store = embedded_store(spark, folder)
    for _ in range(2):
        backfill.backfill_vectors(store, V.hashed_bag_of_words(32), "hashed-bow-32")
    stored = spark.read.parquet(store.vectors_path).groupBy("embedding_model").agg(F.count(F.lit(1)).alias("rows"))
    per_model = store.vectors().groupBy("embedding_model").agg(
        F.count(F.lit(1)).alias("texts"), F.min(F.size("embedding_vector")).alias("dims"), F.max(F.size("embedding_vector")).alias("most_dims")
    )
    return per_model.join(stored, "embedding_model")


@query_of
def embed_documents(spark, folder):
    """Offline vectors of whole texts: size of the support and the largest component."""
    embed = V.hashed_bag_of_words()
    v = spread(table(spark, folder, "documents")).select("doc_id", embed(F.col("text")).alias("v"))
    return v.select(
        "doc_id",
        F.size(F.filter("v", lambda x: x > 0)).alias("support"),
        F.round(F.array_max("v").cast("double"), 4).alias("largest"),
    )


# ---- streaming -----------------------------------------------------------------------------------


def _event_stream(spark, folder) -> DataFrame:
    static = table(spark, folder, "events")
    return spark.readStream.schema(static.schema).option("pathGlobFilter", "events.parquet").parquet(folder)


@query_of
def stream_ingest(spark, folder):
    """The events table as a file stream through filter, dedup and templates; counts from the stored tables."""
    raw = _event_stream(spark, folder)
    stream = adapters.events_as_logs(raw)
    store = LogStore(spark, shared_dir(spark, "stream-store"))
    run = shipper.ship_events(stream, store, shared_dir(spark, "stream-checkpoint"), name="events", config=config())
    run.awaitTermination()
    return store.templates().select("template_hash", "event_count", "first_seen", "last_seen", "source_hosts")


@query_of
def stream_journal(spark, folder):
    """Journal lines written as text files, followed as a stream."""
    lines = shared_dir(spark, "journal-lines")
    adapters.journal_lines(logs(spark, folder)).write.text(lines)
    store = LogStore(spark, shared_dir(spark, "journal-store"))
    run = shipper.ship_journal(spark, lines, "edge-1", store, shared_dir(spark, "journal-checkpoint"), config=config())
    run.awaitTermination()
    return store.events().groupBy("service", "level").agg(F.count(F.lit(1)).alias("n"), F.max("timestamp").alias("newest"))


def in_order(df: DataFrame, cuts: list[str]) -> tuple[DataFrame, str]:
    """A stream of rows that arrive slice by slice in order of time, and its folder."""
    bounds = [None, *cuts, None]
    parts = []
    for low, high in zip(bounds, bounds[1:], strict=False):
        part = df
        part = part if low is None else part.filter(F.col("timestamp") >= predicates.instant(low))
        part = part if high is None else part.filter(F.col("timestamp") < predicates.instant(high))
        parts.append(part)
    source, files = slices(parts)
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(source), source


def slices(parts: list[DataFrame]) -> tuple[str, int]:
    """Write each frame as the same number of files, one after the other; returns the folder and that number.

    A file per core, so that slices are written and read by all; a single one where rows are so few that a file would be missing.
    """
    spark = parts[0].sparkSession
    for files in dict.fromkeys((spark.sparkContext.defaultParallelism, 1)):
        source, there = shared_dir(spark, "slices"), 0
        for n, part in enumerate(parts, 1):
            part.repartition(files, *part.columns).write.mode("append").parquet(source)
            there = len([f for f in LogStore(spark, source).children(source) if f.endswith(".parquet")])
            if there < n * files:
                break
        if there == len(parts) * files:
            break
    return source, files


@query_of
def stream_cooldown(spark, folder):
    """Alerts that arrive in three batches: what fires equals the batch form."""
    alerts = logs(spark, folder).filter(_killed()).select("service", "timestamp")
    stream, _ = in_order(alerts, ["2024-01-10 00:00:00", "2024-01-20 12:00:00"])
    fired = detect.cooldown_stream(stream, key="service", minutes=360)
    out = shared_dir(spark, "fired")
    run = fired.writeStream.option("checkpointLocation", shared_dir(spark, "cooldown-checkpoint")).format("parquet")
    run.trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema(fired.schema).parquet(out).select("service", "minute", "fired_at")


@query_of
def stream_noise_stats(spark, folder):
    """The statistics of the noise filter, kept batch by batch as a stream is shipped, added up."""
    stream, _ = in_order(logs(spark, folder).select(*EVENT_COLUMNS), ["2024-01-08 00:00:00", "2024-01-19 00:00:00"])
    store = LogStore(spark, shared_dir(spark, "stats-store"))
    shipper.ship_events(stream, store, shared_dir(spark, "stats-checkpoint"), name="stats", config=config()).awaitTermination()
    return store.stats().filter(F.col("drop_reason").isNotNull()).groupBy("drop_reason").agg(F.sum("n").alias("dropped"))


@query_of
def stream_dedup_late(spark, folder):
    """Copies in a batch, in a later batch, and in a run that has lost its memory: each event is stored once.

    The stream's own state drops the first two kinds; the third passes it and meets the stored events.
    """
    events = logs(spark, folder).select(*EVENT_COLUMNS)
    early = events.filter(F.col("timestamp") < predicates.instant(HALF))
    late = events.filter(F.col("timestamp") >= predicates.instant(HALF))
    source, files = slices([early.unionByName(early.filter("id % 2 = 0")), late.unionByName(early.filter("id % 3 = 0"))])
    store = LogStore(spark, shared_dir(spark, "copies-store"))
    for name in ("first", "second"):
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", files).parquet(source)
        shipper.ship_events(stream, store, shared_dir(spark, "copies-checkpoint"), name=name, distinct_for="1 hour").awaitTermination()
    run = F.substring_index("ingest_tag", "-", 1).alias("run")
    passed = store.stats().groupBy(run).agg(F.sum("n").alias("passed"))
    stored = store.events().groupBy(run).agg(F.count(F.lit(1)).alias("stored"))
    return passed.join(stored, "run", "left").select("run", "passed", F.coalesce("stored", F.lit(0)).alias("stored"))


# ---- noise and reports ---------------------------------------------------------------------------


@query_of
def noise_stats(spark, folder):
    return noise.stats_by_rule(noise.classify(logs(spark, folder), config()))


@query_of
def noise_summary(spark, folder):
    return noise.summary(noise.classify(all_logs(spark, folder), config()))


@query_of
def report_noisiest_services(spark, folder):
    return reports.noisiest_services(all_logs(spark, folder))


@query_of
def report_levels(spark, folder):
    return reports.level_distribution(all_logs(spark, folder))


@query_of
def report_latest(spark, folder):
    return reports.latest_logs(logs(spark, folder))


@query_of
def report_daily(spark, folder):
    return reports.daily_volume(all_logs(spark, folder))


@query_of
def report_daily_average(spark, folder):
    return reports.daily_average(all_logs(spark, folder))


@query_of
def report_hourly(spark, folder):
    return reports.hourly_volume(logs(spark, folder))


@query_of
def report_service_share(spark, folder):
    return reports.service_share(logs(spark, folder))


@query_of
def report_lengths(spark, folder):
    return reports.message_lengths(all_logs(spark, folder))


@query_of
def report_gaps(spark, folder):
    return reports.data_gaps(logs(spark, folder), timedelta(minutes=4))


@query_of
def report_gaps_by_host(spark, folder):
    return reports.data_gaps(logs(spark, folder), timedelta(hours=1), by="host")


@query_of
def report_compression(spark, folder):
    return reports.compression_ratio(tpl.build_templates(spread(all_logs(spark, folder))))


@query_of
def report_noise(spark, folder):
    return reports.noise_breakdown(logs(spark, folder), config())


@query_of
def report_signal_share(spark, folder):
    return reports.signal_to_noise(spread(all_logs(spark, folder)), config())


@query_of
def report_signals(spark, folder):
    return reports.signal_breakdown(spread(all_logs(spark, folder)))


@query_of
def report_what_if(spark, folder):
    return reports.what_if(logs(spark, folder), config())


@query_of
def report_growth(spark, folder):
    return reports.growth_projection(logs(spark, folder), BYTES_PER_ROW)


@query_of
def report_hosts(spark, folder):
    return reports.logs_per_host(all_logs(spark, folder))


@query_of
def report_embedding_coverage(spark, folder):
    vec = table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("embedding_vector"))
    return reports.embedding_coverage(logs(spark, folder).join(vec, "id", "left"))


# ---- detectors -----------------------------------------------------------------------------------


@query_of
def detect_error_spikes(spark, folder):
    spikes = detect.error_spikes(logs(spark, folder))
    return spikes.select("service", "hour", "errors", r6(F.col("ewma")).alias("ewma"), r6(F.col("sigma")).alias("sigma"))


@query_of
def detect_new_error_templates(spark, folder):
    dimension = stored_dimension(spark, folder)
    return detect.new_error_templates(dimension, "2024-01-02 00:00:00").select("template_hash", "service", "first_seen")


@query_of
def detect_template_anomalies(spark, folder):
    found = detect.template_anomalies(templated(spark, folder))
    return found.select("template_hash", "day", "n", r6(F.col("mean")).alias("mean"), r6(F.col("sigma")).alias("sigma"))


@query_of
def detect_template_stats(spark, folder):
    """Count, span, hosts and trend of every template."""
    return detect.template_stats(templated(spark, folder))


@query_of
def detect_silence(spark, folder):
    return detect.silences(logs(spark, folder), END)


@query_of
def detect_catastrophes(spark, folder):
    return detect.catastrophes(stored_dimension(spark, folder, all_logs)).groupBy("kind", "service").agg(
        F.count(F.lit(1)).alias("templates"), F.sum("event_count").alias("events")
    )


def _killed() -> Column:
    return F.col("message").startswith("Out of memory")


def _refused() -> Column:
    return F.col("message").startswith("connection refused")


@query_of
def detect_correlations(spark, folder):
    return detect.correlations(logs(spark, folder), _killed(), _refused(), by="host", minutes=5)


@query_of
def detect_cooldown(spark, folder):
    alerts = logs(spark, folder).filter(_killed())
    return detect.cooldown(alerts, key="service", minutes=360).select("service", "minute", "fired_at")


@query_of
def detect_context(spark, folder):
    alerts = detect.cooldown(logs(spark, folder).filter(_killed()), key="service", minutes=360)
    incidents = alerts.withColumn("incident_id", F.concat_ws("@", "service", F.col("minute").cast("string")))
    bundle = detect.context_bundle(incidents, templated(spark, folder), minutes=120, top=5)
    return bundle.select("incident_id", "events", F.explode("templates").alias("t")).select(
        "incident_id", "events", "t.rank", "t.template_hash", "t.n"
    )


@query_of
def detect_service_overview(spark, folder):
    return detect.service_overview(templated(spark, folder), "2024-01-20 12:00:00", 24)


@query_of
def detect_log_context(spark, folder):
    """The records around one instant on the same host."""
    return detect.log_context(logs(spark, folder), HALF, 0, around=5, host="node-3").select("id", "host", "message")


def service_edges(spark, folder) -> DataFrame:
    """A dependency graph drawn from the user numbers of the events table."""
    users = table(spark, folder, "events").select(F.col("user_id").alias("u")).distinct()
    return users.selectExpr("'svc-' || u % 48 AS src", "'svc-' || (u * u + 1) % 50 AS dst").distinct()


def _affected(spark) -> DataFrame:
    return spark.createDataFrame([("svc-1",), ("svc-5",), ("svc-9",)], "node string")


@query_of
def graph_upstream(spark, folder):
    return graph.upstream(service_edges(spark, folder), _affected(spark))


@query_of
def graph_blast_radius(spark, folder):
    edges = service_edges(spark, folder)
    return graph.blast_radius(edges, edges.select(F.col("dst").alias("node")).distinct())


@query_of
def graph_common_ancestors(spark, folder):
    return graph.common_ancestors(service_edges(spark, folder), _affected(spark))

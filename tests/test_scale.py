"""What keeps the stored jobs and streams within bounds on large tables."""

from __future__ import annotations

from datetime import UTC, datetime, timedelta

from conftest import plan_of
from pyspark.sql import functions as F

from loglattice import catalog
from loglattice.operators import templates as tpl
from loglattice.plans import ingest, maintenance, retention
from loglattice.sources import deadletter
from loglattice.sources.tables import LogStore
from loglattice.streaming import shipper

START = datetime(2024, 1, 1, tzinfo=UTC)


def lines(make_events, n, minutes=1, text="job {} took {} ms"):
    return make_events(*[{"timestamp": START + timedelta(minutes=minutes * i), "message": text.format(i % 7, i)} for i in range(n)])


def streamed(spark, stream, checkpoint):
    """How many rows and which span each batch of a stream holds."""
    seen = []

    def note(batch, _):
        if batch.limit(1).count():
            seen.append(tuple(batch.agg(F.count(F.lit(1)), F.min("id"), F.max("id")).first()))

    stream.writeStream.option("checkpointLocation", str(checkpoint)).foreachBatch(note).trigger(availableNow=True).start().awaitTermination()
    return seen


def test_canonical_texts_are_not_moved_with_the_events(spark, make_events, tmp_path, monkeypatch):
    moved = []
    plain = LogStore.write_events

    def spy(store, events, *args):
        moved.append(events.columns)
        plain(store, events, *args)

    monkeypatch.setattr(LogStore, "write_events", spy)
    store = LogStore(spark, str(tmp_path / "store"))
    ingest.ingest(lines(make_events, 10), store, "a")
    assert "canonical_text" not in moved[0]
    stored = store.events().select("canonical_text", "canon_version", "template_id").distinct().collect()
    expected = tpl.with_template(lines(make_events, 10)).select("canonical_text", "canon_version", "template_hash").distinct().collect()
    assert sorted(map(tuple, stored)) == sorted(map(tuple, expected))


def test_a_failed_batch_is_kept_compressed(spark, make_events, tmp_path):
    store = LogStore(spark, str(tmp_path / "store"))
    events = lines(make_events, 50)
    store.spool_failed(events, "t", "disk full")
    files = [f for f in store.children(f"{store.failed_path}/ingest_tag=t") if not f.startswith(("_", "."))]
    assert files and all(f.endswith(".json.gz") for f in files)
    again = deadletter.unpack(store.failed_batch("t")).select(events.columns)
    assert again.exceptAll(events).count() == 0 and again.count() == 50


def test_counting_templates_moves_no_text(spark, make_events):
    counts = tpl.host_counts(tpl.with_template(lines(make_events, 20))).localCheckpoint()
    rolled = tpl.roll_up(counts.unionByName(counts))
    exchanges = [p for p in plan_of(rolled.agg(F.count(F.lit(1)))).split("\n\n") if "hashpartitioning" in p]
    assert exchanges and not any("canonical_text" in p for p in exchanges)
    once = tpl.roll_up(counts).withColumn("event_count", F.col("event_count") * 2)
    assert sorted(map(str, rolled.collect())) == sorted(map(str, once.collect()))


def test_retention_moves_counts_once(spark, make_events, tmp_path, monkeypatch):
    store = LogStore(spark, str(tmp_path / "store"))
    for n, days in enumerate((0, 20, 40)):
        row = {"timestamp": START + timedelta(days=days), "host": f"h{n}"}
        ingest.ingest(make_events({**row, "message": "always"}, {**row, "message": f"only {'abc'[n]}"}), store, f"b{n}")
    plans = []
    plain = LogStore.write_snapshot

    def spy(store, counts, tags):
        plans.append(plan_of(counts))
        return plain(store, counts, tags)

    monkeypatch.setattr(LogStore, "write_snapshot", spy)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        retention.purge_templates(store, (START + timedelta(days=10)).replace(tzinfo=None))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    moves = [p for p in plans[0].split("\n\n") if "hashpartitioning" in p and "canonical_text" in p]
    assert len(moves) == 1
    left = {r.canonical_text: (r.event_count, r.source_hosts) for r in store.templates().collect()}
    assert left == {"always": (3, ["h0", "h1", "h2"]), "only b": (1, ["h1"]), "only c": (1, ["h2"])}


def test_a_slice_is_written_by_all_cores_and_arrives_as_one_batch(spark, make_events, tmp_path):
    stream, folder = catalog.in_order(lines(make_events, 300), ["2024-01-01 01:40:00", "2024-01-01 03:20:00"])
    files = [f for f in LogStore(spark, folder).children(folder) if f.endswith(".parquet")]
    assert len(files) == 3 * spark.sparkContext.defaultParallelism
    assert streamed(spark, stream, tmp_path / "cp") == [(100, 0, 99), (100, 100, 199), (100, 200, 299)]


def test_slices_of_few_rows_are_still_a_batch_each(spark, make_events, tmp_path):
    stream, _ = catalog.in_order(lines(make_events, 3), ["2024-01-01 00:01:00", "2024-01-01 00:02:00"])
    assert streamed(spark, stream, tmp_path / "cp") == [(1, 0, 0), (1, 1, 1), (1, 2, 2)]


def test_a_batch_of_a_stream_with_state_is_laid_out_by_day(spark, make_events, tmp_path):
    events, source = lines(make_events, 400), str(tmp_path / "in")
    events.write.parquet(source)
    store = LogStore(spark, str(tmp_path / "store"))
    stream = spark.readStream.schema(events.schema).parquet(source)
    shipper.ship_events(stream, store, str(tmp_path / "cp"), distinct_for="1 hour").awaitTermination()
    assert store.events().count() == 400
    assert [r.files for r in maintenance.day_files(store).collect()] == [1]

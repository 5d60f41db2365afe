"""Ingest, templates, backfill, retention and the stream, against stored tables."""

from __future__ import annotations

import json
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from loglattice.functions import vectors as V
from loglattice.operators import dedup, noise, templates as tpl, validate
from loglattice.plans import backfill, ingest, maintenance, retention, search
from loglattice.sources.tables import LogStore
from loglattice.streaming import shipper

T0 = datetime(2025, 12, 1, 12, 0, tzinfo=UTC)


def at(minutes):
    return T0 + timedelta(minutes=minutes)


@pytest.fixture
def store(spark, tmp_path):
    return LogStore(spark, str(tmp_path / "store"))


@pytest.fixture
def batch(make_events):
    rows = [{"timestamp": at(i), "message": f"pid={1000 + i} started", "host": f"n{i % 2}"} for i in range(6)]
    rows += [dict(rows[0]), dict(rows[1])]  # copies
    rows += [{"timestamp": at(1), "level": "bad"}, {"timestamp": at(60 * 30), "message": "other"}]
    return make_events(*rows)


def counters(result):
    return result.counters().first().asDict()


def dimension(store):
    return {r.canonical_text: r for r in store.templates().collect()}


def test_ingest_twice_is_once(store, batch):
    assert counters(ingest.ingest(batch, store, "a")) == {"ingested": 7, "duplicates": 2, "failed": 1, "dropped": 0}
    assert counters(ingest.ingest(batch, store, "b", few=True)) == {"ingested": 0, "duplicates": 9, "failed": 1, "dropped": 0}
    found = dimension(store)["pid=<PID> started"]
    assert (found.event_count, found.source_hosts, found.first_seen, found.last_seen) == (
        6, ["n0", "n1"], at(0).replace(tzinfo=None), at(5).replace(tzinfo=None),
    )
    assert store.templates().agg(F.sum("event_count")).first()[0] == store.events().count() == 7


def test_rejects_are_spooled_only_where_there_are_some(store, batch, monkeypatch):
    """Records and rejects are counted before anything is written, so a clean input is not read for its rejects."""
    result = ingest.ingest(batch.filter("level <> 'bad'"), store, "clean")
    assert store.children(store.dead_letter_path) == []
    monkeypatch.setattr(validate, "validate", None)
    assert counters(result) == {"ingested": 7, "duplicates": 2, "failed": 0, "dropped": 0}


def test_empty_batch(store, batch):
    assert counters(ingest.ingest(batch.limit(0), store, "none")) == {"ingested": 0, "duplicates": 0, "failed": 0, "dropped": 0}
    assert store.events().count() == 0


def test_retried_batch_changes_nothing(store, batch):
    ingest.ingest(batch, store, "a")
    before = sorted(map(tuple, store.events().select("id", "log_hash", "template_id").collect()))
    assert counters(ingest.ingest(batch, store, "a"))["ingested"] == 7
    assert sorted(map(tuple, store.events().select("id", "log_hash", "template_id").collect())) == before
    assert dimension(store)["pid=<PID> started"].event_count == 6


def test_lowest_id_wins_and_hot_copies_shrink_before_the_shuffle(make_events):
    rows = [{"id": 100 - i} for i in range(50)] + [{"id": 500, "message": "single"}]
    unique = dedup.first_of_each(dedup.with_identity(make_events(*rows)))
    plan = unique._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.id for r in unique.collect()) == [51, 500]
    assert plan.count("WindowGroupLimit") == 2 and "Exchange" in plan.split("WindowGroupLimit")[1]


def test_records_without_id_get_a_stable_one(make_events):
    a, b = (dedup.with_identity(make_events({"id": None})).first().id for _ in range(2))
    assert a == b and a >= 0


def test_noise_is_dropped_before_storing(store, make_events):
    config = noise.NoiseConfig.default()
    df = make_events({"message": "ts=1 caller=checkpoint.go:7 msg=done"}, {"message": "kept"})
    assert counters(ingest.ingest(df, store, "a", config=config))["dropped"] == 1
    assert store.events().count() == 1


def test_replay_keeps_only_what_still_fails(store, make_events):
    ingest.ingest(make_events({"level": "info"}, {"level": "nope", "message": "x"}), store, "a")
    fixed = store.dead_letters()
    assert fixed.count() == 2
    result = ingest.replay(store, "b")
    assert counters(result)["failed"] == 2 and store.dead_letters().select("ingest_tag").distinct().first()[0] == "b"
    with pytest.raises(ValueError):
        ingest.replay(store, "b")


def test_snapshot_folds_batches(store, batch, make_events):
    ingest.ingest(batch, store, "a")
    ingest.ingest(make_events({"timestamp": at(999), "message": "pid=7 started"}), store, "b")
    before = {k: v.event_count for k, v in dimension(store).items()}
    store.compact_templates()
    assert store.pending_tags() == [] and {k: v.event_count for k, v in dimension(store).items()} == before
    # a batch that was folded already and is retried does not count twice
    ingest.ingest(make_events({"timestamp": at(999), "message": "pid=7 started"}), store, "b")
    assert {k: v.event_count for k, v in dimension(store).items()} == before


def three_batches(store, make_events, days=3):
    rows = [{"id": i, "timestamp": at(60 * 8 * i), "message": f"pid={i} up"} for i in range(3 * days)]
    batches = {f"b{n}": make_events(*rows[n::3]) for n in range(3)}
    for tag, batch in batches.items():
        ingest.ingest(batch, store, tag)
    return batches


def contents(store):
    """Ids, the events counted, and the tags of each day."""
    ids = sorted(r.id for r in store.events().collect())
    return ids, store.templates().agg(F.sum("event_count")).first()[0]


LATER = datetime(2025, 12, 4).date()


def test_days_that_are_over_are_merged(store, make_events):
    batches = three_batches(store, make_events, days=5)
    before, full = contents(store), {r.event_date: r.folders for r in maintenance.day_files(store).collect()}
    merged = sum(n > 1 for d, n in full.items() if d < str(LATER))
    assert merged == 3 and maintenance.merge_days(store, LATER) == merged
    after = {r.event_date: (r.folders, r.files) for r in maintenance.day_files(store).collect()}
    assert contents(store) == before and store.merge_state() is None
    assert all(after[d] == (1, 1) if d < str(LATER) else after[d][0] == n for d, n in full.items())
    # a closed batch that is run again adds nothing, before and after its counts are folded
    for _ in range(2):
        assert counters(ingest.ingest(batches["b1"], store, "b1"))["failed"] == 0 and contents(store) == before
        assert maintenance.maintain(store, LATER) == 0
    # a late batch joins the merged folder; copies of merged rows are found
    late = make_events({"id": 100, "timestamp": at(5), "message": "late"}, {"id": 101, "timestamp": at(0), "message": "pid=0 up"})
    assert counters(ingest.ingest(late, store, "late"))["duplicates"] == 1
    assert maintenance.merge_days(store, LATER) == 1 and contents(store) == (sorted([*before[0], 100]), before[1] + 1)
    assert retention.purge(store, datetime(2025, 12, 13), 10).first().total_logs == 16
    with pytest.raises(ValueError):
        ingest.ingest(late, store, "merged-by-hand")


@pytest.mark.parametrize("point", ["_plan", "write_events", "drop_folder", "drop_second"])
def test_a_merge_that_died_shows_each_row_once_and_is_ended(store, make_events, monkeypatch, point):
    batches = three_batches(store, make_events)
    before, dropped = contents(store), []
    plain = {n: getattr(store, n) for n in ("write_events", "drop_folder")}

    def lost(*args, **kwargs):
        if point == "write_events":  # some of the folders are there already
            first = args[0].filter(F.col("event_date") == F.lit("2025-12-01").cast("date"))
            plain["write_events"](first, *args[1:])
        if point == "drop_second":
            dropped.append(args[0])
            if len(dropped) < 3:
                return plain["drop_folder"](*args)
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        target = {"_plan": (store.spark, "createDataFrame"), "drop_second": (store, "drop_folder")}.get(point, (store, point))
        patch.setattr(*target, lost)
        with pytest.raises(RuntimeError):
            maintenance.merge_days(store, LATER)
    assert contents(store) == before and store.events_on(["2025-12-01", "2025-12-02"]).count() == 5
    # batches arrive while the merge is open
    assert counters(ingest.ingest(batches["b0"], store, "b0"))["failed"] == 0
    ingest.ingest(make_events({"id": 50, "timestamp": at(7), "message": "new"}), store, "new")
    want = (sorted([*before[0], 50]), before[1] + 1)
    assert contents(store) == want
    maintenance.merge_days(store, LATER)
    assert contents(store) == want and store.merge_state() is None
    assert {r.folders for r in maintenance.day_files(store).collect() if r.event_date < str(LATER)} == {1}


def test_only_finished_batches_are_merged(store, make_events, monkeypatch):
    three_batches(store, make_events)
    open_batch = make_events({"id": 70, "timestamp": at(1), "message": "half"})
    with monkeypatch.context() as patch:
        patch.setattr(store, "write_counts", lambda *a: (_ for _ in ()).throw(RuntimeError("full")))
        shipper.ship_batch(open_batch, None, store, "half", retry_after=0)
    maintenance.merge_days(store, LATER)
    assert store.events_of("half").count() == 1
    assert shipper.recover(store) == ["half"]
    ids, counted = contents(store)
    assert counted == len(ids) == 10
    assert maintenance.merge_days(store, LATER) == 1 and contents(store) == (ids, counted)


def test_a_batch_lists_its_own_days_only(store, make_events, monkeypatch):
    three_batches(store, make_events, days=6)
    files = store.events_on(["2025-12-02", "2031-01-01"]).inputFiles()
    assert files and all("event_date=2025-12-02" in f for f in files)
    assert all("ingest_tag=b1" in f for f in store.events_on(["2025-12-02"], "b1").inputFiles())
    # ingest never opens the whole table
    monkeypatch.setattr(store, "events", lambda: (_ for _ in ()).throw(AssertionError("listed all days")))
    assert counters(ingest.ingest(make_events({"timestamp": at(3)}), store, "next"))["ingested"] == 1


def test_stale_vectors_go(store, make_events, monkeypatch):
    ingest.ingest(make_events({"message": "old text"}, {"message": "new text", "timestamp": at(60 * 24 * 30)}), store, "a")
    backfill.backfill_vectors(store, V.hashed_bag_of_words(4), "m")
    retention.purge(store, datetime(2026, 1, 2), 10)
    with monkeypatch.context() as patch:
        plain = store.drop_folder
        patch.setattr(store, "drop_folder", lambda p: plain(p) and (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            store.drop_stale_vectors()
    assert store.vectors("m").count() == 1  # the table is gone, what stays is beside it
    assert store.drop_stale_vectors() == 0 and store.vectors("m").count() == 1
    assert store.templates("m").first().embedding_dim == 4


def test_stream_folds_counts(spark, store, make_events, tmp_path):
    rows = [{"id": i, "timestamp": at(i), "message": f"pid={i} up"} for i in range(6)]
    for i in range(0, 6, 2):
        make_events(*rows[i : i + 2]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(make_events({}).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    shipper.ship_events(stream, store, str(tmp_path / "cp"), fold_every=2).awaitTermination()
    assert len(store.pending_tags()) == 1 and len(store.children(store.counts_path)) == 1
    assert contents(store) == (list(range(6)), 6)


def test_new_and_resolved_templates(make_events):
    first = tpl.with_template(make_events({"message": "pid=1 up"}))
    later = tpl.with_template(make_events({"message": "pid=2 up"}, {"message": "pid=3 down"}))
    known = tpl.roll_up(tpl.host_counts(first))
    fresh = tpl.new_templates(tpl.roll_up(tpl.host_counts(later)), known)
    assert [r.canonical_text for r in fresh.collect()] == ["pid=<PID> down"]
    resolved = {r.message: r.template_id for r in tpl.resolve(later, known).collect()}
    assert resolved["pid=2 up"] is not None and resolved["pid=3 down"] is None


def test_dense_ids_are_consecutive(make_events):
    df = tpl.with_dense_ids(tpl.build_templates(make_events(*[{"message": f"m{c}"} for c in "abcdefghij"])), start=5)
    rows = df.orderBy("template_hash").collect()
    assert [r.dense_id for r in rows] == list(range(6, 16))


def test_backfill_links_orphans_and_counts(store, make_events):
    rows = [{"id": i, "timestamp": at(i * 700), "message": f"pid={i} up"} for i in range(6)] + [{"id": 9, "message": "lone"}]
    events = dedup.with_identity(make_events(*rows))
    store.write_events(events, "legacy")
    capped = backfill.safety_net(store, cap=2).first()
    assert (capped.processed, capped.still_unlinked) == (2, 5)
    run = backfill.backfill_templates(store).first()
    assert (run.processed, run.new_templates, run.still_unlinked) == (5, 1, 0)
    assert store.templates().agg(F.sum("event_count")).first()[0] == 7
    again = backfill.backfill_templates(store).first()
    assert (again.processed, again.new_templates, again.linked, again.failed) == (0, 0, 0, 0)


def test_backfill_that_died_is_ended_once(store, make_events, monkeypatch):
    rows = [{"id": i, "timestamp": at(i * 700), "message": f"pid={i} up"} for i in range(6)]
    store.write_events(dedup.with_identity(make_events(*rows)), "legacy")
    for broken in ("write_events", "write_counts"):  # before the rewrite, and after it
        with monkeypatch.context() as patch:
            patch.setattr(store, broken, lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost")))
            with pytest.raises(RuntimeError):
                backfill.backfill_templates(store)
        assert store.open_backfill() is not None
    assert backfill.backfill_templates(store).first().still_unlinked == 0
    assert store.open_backfill() is None and store.templates().agg(F.sum("event_count")).first()[0] == 6


def test_a_batch_that_lands_during_a_fold_stays_pending(store, make_events, monkeypatch):
    ingest.ingest(make_events({"message": "one"}), store, "a")
    plain = LogStore.counts

    def slow(self, pending=None):
        found = plain(self, pending)
        if not self.children(f"{self.counts_path}/ingest_tag=late"):
            store.write_counts(found, "late")
        return found

    monkeypatch.setattr(LogStore, "counts", slow)
    store.compact_templates()
    monkeypatch.undo()
    assert store.pending_tags() == ["late"] and store.templates().first().event_count == 2


def test_vector_backfill_fills_holes(store, make_events):
    ingest.ingest(make_events({"message": "alpha beta"}, {"message": "gamma"}, {"message": "!!!"}), store, "a")
    flaky = V.model_embedder(lambda texts: [None if t == "gamma" else [1.0, 0.0] for t in texts])
    backfill.backfill_vectors(store, flaky, "m1")
    assert store.templates("m1").filter("embedding_vector IS NULL").first().canonical_text == "gamma"
    backfill.backfill_vectors(store, V.hashed_bag_of_words(2), "m1")
    assert store.templates("m1").filter("embedding_vector IS NULL").count() == 0
    assert store.vectors().count() == 3


def test_vectors_of_models_stay_apart(spark, store, make_events):
    rows = [{"id": 1, "message": "disk full"}, {"id": 2, "message": "user in", "level": "ERROR"}, {"id": 3, "message": "disk full", "host": "n2"}]
    ingest.ingest(make_events(*rows), store, "a")
    for model, size in (("z-old", 16), ("a-new", 4), ("a-new", 4)):
        backfill.backfill_vectors(store, V.hashed_bag_of_words(size), model)
    assert store.vectors().count() == 4 and store.vectors("a-new").count() == 2
    assert {r.embedding_dim for r in store.templates("a-new").collect()} == {4}
    assert store.templates().filter("embedding_vector IS NOT NULL").count() == 0
    store.append_vectors(store.vectors("a-new"))  # two runs at the same time
    assert store.templates("a-new").count() == 2
    unit = search.query_vector(spark, "disk full", V.hashed_bag_of_words(16))
    hits = search.search_stored_logs(store, unit, "z-old", limit=2).collect()
    assert [h.id for h in hits] == [1, 3] and hits[0].similarity_score > 0.99
    assert [h.id for h in search.search_stored_logs(store, unit, "z-old", level="ERROR").collect()] == [2]
    assert search.search_stored_logs(store, unit, "nobody").count() == 0


def test_retention_keeps_plus_deletes_all(store, make_events):
    rows = [{"timestamp": at(i * 360), "message": f"m{chr(97 + i)}"} for i in range(20)]
    ingest.ingest(make_events(*rows[::2]), store, "a")
    ingest.ingest(make_events(*rows[1::2]), store, "b")
    as_of = datetime(2025, 12, 13, 15, 0)
    cutoff = retention.cutoff_for(as_of, 10)
    dry = retention.purge(store, as_of, 10, dry_run=True).first()
    assert store.events().count() == 20 and dry.total_logs == 20
    report = retention.purge(store, as_of, 10).first()
    left = store.events()
    assert left.count() == 20 - report.to_delete
    assert left.agg(F.min("timestamp")).first()[0] >= cutoff
    assert store.templates().count() == left.count()
    assert retention.purge(store, as_of, 10).first().to_delete == 0


def test_schema_evolution(make_events):
    from pyspark.sql import types as T

    df = make_events({})
    wide = retention.add_columns(df, {"template_id": T.StringType(), "host": T.StringType()})
    assert wide.columns == [*df.columns, "template_id"]
    assert retention.drop_columns(wide, ["template_id"]).columns == df.columns


def write_lines(folder, name, records):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in records) + "\n")


def journal_record(i, message):
    return {"__REALTIME_TIMESTAMP": str(1764359740000000 + i * 1_000_000), "_SYSTEMD_UNIT": "s", "MESSAGE": message}


def test_stream_equals_batch_and_resumes(spark, store, tmp_path):
    source, checkpoint = tmp_path / "in", str(tmp_path / "cp")
    write_lines(source, "1.json", [journal_record(i, f"pid={i} up") for i in range(5)] + ["broken"])

    def ship():
        shipper.ship_journal(spark, str(source), "n1", store, checkpoint, max_files=1).awaitTermination()

    ship()
    assert store.events().count() == 5
    write_lines(source, "2.json", [journal_record(i, f"pid={i} up") for i in range(3, 8)])
    ship()
    ship()  # nothing new
    assert store.events().count() == 8
    assert dimension(store)["pid=<PID> up"].event_count == 8
    assert store.dead_letters().filter("logs[0].raw = 'broken'").count() == 1


def test_failed_batch_is_spooled_and_can_be_replayed(make_events, store, monkeypatch):
    calls = []

    def broken(*args, **kwargs):
        calls.append(1)
        raise RuntimeError("storage away")

    monkeypatch.setattr(shipper, "ingest", broken)
    shipper.ship_batch(make_events({}, {"message": "two"}), None, store, "t", retry_after=0)
    assert len(calls) == 2 and store.events().count() == 0 and shipper.recover(store) == []
    assert store.failed_tags() == ["t"] and "storage away" in store.failed_batch("t").first().logs[0].errors[0]
    monkeypatch.undo()
    assert shipper.recover(store) == ["t"] and shipper.recover(store) == []
    assert store.events_of("t").count() == 2 and store.templates().agg(F.sum("event_count")).first()[0] == 2


def test_batch_that_failed_half_way_is_counted(make_events, store, monkeypatch):
    """Events were written, counts were not: the replay under the same tag brings them together."""
    with monkeypatch.context() as patch:
        patch.setattr(store, "write_counts", lambda *a: (_ for _ in ()).throw(RuntimeError("full")))
        shipper.ship_batch(make_events({}, {"message": "two"}), None, store, "t", retry_after=0)
    assert store.events().count() == 2 and store.templates().count() == 0
    assert shipper.recover(store) == ["t"]
    assert store.events().count() == 2 and store.templates().agg(F.sum("event_count")).first()[0] == 2


def test_cooldown_is_linear_and_equals_the_definition(spark):
    import random
    import time

    from loglattice.operators import detect

    draw = random.Random(1)
    minutes = {k: sorted({draw.randrange(4000) for _ in range(300)}) for k in "ab"} | {"c": list(range(0, 525_600))}
    start = time.perf_counter()
    assert len(detect.fires(__import__("numpy").array(minutes["c"]), 30)) == 17_520
    assert time.perf_counter() - start < 2
    rows = [(k, T0 + timedelta(minutes=m)) for k in "ab" for m in minutes[k] for _ in range(2)]
    alerts = spark.createDataFrame(rows, "service string, timestamp timestamp")
    got = {(r.service, r.minute) for r in detect.cooldown(alerts, key="service", minutes=30).collect()}
    zero, want = int(T0.timestamp()) // 60, set()
    for k in "ab":
        last = None
        for m in minutes[k]:
            if last is None or m - last >= 30:
                want.add((k, zero + m))
                last = m
    assert got == want and len(want) > 150


def test_cooldown_stream_equals_batch(spark, tmp_path):
    from loglattice.operators import detect

    rows = [("a", at(m)) for m in (0, 3, 29, 30, 31, 95, 96, 300)] + [("b", at(m)) for m in (10, 45, 61)]
    alerts = spark.createDataFrame(rows, "service string, timestamp timestamp")
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for low, high in ((0, 30), (30, 96), (96, 400)):
        part = alerts.filter((F.col("timestamp") >= F.lit(at(low))) & (F.col("timestamp") < F.lit(at(high))))
        part.coalesce(1).write.mode("append").parquet(source)
    for _ in range(2):  # the second start finds nothing new
        stream = spark.readStream.schema(alerts.schema).option("maxFilesPerTrigger", 1).parquet(source)
        fired = detect.cooldown_stream(stream, key="service", minutes=30)
        fired.writeStream.option("checkpointLocation", str(tmp_path / "cp")).format("parquet").trigger(availableNow=True).start(out).awaitTermination()
    got = sorted((r.service, r.minute) for r in spark.read.parquet(out).collect())
    assert got == sorted((r.service, r.minute) for r in detect.cooldown(alerts, key="service", minutes=30).collect())


def test_stored_columns_roll_back(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, "x")], "id int, day string").write.partitionBy("day").parquet(path)
    spark.createDataFrame([(2, "e", "y"), (3, None, "z")], "id int, code string, day string").write.mode("append").partitionBy("day").parquet(path)
    both = {r.id: r.code for r in retention.read_generations(spark, path).collect()}
    assert both == {1: None, 2: "e", 3: None}
    assert retention.drop_stored_columns(spark, path, ["code"], "day") == 2
    after = retention.read_generations(spark, path)
    assert after.columns == ["id", "day"] and sorted(r.id for r in after.collect()) == [1, 2, 3]
    assert retention.drop_stored_columns(spark, path, ["code"], "day") == 0


def test_validate_then_outcome(batch):
    checked = validate.validate(batch)
    unique = dedup.first_of_each(dedup.with_identity(validate.valid(checked)))
    assert tuple(dedup.outcome(checked, unique, validate.rejected(checked)).first()) == (7, 2, 1)

"""Vectors, search, and the shape of the plans behind queries."""

from __future__ import annotations

import os

import numpy as np
import pytest
from conftest import SMALL, plan_of
from pyspark.sql import functions as F

from loglattice.functions import canonical as C
from loglattice.functions import vectors as V
from loglattice.operators import templates as tpl
from loglattice.plans import query, search
from loglattice.schemas import EVENT_COLUMNS

rng = np.random.default_rng(7)
POINTS = rng.normal(size=(300, 16)).astype(np.float32)


@pytest.fixture(scope="module")
def points(spark):
    rows = [(i, p.tolist()) for i, p in enumerate(POINTS)]
    return spark.createDataFrame([*rows, (900, None), (901, [0.0] * 16)], "id bigint, embedding_vector array<float>")


def exact(q):
    m = POINTS.astype(np.float64)
    return 1 - m @ q / (np.linalg.norm(m, axis=1) * np.linalg.norm(q))


def test_cosine_matches_numpy(points):
    unit = search.stored_vector(points, F.col("id") == 3)
    got = search.nearest(points, unit, 10).collect()
    want = exact(POINTS[3].astype(np.float64))
    assert [r.id for r in got] == list(np.argsort(want)[:10])
    assert np.allclose([r.distance for r in got], np.sort(want)[:10])


def test_pairwise_distance_and_range(points):
    flipped = points.filter("id < 300").select("id", V.cosine_distance(F.col("embedding_vector"), F.transform("embedding_vector", lambda x: -x)).alias("d"))
    row = flipped.agg(F.min("d").alias("lo"), F.max("d").alias("hi")).first()
    assert abs(row.lo - 2) < 1e-9 and abs(row.hi - 2) < 1e-9
    odd = points.filter("id IN (901, 900)").select(V.cosine_distance(F.col("embedding_vector"), F.col("embedding_vector")).alias("d"))
    assert [r.d for r in odd.collect()] == [None, None]


def test_index_recall(points, tmp_path):
    index = search.VectorIndex.build(points, str(tmp_path / "index"), dims=16)
    hits = total = 0
    for i in range(0, 100, 10):
        found = [r.id for r in index.nearest(POINTS[i].tolist(), 10).collect()]
        want = np.argsort(exact(POINTS[i].astype(np.float64)))[:10].tolist()
        hits, total = hits + len(set(found) & set(want)), total + 10
        assert len(found) == len(set(found)) == 10 and found[0] == i
    assert hits >= 0.9 * total


def test_index_reads_its_buckets_only(points, spark, tmp_path):
    path = str(tmp_path / "index")
    search.VectorIndex.build(points, path, dims=16, tables=4, bits=6)
    index = search.VectorIndex(spark, path)  # opened again
    assert (index.tables, index.bits, index.dims) == (4, 6, 16)
    few = index.candidates(POINTS[0].tolist(), 1)
    assert 0 < few.count() < 100 and "PushedFilters: [Or(" in plan_of(few).replace("\n", "")
    everything = index.candidates(POINTS[0].tolist(), 6)
    assert everything.count() == 300  # no null, no zero vector
    # too few in the buckets at first: the lookup widens until k rows are met
    assert index.nearest(POINTS[0].tolist(), 300, probes=0).count() == 300
    for bad in ([0.0] * 16, [1.0] * 3):
        with pytest.raises(ValueError):
            index.nearest(bad, 3)


def test_buckets_do_not_depend_on_neighbours(points):
    number = V.bucket_numbers(4, 6, 16)(F.col("embedding_vector"))
    one, many = (dict(map(tuple, points.repartition(n).select("id", F.array_join(number, ",")).collect())) for n in (1, 7))
    assert one == many and one[900] is None


def test_codec_round_trip(points):
    back = points.filter("id < 300").select("id", V.from_text(V.to_text(F.col("embedding_vector"))).alias("v"))
    assert all(np.array_equal(np.float32(r.v), POINTS[r.id]) for r in back.collect())


def test_offline_embedder(spark):
    df = spark.createDataFrame([(0, "a b b"), (1, None), (2, "!!"), (3, "B a B")], "i int, t string")
    rows = {r.i: r.v for r in df.select("i", V.hashed_bag_of_words(32)("t").alias("v")).collect()}
    assert rows[1] is None and set(rows[2]) == {0.0} and rows[0] == rows[3]
    assert abs(np.linalg.norm(rows[0]) - 1) < 1e-6 and len(rows[0]) == 32


def test_model_embedder_isolates_failures(spark):
    def fragile(texts):
        if "bad" in texts:
            raise RuntimeError("cannot embed")
        return [[float(len(t))] for t in texts]

    df = spark.createDataFrame([(i, t) for i, t in enumerate(["a", "bad", None, "ccc"])], "i int, t string").coalesce(1)
    got = [r.v for r in df.select("i", V.model_embedder(fragile, 3)("t").alias("v")).orderBy("i").collect()]
    assert got == [[1.0], None, None, [3.0]]


def test_embedder_by_name():
    with pytest.raises(ValueError):
        V.embedder("unknown")


def search_setup(make_events):
    rows = [{"id": i, "message": f"disk {i}12345 failed"} for i in range(8)] + [{"id": 50, "message": "user logged in", "level": "WARN"}]
    events = tpl.with_template(make_events(*rows)).withColumn("template_id", F.col("template_hash"))
    embed = V.hashed_bag_of_words(64)
    dimension = tpl.roll_up(tpl.host_counts(events)).withColumn("embedding_vector", embed(F.col("canonical_text")))
    return events, dimension, embed


def test_template_search_with_examples(make_events, spark):
    events, dimension, embed = search_setup(make_events)
    unit = search.query_vector(spark, "disk 987654 failed", embed)
    top = search.search_templates(dimension, events, unit, limit=2, examples=3).orderBy(F.desc("similarity_score")).collect()
    assert top[0].canonical_text == "disk <N> failed" and top[0].event_count == 8
    assert abs(top[0].similarity_score - 1) < 1e-6
    assert [e.id for e in top[0].example_events] == [7, 6, 5]
    assert list(top[0].example_events[0].asDict()) == list(EVENT_COLUMNS)
    none = search.search_templates(dimension, events.limit(0), unit, level="WARN", examples=3).collect()
    assert [(r.canonical_text, r.example_events) for r in none] == [("user logged in", [])]
    with pytest.raises(ValueError):
        search.search_templates(dimension, events, unit, limit=101)


def test_log_search_filters_before_ranking(make_events, spark):
    events, _, embed = search_setup(make_events)
    with_vectors = events.withColumn("embedding_vector", embed(F.col("message")))
    unit = search.query_vector(spark, "user logged in", embed)
    assert search.search_logs(with_vectors, unit, limit=1).first().id == 50
    hits = search.search_logs(with_vectors, unit, level="INFO", limit=20).collect()
    assert hits and all(h.level == "INFO" and -1 <= h.similarity_score <= 1 for h in hits)


def test_query_order_paging_and_bounds(make_events):
    events = make_events(*[{"id": i} for i in range(10)])
    assert [r.id for r in query.query_logs(events, limit=3, offset=2).collect()] == [7, 6, 5]
    assert [r.id for r in query.older_than(events, "2025-12-01 12:00:00", 7, limit=2).collect()] == [6, 5]
    assert query.query_logs(events, service="", level=None).count() == 10
    assert query.query_logs(events, start="2025-12-01 12:00:00", end="2025-12-01 12:00:00").count() == 10
    assert query.query_logs(events, service="TEST.service").count() == 0
    assert query.query_logs(events, service="TEST.service", ignore_case=True).count() == 10
    for bad in ({"limit": 0}, {"limit": 10_001}, {"offset": -1}, {"level": "info"}):
        with pytest.raises(ValueError):
            query.query_logs(events, **bad)


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    if not os.path.isdir(SMALL):
        pytest.skip("needs the test tables")
    from loglattice.plans.ingest import ingest
    from loglattice.sources.adapters import logs
    from loglattice.sources.tables import LogStore

    store = LogStore(spark, str(tmp_path_factory.mktemp("store")))
    ingest(logs(spark, SMALL), store, "load")
    return store


def test_filters_reach_the_scan(stored):
    plan = plan_of(query.query_logs(stored.events(), service="svc-1.service", level="ERROR", start="2024-01-10 00:00:00"))
    assert "EqualTo(service,svc-1.service)" in plan and "EqualTo(level,ERROR)" in plan
    assert "GreaterThanOrEqual(timestamp" in plan
    assert "event_date" in plan.split("PartitionFilters:")[1].split("]")[0]
    assert "TakeOrderedAndProject" in plan
    assert "embedding_vector" not in plan.split("ReadSchema:")[1]


def test_examples_are_limited_before_the_shuffle(stored):
    keys = stored.events().filter("level = 'ERROR'").select("template_id").distinct()
    plan = tpl.recent_examples(stored.events(), keys, 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_counts_use_hash_aggregates_with_a_map_side(stored):
    counts = tpl.host_counts(stored.events().withColumn("template_hash", F.col("template_id")))
    plan = plan_of(counts)
    assert "partial_count" in plan and "SortAggregate" not in plan and "ObjectHashAggregate" not in plan


def test_rules_stay_in_the_jvm(stored):
    plan = plan_of(stored.events().select(C.canonicalize(F.col("message"))))
    assert "Python" not in plan and "Arrow" not in plan


def test_dedup_prunes_days(stored, make_events):
    from loglattice.operators import dedup

    new = dedup.with_identity(make_events({}))
    assert "dynamicpruning" in plan_of(dedup.not_stored(new, stored.events()))
    few = plan_of(dedup.not_stored(new, stored.events(), few_keys=new))
    assert "dynamicpruning" in few and few.count("LeftSemi") >= 2 and "SortMergeJoin" not in few


def test_join_on_the_template_key_runs_the_rules_once(spark):
    if not os.path.isdir(SMALL):
        pytest.skip("needs the test tables")
    from loglattice.sources.adapters import logs

    t = tpl.with_template(logs(spark, SMALL))
    joined = tpl.resolve(t, tpl.roll_up(tpl.host_counts(t))).select("id", "template_id")
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    # one chain per side; a pushed null filter would double them
    assert plan.count("veth<HEX>") == 2

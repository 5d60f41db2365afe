"""Reports, detectors and graph traversal against brute force."""

from __future__ import annotations

import os
import random
from collections import Counter
from datetime import UTC, datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loglattice import session
from loglattice.operators import detect, graph, noise
from loglattice.operators import templates as tpl
from loglattice.plans import reports

T0 = datetime(2025, 12, 1, tzinfo=UTC)


def minutes(*values, **common):
    return [{"timestamp": T0 + timedelta(minutes=m), **common} for m in values]


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-5000, 5000), min_size=1, max_size=40), st.integers(1, 600), st.integers(1, 50))
def test_gaps_equal_brute_force(spark, seconds, threshold, chunk):
    df = spark.createDataFrame([(T0 + timedelta(seconds=s),) for s in seconds], "timestamp timestamp")
    got = {r.gap_us for r in reports.data_gaps(df, timedelta(seconds=threshold), chunk=chunk).collect()}
    ordered = sorted(seconds)
    assert got == {(b - a) * 10**6 for a, b in zip(ordered, ordered[1:]) if b - a > threshold}


def test_gap_bounds_and_key(make_events):
    df = make_events(*minutes(0, 10, host="a"), *minutes(5, 70, host="b"))
    assert reports.data_gaps(df, timedelta(minutes=30)).count() == 1
    row = reports.data_gaps(df, timedelta(minutes=30), by="host").first()
    assert (row.host, row.gap_us) == ("b", 65 * 60 * 10**6)


def test_shares_and_distribution(make_events):
    names = ["a"] * 50 + ["b"] * 20 + ["c"] * 10 + ["d"] * 8 + ["e"] * 7 + ["f"] * 5
    df = make_events(*[{"service": s} for s in names])
    share = {r.service: (r.n, r.pct) for r in reports.service_share(df).collect()}
    assert share == {"a": (50, 50.0), "b": (20, 20.0), "c": (10, 10.0), "d": (8, 8.0), "Other": (12, 12.0)}
    assert [r.service for r in reports.noisiest_services(df, 2).collect()] == ["a", "b"]
    assert reports.level_distribution(df).first().asDict() == {"level": "INFO", "n": 100, "pct": 100.0}


def test_growth_and_lengths(make_events):
    df = make_events(*minutes(0, 1, 2 * 1440), {"message": "xy", "timestamp": T0, "meta_json": '{"a":1}'})
    grown = {r.horizon_days: (r.rows, r.megabytes) for r in reports.growth_projection(df, 500, (1, 10), nodes=3).collect()}
    assert grown == {1: (6, 0.003), 10: (60, 0.03)}
    assert reports.message_lengths(df).first().max_message == 16


def test_signal_classes(make_events):
    config = noise.NoiseConfig.default()
    df = make_events(
        {"message": "caller=checkpoint.go"}, {"message": "session opened for user x"}, {"message": "hm"}, {"level": "ERROR", "message": "x"}
    )
    row = reports.signal_to_noise(df, config).first()
    assert tuple(row) == (1, 2, 1, 50.0, 66.67)
    rules = {r.rule: r.n for r in reports.noise_breakdown(df, config).collect()}
    assert rules == {"loki_checkpoint": 1, "(kept)": 3}
    assert {r.category for r in reports.signal_breakdown(df).collect()} == {"session"}
    assert reports.what_if(df, config, samples=2).filter("outcome = '(kept)'").count() == 2


def test_embedding_coverage(spark):
    df = spark.createDataFrame([([1.0],), (None,)], "embedding_vector array<float>")
    assert tuple(reports.embedding_coverage(df).first()) == (2, 1, 1, 50.0)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 400), min_size=1, max_size=60), st.integers(1, 90))
def test_cooldown_equals_a_sequential_walk(make_events, at, pause):
    got = [r.minute for r in detect.cooldown(make_events(*minutes(*at)), key="service", minutes=pause).orderBy("minute").collect()]
    base, want = int(T0.timestamp() // 60), []
    for m in sorted(set(at)):
        if not want or m - want[-1] >= pause:
            want.append(m)
    assert got == [base + m for m in want]


def test_correlations_equal_pairs(make_events):
    random.seed(3)
    rows = [{"timestamp": T0 + timedelta(minutes=random.randrange(300)), "host": random.choice("xy"), "message": random.choice("AB")} for _ in range(60)]
    df = make_events(*rows)
    found = {(r.host, r.minute) for r in detect.correlations(df, F.col("message") == "A", F.col("message") == "B", minutes=4).collect()}
    minute = lambda r: int(r["timestamp"].timestamp() // 60)
    want = {
        (a["host"], minute(a))
        for a in rows for b in rows
        if a["message"] == "A" and b["message"] == "B" and a["host"] == b["host"] and 0 <= minute(b) - minute(a) <= 4
    }
    assert found == want


def test_spikes_and_anomalies(make_events):
    quiet = [r for h in range(10) for r in minutes(*[h * 60 + i for i in range(2)], level="ERROR")]
    loud = minutes(*[600 + i for i in range(30)], level="ERROR")
    spikes = detect.error_spikes(make_events(*quiet, *loud)).collect()
    assert [(r.errors, r.ewma, r.sigma) for r in spikes] == [(30, 2.0, 0.0)]
    days = [r for d in range(5) for r in minutes(d * 1440, d * 1440 + 1)] + minutes(*[5 * 1440 + i for i in range(9)])
    odd = detect.template_anomalies(tpl.with_template(make_events(*days))).collect()
    assert [(r.n, r.mean, r.sigma) for r in odd] == [(9, 2.0, 0.0)]


def test_silence(make_events):
    df = make_events(*minutes(0, 60, 180, service="a"), *minutes(130, service="b"))
    silent = {(r.service, r.hour.hour) for r in detect.silences(df, "2025-12-01 04:10:00").collect()}
    assert silent == {("a", 2), ("a", 4), ("b", 3), ("b", 4)}


def test_new_and_catastrophic_templates(make_events):
    dimension = tpl.build_templates(
        make_events(*minutes(0, level="ERROR", message="Out of memory"), *minutes(50, level="ERROR", message="new"), *minutes(60, message="calm"))
    )
    assert [r.canonical_text for r in detect.new_error_templates(dimension, "2025-12-01 00:30:00").collect()] == ["new"]
    assert [r.kind for r in detect.catastrophes(dimension).collect()] == ["out_of_memory"]


def test_context_bundle_equals_brute_force(make_events, spark):
    random.seed(5)
    rows = [{"timestamp": T0 + timedelta(minutes=random.randrange(600)), "service": random.choice("pq"), "message": random.choice("uvw")} for _ in range(200)]
    base = int(T0.timestamp() // 60)
    incidents = [("i1", "p", base + 100), ("i2", "p", base + 100), ("i3", "q", base + 333)]
    bundles = detect.context_bundle(
        spark.createDataFrame(incidents, "incident_id string, service string, minute bigint"), tpl.with_template(make_events(*rows)), minutes=45, top=2
    ).collect()
    assert len(bundles) == 3
    for name, service, minute in incidents:
        near = Counter(
            r["message"] for r in rows if r["service"] == service and abs(int(r["timestamp"].timestamp() // 60) - minute) <= 45
        )
        got = next(b for b in bundles if b.incident_id == name)
        assert sorted((t.n for t in got.templates), reverse=True) == sorted(near.values(), reverse=True)[:2]
        assert got.events == sum(near.values())


def test_overview_and_context(make_events):
    df = make_events(*minutes(*range(20)), *minutes(5, level="ERROR", host="h2"))
    row = detect.service_overview(tpl.with_template(df), "2025-12-01 00:10:00", 24).first()
    assert (row.events, row.errors, row.hosts, row.templates) == (12, 1, 2, 2)
    around = detect.log_context(df, "2025-12-01 00:10:00", 10, around=2).orderBy("timestamp").collect()
    assert [r.id for r in around] == [8, 9, 10, 11, 12]


def test_graph(spark):
    edges = spark.createDataFrame([("api", "db"), ("web", "api"), ("job", "db"), ("db", "disk"), ("disk", "db")], "src string, dst string")
    nodes = lambda *n: spark.createDataFrame([(x,) for x in n], "node string")
    up = {(r.node, r.depth) for r in graph.upstream(edges, nodes("web")).collect()}
    assert up == {("api", 1), ("db", 2), ("disk", 3)}
    assert {r.node for r in graph.downstream(edges, nodes("db")).collect()} == {"api", "web", "job", "disk"}
    assert tuple(graph.blast_radius(edges, nodes("db")).first()) == ("db", 4, 2)
    shared = graph.common_ancestors(edges, nodes("web", "job")).orderBy("distance").collect()
    assert [(r.node, r.distance) for r in shared] == [("db", 3), ("disk", 5)]
    chain = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(14)], "src string, dst string")
    assert graph.upstream(chain, nodes("n0")).count() == 14
    assert graph.upstream(chain, nodes("n0"), 3).count() == 3
    with pytest.raises(ValueError):
        graph.upstream(edges, nodes("web"), 0)


def test_blast_radius_of_many_roots(spark):
    """More roots than a row has bits, cycles, a hub, edges without an end, against a plain walk."""
    rng = random.Random(5)
    pairs = {(f"n{rng.randrange(150)}", f"n{rng.randrange(150)}") for _ in range(190)} | {(f"n{i}", "hub") for i in range(0, 150, 3)}
    pairs |= {(f"c{i}", f"c{i + 1}") for i in range(15)}  # deeper than the levels that become one table
    edges = spark.createDataFrame([*pairs, ("n1", None), (None, "n2")], "src string, dst string")
    callers = {}
    for src, dst in pairs:
        callers.setdefault(dst, set()).add(src)
    names = sorted({n for p in pairs for n in p}) + ["alone"]
    expected = {}
    for root in names:
        depth, level = {root: 0}, [root]
        while level:
            level = sorted({c for n in level for c in callers.get(n, ())} - set(depth))
            depth |= {c: max(depth.values()) + 1 for c in level}
        if len(depth) > 1:
            expected[root] = (len(depth) - 1, max(depth.values()))
    nodes = spark.createDataFrame([(n,) for n in [*names, "n1", None]], "node string").repartition(3)
    got = graph.blast_radius(edges, nodes).collect()
    assert len(got) == len(expected) and {r.root: (r.affected, r.farthest) for r in got} == expected
    assert {r.root: (r.affected, r.farthest) for r in graph.blast_radius(edges, nodes, 2).collect()} != expected
    assert graph.blast_radius(edges.limit(0), nodes).count() == 0


def test_sweep_deletes_by_age(spark):
    kept = session.materialise(spark.range(3), "kept")
    old = session.shared_dir(spark, "old")
    spark.range(3).write.parquet(old)
    names = os.listdir(old)
    for name in names:
        os.utime(os.path.join(old, name), (1, 1))
    assert session.sweep(spark, 24) >= 1
    assert not os.path.exists(old) and kept.count() == 3
    assert session.sweep(spark, 24) == 0

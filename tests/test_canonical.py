from __future__ import annotations

import hashlib
import os
import re

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from loglattice.functions import canonical as C

HAS = [
    ("fw drop MAC=aa:00:bb:11:cc:22:dd:33 SRC=10.1.2.3 DST=172.16.0.9 LEN=1500 ID=77 TTL=3 PROTO=UDP SPT=53 DPT=5353",
     ["MAC=<MAC>", "SRC=<IPV4>", "DST=<IPV4>", "SPT=<PORT>", "DPT=<PORT>", "LEN=<N>", "TTL=<N>", "ID=<N>", "PROTO=UDP"]),
    ("ts=1999-05-06 caller=ring.go:7 opened", ["ts=<TS>", "caller=ring.go:<LINE>"]),
    ("lookup duration=0.5h in cache", ["duration=<DUR> in cache"]),
    ("[BATCH] Sending 8 frames", ["[BATCH] Sending <N> frames"]),
    ("quota raised for user mallory", ["quota raised for user <USER>"]),
    ("CRON[77]: (www) CMD (/opt/jobs/rotate --all)", ["CRON[<PID>]: (<USER>) CMD (<CMD>)"]),
    ("[GIN] 1999/05/06 - 07:08:09 | 404 | 17ms | 10.1.2.3", ["[GIN] <TS> | 404 | <DUR> | <ADDR>"]),
    ("took 12.5µs, budget 3ms", ["took <DUR>, budget <DUR>"]),
    ("unit session-31.scope gone, session 31 closed", ["session-<SID>.scope", "session <SID> closed"]),
    ("Session 8 began", ["Session <SID> began"]),
    ("bridge lost vethbeef01", ["veth<HEX>"]),
    ("[   42] woke, [43] slept", ["[<PID>] woke, [<PID>] slept"]),
    ("renewed at 1999-05-06T07:08:09.5+02:00 by agent", ["renewed at <TS> by agent"]),
    ("job 0f0e0d0c-1111-2222-3333-444455556666 queued", ["job <UUID> queued"]),
    ("etag deadbeefcafe0123456 changed", ["etag <HEX> changed"]),
    ("route 10.1.2.3 moved to 10.4.5.6", ["route <IPV4> moved to <IPV4>"]),
    ("neighbour fd00:12:34:0:0:9:8:7 is stale", ["neighbour <IPV6> is stale"]),
    ("port 0a:1b:2c:3d:4e:5f is up", ["port <MAC> is up"]),
    ("worker pid=9 exited", ["worker pid=<PID> exited"]),
    ("idle 90 seconds of 2 hours", ["idle <DUR> of <DUR>"]),
    ("read 90210 of 100000 rows, 12 bad", ["read <N> of <N> rows, 12 bad"]),
    ("wide    gaps   close", ["wide gaps close"]),
]

EXACT = [
    ("1999-05-06 07:08:09,041 - hub.tasks - INFO - 2 files moved", "<TS> - hub.tasks - INFO - 2 files moved"),
    ("1999-05-06T07:08:09.123Z   started", "<TS> started"),
    ("Session 12 ended, session 13 follows", "Session <SID> ended, session <SID> follows"),
    ("é12345 stays, 12345 goes", "é12345 stays, <N> goes"),
    ("٠١٢٣٤٥", "<N>"),
    ("\t\n line \x1c ", "line"),
    ("(root) CMD (a\rb)", "(<USER>) CMD (<CMD>)"),
    ("", ""),
]

ONE_TEMPLATE = [
    ["[GIN] 1999/05/06 - 07:08:09 | 204 | 3.2ms | 10.1.2.3", "[GIN] 2001/01/01 - 00:00:01 | 204 | 88.5µs | 10.7.8.9"],
    ["session-5.scope: Stopped", "session-70501.scope: Stopped"],
    ["veth00ff11: gone", "vethabcdef9: gone"],
    ["[ 7] Polling", "[70001] Polling"],
    ["link fd00:1:2:3:4:5:6:7 up", "link fe80:0:0:0:a:b:c:d up"],
    [f"pid={p} via 10.4.{p % 7}.{p % 200}" for p in range(2000, 2010)],
]


def python_canonical(text: str, version: str = "v1") -> str:
    """The same rule table under Python's own regex engine."""
    for rule in C.rules_for(version):
        text = re.sub(rule.pattern, rule.replacement, text)
    return text.strip()


def test_expected_fragments(evaluate):
    for (raw, wanted), got in zip(HAS, evaluate(C.canonicalize, [t for t, _ in HAS]), strict=True):
        for fragment in wanted:
            assert fragment in got, (raw, got)


def test_exact_results(evaluate):
    assert evaluate(C.canonicalize, [t for t, _ in EXACT]) == [w for _, w in EXACT]


def test_null_stays_null(evaluate):
    assert evaluate(C.canonicalize, [None]) == [None]


def test_groups_collapse(evaluate):
    for group in ONE_TEMPLATE:
        assert len(set(evaluate(C.canonicalize, group))) == 1


def test_different_events_stay_apart(evaluate):
    assert len(set(evaluate(C.canonicalize, ["disk sda failed", "disk sdb failed", "fan failed"]))) == 3


def test_idempotent_and_equal_to_python(evaluate):
    raw = [t for t, _ in HAS + EXACT] + [m for g in ONE_TEMPLATE for m in g]
    once = evaluate(C.canonicalize, raw)
    assert once == [python_canonical(t) for t in raw]
    assert evaluate(C.canonicalize, once) == once


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the test tables")
def test_whole_texts_equal_python(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select(F.col("text").alias("t"))
    pages = spark.read.parquet(f"{SMALL}/pages.parquet").select(F.col("html").alias("t"))
    rows = docs.unionByName(pages).select("t", C.canonicalize(F.col("t")).alias("c")).collect()
    assert all(r.c == python_canonical(r.t) for r in rows)


def test_every_rule_has_a_sentence():
    """Each of the rules changes one of the sentences at its turn, and so does the trimming at the end."""
    changed = set()
    for text in [t for t, _ in HAS + EXACT]:
        for rule in C.RULES_V1:
            after = re.sub(rule.pattern, rule.replacement, text)
            if after != text:
                changed.add(rule.name)
            text = after
        if text.strip() != text:
            changed.add("trim")
    assert changed == {*(r.name for r in C.RULES_V1), "trim"}


def test_guards_never_hide_a_match():
    """Each rule's literal and probe must be found in every string the rule matches."""
    samples = [t for t, _ in HAS + EXACT] + [m for g in ONE_TEMPLATE for m in g]
    samples += ["5m", "5 hours", "7us", "3ns x", "1h", "0:0:0", "a:b:c:d", "12.5 ms", "9µs", "session  7", "a  b"]
    for rule in C.RULES_V1:
        for text in samples:
            if re.search(rule.pattern, text):
                assert rule.literal is None or rule.literal in text, rule
                assert rule.probe is None or re.search(rule.probe, text), rule


def test_hashes(spark):
    text, service, level = "started <N>", "svc", "INFO"
    row = spark.range(1).select(
        C.canon_hash(F.lit(text), F.lit(service), F.lit(level)), C.text_hash(F.lit(text)),
        C.template_key(F.lit("started 123456"), F.lit(service), F.lit(level)),
    ).first()
    expected = hashlib.sha256(f"{service}|{level}|{text}".encode()).hexdigest()[:32]
    assert row[0] == expected
    assert row[1] == hashlib.sha256(text.encode()).hexdigest()[:32]
    assert tuple(row[2]) == (text, expected, "v1")


def test_hash_depends_on_service_and_level(spark):
    h = lambda s, lv: C.canon_hash(F.lit("x"), F.lit(s), F.lit(lv))
    row = spark.range(1).select(h("a", "INFO"), h("b", "INFO"), h("a", "WARN")).first()
    assert len(set(row)) == 3 and all(re.fullmatch("[0-9a-f]{32}", x) for x in row)


def test_versions(evaluate):
    with pytest.raises(ValueError):
        C.canonicalize(F.lit("x"), "v9")
    if "t1" not in C.VERSIONS:
        C.register_version("t1", [C.Rule("X1", r"it's (\d)", r"its \1$")])
    assert evaluate(lambda c: C.canonicalize(c, "t1"), ["it's 5"]) == ["its 5$"]
    with pytest.raises(ValueError):
        C.register_version("v1", [])

"""journald parsing, validation, noise rules and hashes."""

from __future__ import annotations

import hashlib
import json
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from loglattice.functions import hashing, journald as J
from loglattice.operators import noise, validate
from loglattice.schemas import LOG_EVENTS, check_level, check_range, conform
from loglattice.sources import deadletter, journald


def lines(spark, *records):
    texts = [r if isinstance(r, str) else json.dumps(r) for r in records]
    return spark.createDataFrame([(t,) for t in texts], "value string")


def test_journald_mapping(spark):
    df = lines(
        spark,
        {"__REALTIME_TIMESTAMP": "1764359740521872", "_SYSTEMD_UNIT": "a.service", "MESSAGE": "hi", "PRIORITY": "3",
         "_PID": "493414", "_COMM": "x", "SYSLOG_FACILITY": "3"},
        {"SYSLOG_IDENTIFIER": "cron", "MESSAGE": "m"},
        {"MESSAGE": "m", "PRIORITY": 4},
    )
    rows = journald.to_events(journald.parse(df), "n1").select(
        F.unix_micros("timestamp").alias("us"), "source", "service", "host", "level", "message", "meta_json"
    ).collect()
    assert rows[0].us == 1764359740521872
    assert rows[0][1:] == ("journald", "a.service", "n1", "ERROR", "hi", '{"pid":"493414","comm":"x","facility":"3"}')
    assert (rows[1].us, rows[1].service, rows[1].level, rows[1].meta_json) == (0, "cron", "INFO", None)
    assert (rows[2].service, rows[2].level) == ("unknown", "WARN")


def test_priorities(evaluate):
    values = ["0", "1", "2", "3", "4", "5", "6", "7", None, "9"]
    expected = "FATAL CRITICAL CRITICAL ERROR WARN INFO INFO DEBUG INFO INFO".split()
    assert evaluate(J.level_of, values) == expected


def test_unreadable_lines_are_kept(spark):
    df = lines(spark, "not json", "[1,2]", '"text"', "", '{"MESSAGE": "cut', {"__REALTIME_TIMESTAMP": "soon"}, {"MESSAGE": "ok"})
    parsed = journald.parse(df)
    assert [r.parse_error for r in journald.quarantined(parsed).collect()] == ["not_json"] * 5 + ["bad_timestamp"]
    assert journald.to_events(parsed, "h").count() == 1


def test_look_back(spark):
    at = lambda s: str(int(datetime.fromisoformat(s).replace(tzinfo=UTC).timestamp() * 1e6))
    df = lines(*[spark], {"__REALTIME_TIMESTAMP": at("2025-01-01T00:00:00")}, {"__REALTIME_TIMESTAMP": at("2025-01-02T00:00:00")})
    events = journald.to_events(journald.parse(df), "h")
    assert journald.look_back(events, "2025-01-02 12:00:00", 24).count() == 1
    assert journald.look_back(events, datetime(2025, 1, 2, 0, 0), 24).count() == 2


def test_text_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"MESSAGE": "one"}\nbroken\n{"MESSAGE": "two"}\n')
    events = journald.read_events(spark, str(tmp_path), "h")
    assert sorted(r.message for r in events.collect()) == ["one", "two"]


def test_log_hash_is_python_text(spark):
    stamps = [datetime(2025, 12, 1, 12, 0, 0), datetime(2025, 12, 1, 12, 0, 0, 500), datetime(2025, 12, 1, 12, 0, 0, 120000)]
    df = spark.createDataFrame([(t.replace(tzinfo=UTC), "h", "s", "é|m") for t in stamps], "timestamp timestamp, host string, service string, message string")
    got = [r[0] for r in df.select(hashing.log_hash(*[F.col(c) for c in ("timestamp", "host", "service", "message")])).collect()]
    expected = [hashlib.sha256(f"{t.replace(tzinfo=UTC)}|h|s|é|m".encode()).hexdigest()[:16] for t in stamps]
    assert got == expected


@pytest.mark.parametrize(
    ("change", "code"),
    [
        ({"service": None}, "service:required"),
        ({"timestamp": None}, "timestamp:required"),
        ({"message": None}, "message:required"),
        ({"level": "INVALID"}, "level:enum"),
        ({"level": "info"}, "level:enum"),
        ({"source": "x" * 256}, "source:max_length"),
        ({"trace_id": "x" * 65}, "trace_id:max_length"),
        ({"span_id": "x" * 33}, "span_id:max_length"),
        ({"event_type": "x" * 101}, "event_type:max_length"),
        ({"error_code": "x" * 51}, "error_code:max_length"),
        ({"meta_json": "[1]"}, "meta_json:object"),
        ({"meta_json": "nope"}, "meta_json:object"),
    ],
)
def test_validation_codes(make_events, change, code):
    assert validate.validate(make_events(change)).first().errors == [code]


def test_validation_accepts(make_events):
    checked = validate.validate(make_events({}, {"source": "x" * 255, "level": "WARNING", "meta_json": '{"a": {"b": 1}}'}, {"meta_json": "{ }"}))
    assert validate.valid(checked).count() == 3
    assert [r.meta_json for r in checked.orderBy("id").collect()] == [None, '{"a": {"b": 1}}', None]


def test_missing_columns_are_reported(spark):
    df = spark.createDataFrame([("data",)], "bad string")
    errors = validate.validate(df).first().errors
    assert len(errors) == 6 and all(e.endswith(":required") for e in errors)


def test_batch_bounds(make_events, spark):
    assert validate.check_batch(make_events({}, {})).count() == 2
    with pytest.raises(ValueError):
        validate.check_batch(make_events({}).limit(0))
    with pytest.raises(ValueError):
        validate.check_batch(spark.range(10_001))
    validate.check_batch(spark.range(10_000))


def test_argument_bounds():
    for bad in (0, 10_001, "5", True):
        with pytest.raises(ValueError):
            check_range("limit", bad, 1, 10_000)
    with pytest.raises(ValueError):
        check_level("info")
    assert check_level(None) is None


RULE = {"name": "test_noise", "pattern": "table manager .* uploading tables", "reason": "routine"}
CONFIG = {
    "enabled": True, "always_keep_levels": ["ERROR", "CRITICAL", "FATAL"],
    "always_keep_services": ["sshd.service", "docker.service"], "drop_patterns": [RULE],
}
NOISY = "table manager x uploading tables"


@pytest.mark.parametrize(
    ("level", "service", "message", "reason"),
    [
        ("ERROR", "random.service", NOISY, None),
        ("INFO", "sshd.service", NOISY, None),
        ("INFO", "loki.service", NOISY, "test_noise"),
        (None, None, NOISY, "test_noise"),
        ("INFO", "myapp.service", "other", None),
        ("INFO", "myapp.service", None, None),
    ],
)
def test_noise_precedence(make_events, level, service, message, reason):
    df = make_events({"level": level, "service": service, "message": message})
    assert noise.classify(df, noise.NoiseConfig.from_dict(CONFIG)).first().drop_reason == reason


def test_noise_switch_and_stats(make_events):
    df = make_events({"message": NOISY}, {"message": "other"})
    off = noise.NoiseConfig.from_dict({**CONFIG, "enabled": False})
    assert noise.keep(noise.classify(df, off)).count() == 2
    on = noise.classify(df, noise.NoiseConfig.from_dict(CONFIG))
    assert tuple(noise.summary(on).first()) == (2, 1, 1, 50.0)
    assert [tuple(r) for r in noise.stats_by_rule(on).collect()] == [("test_noise", 1)]
    watched, seen = noise.observed(on)
    assert noise.keep(watched).count() == 1
    assert seen.get == {"seen": 2, "dropped": 1}


def test_noise_first_rule_wins(make_events):
    rules = [RULE, {"name": "later", "pattern": "uploading", "reason": "r"}]
    config = noise.NoiseConfig.from_dict({**CONFIG, "drop_patterns": rules})
    got = noise.classify(make_events({"message": NOISY}, {"message": "uploading"}), config).orderBy("id")
    assert [r.drop_reason for r in got.collect()] == ["test_noise", "later"]


def test_noise_config_errors(tmp_path):
    with pytest.raises(noise.NoiseConfigError):
        noise.NoiseConfig.from_dict({"enabled": True})
    with pytest.raises(noise.NoiseConfigError):
        noise.NoiseConfig.from_dict({**CONFIG, "drop_patterns": [{"name": "x", "pattern": "[invalid", "reason": "r"}]})
    with pytest.raises(noise.NoiseConfigError):
        noise.NoiseConfig.from_dict({**CONFIG, "drop_patterns": [{"name": "x"}]})
    path = tmp_path / "rules.yaml"
    path.write_text(json.dumps(CONFIG))  # JSON is YAML
    pytest.importorskip("yaml")
    assert noise.NoiseConfig.from_yaml(str(path)).drop_patterns[0].name == "test_noise"
    assert len(noise.NoiseConfig.default().drop_patterns) == 12


def test_dead_letters_survive_json(make_events, spark, tmp_path):
    bad = validate.rejected(validate.validate(make_events({"level": "info", "message": 'quote " é'}, {})))
    deadletter.spool(bad, str(tmp_path / "dl"))
    records = deadletter.read_spool(spark, str(tmp_path / "dl"))
    assert records.first()["count"] == 1 and records.first()["logs"][0]["errors"] == ["level:enum"]
    back = deadletter.unpack(records).first()
    assert back.message == 'quote " é' and back.timestamp == bad.first().timestamp


def test_conform(make_events):
    df = conform(make_events({}).drop("trace_id").withColumn("extra", F.lit(1)), LOG_EVENTS)
    assert df.schema.names == LOG_EVENTS.names and df.first().trace_id is None

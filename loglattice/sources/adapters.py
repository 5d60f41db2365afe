"""Views of general tables as log events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import log_hash
from ..schemas import EVENT_COLUMNS

DOCUMENT_ID_BASE = 1_000_000_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


# The messages carry addresses, pids, durations, sessions and ids, all made of integers (n: event, u: user).
_LOKI = "'ts=2024-01-01T00:00:00.' || n || 'Z caller="
_CLICK = (
    _LOKI + """table_manager.go:' || n % 400 || ' msg="uploading tables" duration=' || n % 90 || 'ms'""",
    _LOKI + """table_manager.go:' || n % 400 || ' msg="syncing tables" duration=' || n % 90 || 'ms'""",
    _LOKI + """compactor.go:' || n % 300 || ' msg="compacting table" table=index_' || n""",
    _LOKI + """checkpoint.go:' || n % 200 || ' msg=done elapsed=' || n % 70 || '.5s'""",
    _LOKI + """main.go:' || n % 100 || ' msg=starting node=' || u""",
    "'[BATCH] Sending ' || n || ' records downstream'",
)
_SIGNUP = (
    "'pam_unix(sshd:session): session opened for user u' || u || '(uid=' || u || ')'",
    "'session-' || n || '.scope: Consumed ' || n % 60 || '.' || n % 10 || 's CPU time.'",
    "'CRON[' || n || ']: (root) CMD (/opt/jobs/rotate ' || u || ')'",
    "'veth' || lpad(string(n % 9000 + 1000), 7, '0') || ': Link UP'",
    "'2024-01-01 08:30:00,' || n % 900 || ' - hub.tasks - INFO - change ' || n",
    "'Closed session ' || n || ' on seat ' || u",
    "'neighbour fd00:' || lower(hex(n % 9999)) || ':0:0:9:' || u || ':7 is stale'",
    "'   lease renewed at 2024-01-02T03:04:05.' || n || 'Z for 0a:1b:2c:3d:4e:' || lpad(lower(hex(u % 256)), 2, '0') || ' '",
)
_ERROR = (
    "'connection refused by 10.0.' || u % 200 || '.' || n % 250 || ':8080 pid=' || (n + 1000) || ' request '"
    " || lpad(string(n), 8, '0') || '-0000-4000-8000-' || lpad(string(u), 12, '0')"
    " || ' after ' || n % 90 || '.' || n % 10 || 's retry ' || n % 5",
    "'Failed password for user u' || u || ' from 192.168.' || u % 200 || '.' || n % 250 || ' port ' || (n % 50000 + 10000)",
    "'Out of memory: killed process [ ' || n || '] after ' || n % 600 || ' seconds'",
    "'write failed: No space left on device, offset ' || (n + 100000) || '   token ' || lpad(string(n), 24, '0')",
)
_FIREWALL = (
    "'[UFW BLOCK] IN=ens5 OUT= MAC=01:23:45:67:89:ab:01:23:45:67:89:ab:08:00 SRC=192.168.' || u % 200 || '.' || n % 250"
    " || ' DST=10.0.0.' || u % 250 || ' LEN=' || (n % 1400 + 40) || ' TTL=' || n % 64 || ' ID=' || n"
    " || ' PROTO=TCP SPT=' || n % 60000 || ' DPT=' || u % 1024"
)
_ACCESS = (
    "'[GIN] 2024/01/01 - 12:00:00 | ' || (n % 3 * 100 + 200) || ' |   ' || n % 900 || '.' || n % 10"
    " || 'ms |  10.0.0.' || n % 250 || ' | GET \"/items\"'"
)


def _choose(options: tuple[str, ...]) -> str:
    arms = " ".join(f"WHEN {i} THEN {text}" for i, text in enumerate(options))
    return f"CASE n % {len(options)} {arms} END"


_MESSAGE = (
    f"CASE event_type WHEN 'click' THEN {_choose(_CLICK)} WHEN 'signup' THEN {_choose(_SIGNUP)} "
    f"WHEN 'error' THEN {_choose(_ERROR)} WHEN 'purchase' THEN {_FIREWALL} ELSE {_ACCESS} END"
)
_LEVEL = (
    "CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARN' WHEN 'view' THEN 'DEBUG' ELSE 'INFO' END"
)


def logs(spark: SparkSession, folder: str) -> DataFrame:
    return events_as_logs(table(spark, folder, "events"))


def events_as_logs(events: DataFrame) -> DataFrame:
    """The `events` table, or a stream of it, as log events; every column is an expression over its row."""
    named = events.selectExpr("event_id AS n", "user_id AS u", "ts", "event_type", "props")
    return named.selectExpr(
        "n AS id",
        "CAST(ts AS timestamp) AS timestamp",
        "'events' AS source",
        "'svc-' || u % 12 || '.service' AS service",
        "'node-' || u % 7 AS host",
        f"{_LEVEL} AS level",
        "lpad(lower(hex(n)), 16, '0') AS trace_id",
        "CAST(NULL AS string) AS span_id",
        "event_type",
        "CASE WHEN event_type = 'error' THEN 'E' || n % 5 END AS error_code",
        f"{_MESSAGE} AS message",
        "props AS meta_json",
    )


def document_logs(spark: SparkSession, folder: str) -> DataFrame:
    """Real text: each document as one long log message; copies of a text share all hashed fields."""
    return table(spark, folder, "documents").selectExpr(
        f"doc_id + {DOCUMENT_ID_BASE} AS id",
        "timestamp'2024-02-01 00:00:00' + make_dt_interval(0, 0, 0, n_chars) AS timestamp",
        "'documents' AS source",
        "'doc-' || lang AS service",
        "'docs' AS host",
        "'INFO' AS level",
        *[f"CAST(NULL AS string) AS {c}" for c in ("trace_id", "span_id", "event_type", "error_code")],
        "text AS message",
        "CAST(NULL AS string) AS meta_json",
    )


def all_logs(spark: SparkSession, folder: str) -> DataFrame:
    return logs(spark, folder).unionByName(document_logs(spark, folder)).select(*EVENT_COLUMNS)


def with_hash(events: DataFrame) -> DataFrame:
    return events.withColumn(
        "log_hash", log_hash(F.col("timestamp"), F.col("host"), F.col("service"), F.col("message"))
    )


def journal_lines(events: DataFrame) -> DataFrame:
    """Events written as journald JSON lines, one per row."""
    record = """named_struct(
        '__REALTIME_TIMESTAMP', string(unix_micros(timestamp)),
        '__CURSOR', 's=' || id,
        '_SYSTEMD_UNIT', CASE WHEN id % 3 <> 0 THEN service END,
        'SYSLOG_IDENTIFIER', CASE WHEN id % 5 <> 0 THEN 'cron' END,
        'MESSAGE', message,
        'PRIORITY', CASE level WHEN 'ERROR' THEN '3' WHEN 'WARN' THEN '4' WHEN 'DEBUG' THEN '7' END,
        '_PID', CASE WHEN id % 4 <> 0 THEN string(id) END,
        '_COMM', CASE WHEN id % 8 = 1 THEN 'worker' END,
        'SYSLOG_FACILITY', CASE WHEN id % 4 = 2 THEN '3' END,
        '_HOSTNAME', CASE WHEN id % 4 <> 0 THEN host END)"""
    return events.selectExpr(f"to_json({record}) AS value")

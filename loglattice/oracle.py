"""The catalog's queries in ANSI SQL, for an independent engine over the same tables."""

from __future__ import annotations

from .functions.canonical import RULES_V1, STRIP_CHARS
from .functions.journald import PRIORITY_LEVELS
from .functions.vectors import OFFLINE_DIM
from .operators.detect import CATASTROPHES
from .operators.noise import DEFAULT_CONFIG
from .plans.reports import SIGNAL_CATEGORIES
from .schemas import LEVELS, MAX_LENGTHS, REQUIRED_FIELDS

HALF = "TIMESTAMP '2024-01-15 00:00:00'"
CUTOFF_10 = "TIMESTAMP '2024-01-15 06:30:00'"
CUTOFF_1 = "TIMESTAMP '2024-01-24 06:30:00'"
END = "TIMESTAMP '2024-01-31 00:00:00'"
SEVERE = "('ERROR', 'CRITICAL', 'FATAL')"
EVENT_COLS = "id, timestamp, source, service, host, level, trace_id, span_id, event_type, error_code, message, meta_json"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def canon(text: str) -> str:
    for rule in RULES_V1:
        text = f"regexp_replace({text}, {q(rule.pattern)}, {q(rule.replacement)}, 'g')"
    return f"trim({text}, {q(STRIP_CHARS)})"


def pad(expr: str, width: int) -> str:
    return f"lpad(CAST({expr} AS VARCHAR), {width}, '0')"


_N, _U = "event_id", "user_id"


def _choose(by: str, options: list[str]) -> str:
    arms = " ".join(f"WHEN {by} % {len(options)} = {i} THEN {o}" for i, o in enumerate(options))
    return f"CASE {arms} END"


_LOKI = f"'ts=2024-01-01T00:00:00.' || {_N} || 'Z caller="
_CLICK = [
    f"""{_LOKI}table_manager.go:' || {_N} % 400 || ' msg="uploading tables" duration=' || {_N} % 90 || 'ms'""",
    f"""{_LOKI}table_manager.go:' || {_N} % 400 || ' msg="syncing tables" duration=' || {_N} % 90 || 'ms'""",
    f"""{_LOKI}compactor.go:' || {_N} % 300 || ' msg="compacting table" table=index_' || {_N}""",
    f"""{_LOKI}checkpoint.go:' || {_N} % 200 || ' msg=done elapsed=' || {_N} % 70 || '.5s'""",
    f"""{_LOKI}main.go:' || {_N} % 100 || ' msg=starting node=' || {_U}""",
    f"""'[BATCH] Sending ' || {_N} || ' records downstream'""",
]
_SIGNUP = [
    f"'pam_unix(sshd:session): session opened for user u' || {_U} || '(uid=' || {_U} || ')'",
    f"'session-' || {_N} || '.scope: Consumed ' || {_N} % 60 || '.' || {_N} % 10 || 's CPU time.'",
    f"'CRON[' || {_N} || ']: (root) CMD (/opt/jobs/rotate ' || {_U} || ')'",
    f"'veth' || {pad(f'{_N} % 9000 + 1000', 7)} || ': Link UP'",
    f"'2024-01-01 08:30:00,' || {_N} % 900 || ' - hub.tasks - INFO - change ' || {_N}",
    f"'Closed session ' || {_N} || ' on seat ' || {_U}",
    f"'neighbour fd00:' || lower(to_hex({_N} % 9999)) || ':0:0:9:' || {_U} || ':7 is stale'",
    f"'   lease renewed at 2024-01-02T03:04:05.' || {_N} || 'Z for 0a:1b:2c:3d:4e:' || lpad(lower(to_hex({_U} % 256)), 2, '0') || ' '",
]
_ERROR = [
    f"'connection refused by 10.0.' || {_U} % 200 || '.' || {_N} % 250 || ':8080 pid=' || ({_N} + 1000) || ' request ' || "
    f"{pad(_N, 8)} || '-0000-4000-8000-' || {pad(_U, 12)} || ' after ' || {_N} % 90 || '.' || {_N} % 10 || 's retry ' || {_N} % 5",
    f"'Failed password for user u' || {_U} || ' from 192.168.' || {_U} % 200 || '.' || {_N} % 250 || ' port ' || ({_N} % 50000 + 10000)",
    f"'Out of memory: killed process [ ' || {_N} || '] after ' || {_N} % 600 || ' seconds'",
    f"'write failed: No space left on device, offset ' || ({_N} + 100000) || '   token ' || {pad(_N, 24)}",
]
_UFW = (
    f"'[UFW BLOCK] IN=ens5 OUT= MAC=01:23:45:67:89:ab:01:23:45:67:89:ab:08:00 SRC=192.168.' || {_U} % 200 || '.' || {_N} % 250"
    f" || ' DST=10.0.0.' || {_U} % 250 || ' LEN=' || ({_N} % 1400 + 40) || ' TTL=' || {_N} % 64 || ' ID=' || {_N}"
    f" || ' PROTO=TCP SPT=' || {_N} % 60000 || ' DPT=' || {_U} % 1024"
)
_GIN = (
    f"'[GIN] 2024/01/01 - 12:00:00 | ' || ({_N} % 3 * 100 + 200) || ' |   ' || {_N} % 900 || '.' || {_N} % 10"
    f" || 'ms |  10.0.0.' || {_N} % 250 || ' | GET \"/items\"'"
)
_LEVEL = (
    "CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARN' WHEN 'view' THEN 'DEBUG' ELSE 'INFO' END"
)

LOGS = f"""logs AS (
  SELECT event_id AS id, ts AS timestamp, 'events' AS source,
         'svc-' || user_id % 12 || '.service' AS service, 'node-' || user_id % 7 AS host, {_LEVEL} AS level,
         lpad(lower(to_hex(event_id)), 16, '0') AS trace_id, CAST(NULL AS VARCHAR) AS span_id, event_type,
         CASE WHEN event_type = 'error' THEN 'E' || event_id % 5 END AS error_code,
         CASE event_type WHEN 'click' THEN {_choose(_N, _CLICK)} WHEN 'signup' THEN {_choose(_N, _SIGNUP)}
              WHEN 'error' THEN {_choose(_N, _ERROR)} WHEN 'purchase' THEN {_UFW} ELSE {_GIN} END AS message,
         props AS meta_json
  FROM events)"""
DOCS = """docs AS (
  SELECT doc_id + 1000000000 AS id, TIMESTAMP '2024-02-01 00:00:00' + to_seconds(n_chars) AS timestamp,
         'documents' AS source, 'doc-' || lang AS service, 'docs' AS host, 'INFO' AS level,
         CAST(NULL AS VARCHAR) AS trace_id, CAST(NULL AS VARCHAR) AS span_id, CAST(NULL AS VARCHAR) AS event_type,
         CAST(NULL AS VARCHAR) AS error_code, text AS message, CAST(NULL AS VARCHAR) AS meta_json
  FROM documents)"""
ALL = f"all_logs AS (SELECT {EVENT_COLS} FROM logs UNION ALL SELECT {EVENT_COLS} FROM docs)"


def templated(name: str, source: str) -> str:
    """Two steps, so that the long canonical expression is evaluated once per row."""
    return (
        f"{name}_c AS MATERIALIZED (SELECT *, {canon('message')} AS canonical_text FROM {source}), "
        f"{name} AS (SELECT *, substr(sha256(service || '|' || level || '|' || canonical_text), 1, 32) AS template_hash "
        f"FROM {name}_c)"
    )


def dimension(name: str, source: str, where: str = "TRUE") -> str:
    return (
        f"{name} AS (SELECT template_hash, any_value(canonical_text) AS canonical_text, any_value(service) AS service, "
        "any_value(level) AS level, count(*) AS event_count, min(timestamp) AS first_seen, max(timestamp) AS last_seen, "
        "array_to_string(list_sort(list(DISTINCT host)), ',') AS source_hosts, "
        "substr(sha256(any_value(canonical_text)), 1, 32) AS canon_hash, "
        "CAST('0x' || substr(template_hash, 1, 15) AS BIGINT) AS id "
        f"FROM {source} WHERE {where} GROUP BY template_hash)"
    )


TS_TEXT = (
    "strftime(timestamp, '%Y-%m-%d %H:%M:%S') || CASE WHEN strftime(timestamp, '%f') = '000000' THEN '' "
    "ELSE '.' || strftime(timestamp, '%f') END || '+00:00'"
)
LOG_HASH = f"substr(sha256({TS_TEXT} || '|' || host || '|' || service || '|' || message), 1, 16)"
HASHED = f"hashed AS (SELECT *, {LOG_HASH} AS log_hash FROM all_logs)"
UNIQUE = (
    "uniq AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY log_hash ORDER BY id) AS rn FROM hashed) WHERE rn = 1)"
)


def _in(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


REASON = (
    f"CASE WHEN level IN {_in(DEFAULT_CONFIG['always_keep_levels'])} OR service IN "
    f"{_in(DEFAULT_CONFIG['always_keep_services'])} THEN NULL "
    + " ".join(
        f"WHEN regexp_matches(message, {q(r['pattern'])}) THEN {q(r['name'])}" for r in DEFAULT_CONFIG["drop_patterns"]
    )
    + " END"
)
CATEGORY = "CASE " + " ".join(f"WHEN regexp_matches(message, {q(p)}) THEN {q(n)}" for n, p in SIGNAL_CATEGORIES) + " END"

DAMAGED = """damaged AS (
  SELECT id, timestamp, CASE WHEN id % 17 <> 0 THEN source END AS source,
         CASE WHEN id % 11 = 0 THEN service || '/' || message ELSE service END AS service, host,
         CASE WHEN id % 13 = 0 THEN lower(level) ELSE level END AS level, trace_id, span_id, event_type,
         CASE WHEN id % 29 = 0 THEN lpad(error_code, 51, '0') ELSE error_code END AS error_code, message,
         CASE WHEN id % 19 = 0 THEN 'no json' WHEN id % 23 = 0 THEN '{ }' ELSE meta_json END AS meta_json
  FROM all_logs)"""
ERRORS = (
    "concat_ws(',', "
    + ", ".join(f"CASE WHEN {f} IS NULL THEN '{f}:required' END" for f in REQUIRED_FIELDS)
    + ", "
    + ", ".join(f"CASE WHEN length({f}) > {n} THEN '{f}:max_length' END" for f, n in MAX_LENGTHS.items())
    + f", CASE WHEN level NOT IN {_in(LEVELS)} THEN 'level:enum' END"
    + ", CASE WHEN meta_json IS NOT NULL AND NOT (json_valid(meta_json) AND "
    "json_type(CASE WHEN json_valid(meta_json) THEN meta_json END) = 'OBJECT') THEN 'meta_json:object' END)"
)
CHECKED = f"checked AS (SELECT *, {ERRORS} AS errors FROM damaged)"

JOURNAL = f"""journal AS (
  SELECT id, timestamp, CASE WHEN id % 3 <> 0 THEN service END AS unit, CASE WHEN id % 5 <> 0 THEN 'cron' END AS ident,
         message, CASE level WHEN 'ERROR' THEN '3' WHEN 'WARN' THEN '4' WHEN 'DEBUG' THEN '7' END AS priority,
         CASE WHEN id % 4 <> 0 THEN CAST(id AS VARCHAR) END AS pid, CASE WHEN id % 8 = 1 THEN 'worker' END AS comm,
         CASE WHEN id % 4 = 2 THEN '3' END AS facility, CASE WHEN id % 4 <> 0 THEN host END AS hostname
  FROM logs),
shipped AS (
  SELECT timestamp, 'journald' AS source, coalesce(unit, ident, 'unknown') AS service, 'edge-1' AS host,
         CASE coalesce(priority, '6') {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in PRIORITY_LEVELS.items())} ELSE 'INFO' END AS level,
         message,
         CASE WHEN coalesce(pid, comm, facility, hostname) IS NOT NULL THEN
           '{{' || concat_ws(',', '"pid":"' || pid || '"', '"comm":"' || comm || '"', '"facility":"' || facility || '"',
                             '"hostname":"' || hostname || '"') || '}}' END AS meta_json
  FROM journal)"""

# every seventh log is not linked yet
PARTLY = "partly AS (SELECT *, CASE WHEN id % 7 <> 0 THEN template_hash END AS template_id FROM t)"
BASE = f"{LOGS}, {DOCS}, {ALL}"
T = f"{BASE}, {templated('t', 'logs')}"
TA = f"{BASE}, {templated('t', 'all_logs')}"


def words(name: str, source: str, key: str, text: str) -> str:
    """Counts per text and hash bucket."""
    return (
        f"{name}_w AS (SELECT {key}, unnest(regexp_extract_all(lower({text}), '[a-z0-9]+')) AS w FROM {source}), "
        f"{name} AS (SELECT {key}, CAST('0x' || substr(sha256(w), 1, 8) AS BIGINT) % {OFFLINE_DIM} AS pos, count(*) AS c "
        f"FROM {name}_w GROUP BY ALL)"
    )


def pct(part: str, whole: str) -> str:
    return f"round({part} * CAST(100.0 AS DOUBLE) / {whole}, 2)"


VEC0 = "SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0"
DIST = f"(1 - list_cosine_similarity(embedding::DOUBLE[], ({VEC0})))"
DAY = "strftime(timestamp, '%Y-%m-%d')"
MINUTE = "CAST(floor(epoch_us(timestamp) / 60000000) AS BIGINT)"


def _spikes(alpha: float = 0.3, history: int = 12, sigmas: float = 2.0, min_history: int = 6) -> str:
    weight = [f"'{(1 - alpha) ** (k - 1)!r}'::DOUBLE" for k in range(1, history + 1)]
    lag = [f"lag(errors, {k}) OVER w" for k in range(1, history + 1)]
    top, bottom = "CAST(0.0 AS DOUBLE)", "CAST(0.0 AS DOUBLE)"
    for x, w in zip(lag, weight, strict=True):
        top = f"({top} + coalesce({x} * {w}, 0.0))"
        bottom = f"({bottom} + CASE WHEN {x} IS NOT NULL THEN {w} ELSE 0.0 END)"
    return f"""WITH {BASE}, h AS (
        SELECT service, date_trunc('hour', timestamp) AS hour, count(*) FILTER (level IN {SEVERE}) AS errors FROM logs GROUP BY ALL),
      s AS (SELECT service, hour, errors, {top} / nullif({bottom}, 0) AS ewma, count(errors) OVER f AS seen,
                   sqrt(CAST(count(errors) OVER f * sum(errors * errors) OVER f - sum(errors) OVER f * sum(errors) OVER f AS DOUBLE))
                     / nullif(count(errors) OVER f, 0) AS sigma
            FROM h WINDOW w AS (PARTITION BY service ORDER BY hour),
                          f AS (PARTITION BY service ORDER BY hour ROWS BETWEEN {history} PRECEDING AND 1 PRECEDING))
      SELECT service, hour, errors, round(ewma, 6) + 0.0 AS ewma, round(sigma, 6) + 0.0 AS sigma FROM s
      WHERE seen >= {min_history} AND errors > ewma + {sigmas} * sigma"""


def _gaps(micros: int, by: str | None = None) -> str:
    key, part = (f"{by}, ", f"PARTITION BY {by} ") if by else ("", "")
    return f"""WITH {BASE}, g AS (
        SELECT {key}timestamp AS gap_end, lag(timestamp) OVER ({part}ORDER BY timestamp) AS gap_start FROM logs)
      SELECT {key}gap_start, gap_end, epoch_us(gap_end) - epoch_us(gap_start) AS gap_us FROM g
      WHERE epoch_us(gap_end) - epoch_us(gap_start) > {micros}"""


def _rule_hits() -> str:
    ctes, prev = [], "(SELECT message AS x0 FROM all_logs)"
    names = [r.name for r in RULES_V1] + ["R33"]
    for i, rule in enumerate(RULES_V1):
        ctes.append(
            f"s{i + 1} AS MATERIALIZED (SELECT x{i}, regexp_replace(x{i}, {q(rule.pattern)}, {q(rule.replacement)}, 'g') "
            f"AS x{i + 1} FROM {prev})"
        )
        prev = f"s{i + 1}"
    last = len(RULES_V1)
    ctes.append(f"s{last + 1} AS (SELECT x{last}, trim(x{last}, {q(STRIP_CHARS)}) AS x{last + 1} FROM {prev})")
    rows = " UNION ALL ".join(
        f"SELECT '{n}' AS rule, count(*) FILTER (x{i} <> x{i + 1}) AS hits FROM s{i + 1}" for i, n in enumerate(names)
    )
    return f"WITH {BASE}, {', '.join(ctes)} {rows}"


KILLED = "starts_with(message, 'Out of memory')"
REFUSED = "starts_with(message, 'connection refused')"
COOLDOWN = f"""slots AS (SELECT DISTINCT service, {MINUTE} AS minute FROM logs WHERE {KILLED}),
    fired AS (
      SELECT service, min(minute) AS minute FROM slots GROUP BY service
      UNION ALL
      SELECT service, minute FROM (
        SELECT s.service, s.minute, row_number() OVER (PARTITION BY s.service ORDER BY s.minute) AS rn
        FROM fired f JOIN slots s ON s.service = f.service AND s.minute >= f.minute + 360) WHERE rn = 1)"""
EDGES = (
    "edges AS (SELECT DISTINCT 'svc-' || user_id % 48 AS src, 'svc-' || (user_id * user_id + 1) % 50 AS dst FROM events)"
)
AFFECTED = "affected AS (SELECT unnest(['svc-1', 'svc-5', 'svc-9']) AS node)"


def _reach(roots: str, src: str, dst: str) -> str:
    # no shortest path has more hops than there are nodes
    return f"""most AS (SELECT count(DISTINCT src) + count(DISTINCT dst) AS hops FROM edges), walk AS (
        SELECT node AS root, node, 0 AS depth FROM {roots}
        UNION
        SELECT w.root, e.{dst}, w.depth + 1 FROM walk w JOIN edges e ON e.{src} = w.node WHERE w.depth < (SELECT hops FROM most)),
      reached AS (SELECT root, node, CAST(min(depth) AS BIGINT) AS depth FROM walk GROUP BY root, node HAVING min(depth) > 0)"""


def statements() -> dict[str, str]:
    s: dict[str, str] = {}
    s["scan_journald"] = f"""WITH {BASE}, {JOURNAL} SELECT * FROM shipped
      WHERE timestamp >= {HALF} - INTERVAL 240 HOURS"""
    s["journald_quarantine"] = f"""WITH {BASE}, o AS (
        SELECT CASE WHEN epoch_us(timestamp) % 10 = 7 THEN 'bad_timestamp' ELSE 'ok' END AS outcome FROM logs
        UNION ALL SELECT 'not_json' FROM documents) SELECT outcome, count(*) AS n FROM o GROUP BY ALL"""
    s["resume_after_id"] = f"WITH {BASE} SELECT id, service, message FROM logs WHERE id > 2500"
    s["events_scan"] = f"WITH {BASE} SELECT {EVENT_COLS} FROM all_logs"
    s["templates_scan"] = f"WITH {T}, {dimension('d', 't')} SELECT template_hash, id FROM d"
    s["dead_letter_round_trip"] = f"""WITH {BASE}, {DAMAGED}, {CHECKED},
      mended AS (SELECT * REPLACE (upper(level) AS level) FROM checked WHERE errors <> ''),
      again AS (SELECT * EXCLUDE (errors), {ERRORS} AS errors FROM mended)
      SELECT CAST(errors = '' AS BIGINT) AS accepted, count(*) AS n, CAST(sum(length(message)) AS BIGINT) AS chars
      FROM again GROUP BY ALL"""
    s["metadata_values"] = f"""WITH {BASE}, k AS (SELECT level, CAST(json_extract(meta_json, '$.k') AS BIGINT) AS k FROM logs)
      SELECT level, CAST(sum(k) AS BIGINT) AS sum_k, min(k) AS min_k, max(k) AS max_k FROM k GROUP BY level"""
    s["conform_to_table"] = f"""WITH {BASE} SELECT id, timestamp, source, service, host, level,
      CAST(NULL AS VARCHAR) AS trace_id, span_id, event_type, CAST(NULL AS VARCHAR) AS error_code, message, meta_json FROM logs"""
    s["vector_codec"] = """SELECT vec_id, len(embedding) AS dims, round(list_sum(embedding::DOUBLE[]), 6) + 0.0 AS total
      FROM embeddings"""
    s["query_logs"] = f"""WITH {BASE} SELECT {EVENT_COLS} FROM logs WHERE service = 'svc-3.service' AND level = 'ERROR'
      AND host = 'node-1' AND timestamp >= TIMESTAMP '2024-01-02 00:00:00' AND timestamp <= TIMESTAMP '2024-01-28 00:00:00'
      ORDER BY timestamp DESC, id DESC LIMIT 50 OFFSET 5"""
    s["query_logs_next_page"] = f"""WITH {BASE} SELECT {EVENT_COLS} FROM logs WHERE level = 'WARN'
      AND (timestamp < {HALF} OR (timestamp = {HALF} AND id < 0)) ORDER BY timestamp DESC, id DESC LIMIT 100"""
    s["query_logs_any_case"] = f"""WITH {BASE} SELECT id, service, timestamp FROM logs
      WHERE lower(service) = 'svc-3.service' AND timestamp >= {HALF}"""
    s["expired_by_day"] = f"WITH {BASE} SELECT {DAY} AS day, count(*) AS n FROM all_logs WHERE timestamp < {HALF} GROUP BY ALL"
    s["unlinked_events"] = f"WITH {BASE} SELECT id, service, level FROM logs WHERE id % 7 = 0"
    s["template_key_lookup"] = f"""WITH {T}, {dimension('d', 't')} SELECT template_hash, canonical_text, event_count FROM d
      WHERE template_hash IN (SELECT template_hash FROM t WHERE level = 'ERROR')"""
    s["noise_classify"] = f"WITH {BASE} SELECT id, level, service, {REASON} AS drop_reason FROM all_logs"
    s["validate_records"] = f"""WITH {BASE}, {DAMAGED}, {CHECKED} SELECT id, errors,
      CASE WHEN regexp_replace(meta_json, '\\s', '', 'g') <> '{{}}' THEN meta_json END AS meta_json FROM checked"""
    s["resolve_templates"] = f"""WITH {T}, {dimension('k', 't', f'timestamp < {HALF}')}
      SELECT t.id, t.template_hash, k.id AS template_id FROM t LEFT JOIN k ON t.template_hash = k.template_hash"""
    s["new_templates"] = f"""WITH {TA}, {dimension('l', 't', "timestamp >= TIMESTAMP '2024-01-03 00:00:00'")}
      SELECT template_hash, service, level, event_count FROM l WHERE template_hash NOT IN
      (SELECT template_hash FROM t WHERE timestamp < TIMESTAMP '2024-01-03 00:00:00')"""
    s["accept_new_events"] = f"""WITH {BASE}, {HASHED}, {UNIQUE} SELECT id, log_hash FROM uniq WHERE log_hash NOT IN
      (SELECT log_hash FROM hashed WHERE timestamp < {HALF})"""
    s["ingest_outcome"] = f"""WITH {BASE}, {DAMAGED}, {CHECKED}, ok AS (SELECT {LOG_HASH} AS log_hash FROM checked WHERE errors = '')
      SELECT (SELECT count(DISTINCT log_hash) FROM ok) AS ingested,
             (SELECT count(*) - count(DISTINCT log_hash) FROM ok) AS duplicates,
             (SELECT count(*) FROM checked WHERE errors <> '') AS failed"""
    s["ingest_twice"] = f"""WITH {TA}, k AS (SELECT *, {LOG_HASH} AS log_hash, {REASON} AS reason FROM t),
      c AS (SELECT count(DISTINCT log_hash) FILTER (reason IS NULL) AS ingested, count(*) FILTER (reason IS NULL) AS kept,
                   count(reason) AS dropped, count(DISTINCT template_hash) FILTER (reason IS NULL) AS templates FROM k)
      SELECT ingested, kept - ingested AS duplicates, 0::BIGINT AS failed, dropped, 1::BIGINT AS run, ingested AS counted_events, templates FROM c
      UNION ALL SELECT 0, kept, 0, dropped, 2, ingested, templates FROM c"""
    s["first_event_per_template"] = f"""WITH {T}, r AS (SELECT *, row_number() OVER
      (PARTITION BY template_hash ORDER BY timestamp, id) AS rn FROM t) SELECT template_hash, id, timestamp, host FROM r WHERE rn = 1"""
    s["template_batch_counts"] = f"""WITH {T} SELECT template_hash, host, count(*) AS event_count, min(timestamp) AS first_seen,
      max(timestamp) AS last_seen FROM t GROUP BY ALL"""
    s["merge_template_counts"] = f"""WITH {TA}, {dimension('d', 't')}
      SELECT template_hash, event_count, first_seen, last_seen, source_hosts FROM d"""
    s["template_dimension"] = f"""WITH {TA}, {dimension('d', 't')} SELECT id, template_hash, canonical_text, service, level,
      'v1' AS canon_version, canon_hash, 'v1' AS chunk_version, first_seen, last_seen, event_count, source_hosts FROM d"""
    s["template_dense_ids"] = f"""WITH {T} SELECT template_hash, 1000 + row_number() OVER (ORDER BY template_hash) AS dense_id
      FROM (SELECT DISTINCT template_hash FROM t)"""
    s["recent_examples"] = f"""WITH {T}, r AS (SELECT *, row_number() OVER
      (PARTITION BY template_hash ORDER BY timestamp DESC, id DESC) AS recency FROM t WHERE level = 'ERROR')
      SELECT template_hash AS template_id, recency, id, message FROM r WHERE recency <= 3"""
    s["canonicalize_logs"] = f"WITH {T} SELECT id, canonical_text FROM t"
    s["canonicalize_documents"] = f"""WITH {BASE}, {templated('t', 'docs')} SELECT id, canonical_text, template_hash,
      'v1' AS canon_version, substr(sha256(canonical_text), 1, 32) AS canon_hash FROM t"""
    s["canonicalize_pages"] = f"SELECT page_id, substr(sha256({canon('html')}), 1, 32) AS canon_hash FROM pages"
    s["rule_hits"] = _rule_hits()
    s["log_hashes"] = f"WITH {BASE}, {HASHED} SELECT id, log_hash FROM hashed"
    s["resume_points"] = f"""WITH {BASE}, e AS (SELECT l.id, v.vec_id FROM logs l LEFT JOIN embeddings v ON v.vec_id = l.id)
      SELECT coalesce(min(id) FILTER (id % 7 = 0) - 1, 0) AS template_resume_id, coalesce(max(vec_id), 0) AS embedding_resume_id,
             count(*) FILTER (id % 7 = 0) AS orphans, count(*) FILTER (vec_id IS NULL) AS missing_vectors FROM e"""
    s["backfill_links"] = f"WITH {T} SELECT id, template_hash AS template_id FROM t"
    s["safety_net_links"] = f"""WITH {BASE}, o AS (SELECT id, row_number() OVER (ORDER BY id) AS rn FROM logs WHERE id % 7 = 0),
      f AS (SELECT l.id, CASE WHEN o.rn > 500 THEN 1::BIGINT ELSE 0 END AS unlinked FROM logs l LEFT JOIN o ON o.id = l.id)
      SELECT unlinked, count(*) AS n, max(id) AS max_id, min(id) AS min_id FROM f GROUP BY unlinked"""
    s["backfill_stored"] = f"""WITH {T} SELECT count(*) FILTER (id % 7 = 0) AS processed,
      (SELECT count(DISTINCT template_hash) FROM t WHERE template_hash NOT IN
        (SELECT template_hash FROM t WHERE id % 7 <> 0)) AS new_templates,
      count(*) FILTER (id % 7 = 0) AS linked, 0::BIGINT AS failed, 0::BIGINT AS still_unlinked, count(*) AS counted_events FROM t"""
    s["backfill_after_purge"] = f"""WITH {T}, f AS (SELECT template_hash, count(*) AS n FROM t WHERE id % 7 <> 0
        GROUP BY template_hash HAVING max(timestamp) >= {CUTOFF_10}),
      o AS (SELECT template_hash FROM t WHERE id % 7 = 0 AND timestamp >= {CUTOFF_10}),
      c AS (SELECT CAST((SELECT coalesce(sum(n), 0) FROM f) AS BIGINT) AS before, (SELECT count(*) FROM o) AS due)
      SELECT due AS processed, (SELECT count(DISTINCT template_hash) FROM o WHERE template_hash NOT IN (SELECT template_hash FROM f)) AS new_templates,
             due AS linked, 0::BIGINT AS failed, 0::BIGINT AS still_unlinked, before AS counted_before, before + due AS counted_after,
             0::BIGINT AS second_run, before + due AS counted_at_last FROM c"""
    s["safety_net_stored"] = f"""WITH {T}, o AS (SELECT template_hash, row_number() OVER (ORDER BY id) <= 500 AS now FROM t WHERE id % 7 = 0)
      SELECT count(*) FILTER (now) AS processed, count(DISTINCT template_hash) FILTER (now AND template_hash NOT IN
               (SELECT template_hash FROM t WHERE id % 7 <> 0)) AS new_templates, count(*) FILTER (now) AS linked, 0::BIGINT AS failed,
             count(*) FILTER (NOT now) AS still_unlinked, (SELECT count(*) FROM t WHERE id % 7 <> 0) + count(*) FILTER (now) AS counted_events FROM o"""
    s["failed_batch_replay"] = f"""WITH {TA}, k AS (SELECT *, {LOG_HASH} AS log_hash FROM t WHERE {REASON} IS NULL)
      SELECT count(DISTINCT log_hash) AS stored, count(DISTINCT template_hash) AS templates, 0::BIGINT AS counted_before,
             count(DISTINCT log_hash) AS counted, 1::BIGINT AS kept, 1::BIGINT AS recovered, 0::BIGINT AS left FROM k"""
    s["evolve_stored"] = f"""WITH {BASE}, d AS (SELECT id, service, timestamp, error_code, {DAY} AS event_date FROM logs)
      SELECT id, service, CASE WHEN timestamp >= {HALF} THEN error_code END AS error_code, event_date, 1::BIGINT AS rows_after,
             (SELECT count(DISTINCT event_date) FROM d WHERE timestamp >= {HALF}) AS rewritten, 'event_date,id,service' AS columns_after FROM d"""
    s["catalog_views"] = f"""WITH {T}, u AS (SELECT level, template_hash, {LOG_HASH} AS log_hash FROM t)
      SELECT level, count(DISTINCT template_hash) AS templates, count(DISTINCT log_hash) AS counted, count(DISTINCT log_hash) AS n FROM u GROUP BY level"""
    s["embed_missing_texts"] = f"""WITH {TA}, {dimension('d', 't')}, m AS (SELECT DISTINCT canon_hash, canonical_text FROM d
        WHERE canon_hash NOT IN (SELECT canon_hash FROM d WHERE level = 'ERROR')), {words('w', 'm', 'canon_hash', 'canonical_text')},
      n AS (SELECT canon_hash, sqrt(sum(c * c)) AS norm FROM w GROUP BY ALL)
      SELECT canon_hash, pos, round(CAST(c / norm AS FLOAT)::DOUBLE, 5) AS x FROM w JOIN n USING (canon_hash)"""
    s["retention_report"] = f"""WITH {TA}, {dimension('d', 't')} SELECT count(*) AS total_logs, min(timestamp) AS oldest_log,
      max(timestamp) AS newest_log, count(*) FILTER (timestamp < {CUTOFF_10}) AS to_delete,
      (SELECT count(*) FROM d WHERE last_seen < {CUTOFF_10}) AS stale_templates FROM all_logs"""
    s["retention_survivors"] = f"""WITH {BASE} SELECT {DAY} AS day, count(*) AS n, min(id) AS min_id FROM all_logs
      WHERE timestamp >= {CUTOFF_10} GROUP BY ALL"""
    s["fresh_templates"] = f"""WITH {TA}, {dimension('d', 't')} SELECT template_hash, last_seen FROM d WHERE last_seen >= {CUTOFF_1}"""
    s["purge_store"] = f"""WITH {TA}, {HASHED}, {dimension('d', 't')} SELECT count(DISTINCT log_hash) AS events, min(timestamp) AS oldest,
      (SELECT count(*) FROM d WHERE last_seen >= {CUTOFF_10}) AS templates FROM hashed WHERE timestamp >= {CUTOFF_10}"""
    s["stored_retention_report"] = f"""WITH {TA}, {HASHED}, {dimension('d', 't')} SELECT count(DISTINCT log_hash) AS total_logs,
      min(timestamp) AS oldest_log, max(timestamp) AS newest_log, count(DISTINCT log_hash) FILTER (timestamp < {CUTOFF_10}) AS to_delete,
      (SELECT count(*) FROM d WHERE last_seen < {CUTOFF_10}) AS stale_templates FROM hashed"""
    s["stored_query_logs"] = f"""WITH {BASE}, u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {LOG_HASH} ORDER BY id) AS rn FROM logs) WHERE rn = 1)
      SELECT {EVENT_COLS} FROM u WHERE service = 'svc-3.service' AND level = 'ERROR'
      AND host = 'node-1' AND timestamp >= TIMESTAMP '2024-01-02 00:00:00' AND timestamp <= TIMESTAMP '2024-01-28 00:00:00'
      ORDER BY timestamp DESC, id DESC LIMIT 50 OFFSET 5"""
    s["merge_day_files"] = f"""WITH {BASE}, u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {LOG_HASH} ORDER BY id % 3, id) AS rn FROM logs)
        WHERE rn = 1), f AS (SELECT {DAY} AS event_date, count(*) AS n, min(id) AS min_id, CAST(sum(id) AS BIGINT) AS ids,
        count(DISTINCT id % 3) AS folders_before, max(timestamp) < {HALF} AS over FROM u GROUP BY ALL)
      SELECT event_date, n, min_id, ids, folders_before, CASE WHEN over THEN 1 ELSE folders_before END AS folders_after,
             (SELECT count(*) FROM u) AS counted FROM f"""
    s["evolve_schema"] = f"WITH {BASE} SELECT id, service, CAST(NULL AS VARCHAR) AS template_id FROM logs"
    s["cosine_distances"] = f"SELECT vec_id, round({DIST}, 6) + 0.0 AS distance FROM embeddings"
    s["search_logs"] = f"""WITH {BASE}, h AS (SELECT l.id, service, message, {DIST} AS d FROM logs l
        JOIN embeddings e ON e.vec_id = l.id WHERE level = 'ERROR' AND timestamp >= TIMESTAMP '2024-01-01 00:00:00' AND timestamp <= {END}
        ORDER BY d, l.id LIMIT 20)
      SELECT id, service, message, round(1 - d, 6) + 0.0 AS similarity_score FROM h"""
    s["search_templates"] = f"""WITH {T}, {dimension('d', 't')}, {words('w', 'd', 'template_hash', 'canonical_text')},
      ask AS (SELECT 1 AS k, {canon("'connection refused by 10.0.0.1:8080 pid=4242 after 3.5s'")} AS text), {words('a', 'ask', 'k', 'text')},
      dots AS (SELECT template_hash, sum(w.c * a.c) AS dot FROM w JOIN a USING (pos) GROUP BY ALL),
      norms AS (SELECT template_hash, sqrt(sum(c * c)) AS norm FROM w GROUP BY ALL),
      asked AS (SELECT sqrt(sum(c * c)) AS asked FROM a),
      sims AS (SELECT d.*, coalesce(dot, 0) / (norm * asked) AS sim FROM d JOIN norms USING (template_hash)
               LEFT JOIN dots USING (template_hash), asked),
      hits AS (SELECT * FROM sims ORDER BY round(sim, 6) DESC, template_hash LIMIT 10),
      r AS (SELECT template_hash, id, row_number() OVER (PARTITION BY template_hash ORDER BY timestamp DESC, id DESC) AS rn FROM t)
      SELECT template_hash AS template_id, canonical_text, event_count, round(sim, 6) + 0.0 AS similarity_score, rn - 1 AS rank,
             r.id AS event_id FROM hits JOIN r USING (template_hash) WHERE rn <= 3"""
    once = f"u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {LOG_HASH} ORDER BY id) AS rn FROM t) WHERE rn = 1)"
    asked = f"""ask AS (SELECT 1 AS k, {canon("'connection refused by 10.0.0.1:8080 pid=4242 after 3.5s'")} AS text), {words('a', 'ask', 'k', 'text')},
      dots AS (SELECT template_hash, sum(w.c * a.c) AS dot FROM w JOIN a USING (pos) GROUP BY ALL),
      norms AS (SELECT template_hash, sqrt(sum(c * c)) AS norm FROM w GROUP BY ALL), whole AS (SELECT sqrt(sum(c * c)) AS asked FROM a),
      sims AS (SELECT d.*, coalesce(dot, 0) / (norm * asked) AS sim FROM d JOIN norms USING (template_hash) LEFT JOIN dots USING (template_hash), whole)"""
    s["stored_search_logs"] = f"""WITH {T}, {once}, {dimension('d', 'u')}, {words('w', 'd', 'template_hash', 'canonical_text')}, {asked}
      SELECT u.id, u.service, u.message, round(sim, 6) + 0.0 AS similarity_score FROM u JOIN sims USING (template_hash)
      WHERE u.level = 'ERROR' AND u.timestamp >= TIMESTAMP '2024-01-05 00:00:00' AND u.timestamp <= {END} ORDER BY round(sim, 6) DESC, u.id LIMIT 20"""
    s["stored_search_templates"] = f"""WITH {T}, {once}, {dimension('d', 'u')}, {words('w', 'd', 'template_hash', 'canonical_text')}, {asked},
      hits AS (SELECT * FROM sims ORDER BY round(sim, 6) DESC, template_hash LIMIT 10),
      r AS (SELECT template_hash, id, row_number() OVER (PARTITION BY template_hash ORDER BY timestamp DESC, id DESC) AS n FROM u)
      SELECT template_hash AS template_id, canonical_text, event_count, round(sim, 6) + 0.0 AS similarity_score, n - 1 AS rank,
             r.id AS event_id FROM hits JOIN r USING (template_hash) WHERE n <= 3"""
    s["reembed_new_model"] = f"""WITH {T}, c AS (SELECT count(DISTINCT canonical_text) AS n FROM t)
      SELECT 'hashed-bow-' || dims AS embedding_model, n AS texts, dims, dims AS most_dims, n AS rows FROM c, (SELECT unnest([32, 64])::BIGINT AS dims)"""
    s["nearest_by_index"] = f"""WITH p AS (SELECT tab, bit, list(1.0 - 2.0 * (ascii(sha256(tab || ':' || bit || ':' || dim)) % 2) ORDER BY dim) AS w
        FROM range(8) x(tab), range(10) y(bit), range(64) z(dim) GROUP BY tab, bit),
      s AS (SELECT vec_id, tab, bit, list_dot_product(embedding::DOUBLE[], w::DOUBLE[]) AS side FROM embeddings, p),
      a AS (SELECT tab, bit, side > 0 AS own, row_number() OVER (PARTITION BY tab ORDER BY abs(side), bit) AS turn FROM s WHERE vec_id = 0),
      m AS (SELECT vec_id, tab, max(CASE WHEN (side > 0) <> own THEN turn ELSE 0 END) AS loose FROM s JOIN a USING (tab, bit) GROUP BY vec_id, tab),
      l AS (SELECT vec_id, min(loose) AS loose FROM m GROUP BY vec_id),
      w AS (SELECT greatest(5, max(loose)) AS loose FROM (SELECT loose FROM l ORDER BY loose LIMIT 10)),
      h AS (SELECT e.vec_id AS id, label, {DIST} AS d FROM embeddings e JOIN l USING (vec_id) WHERE l.loose <= (SELECT loose FROM w) ORDER BY d, id LIMIT 10)
      SELECT id, label::BIGINT AS label, round(d, 6) + 0.0 AS distance FROM h"""
    s["embed_documents"] = f"""WITH {words('w', 'documents', 'doc_id', 'text')}
      SELECT d.doc_id, count(pos) AS support, round(CAST(coalesce(max(c) / sqrt(sum(c * c)), 0) AS FLOAT)::DOUBLE, 4) AS largest
      FROM documents d LEFT JOIN w USING (doc_id) GROUP BY ALL"""
    kept = f"kept AS (SELECT * FROM t WHERE {REASON} IS NULL)"
    s["stream_ingest"] = f"""WITH {T}, {kept}, {dimension('d', 'kept')}
      SELECT template_hash, event_count, first_seen, last_seen, source_hosts FROM d"""
    s["stream_noise_stats"] = f"""WITH {BASE}, c AS (SELECT {REASON} AS drop_reason FROM logs) SELECT drop_reason, count(*) AS dropped FROM c
      WHERE drop_reason IS NOT NULL GROUP BY ALL"""
    s["stream_dedup_late"] = f"""WITH {BASE}, h AS (SELECT count(DISTINCT {LOG_HASH}) AS n FROM logs)
      SELECT 'first' AS run, n AS passed, n AS stored FROM h UNION ALL SELECT 'second', n, 0 FROM h"""
    s["stream_journal"] = f"""WITH {BASE}, {JOURNAL}, k AS (SELECT DISTINCT service, level, timestamp, message FROM shipped
        WHERE {REASON} IS NULL)
      SELECT service, level, count(*) AS n, max(timestamp) AS newest FROM k GROUP BY ALL"""
    classified = f"c AS (SELECT {REASON} AS drop_reason FROM logs)"
    s["noise_stats"] = f"""WITH {BASE}, {classified} SELECT drop_reason, count(*) AS dropped FROM c
      WHERE drop_reason IS NOT NULL GROUP BY ALL"""
    s["noise_summary"] = f"""WITH {BASE}, c AS (SELECT {REASON} AS drop_reason FROM all_logs) SELECT count(*) AS seen,
      count(drop_reason) AS dropped, count(*) - count(drop_reason) AS kept,
      round(count(drop_reason) * CAST(100.0 AS DOUBLE) / count(*), 1) AS drop_rate_pct FROM c"""
    s["report_noisiest_services"] = f"""WITH {BASE} SELECT service, count(*) AS n FROM all_logs GROUP BY service
      ORDER BY n DESC, service LIMIT 20"""
    s["report_levels"] = f"""WITH {BASE}, c AS (SELECT level, count(*) AS n FROM all_logs GROUP BY level)
      SELECT level, n, {pct('n', '(SELECT sum(n) FROM c)')} AS pct FROM c"""
    s["report_latest"] = f"WITH {BASE} SELECT {EVENT_COLS} FROM logs ORDER BY timestamp DESC, id DESC LIMIT 10"
    s["report_daily"] = f"WITH {BASE} SELECT {DAY} AS day, count(*) AS n FROM all_logs GROUP BY ALL"
    s["report_daily_average"] = f"""WITH {BASE}, d AS (SELECT {DAY} AS day, count(*) AS n FROM all_logs GROUP BY ALL)
      SELECT count(*) AS days, CAST(sum(n) AS BIGINT) AS logs, round(avg(n), 2) AS avg_per_day FROM d"""
    s["report_hourly"] = f"""WITH {BASE}, h AS (SELECT date_trunc('hour', timestamp) AS hour, count(*) AS n FROM logs GROUP BY ALL)
      SELECT strftime(hour, '%Y-%m-%d') AS day, round(avg(n), 2) AS avg_n, min(n) AS min_n, max(n) AS max_n FROM h GROUP BY ALL"""
    s["report_service_share"] = f"""WITH {BASE}, c AS (SELECT service, count(*) AS n FROM logs GROUP BY service),
      r AS (SELECT *, row_number() OVER (ORDER BY n DESC, service) AS rn FROM c),
      g AS (SELECT CASE WHEN rn <= 4 THEN service ELSE 'Other' END AS service, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY 1)
      SELECT service, n, {pct('n', '(SELECT sum(n) FROM c)')} AS pct FROM g"""
    s["report_lengths"] = f"""WITH {BASE} SELECT round(avg(length(message)), 2) AS avg_message, max(length(message)) AS max_message,
      round(avg(length(meta_json)), 2) AS avg_meta, max(length(meta_json)) AS max_meta FROM all_logs"""
    s["report_gaps"] = _gaps(4 * 60_000_000)
    s["report_gaps_by_host"] = _gaps(3600_000_000, "host")
    s["report_compression"] = f"""WITH {TA} SELECT count(*) AS events, count(DISTINCT template_hash) AS templates,
      round(count(*) * CAST(1.0 AS DOUBLE) / count(DISTINCT template_hash), 2) AS ratio FROM t"""
    s["report_noise"] = f"""WITH {BASE}, c AS (SELECT coalesce({REASON}, '(kept)') AS rule, count(*) AS n FROM logs GROUP BY ALL)
      SELECT rule, n, {pct('n', '(SELECT sum(n) FROM c)')} AS pct FROM c"""
    s["report_signal_share"] = f"""WITH {BASE}, c AS (SELECT CASE WHEN {REASON} IS NOT NULL THEN 'noise'
        WHEN level IN ('WARN', 'WARNING', 'ERROR', 'CRITICAL', 'FATAL') OR {CATEGORY} IS NOT NULL THEN 'signal' ELSE 'ambiguous' END AS c
        FROM all_logs),
      n AS (SELECT count(*) FILTER (c = 'noise') AS noise, count(*) FILTER (c = 'signal') AS signal,
                   count(*) FILTER (c = 'ambiguous') AS ambiguous FROM c)
      SELECT *, {pct('signal', '(noise + signal + ambiguous)')} AS signal_pct_before,
             {pct('signal', '(signal + ambiguous)')} AS signal_pct_after FROM n"""
    s["report_signals"] = f"""WITH {BASE}, c AS (SELECT {CATEGORY} AS category FROM all_logs)
      SELECT category, count(*) AS n FROM c WHERE category IS NOT NULL GROUP BY ALL"""
    s["report_what_if"] = f"""WITH {BASE}, c AS (SELECT coalesce({REASON}, '(kept)') AS outcome, id, timestamp, service, message FROM logs),
      r AS (SELECT *, count(*) OVER (PARTITION BY outcome) AS n,
                   row_number() OVER (PARTITION BY outcome ORDER BY timestamp DESC, id DESC) AS rank FROM c)
      SELECT outcome, n, rank, id, service, message FROM r WHERE rank <= 3"""
    s["report_growth"] = f"""WITH {BASE}, d AS (SELECT avg(n) AS a FROM (SELECT {DAY} AS day, count(*) AS n FROM logs GROUP BY ALL)),
      h AS (SELECT unnest([1, 7, 30, 90])::BIGINT AS horizon_days)
      SELECT horizon_days, CAST(round(a * horizon_days, 0) AS BIGINT) AS rows,
             round(a * horizon_days * 520 / CAST(1000000.0 AS DOUBLE), 3) AS megabytes FROM d, h"""
    s["report_hosts"] = f"WITH {BASE} SELECT host, count(*) AS n FROM all_logs GROUP BY host"
    s["report_embedding_coverage"] = f"""WITH {BASE}, e AS (SELECT l.id, v.vec_id FROM logs l LEFT JOIN embeddings v ON v.vec_id = l.id)
      SELECT count(*) AS total, count(vec_id) AS embedded, count(*) - count(vec_id) AS missing,
             {pct('count(vec_id)', 'count(*)')} AS pct FROM e"""
    s["detect_error_spikes"] = _spikes()
    s["detect_new_error_templates"] = f"""WITH {T}, {dimension('d', 't')} SELECT template_hash, service, first_seen FROM d
      WHERE first_seen >= TIMESTAMP '2024-01-02 00:00:00' AND level IN {SEVERE}"""
    s["detect_template_anomalies"] = f"""WITH {T}, d AS (SELECT template_hash, CAST(timestamp AS DATE) AS day, count(*) AS n FROM t GROUP BY ALL),
      s AS (SELECT template_hash, day, n, count(n) OVER f AS k, sum(n) OVER f AS s1, sum(n * n) OVER f AS s2 FROM d
            WINDOW f AS (PARTITION BY template_hash ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING))
      SELECT template_hash, strftime(day, '%Y-%m-%d') AS day, n, round(CAST(s1 AS DOUBLE) / k, 6) + 0.0 AS mean,
             round(sqrt(CAST(k * s2 - s1 * s1 AS DOUBLE)) / k, 6) + 0.0 AS sigma FROM s
      WHERE k >= 3 AND (k * n - s1) * (k * n - s1) > 4 * (k * s2 - s1 * s1)"""
    s["detect_template_stats"] = f"""WITH {T}, d AS (SELECT template_hash, {DAY} AS day, count(*) AS n FROM t GROUP BY ALL),
      k AS (SELECT template_hash, count(*) AS active_days, max(n) AS peak_n, max({{'n': n, 'day': day}}).day AS peak_day FROM d GROUP BY ALL),
      a AS (SELECT template_hash, count(*) AS event_count, min(timestamp) AS first_seen, max(timestamp) AS last_seen, count(DISTINCT host) AS hosts FROM t GROUP BY ALL)
      SELECT a.*, active_days, round(event_count::DOUBLE / active_days, 4) AS per_active_day, peak_n, peak_day FROM a JOIN k USING (template_hash)"""
    s["detect_silence"] = f"""WITH {BASE}, h AS (SELECT DISTINCT service, date_trunc('hour', timestamp) AS hour FROM logs),
      f AS (SELECT service, min(hour) AS first FROM h GROUP BY service),
      spine AS (SELECT service, unnest(generate_series(first, {END}, INTERVAL 1 HOUR)) AS hour FROM f)
      SELECT service, hour FROM spine EXCEPT SELECT service, hour FROM h"""
    kind = "CASE " + " ".join(f"WHEN regexp_matches(canonical_text, {q(p)}) THEN {q(n)}" for n, p in CATASTROPHES) + " END"
    s["detect_catastrophes"] = f"""WITH {TA}, {dimension('d', 't')}, k AS (SELECT {kind} AS kind, service, event_count FROM d)
      SELECT kind, service, count(*) AS templates, CAST(sum(event_count) AS BIGINT) AS events FROM k WHERE kind IS NOT NULL GROUP BY ALL"""
    s["detect_correlations"] = f"""WITH {BASE}, g AS (SELECT host, {MINUTE} AS minute, count(*) FILTER ({KILLED}) AS a_count,
        count(*) FILTER ({REFUSED}) AS b FROM logs WHERE {KILLED} OR {REFUSED} GROUP BY ALL),
      w AS (SELECT *, CAST(sum(b) OVER (PARTITION BY host ORDER BY minute RANGE BETWEEN CURRENT ROW AND 5 FOLLOWING) AS BIGINT) AS b_following FROM g)
      SELECT host, minute, a_count, b_following FROM w WHERE a_count > 0 AND b_following > 0"""
    s["detect_cooldown"] = f"""WITH RECURSIVE {BASE}, {COOLDOWN}
      SELECT service, minute, make_timestamp(minute * 60000000) AS fired_at FROM fired"""
    s["stream_cooldown"] = s["detect_cooldown"]
    s["detect_context"] = f"""WITH RECURSIVE {T}, {COOLDOWN}, i AS (SELECT service || '@' || minute AS incident_id, service, minute AS at FROM fired),
      c AS (SELECT service, template_hash, {MINUTE} AS minute, count(*) AS n FROM t GROUP BY ALL),
      near AS (SELECT incident_id, template_hash, CAST(sum(n) AS BIGINT) AS n FROM c JOIN i ON i.service = c.service
               AND abs(c.minute - i.at) <= 120 GROUP BY ALL),
      r AS (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY n DESC, template_hash) AS rank,
             CAST(sum(n) OVER (PARTITION BY incident_id) AS BIGINT) AS events FROM near),
      b AS (SELECT * FROM r WHERE rank <= 5)
      SELECT incident_id, events, rank, template_hash, n FROM b"""
    s["detect_service_overview"] = f"""WITH {T} SELECT service, count(*) AS events, count(*) FILTER (level IN {SEVERE}) AS errors,
      count(*) FILTER (level IN ('WARN', 'WARNING')) AS warnings, count(DISTINCT host) AS hosts,
      count(DISTINCT template_hash) AS templates, max(timestamp) AS last_seen FROM t
      WHERE timestamp > TIMESTAMP '2024-01-19 12:00:00' AND timestamp <= TIMESTAMP '2024-01-20 12:00:00' GROUP BY service"""
    s["detect_log_context"] = f"""WITH {BASE}, h AS (SELECT * FROM logs WHERE host = 'node-3')
      (SELECT id, host, message FROM h WHERE timestamp < {HALF} OR (timestamp = {HALF} AND id <= 0) ORDER BY timestamp DESC, id DESC LIMIT 6)
      UNION ALL (SELECT id, host, message FROM h WHERE NOT (timestamp < {HALF} OR (timestamp = {HALF} AND id <= 0))
                 ORDER BY timestamp, id LIMIT 5)"""
    s["graph_upstream"] = f"WITH RECURSIVE {EDGES}, {AFFECTED}, {_reach('affected', 'src', 'dst')} SELECT * FROM reached"
    s["graph_blast_radius"] = f"""WITH RECURSIVE {EDGES}, nodes AS (SELECT DISTINCT dst AS node FROM edges),
      {_reach('nodes', 'dst', 'src')} SELECT root, count(*) AS affected, max(depth) AS farthest FROM reached GROUP BY root"""
    s["graph_common_ancestors"] = f"""WITH RECURSIVE {EDGES}, {AFFECTED}, {_reach('affected', 'src', 'dst')}
      SELECT node, CAST(sum(depth) AS BIGINT) AS distance FROM reached GROUP BY node HAVING count(*) = 3"""
    return s

"""The same results in SQL, computed from the tables directly."""

from __future__ import annotations

EV = """
ev AS (
  SELECT *,
    CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARN' WHEN 'signup' THEN 'DEBUG' ELSE 'INFO' END AS level,
    CASE event_type WHEN 'error' THEN '500' WHEN 'purchase' THEN '201' WHEN 'signup' THEN '404' ELSE '200' END AS status,
    CASE WHEN event_id % 10 = 0 THEN '0' ELSE CAST(event_id AS VARCHAR) END AS bytes,
    CASE CAST(event_id % 8 AS INTEGER) WHEN 0 THEN 'EMERG' WHEN 1 THEN 'ALERT' WHEN 2 THEN 'CRIT' WHEN 3 THEN 'ERROR'
      WHEN 4 THEN 'WARN' WHEN 5 THEN 'NOTICE' WHEN 6 THEN 'INFO' ELSE 'DEBUG' END AS severity,
    regexp_extract(props, '"k": ([0-9]+)', 1) AS k,
    CAST(value AS VARCHAR) AS val,
    event_type || ' by user ' || user_id AS message,
    strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso,
    strftime(ts, '%d/%b/%Y:%H:%M:%S') || ' +0000' AS apache_time,
    strftime(ts, '%b %d %H:%M:%S') AS syslog_time,
    event_id % 4 AS turn
  FROM events
)"""

MIXED = (
    EV
    + """,
mixed AS (
  SELECT *, event_id AS seq, 'part-' || (user_id % 7) AS file,
    CASE turn WHEN 0 THEN 'json' WHEN 1 THEN 'apache' WHEN 2 THEN 'syslog' ELSE 'raw' END AS format,
    CASE turn
      WHEN 0 THEN '{"timestamp":"' || iso || '","level":"' || level || '","message":"' || message || '","latency_ms":' || val || ',"k":' || k || '}'
      WHEN 1 THEN '10.0.0.' || (user_id % 256) || ' - - [' || apache_time || '] "GET /' || event_type || '/' || user_id || ' HTTP/1.1" ' || status || ' '
        || CASE WHEN event_id % 10 = 0 THEN '-' ELSE bytes END
      WHEN 2 THEN '<' || (8 + event_id % 8) || '>' || syslog_time || ' host' || (user_id % 5) || ' ' || event_type || '[' || event_id || ']: value ' || val
      ELSE 'note ' || event_id END AS raw
  FROM ev
),
entries AS (
  SELECT *,
    CASE turn WHEN 0 THEN iso WHEN 1 THEN apache_time WHEN 2 THEN syslog_time END AS e_timestamp,
    CASE turn WHEN 0 THEN level WHEN 1 THEN CASE WHEN status = '500' THEN 'ERROR' ELSE 'INFO' END WHEN 2 THEN severity END AS e_level,
    CASE turn WHEN 0 THEN message WHEN 2 THEN 'value ' || val WHEN 3 THEN raw END AS e_message,
    CASE turn WHEN 1 THEN status END AS e_status,
    CASE turn WHEN 2 THEN CAST(event_id AS VARCHAR) END AS e_pid,
    CASE turn WHEN 3 THEN 'True' END AS e_raw
  FROM mixed
)"""
)

_PARSED = "seq, {fmt} AS format, {c}timestamp AS timestamp, {c}level AS level, {c}message AS message, {c}status AS status, {c}pid AS pid, {c}raw AS is_raw"
_AS_ENTRY = _PARSED.format(fmt="format", c="e_")

LOCKS = (
    MIXED
    + """,
locks AS (
  SELECT file, min(seq) AS lock_seq, arg_min(format, seq) AS lock_format FROM entries WHERE format <> 'raw' GROUP BY file
),
locked AS (
  SELECT e.*, CASE WHEN e.seq >= l.lock_seq THEN l.lock_format ELSE 'raw' END AS fmt
  FROM entries e LEFT JOIN locks l ON e.file = l.file
),
file_entries AS (
  SELECT * FROM locked WHERE fmt = format
  UNION ALL
  SELECT * REPLACE (NULL AS e_timestamp, NULL AS e_level, raw AS e_message, NULL AS e_status, NULL AS e_pid, 'True' AS e_raw)
  FROM locked WHERE fmt <> format AND fmt IN ('syslog', 'raw')
)"""
)


def _ev(sql: str) -> str:
    return f"WITH {EV} {sql}"


def _mixed(sql: str) -> str:
    return f"WITH {MIXED} {sql}"


def _locked(sql: str) -> str:
    return f"WITH {LOCKS} {sql}"


def _percentile(p: float, v: str) -> str:
    return f"quantile_disc({v}, {p / 100})"


def _summary(v: str, table: str, ps: tuple[int, ...]) -> str:
    ranks = ", ".join(f"{_percentile(p, v)} AS p{p}" for p in ps)
    return f"SELECT {ranks}, min({v}) AS min, max({v}) AS max, round(avg({v}), 6) AS mean, CAST(count({v}) AS DOUBLE) AS count FROM {table}"


def _past(source: str, value: str, partition: str, order: str, threshold: float = 3.0, samples: int = 30) -> str:
    """Each row against the earlier rows of its partition."""
    window = f"OVER ({partition} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"""past AS (
  SELECT *, {value} AS v, count({value}) {window} AS n, avg({value}) {window} AS mean, stddev_pop({value}) {window} AS std
  FROM {source}
),
scored AS (
  SELECT *, CASE WHEN n >= {samples} AND std > 0 THEN abs(v - mean) / std END AS z FROM past
),
judged AS (
  SELECT *, round(z, 6) AS z_score, coalesce(z > {threshold}, false) AS is_anomaly FROM scored
)"""


def _chain(name: str, matches: str, seconds: int) -> str:
    """Fires of one rule: the first match, then each first match after the cooldown."""
    return f"""{name}_m AS ({matches}),
{name}_fires(t) AS (
  SELECT min(t) FROM {name}_m
  UNION ALL
  SELECT n.t FROM {name}_fires f, LATERAL (
    SELECT m.t FROM {name}_m m WHERE m.t >= f.t + INTERVAL {seconds} SECOND ORDER BY m.t LIMIT 1
  ) n
)"""


FIRED = f"""WITH RECURSIVE {EV},
{_chain("errors", "SELECT ts AS t FROM ev WHERE level = 'ERROR'", 6 * 3600)},
{_chain("slow", "SELECT ts AS t FROM ev WHERE value > 60", 86_400)},
fired AS (
  SELECT 0 AS rule_no, 'errors' AS rule, event_id, ts AS fired_at FROM ev WHERE level = 'ERROR' AND ts IN (SELECT t FROM errors_fires)
  UNION ALL
  SELECT 1, 'slow', event_id, ts FROM ev WHERE value > 60 AND ts IN (SELECT t FROM slow_fires)
  UNION ALL
  SELECT 2, 'big purchase', event_id, ts FROM ev WHERE level = 'WARN' AND value > 150
)
"""

_ESCAPED = "replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"

_VIEW_ACCESS = """SELECT event_id AS seq, '10.0.0.' || (user_id % 256) AS host, apache_time AS timestamp, 'GET' AS method,
  '/' || event_type || '/' || user_id AS path, 'HTTP/1.1' AS protocol, CAST(status AS BIGINT) AS status, CAST(bytes AS BIGINT) AS bytes,
  CAST(NULL AS VARCHAR) AS referer, CAST(NULL AS VARCHAR) AS user_agent, CASE WHEN status = '500' THEN 'ERROR' ELSE 'INFO' END AS level FROM ev"""

_NDJSON = "SELECT event_id AS seq, iso AS timestamp, level, message, val AS latency_ms, k FROM ev"

_SUFFIX = "'<' || (8 + event_id % 8) || '>' || syslog_time || ' host' || (user_id % 5) || ' ' || event_type || '[' || event_id || ']: value ' || val"

ORACLE: dict[str, str] = {
    # sources
    "read_lines_stripped": _ev(f"SELECT {_SUFFIX} AS raw FROM ev"),
    "parse_json_lines": _ev(_NDJSON),
    "parse_json_exact": _ev(_NDJSON),
    "parse_json_typed": _ev("SELECT event_id AS seq, iso AS timestamp, level, message, value AS latency_ms, CAST(k AS BIGINT) AS k FROM ev"),
    "json_field_kinds": _mixed(
        "SELECT name, CASE name WHEN 'latency_ms' THEN 'float' WHEN 'k' THEN 'int' ELSE 'str' END AS kind, count(*) AS count "
        "FROM mixed, (VALUES ('timestamp'), ('level'), ('message'), ('latency_ms'), ('k')) AS keys(name) WHERE format = 'json' GROUP BY name"
    ),
    "typed_entries_stored": _ev("SELECT event_id AS seq, message, value AS latency_ms FROM ev WHERE level = 'ERROR' AND value > 50"),
    "parse_json_misfits": _mixed("SELECT seq, level FROM mixed WHERE format = 'json'"),
    "parse_access_log": _ev(_VIEW_ACCESS),
    "parse_syslog": _ev(
        "SELECT event_id AS seq, syslog_time AS timestamp, 'host' || (user_id % 5) AS hostname, event_type AS tag,"
        " CAST(event_id AS VARCHAR) AS pid, 'value ' || val AS message, severity AS level, 8 + event_id % 8 AS priority FROM ev"
    ),
    "severity_counts": _ev("SELECT severity AS value, count(*) AS count FROM ev GROUP BY severity"),
    "detect_format_counts": _mixed("SELECT format, count(*) AS lines FROM mixed GROUP BY format"),
    "parse_auto_line": _mixed(f"SELECT {_AS_ENTRY} FROM entries"),
    "parse_auto_file": _locked(f"SELECT {_PARSED.format(fmt='fmt', c='e_')} FROM file_entries"),
    "file_locks": _locked("SELECT file, lock_seq, lock_format FROM locks"),
    "parse_as_syslog": _mixed(
        f"SELECT {_PARSED.format(fmt=chr(39) + 'syslog' + chr(39), c='e_')} FROM entries WHERE format = 'syslog' UNION ALL"
        " SELECT seq, 'syslog', NULL, NULL, raw, NULL, NULL, 'True' FROM entries WHERE format <> 'syslog'"
    ),
    "parse_parallel": _mixed("SELECT format, e_level AS level, count(*) AS entries FROM entries GROUP BY ALL"),
    "custom_parser": _mixed("SELECT seq, CAST(seq AS VARCHAR) AS note FROM mixed WHERE format = 'raw'"),
    "custom_rows_parser": _mixed(
        "SELECT seq, i AS entry_no, i * 10 AS part, CAST(seq AS DOUBLE) / 2 AS share"
        " FROM (SELECT seq, unnest(range(seq % 3)) AS i FROM mixed WHERE format = 'raw')"
    ),
    "custom_python_parser": _mixed("SELECT seq, CAST(seq AS VARCHAR) AS note FROM mixed WHERE format = 'raw'"),
    # projections, filters, search
    "field_or_default": _mixed(
        "SELECT CASE WHEN format = 'syslog' THEN 'number' ELSE 'unknown' END AS pid,"
        " CASE WHEN format = 'apache' THEN 'None' ELSE '-' END AS referer, count(*) AS entries FROM entries GROUP BY ALL"
    ),
    "select_fields": _mixed(
        "SELECT seq, CASE turn WHEN 0 THEN 'k,level' WHEN 1 THEN 'level,status' WHEN 2 THEN 'level' ELSE '' END AS keys, e_level AS level FROM entries"
    ),
    "field_table": _mixed(
        "SELECT CAST(seq AS VARCHAR) AS seq, coalesce(e_level, '') AS level, CASE turn WHEN 0 THEN k ELSE '' END AS k,"
        " CASE turn WHEN 1 THEN 'None' ELSE '' END AS referer FROM entries"
    ),
    "default_columns": _ev(
        f"SELECT host, timestamp, method, path, CAST(status AS VARCHAR) AS status, CAST(bytes AS VARCHAR) AS bytes, level FROM ({_VIEW_ACCESS})"
    ),
    "normalise_entries": _mixed(
        "SELECT seq, coalesce(e_timestamp, '') AS ts, coalesce(e_level, 'INFO') AS level,"
        " CASE turn WHEN 1 THEN 'GET /' || event_type || '/' || user_id || ' → ' || status || ' (' || bytes || ' B)'"
        " WHEN 2 THEN '[' || event_type || '] value ' || val ELSE e_message END AS msg FROM entries"
    ),
    "regex_any_field": (
        "SELECT conv_id, turn, role FROM conversations WHERE regexp_matches(role, '^assist|\\bouon', 'i')"
        " OR regexp_matches(text, '^assist|\\bouon', 'i')"
    ),
    "regex_log_entries": _mixed(
        "SELECT seq, format FROM entries WHERE turn = 1 OR (turn = 0 AND (message LIKE '% user 7' OR event_type = 'click'))"
        " OR (turn = 2 AND event_type = 'click')"
    ),
    "regex_one_field": "SELECT doc_id, lang FROM documents WHERE regexp_matches(text, '\\bthe (an|on)', 'i')",
    "regex_case_sensitive": "SELECT doc_id FROM documents WHERE regexp_matches(text, 'The [a-m]')",
    "regex_python_dialect": _ev("SELECT event_id AS seq FROM ev WHERE event_type IN ('click', 'view')"),
    "raw_prefilter": _mixed("SELECT seq, format FROM mixed WHERE regexp_matches(raw, 'ERROR|/error/', 'i')"),
    "time_range_table": "SELECT event_id, event_type FROM events WHERE ts BETWEEN '2024-01-10' AND '2024-01-12 12:30:00'",
    "time_range_orders": (
        "SELECT o_orderstatus, count(*) AS orders, max(o_orderkey) AS last_key FROM orders"
        " WHERE o_orderdate BETWEEN '1996-02-01' AND '1996-03-01' GROUP BY o_orderstatus"
    ),
    "time_range_entries": _mixed(
        "SELECT seq, format FROM entries WHERE turn IN (0, 1) AND date_trunc('second', ts) BETWEEN '2024-01-10' AND '2024-01-12 12:30:00'"
    ),
    "parse_timestamps": _mixed(
        "SELECT seq, CASE WHEN turn IN (0, 1) THEN date_trunc('second', ts)"
        " WHEN turn = 2 THEN try_strptime('1900 ' || syslog_time, '%Y %b %d %H:%M:%S') END AS event_time FROM entries"
    ),
    "filter_all": _ev("SELECT event_id, value FROM ev WHERE level = 'ERROR' AND value > 50"),
    "filter_any": _ev("SELECT event_id, level FROM ev WHERE level = 'WARN' OR value > 100"),
    "filter_combined": (
        "SELECT event_id, event_type FROM events WHERE ts >= '2024-01-15' AND event_type IN ('error', 'purchase')"
    ),
    "filter_python": _ev("SELECT event_id AS seq FROM ev WHERE CAST(k AS INTEGER) % 2 = 1 AND level <> 'INFO'"),
    "substring_sql": "SELECT doc_id, lang FROM documents WHERE text LIKE '%the_an%ing%' ORDER BY doc_id LIMIT 50",
    "substring_search": "SELECT doc_id, lang FROM documents WHERE text LIKE '%the_an%ing%' ORDER BY doc_id LIMIT 50",
    "search_matches": _locked(
        "SELECT seq, fmt AS format FROM file_entries WHERE CASE WHEN e_raw = 'True' THEN regexp_matches(raw, 'error', 'i')"
        " WHEN turn = 0 THEN event_type = 'error' WHEN turn = 1 THEN event_type = 'error'"
        " ELSE event_type = 'error' OR severity = 'ERROR' END"
    ),
    "search_first_n": _ev(
        "SELECT event_id AS seq, level, message FROM ev WHERE level IN ('WARN', 'ERROR')"
        " AND date_trunc('second', ts) BETWEEN '2024-01-05 06:00:00' AND '2024-01-20' ORDER BY event_id LIMIT 25"
    ),
    "text_functions": (
        "SELECT doc_id, md5(trim(text, chr(9) || chr(10) || chr(13) || ' ')) AS stripped_md5, left(text, 40) AS head,"
        " left(sha256(text), 32) AS digest FROM documents"
    ),
    # counts, groups, numbers
    "count_by": _mixed("SELECT coalesce(e_status, 'unknown') AS value, count(*) AS count FROM entries GROUP BY 1"),
    "count_by_null": _mixed(
        "SELECT CASE turn WHEN 1 THEN 'None' ELSE 'unknown' END AS value, count(*) AS count FROM entries GROUP BY 1"
    ),
    "top_n": _mixed(
        "SELECT row_number() OVER (ORDER BY count DESC, first) AS rank, value, count FROM"
        " (SELECT coalesce(e_level, 'unknown') AS value, count(*) AS count, min((file, seq)) AS first FROM entries GROUP BY 1) ORDER BY rank LIMIT 3"
    ),
    "top_n_ties": (
        "SELECT row_number() OVER (ORDER BY count DESC, first) AS rank, value, count FROM"
        " (SELECT CAST(user_id AS VARCHAR) AS value, count(*) AS count, min(event_id) AS first FROM events GROUP BY 1) ORDER BY rank LIMIT 20"
    ),
    "top_n_orders": (
        "SELECT row_number() OVER (ORDER BY count DESC, first) AS rank, value, count FROM"
        " (SELECT CAST(o_custkey AS VARCHAR) AS value, count(*) AS count, min(o_orderkey) AS first FROM orders GROUP BY 1) ORDER BY rank LIMIT 15"
    ),
    "total_entries": "SELECT count(*) AS total FROM events",
    "distribution": _ev(
        "SELECT rank, value, count, CAST(floor(CAST(count AS DOUBLE) / max(count) OVER () * 40) AS INTEGER) AS bar_len,"
        " round(CAST(count AS DOUBLE) / max(count) OVER () * 100, 6) AS pct_of_max FROM"
        " (SELECT row_number() OVER (ORDER BY count(*) DESC, min(event_id)) AS rank, k AS value, count(*) AS count FROM ev GROUP BY k ORDER BY rank LIMIT 10)"
    ),
    "group_buckets": 'SELECT event_type AS "group", row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS position, event_id FROM events',
    "group_buckets_in_blocks": (
        'SELECT o_orderstatus AS "group", row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey) AS position, o_orderkey FROM orders'
    ),
    "group_positions_tied": (
        'SELECT o_orderstatus AS "group", CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, min(position) AS first, max(position) AS last, count(DISTINCT position) AS count'
        " FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey) AS position FROM orders) GROUP BY 1, 2"
    ),
    "group_items": _mixed("SELECT seq FROM mixed WHERE format = 'raw'"),
    "group_keys": _mixed("SELECT DISTINCT coalesce(e_level, 'unknown') AS \"group\" FROM entries"),
    "group_counts": 'SELECT l_returnflag AS "group", count(*) AS count FROM lineitem GROUP BY 1',
    "group_cardinality": "SELECT count(DISTINCT l_partkey) AS groups FROM lineitem",
    "group_folders": 'SELECT event_type AS "group", count(*) AS count, max(event_id) AS last FROM events GROUP BY 1',
    "percentile_summary": _summary("l_extendedprice", "lineitem", (50, 90, 95, 99)),
    "percentile_custom": _summary("l_quantity", "lineitem", (25, 75)),
    "percentile_one": _mixed(f"SELECT {_percentile(95, 'value')} AS p95 FROM mixed WHERE format = 'json'"),
    "percentile_in_blocks": _summary("l_extendedprice", "lineitem", (50, 90, 95, 99)),
    "numeric_skipped": _mixed("SELECT count(*) AS skipped FROM mixed WHERE format <> 'json'"),
    "running_moments": (
        "SELECT count(value) AS count, round(avg(value), 6) AS mean, round(var_pop(value), 6) AS variance, round(stddev_pop(value), 6) AS std FROM events"
    ),
    "stats_report": f"""WITH {EV},
top5 AS (
  SELECT row_number() OVER (ORDER BY count(*) DESC, min(event_id)) AS rank, val AS label, CAST(count(*) AS DOUBLE) AS value FROM ev GROUP BY val ORDER BY rank LIMIT 5
),
facts AS ({_summary("value", "ev", (50, 90, 95, 99))})
SELECT 'total' AS section, CAST(NULL AS BIGINT) AS rank, 'entries' AS label, CAST(count(*) AS DOUBLE) AS value FROM ev
UNION ALL SELECT 'top', rank, label, value FROM top5
UNION ALL SELECT 'numeric', NULL, name, value FROM (UNPIVOT facts ON COLUMNS(*) INTO NAME name VALUE value)
UNION ALL SELECT 'numeric', NULL, 'skipped', 0.0""",
    "level_counters": _mixed("SELECT e_level AS level, count(*) AS count FROM entries WHERE e_level IS NOT NULL GROUP BY 1"),
    "line_counters": _mixed(
        "SELECT count(*) FILTER (WHERE NOT (turn = 0 AND event_id % 9 = 0)) AS entries,"
        " count(*) FILTER (WHERE turn = 0 AND event_id % 9 = 0) AS failures FROM mixed"
    ),
    "custom_median": "SELECT round(median(value), 6) AS median, count(value) AS count FROM events",
    "custom_median_in_blocks": "SELECT round(median(o_totalprice), 6) AS median, count(o_totalprice) AS count FROM orders",
    "custom_aggregator_by_key": "SELECT event_type, count(*) AS count, round(max(value) - min(value), 6) AS gap FROM events GROUP BY event_type",
    "quantile_sketches": "SELECT CAST(p AS DOUBLE) AS percent, count(value) AS n, true AS near"
    " FROM events, (VALUES (1), (50), (90), (99.9)) AS v(p) GROUP BY p",
    "distinct_sketches": "SELECT l_returnflag, count(DISTINCT l_partkey) AS exact, true AS near FROM lineitem GROUP BY l_returnflag",
    "custom_aggregator": "SELECT count(*) AS count, round(max(value) - min(value), 6) AS gap FROM events",
    # anomalies and alerts
    "anomaly_scores": f"WITH {_past('events', 'value', '', 'event_id')} SELECT event_id, z_score, is_anomaly, n FROM judged",
    "anomaly_scores_in_blocks": f"WITH {_past('events', 'value', '', 'ts')} SELECT event_id, z_score, is_anomaly, n FROM judged",
    "anomaly_by_key": (
        f"WITH {_past('events', 'value', 'PARTITION BY event_type', 'event_id')} SELECT event_type, event_id, z_score, is_anomaly, n FROM judged"
    ),
    "anomaly_tied_order": (
        f"WITH {_past('events', 'value', '', 'event_type, event_id')}"
        " SELECT event_type, min(n) AS least, max(n) AS most, count(DISTINCT n) AS pasts FROM judged GROUP BY 1"
    ),
    "anomaly_log_entries": (
        f"WITH {MIXED}, {_past('entries', 'CASE WHEN turn = 0 THEN value END', '', 'seq', 2.5, 10)}"
        " SELECT seq, v IS NULL AS skipped, z_score FROM judged"
    ),
    "anomaly_reset": (
        f"WITH {_past('events', 'value', 'PARTITION BY event_id // 1000', 'event_id')} SELECT event_id, z_score, is_anomaly, n FROM judged"
    ),
    "alerts_fired": FIRED + "SELECT rule_no, rule, event_id, fired_at FROM fired",
    "alerts_fired_in_cells": FIRED + "SELECT rule, event_id FROM fired",
    "alerts_log_entries": (
        f"WITH RECURSIVE {EV}, {_chain('errors', 'SELECT date_trunc(' + chr(39) + 'second' + chr(39) + ', ts) AS t FROM ev WHERE level = ' + chr(39) + 'ERROR' + chr(39), 3 * 3600)}"
        " SELECT min(event_id) AS seq, 'errors' AS rule, f.t AS fired_at FROM errors_fires f JOIN ev ON date_trunc('second', ev.ts) = f.t AND level = 'ERROR' GROUP BY f.t"
    ),
    "alert_on_anomaly": (
        f"WITH RECURSIVE {_past('events', 'value', '', 'event_id')}, {_chain('anomaly', 'SELECT ts AS t FROM judged WHERE is_anomaly', 86_400)}"
        " SELECT event_id, 'anomaly' AS rule FROM judged WHERE is_anomaly AND ts IN (SELECT t FROM anomaly_fires)"
    ),
    "alert_rules_per_entry": FIRED + "SELECT event_id, string_agg(rule, ',' ORDER BY rule_no) AS rules FROM fired GROUP BY event_id",
    "alert_routes": FIRED
    + "SELECT event_id, rule, 'chat' AS channel FROM fired WHERE rule_no IN (0, 2) UNION ALL SELECT event_id, rule, 'mail' FROM fired WHERE rule_no IN (0, 1)",
    "alert_delivery": FIRED
    + "SELECT 'chat' AS channel, true AS delivered, count(*) AS sent FROM fired WHERE rule_no IN (0, 2) UNION ALL SELECT 'mail', false, NULL",
    "alert_payload_chat": (
        "SELECT doc_id, ':rotating_light: *cairnlog alert: long text*' AS headline,"
        " '*Rule:* long text' || chr(10) || '*Level:* ' || lang || chr(10) || '*Message:* ' || left(text, 300) AS text FROM documents"
    ),
    "alert_payload_mail": (
        "SELECT doc_id, '[cairnlog] Alert: long text' AS subject, 'cairnlog Alert — long text' || chr(10) || repeat('=', 40) || chr(10)"
        " || 'Rule   : long text' || chr(10) || 'Level  : ' || lang || chr(10) || 'Message: ' || left(text, 500) || chr(10) || chr(10)"
        " || 'Full entry:' || chr(10) || '  doc_id: ' || doc_id || chr(10) || '  level: ' || lang || chr(10) || '  message: ' || text AS body FROM documents"
    ),
    # sinks
    "html_rows": (
        "SELECT page_id, '<tr class=\"level-warn\">' || chr(10) || '  <td>' || " + _ESCAPED.format("url")
        + " || '</td>' || chr(10) || '  <td class=\"level\">WARN</td>' || chr(10) || '  <td>' || " + _ESCAPED.format("html")
        + " || '</td>' || chr(10) || '</tr>' AS row FROM pages"
    ),
    "html_escape": f"SELECT page_id, md5({_ESCAPED.format('html')}) AS escaped_md5 FROM pages",
    "ndjson_lines": _mixed(
        "SELECT CASE turn WHEN 0 THEN '{\"timestamp\":\"' || iso || '\",\"k\":' || k || '}'"
        " WHEN 1 THEN '{\"timestamp\":\"' || apache_time || '\",\"status\":' || status || '}'"
        " WHEN 2 THEN '{\"timestamp\":\"' || syslog_time || '\",\"pid\":\"' || event_id || '\"}'"
        " ELSE '{\"raw\":true}' END AS line FROM mixed"
    ),
    "csv_export": "SELECT doc_id, lang, md5(text) AS text_md5 FROM documents",
    "custom_output": _ev("SELECT level || ' #' || event_id AS line FROM ev"),
    "materialised_result": _mixed(
        "SELECT row_number() OVER (ORDER BY count DESC, first) AS rank, value, count FROM"
        " (SELECT coalesce(e_level, 'unknown') AS value, count(*) AS count, min((file, seq)) AS first FROM entries GROUP BY 1) ORDER BY rank LIMIT 3"
    ),
    # streams
    "search_match_count": _ev("SELECT count(*) AS matches FROM ev WHERE level IN ('WARN', 'ERROR')"),
    "group_buckets_text_order": (
        "SELECT event_type AS \"group\", event_id, row_number() OVER (PARTITION BY event_type ORDER BY "
        "CASE WHEN event_id % 5 > 0 THEN 'w' || (event_id % 13) END NULLS FIRST, event_id) AS position FROM events"
    ),
    "alerts_tied_order": FIRED + "SELECT rule, event_id FROM fired",
    "alerts_within_one_cooldown": "SELECT 'any' AS rule, arg_min(event_id, ts) AS event_id FROM events",
    "stream_top_levels": _mixed(
        "SELECT e_level AS level, count(*) AS count FROM entries WHERE e_level IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5"
    ),
    "stream_counted_lines": _mixed(
        "SELECT count(*) FILTER (WHERE NOT (turn = 0 AND event_id % 9 = 0)) AS entries,"
        " count(*) FILTER (WHERE turn = 0 AND event_id % 9 = 0) AS failures, CAST(3 AS BIGINT) AS batches,"
        " count(*) FILTER (WHERE NOT (turn = 0 AND event_id % 9 = 0)) AS written FROM mixed"
    ),
    "stream_line_counters": _mixed(
        "SELECT count(*) FILTER (WHERE NOT (turn = 0 AND event_id % 9 = 0)) AS entries,"
        " count(*) FILTER (WHERE turn = 0 AND event_id % 9 = 0) AS failures FROM mixed"
    ),
    "stream_level_counts": _mixed("SELECT e_level AS level, count(*) AS count FROM entries WHERE e_level IS NOT NULL GROUP BY 1"),
    "stream_anomaly": (
        f"WITH {_past('events', 'value', 'PARTITION BY event_type', 'event_id')} SELECT event_type, event_id, z_score, is_anomaly, n FROM judged"
    ),
    "stream_alerts": FIRED + "SELECT rule_no, rule, event_id, fired_at FROM fired",
    "tail_new_lines": _mixed(
        "SELECT coalesce(e_timestamp, '') AS ts, coalesce(e_level, 'INFO') AS level,"
        " CASE turn WHEN 1 THEN 'GET /' || event_type || '/' || user_id || ' → ' || status || ' (' || bytes || ' B)'"
        " WHEN 2 THEN '[' || event_type || '] value ' || val ELSE e_message END AS msg FROM entries"
        " WHERE regexp_matches(raw, 'error|note', 'i')"
    ),
    "tail_from_now": _mixed(
        "SELECT coalesce(e_timestamp, '') AS ts, coalesce(e_level, 'INFO') AS level,"
        " CASE turn WHEN 1 THEN 'GET /' || event_type || '/' || user_id || ' → ' || status || ' (' || bytes || ' B)'"
        " WHEN 2 THEN '[' || event_type || '] value ' || val ELSE e_message END AS msg FROM entries"
        " WHERE event_id >= (SELECT min(event_id) + (max(event_id) + 1 - min(event_id)) // 3 FROM events)"
    ),
}

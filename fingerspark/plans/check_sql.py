"""SQL building blocks of the checks: the same projections and features in plain SQL."""

from __future__ import annotations

from fingerspark.functions.fixed import (
    CATEGORY_SYSCALLS,
    FEATURE_NAMES,
    FREQUENCY_SYSCALLS,
    NETWORK_EVENT_SYSCALLS,
    PRIVILEGED_SYSCALLS,
    PROCESS_CREATING_SYSCALLS,
    RISK_LEVELS,
    SEVERITY_TIERS,
    SYSCALL_NUMBERS,
)
from fingerspark.plans.telemetry import (
    AS_OF,
    NORMAL_PROCESSES,
    NORMAL_SYSCALLS,
    PORTS,
    SUSPICIOUS_PROCESSES,
    SUSPICIOUS_SYSCALLS,
    WINDOW,
)

NOW = f"TIMESTAMP '{AS_OF}'"


def listed(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def pick(values, index: str) -> str:
    items = ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values)
    return f"list_extract([{items}], CAST(({index}) % {len(values)} + 1 AS INT))"


def category(column: str) -> str:
    cases = " ".join(f"WHEN lower({column}) IN ({listed(v)}) THEN '{c}'" for c, v in CATEGORY_SYSCALLS.items())
    return f"CASE {cases} ELSE 'OTHER' END"


def severity(score: str) -> str:
    cases = " ".join(f"WHEN {score} >= CAST({f} AS DOUBLE) THEN '{n}'" for n, f in SEVERITY_TIERS)
    return f"CASE {cases} ELSE 'NONE' END"


def risk(rate: str, top: str) -> str:
    cases = " ".join(
        f"WHEN {top} >= CAST({s} AS DOUBLE) OR {rate} >= CAST({r} AS DOUBLE) THEN '{n}'"
        for n, s, r in RISK_LEVELS)
    return f"CASE {cases} ELSE 'LOW' END"


def syscall_name(column: str) -> str:
    cases = " ".join(f"WHEN {n} THEN '{v}'" for n, v in SYSCALL_NUMBERS.items())
    return f"CASE {column} {cases} ELSE concat('unknown_', {column}) END"


RUNTIME = f"""
base AS (
  SELECT event_id AS seq, ts, user_id, event_type,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k
  FROM events),
runtime AS (
  SELECT seq, k,
         concat('evt-', seq) AS event_id,
         ts AS "timestamp",
         CASE WHEN k = 0 THEN ' ' ELSE concat('c', user_id % 5) END AS container_id,
         user_id + 1000 AS pid,
         CASE WHEN k = 1 THEN NULL
              WHEN event_type = 'error' THEN {pick(SUSPICIOUS_SYSCALLS, 'seq + k')}
              WHEN event_type = 'purchase' THEN 'connect'
              WHEN k % 10 = 3 THEN upper({pick(NORMAL_SYSCALLS, 'seq + k')})
              ELSE {pick(NORMAL_SYSCALLS, 'seq + k')} END AS syscall,
         CASE WHEN event_type = 'error' THEN {pick(SUSPICIOUS_PROCESSES, 'seq + k')}
              ELSE {pick(NORMAL_PROCESSES, 'user_id')} END AS process_name,
         CAST(k AS BIGINT) AS return_value,
         CASE WHEN event_type = 'purchase' THEN concat('10.0.', user_id % 4, '.', k) END AS destination_ip,
         CASE WHEN event_type = 'purchase' THEN {pick(PORTS, 'k')} END AS port,
         CASE WHEN event_type = 'purchase' THEN 'TCP' END AS protocol,
         CAST(CASE WHEN event_type = 'error' AND k % 2 = 0 THEN 0 ELSE user_id + 1000 END AS BIGINT) AS uid,
         concat('node-', user_id % 3) AS hostname,
         concat('img', user_id % 5) AS image_name,
         concat('ns', user_id % 2) AS namespace
  FROM base),
copies AS (
  SELECT * FROM runtime
  UNION ALL BY NAME
  SELECT * REPLACE ("timestamp" + INTERVAL 1 SECOND AS "timestamp", 'copy' AS process_name)
  FROM runtime WHERE k = 5),
valid AS (
  SELECT * FROM runtime
  WHERE trim(container_id) <> '' AND syscall IS NOT NULL AND trim(syscall) <> ''),
processed AS (
  SELECT * REPLACE (lower(syscall) AS syscall),
         {category('syscall')} AS syscall_category,
         lower(syscall) IN ({listed(PRIVILEGED_SYSCALLS)}) AS is_privileged,
         lower(syscall) IN ({listed(NETWORK_EVENT_SYSCALLS)}) AS is_network_event
  FROM valid)"""


def feature_ctes(source: str = "placed", extra: str = "", seconds: str = str(WINDOW)) -> str:
    """CTE ``vectors`` from ``source``, which carries ws and we (and the columns of ``extra``)."""
    keys = f"container_id, ws, we{extra}"
    shares = ",\n".join(
        f"count(*) FILTER (syscall = '{name}') / CAST(count(*) AS DOUBLE) AS {feature}"
        for feature, name in FREQUENCY_SYSCALLS.items())
    key_list = [c.strip() for c in extra.split(",") if c.strip()]
    parts = ", ".join(
        ["container_id", "strftime(ws, '%Y%m%d%H%M%S')", f"CAST({seconds} AS VARCHAR)"]
        + [f"CAST({c} AS VARCHAR)" for c in key_list if c != "secs"])
    return f"""
totals AS (
  SELECT {keys}, max(image_name) AS image_name, count(*) AS total_events,
         {shares},
         CAST(count(DISTINCT process_name) AS INT) AS unique_process_count,
         CAST(count(DISTINCT syscall) AS INT) AS unique_syscall_count,
         count(*) FILTER (syscall IN ({listed(PROCESS_CREATING_SYSCALLS)})) / CAST({seconds} AS DOUBLE)
           AS process_creation_rate,
         CAST(count(DISTINCT destination_ip) AS INT) AS unique_dest_ips,
         CAST(count(DISTINCT port) AS INT) AS unique_dest_ports,
         count(*) FILTER (is_network_event) / CAST(count(*) AS DOUBLE) AS network_event_ratio,
         count(*) FILTER (is_privileged) / CAST(count(*) AS DOUBLE) AS privileged_event_ratio,
         count(*) FILTER (uid = 0) / CAST(count(*) AS DOUBLE) AS uid_zero_ratio
  FROM {source} GROUP BY {keys}),
syscall_shares AS (
  SELECT {keys}, syscall, count(*) AS n,
         count(*) / CAST(sum(count(*)) OVER (PARTITION BY {keys}) AS DOUBLE) AS p
  FROM {source} GROUP BY {keys}, syscall),
process_shares AS (
  SELECT {keys}, process_name,
         count(*) / CAST(sum(count(*)) OVER (PARTITION BY {keys}) AS DOUBLE) AS p
  FROM {source} GROUP BY {keys}, process_name),
syscall_bits AS (
  SELECT {keys}, -sum(p * log2(p)) AS syscall_entropy
  FROM syscall_shares WHERE syscall IS NOT NULL GROUP BY {keys}),
process_bits AS (
  SELECT {keys}, -sum(p * log2(p)) AS process_entropy
  FROM process_shares WHERE process_name IS NOT NULL GROUP BY {keys}),
vectors AS (
  SELECT md5(concat_ws('|', {parts})) AS vector_id, totals.*,
         coalesce(syscall_entropy, 0) AS syscall_entropy,
         coalesce(process_entropy, 0) AS process_entropy,
         ws AS window_start, we AS window_end, {seconds} AS window_duration_seconds
  FROM totals LEFT JOIN syscall_bits USING ({keys}) LEFT JOIN process_bits USING ({keys}))"""


PLACED = f"""
placed AS (
  SELECT *, time_bucket(INTERVAL {WINDOW} SECOND, "timestamp") AS ws,
         time_bucket(INTERVAL {WINDOW} SECOND, "timestamp") + INTERVAL {WINDOW} SECOND AS we
  FROM processed)"""

VECTORS = f"{RUNTIME},{PLACED},{feature_ctes()}"
FEATURE_LIST = ", ".join(FEATURE_NAMES)
ROUNDED_FEATURES = ", ".join(
    f"round({n}, 6) AS {n}" if not n.startswith("unique_") else n for n in FEATURE_NAMES)
VECTOR_ARRAY = "[" + ", ".join(f"CAST({n} AS DOUBLE)" for n in FEATURE_NAMES) + "]"
LONG = f"""
long AS (
  SELECT vector_id, container_id, image_name, window_start, window_end, total_events,
         unnest(range({len(FEATURE_NAMES)})) AS pos,
         unnest([{listed(FEATURE_NAMES)}]) AS feature,
         unnest({VECTOR_ARRAY}) AS value
  FROM vectors)"""

RESULTS = f"""
scored AS (
  SELECT event_id, ts, user_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) / CAST(100 AS DOUBLE) AS anomaly_score
  FROM events),
results AS (
  SELECT concat('r-', event_id) AS result_id, concat('v-', event_id) AS vector_id,
         concat('c', user_id % 40) AS container_id, ts AS detected_at, anomaly_score,
         anomaly_score > CAST(0.5 AS DOUBLE) AS is_anomalous,
         {severity('anomaly_score')} AS severity,
         '20240101000000' AS model_version,
         concat({pick(FEATURE_NAMES, 'k')}, ',', {pick(FEATURE_NAMES, 'k + 5')}) AS contributing_features
  FROM scored)"""

PROFILES = f"""
sums AS (
  SELECT container_id, count(*) AS total_events, count(*) FILTER (is_anomalous) AS total_anomalies,
         count(*) FILTER (is_anomalous) / CAST(count(*) AS DOUBLE) AS anomaly_rate,
         avg(anomaly_score) AS avg_anomaly_score, max(anomaly_score) AS max_anomaly_score,
         min(detected_at) AS first_seen, max(detected_at) AS last_seen
  FROM results GROUP BY container_id),
profiles AS (SELECT *, {risk('anomaly_rate', 'max_anomaly_score')} AS risk_level FROM sums)"""

ALERTS = """
alerts AS (
  SELECT md5(concat_ws('|', 'alert', result_id)) AS alert_id, result_id, container_id, severity,
         anomaly_score,
         concat('[', severity, '] Anomaly detected on container ', container_id) AS title,
         concat('score=', printf('%.4f', anomaly_score), ' severity=', severity, ' resultId=', result_id)
           AS description,
         FALSE AS acknowledged, detected_at AS created_at
  FROM results WHERE is_anomalous AND severity IN ('HIGH', 'CRITICAL'))"""

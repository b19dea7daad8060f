"""Registered queries: anomaly analytics, profiles, alerts."""

from __future__ import annotations

from hashlib import md5
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fingerspark.functions.scoring import risk_level
from fingerspark.operators import alerts, analytics, profiles
from fingerspark.operators.paging import by_id, page_rows
from fingerspark.operators.results import stored_form
from fingerspark.plans import telemetry
from fingerspark.plans.check_sql import ALERTS, NOW, PROFILES, RESULTS, RUNTIME, risk
from fingerspark.plans.feature_queries import rounded
from fingerspark.plans.registered import query
from fingerspark.plans.telemetry import AS_OF, anomaly_results, read
from fingerspark.sources.tables import durable, shared_folder

RESULT = ("result_id, vector_id, container_id, detected_at, anomaly_score, is_anomalous, severity, "
          "model_version, contributing_features")
_MONTH = "2024-01-01 00:00:00"
# Decimals of shown averages of scores.
SCORE_DIGITS = 10


def _shown(df: DataFrame) -> DataFrame:
    return stored_form(df).select(*RESULT.split(", "))


@query(f"""WITH {RESULTS} SELECT {RESULT} FROM results
WHERE detected_at BETWEEN {NOW} - INTERVAL 24 HOUR AND {NOW}
ORDER BY detected_at DESC, result_id LIMIT 20 OFFSET 40""")
def anomaly_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(analytics.anomaly_page(anomaly_results(spark, sf_dir), AS_OF, page=2, size=20))


@query(f"""WITH {RESULTS} SELECT {RESULT} FROM results
WHERE detected_at BETWEEN TIMESTAMP '{_MONTH}' AND {NOW} AND severity = 'HIGH' AND container_id = 'c7'
ORDER BY detected_at DESC, result_id LIMIT 500""")
def anomaly_page_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(analytics.anomaly_page(
        anomaly_results(spark, sf_dir), AS_OF, page=0, size=500, severity="high",
        container_id="c7", start=_MONTH))


@query(f"""WITH {RESULTS} SELECT {RESULT} FROM results
WHERE detected_at BETWEEN TIMESTAMP '{_MONTH}' AND {NOW}
ORDER BY detected_at DESC, result_id LIMIT 200 OFFSET 400""")
def anomaly_page_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page far down."""
    found = analytics.find_anomalies(anomaly_results(spark, sf_dir), AS_OF, start=_MONTH)
    return _shown(page_rows(found, "detected_at", "result_id", 2, 200))


def _timeless(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of which those of container c3 have no time."""
    none = F.lit(None).cast("timestamp_ntz")
    return anomaly_results(spark, sf_dir).withColumn(
        "detected_at", F.when(F.col("container_id") == "c3", none).otherwise(F.col("detected_at")))


_TIMELESS = f"""WITH {RESULTS},
timeless AS (SELECT * REPLACE (CASE WHEN container_id <> 'c3' THEN detected_at END AS detected_at) FROM results)
SELECT result_id, detected_at FROM timeless ORDER BY detected_at DESC NULLS LAST, result_id"""


@query(f"{_TIMELESS} LIMIT 900 OFFSET (SELECT count(*) // 900 * 900 FROM results)")
def anomaly_page_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last page, where rows without a time stand."""
    found = durable(_timeless(spark, sf_dir))
    return page_rows(found, "detected_at", "result_id", found.count() // 900, 900).select("result_id", "detected_at")


@query(f"{_TIMELESS} LIMIT 900")
def anomaly_page_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_rows(_timeless(spark, sf_dir), "detected_at", "result_id", 0, 900).select("result_id", "detected_at")


@query(f"""WITH {RESULTS}
SELECT 2 AS page, 20 AS size, count(*) AS total_elements, CAST(ceil(count(*) / 20) AS INT) AS total_pages,
       2 < ceil(count(*) / 20) - 1 AS has_next
FROM results WHERE detected_at BETWEEN {NOW} - INTERVAL 24 HOUR AND {NOW}""")
def anomaly_page_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.anomaly_envelope(anomaly_results(spark, sf_dir), AS_OF, page=2, size=20)


@query(f"WITH {RESULTS} SELECT {RESULT} FROM results WHERE result_id = 'r-77'")
def anomaly_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(by_id(anomaly_results(spark, sf_dir), "result_id", "r-77"))


@query(f"""WITH {RESULTS}
SELECT count(*) FILTER (is_anomalous) AS total_anomalies, count(*) AS total_scored,
       round(coalesce(avg(anomaly_score), 0), 10) AS avg_anomaly_score,
       count(*) FILTER (severity = 'CRITICAL') AS critical_count, count(*) FILTER (severity = 'HIGH') AS high_count,
       count(DISTINCT CASE WHEN is_anomalous THEN container_id END) AS affected_containers,
       TIMESTAMP '{_MONTH}' AS since, {NOW} AS generated_at
FROM results WHERE detected_at > TIMESTAMP '{_MONTH}'""")
def anomaly_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = analytics.stats(anomaly_results(spark, sf_dir), _MONTH, AS_OF)
    return rounded(found, "avg_anomaly_score", digits=SCORE_DIGITS)


def _bucket(minutes: int) -> str:
    return f"date_trunc('minute', detected_at) - to_minutes(minute(detected_at) % {minutes})"


def _trend_sql(minutes: int, low: str) -> str:
    return f"""WITH {RESULTS}
SELECT {_bucket(minutes)} AS bucket, count(*) AS total, count(*) FILTER (is_anomalous) AS anomalies,
       round(avg(anomaly_score), 10) AS avg_score
FROM results WHERE detected_at BETWEEN {low} AND {NOW} GROUP BY 1"""


def shown_averages(df: DataFrame) -> DataFrame:
    return rounded(df, "avg_score", digits=SCORE_DIGITS)


@query(_trend_sql(15, f"{NOW} - INTERVAL 24 HOUR"))
def anomaly_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown_averages(analytics.anomaly_trend(anomaly_results(spark, sf_dir), AS_OF))


@query(_trend_sql(7, f"TIMESTAMP '{_MONTH}'"))
def anomaly_trend_odd_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown_averages(analytics.anomaly_trend(
        anomaly_results(spark, sf_dir), AS_OF, bucket_minutes=7, start=_MONTH))


@query(_trend_sql(9999, f"TIMESTAMP '{_MONTH}'"))
def anomaly_trend_whole_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown_averages(analytics.anomaly_trend(
        anomaly_results(spark, sf_dir), AS_OF, bucket_minutes=9999, start=_MONTH))


@query(f"""WITH {RESULTS}
SELECT {_bucket(15)} AS bucket, severity, count(*) AS "count" FROM results
WHERE detected_at BETWEEN TIMESTAMP '{_MONTH}' AND {NOW} AND is_anomalous GROUP BY 1, 2""")
def severity_over_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.severity_over_time(anomaly_results(spark, sf_dir), AS_OF, start=_MONTH)


@query(f"""WITH {RESULTS}
SELECT container_id, count(*) AS anomaly_count, max(anomaly_score) AS max_score, round(avg(anomaly_score), 10) AS avg_score,
       CASE max(CASE severity WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END)
            WHEN 4 THEN 'CRITICAL' WHEN 3 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' ELSE 'LOW' END AS worst_severity,
       max(severity) AS max_severity_lex
FROM results WHERE is_anomalous AND detected_at > {NOW} - INTERVAL 240 HOUR
GROUP BY container_id ORDER BY anomaly_count DESC, max_score DESC, container_id LIMIT 10""")
def top_risky_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown_averages(analytics.top_risky_containers(
        anomaly_results(spark, sf_dir), AS_OF, hours=240, limit=10))


PROFILE = ("container_id, first_seen, last_seen, total_events, total_anomalies, anomaly_rate, "
           "avg_anomaly_score, max_anomaly_score, risk_level")
SQL_PROFILE = PROFILE.replace("anomaly_rate", "round(anomaly_rate, 6) AS anomaly_rate").replace(
    "avg_anomaly_score", "round(avg_anomaly_score, 10) AS avg_anomaly_score")


def shown_profiles(df: DataFrame) -> DataFrame:
    shown = rounded(df.select(*PROFILE.split(", ")), "anomaly_rate")
    return rounded(shown, "avg_anomaly_score", digits=SCORE_DIGITS)


@query(f"WITH {RESULTS}, {PROFILES} SELECT {SQL_PROFILE} FROM profiles")
def container_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown_profiles(profiles.container_profiles(anomaly_results(spark, sf_dir)))


_SPLIT = "2024-01-20 00:00:00"


@query(f"""WITH {RESULTS}, {PROFILES} SELECT {SQL_PROFILE} FROM profiles
UNION ALL SELECT 'early only', TIMESTAMP '{_MONTH}', TIMESTAMP '{_MONTH}', 1, 1, 1e0, 0.9e0, 0.9e0, {risk('1e0', '0.9e0')}
UNION ALL SELECT 'late only', {NOW}, {NOW}, 1, 0, 0e0, 0.2e0, 0.2e0, {risk('0e0', '0.2e0')}""")
def profile_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored profiles plus later results; besides, a container without news and a new one."""
    results = anomaly_results(spark, sf_dir)
    early = F.col("detected_at") < F.lit(_SPLIT).cast("timestamp_ntz")

    def single(container: str, at: str, score: float, flag: bool) -> DataFrame:
        one = results.orderBy("result_id").limit(1)
        return one.withColumns({"container_id": F.lit(container), "detected_at": F.lit(at).cast("timestamp_ntz"),
                                "anomaly_score": F.lit(score), "is_anomalous": F.lit(flag)})

    state = profiles.container_profiles(results.filter(early).unionByName(single("early only", _MONTH, 0.9, True)))
    delta = profiles.profile_delta(results.filter(~early).unionByName(single("late only", AS_OF, 0.2, False)))
    return shown_profiles(profiles.merge_profiles(state, delta))


@query(f"""WITH {RESULTS}
SELECT result_id, container_id, count(*) OVER w AS seen, round(avg(anomaly_score) OVER w, 10) AS running_avg
FROM results
WINDOW w AS (PARTITION BY container_id ORDER BY detected_at, result_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def profile_running_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = profiles.score_trajectory(anomaly_results(spark, sf_dir))
    shown = path.select("result_id", "container_id", "seen", "running_avg")
    return rounded(shown, "running_avg", digits=SCORE_DIGITS)


@query(f"""WITH {RUNTIME},
flat AS (SELECT container_id, 'syscall' AS kind, syscall AS value FROM processed
         UNION ALL SELECT container_id, 'process', process_name FROM processed
         UNION ALL SELECT container_id, 'destination', destination_ip FROM processed),
sizes AS (SELECT container_id, count(*) AS total FROM processed GROUP BY 1)
SELECT container_id, kind, value, count(*) AS n, round(count(*) / any_value(total), 6) AS share
FROM flat JOIN sizes USING (container_id) WHERE value IS NOT NULL GROUP BY 1, 2, 3""")
def profile_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(profiles.baseline_behaviour(telemetry.stored_events(spark, sf_dir)), "share")


@query(f"""WITH {RUNTIME},
shares AS (SELECT container_id, syscall, count(*) / sum(count(*)) OVER (PARTITION BY container_id) AS share
           FROM processed GROUP BY 1, 2),
texts AS (SELECT container_id, string_agg(printf('%s:%.6f', syscall, share), ',' ORDER BY syscall) AS syscall_distribution
          FROM shares WHERE syscall IS NOT NULL GROUP BY 1)
SELECT container_id, syscall_distribution, string_agg(DISTINCT process_name, ',' ORDER BY process_name) AS process_list,
       string_agg(DISTINCT destination_ip, ',' ORDER BY destination_ip) AS network_destinations
FROM processed JOIN texts USING (container_id) GROUP BY 1, 2""")
def profile_baseline_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = profiles.behaviour_columns(profiles.baseline_behaviour(telemetry.stored_events(spark, sf_dir)))
    shares = F.transform(F.array_sort(F.map_entries("baseline_syscall_distribution")),
                         lambda e: F.format_string("%s:%.6f", e["key"], e["value"]))
    return shown.select(
        "container_id", F.array_join(shares, ",").alias("syscall_distribution"),
        F.concat_ws(",", "baseline_process_list").alias("process_list"),
        F.concat_ws(",", "baseline_network_destinations").alias("network_destinations"))


@query(f"""WITH {RESULTS}, {PROFILES}
SELECT {SQL_PROFILE} FROM profiles WHERE risk_level = 'CRITICAL'
ORDER BY last_seen DESC, container_id LIMIT 15 OFFSET 15""")
def container_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = profiles.container_profiles(anomaly_results(spark, sf_dir))
    return shown_profiles(profiles.container_page(found, page=1, size=15, risk_level="critical"))


@query(f"""WITH {RESULTS}, {PROFILES}
SELECT 0 AS page, 15 AS size, count(*) AS total_elements, CAST(ceil(count(*) / 15) AS INT) AS total_pages,
       0 < ceil(count(*) / 15) - 1 AS has_next FROM profiles""")
def container_page_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = profiles.container_profiles(anomaly_results(spark, sf_dir))
    return profiles.container_envelope(found, page=0, size=15)


@query(f"WITH {RESULTS}, {PROFILES} SELECT {SQL_PROFILE} FROM profiles WHERE container_id = 'c9'")
def container_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = profiles.container_profiles(anomaly_results(spark, sf_dir))
    return shown_profiles(by_id(found, "container_id", "c9"))


_RATES = ["CAST(user_id % 41 AS DOUBLE) / 100e0", "CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) / 100e0"]


@query(f"""SELECT {risk(*_RATES)} AS risk_level, count(*) AS n FROM events GROUP BY 1""")
def risk_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rate = (F.col("user_id") % 41).cast("double") / F.lit(100.0)
    top = F.regexp_extract("props", "([0-9]+)", 1).cast("double") / F.lit(100.0)
    return read(spark, sf_dir, "events").groupBy(risk_level(rate, top).alias("risk_level")).agg(F.count("*").alias("n"))


ALERT = "alert_id, result_id, container_id, severity, title, description, anomaly_score, acknowledged, created_at"


def _alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alerts.raise_alerts(anomaly_results(spark, sf_dir))


@query(f"WITH {RESULTS}, {ALERTS} SELECT {ALERT} FROM alerts")
def alerts_created(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _alerts(spark, sf_dir).select(*ALERT.split(", "))


@query(f"""WITH {RESULTS}, {ALERTS}
SELECT alert_id, CAST(to_json({{'alert_id': alert_id, 'container_id': container_id, 'severity': severity,
  'anomaly_score': anomaly_score, 'title': title,
  'triggered_at': strftime(created_at, '%Y-%m-%dT%H:%M:%S.%fZ')}}) AS VARCHAR) AS payload FROM alerts""")
def alert_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alerts.webhook_payloads(_alerts(spark, sf_dir))


@query(f"""WITH {RESULTS}, {ALERTS} SELECT {ALERT} FROM alerts WHERE severity = 'CRITICAL'
ORDER BY created_at DESC, alert_id LIMIT 25 OFFSET 25""")
def alert_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alerts.alert_page(
        _alerts(spark, sf_dir), page=1, size=25, severity="critical", acknowledged=False).select(*ALERT.split(", "))


@query(f"""WITH {RESULTS}, {ALERTS}
SELECT 1 AS page, 25 AS size, count(*) AS total_elements, CAST(ceil(count(*) / 25) AS INT) AS total_pages,
       1 < ceil(count(*) / 25) - 1 AS has_next FROM alerts WHERE severity = 'CRITICAL'""")
def alert_page_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alerts.alert_envelope(_alerts(spark, sf_dir), page=1, size=25, severity="critical")


@query(f"WITH {RESULTS}, {ALERTS} SELECT {ALERT} FROM alerts WHERE alert_id = md5('alert|r-1')")
def alert_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = md5(b"alert|r-1").hexdigest()
    return by_id(_alerts(spark, sf_dir), "alert_id", wanted).select(*ALERT.split(", "))


def _requests(raised: DataFrame) -> DataFrame:
    """Two acknowledgements of every critical alert, a second apart; the earlier is ann's."""
    minute = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(1), F.lit(0))
    second = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(1), F.lit(1))
    chosen = raised.filter("severity = 'CRITICAL'")
    first = chosen.select("alert_id", F.lit("ann").alias("acknowledged_by"),
                          (F.col("created_at") + minute).alias("acknowledged_at"))
    return first.unionByName(chosen.select(
        "alert_id", F.lit("bob").alias("acknowledged_by"), (F.col("created_at") + second).alias("acknowledged_at")))


@query(f"""WITH {RESULTS}, {ALERTS},
marked AS (SELECT *, severity = 'CRITICAL' AS wanted, container_id IN ('c7', 'c8') AS done FROM alerts)
SELECT alert_id, wanted OR done AS acknowledged, wanted AND NOT done AS updated,
       CASE WHEN done THEN 'eve' WHEN wanted THEN 'ann' END AS acknowledged_by,
       CASE WHEN done THEN created_at WHEN wanted THEN created_at + INTERVAL 1 MINUTE END AS acknowledged_at
FROM marked""")
def alerts_acknowledged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests against alerts of which those of two containers are acknowledged already."""
    raised = _alerts(spark, sf_dir)
    done = F.col("container_id").isin("c7", "c8")
    stored = raised.withColumns({
        "acknowledged": done,
        "acknowledged_by": F.when(done, F.lit("eve")),
        "acknowledged_at": F.when(done, F.col("created_at")),
    })
    return alerts.acknowledge(stored, _requests(raised)).select(
        "alert_id", "acknowledged", "updated", "acknowledged_by", "acknowledged_at")


@query(f"""WITH {RESULTS}, {ALERTS}
SELECT alert_id, 'ann' AS acknowledged_by, created_at FROM alerts WHERE severity = 'CRITICAL'
ORDER BY created_at DESC, alert_id LIMIT 25 OFFSET 25""")
def alerts_acknowledged_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Acknowledgements stored in two batches, one of them again, then a page of the acknowledged."""
    root = f"{shared_folder(spark)}/alerts-{uuid4().hex}"
    raised = _alerts(spark, sf_dir)
    wanted = _requests(raised)
    for batch, by in ((0, "bob"), (1, "ann"), (1, "ann")):
        alerts.store_acknowledgements(wanted.filter(F.col("acknowledged_by") == by), root, batch)
    return alerts.alert_page(alerts.current_alerts(raised, root), page=1, size=25, acknowledged=True).select(
        "alert_id", "acknowledged_by", "created_at")


@query(f"""WITH {RESULTS}, {ALERTS}
SELECT alert_id, result_id, r.vector_id, r.model_version, r.contributing_features, e.user_id AS total_events
FROM alerts JOIN results r USING (result_id) JOIN events e ON r.vector_id = concat('v-', e.event_id)""")
def alert_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts joined to the result and the vector behind them."""
    results = anomaly_results(spark, sf_dir)
    vectors = read(spark, sf_dir, "events").selectExpr(
        "concat('v-', event_id) AS vector_id", "user_id AS total_events",
        "CAST(array() AS ARRAY<DOUBLE>) AS features")
    lineage = alerts.alert_lineage(alerts.raise_alerts(results), results, vectors)
    return lineage.select(
        "alert_id", "result_id", "vector_id", "model_version",
        F.concat_ws(",", "contributing_features").alias("contributing_features"), "total_events")

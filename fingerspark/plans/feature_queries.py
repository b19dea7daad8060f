"""Registered queries: window features and baselines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fingerspark.functions.fixed import FEATURE_NAMES
from fingerspark.functions.scoring import clean_vector
from fingerspark.operators import baseline, features
from fingerspark.plans.check_sql import (
    LONG,
    ROUNDED_FEATURES,
    RUNTIME,
    VECTORS,
    feature_ctes,
)
from fingerspark.plans.registered import query
from fingerspark.plans.telemetry import (
    WINDOW,
    feature_vectors,
    processed_events,
    stored_events,
    stored_vectors,
)
from fingerspark.sources.tables import durable

IDENTITY = "vector_id, container_id, image_name, window_start, window_end, window_duration_seconds, total_events"


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# Decimals of shown means and deviations.
_DIGITS = 9


_DOUBLES = [n for n in FEATURE_NAMES if not n.startswith("unique_")]


def flat(vectors: DataFrame, *more: str) -> DataFrame:
    return rounded(vectors.select(*IDENTITY.split(", "), *FEATURE_NAMES, *more), *_DOUBLES)


@query(f"WITH {VECTORS} SELECT {IDENTITY}, {ROUNDED_FEATURES} FROM vectors")
def window_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship slice: events to 18 features per container and window."""
    return flat(feature_vectors(spark, sf_dir))


@query(f"WITH {VECTORS}, {LONG} SELECT vector_id, pos, feature, round(value, 6) AS value FROM long")
def feature_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features.feature_rows(feature_vectors(spark, sf_dir))
    return rounded(rows.select("vector_id", F.col("pos").cast("bigint").alias("pos"), "feature", "value"), "value")


@query(f"""WITH {VECTORS}
SELECT vector_id, syscall, n FROM syscall_shares
JOIN vectors USING (container_id, ws, we) WHERE syscall IS NOT NULL""")
def syscall_frequency_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.frequency_rows(feature_vectors(spark, sf_dir)).select("vector_id", "syscall", "n")


@query(f"""WITH {VECTORS},
texts AS (SELECT container_id, ws, concat('{{', string_agg(concat('"', syscall, '":', n), ',' ORDER BY syscall), '}}') AS t
          FROM syscall_shares WHERE syscall IS NOT NULL GROUP BY 1, 2)
SELECT {IDENTITY}, {ROUNDED_FEATURES}, t AS syscall_frequencies_json FROM vectors JOIN texts USING (container_id, ws)""")
def feature_vector_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors in the flat form they are stored in."""
    return features.stored_form(feature_vectors(spark, sf_dir)).select(
        *IDENTITY.split(", "), *FEATURE_NAMES, "syscall_frequencies_json")


_HOUR = 3600


@query(f"""WITH {RUNTIME},
placed AS (SELECT *, time_bucket(INTERVAL 1 HOUR, "timestamp") AS ws,
                  time_bucket(INTERVAL 1 HOUR, "timestamp") + INTERVAL 1 HOUR AS we FROM processed),
{feature_ctes(seconds=str(_HOUR))},
spans AS (SELECT container_id, min(ws) AS a, max(ws) AS b FROM vectors GROUP BY 1),
spine AS (SELECT container_id, unnest(range(a, b + INTERVAL 1 HOUR, INTERVAL 1 HOUR)) AS ws FROM spans)
SELECT coalesce(vector_id, md5(concat_ws('|', container_id, strftime(ws, '%Y%m%d%H%M%S'), '0'))) AS vector_id,
       container_id, ws AS window_start, ws + INTERVAL 1 HOUR AS window_end,
       coalesce(window_duration_seconds, 0) AS window_duration_seconds,
       coalesce(total_events, 0) AS total_events,
       round(syscall_entropy, 6) AS syscall_entropy,
       unique_process_count,
       round(coalesce(network_event_ratio, 0), 6) AS network_element
FROM spine LEFT JOIN vectors USING (container_id, ws)""")
def window_spine_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    filled = features.fill_empty_windows(stored_vectors(spark, sf_dir, _HOUR), _HOUR)
    network = F.get("features", F.lit(FEATURE_NAMES.index("network_event_ratio")))
    return rounded(filled.select(
        "vector_id", "container_id", "window_start", "window_end", "window_duration_seconds",
        "total_events", "syscall_entropy", "unique_process_count", network.alias("network_element"),
    ), "syscall_entropy", "network_element")


@query(f"""WITH {RUNTIME},
placed AS (
  SELECT *, (row_number() OVER (PARTITION BY container_id, ws ORDER BY "timestamp", event_id) - 1) // 10 AS chunk
  FROM (SELECT *, time_bucket(INTERVAL {WINDOW} SECOND, "timestamp") AS ws,
               time_bucket(INTERVAL {WINDOW} SECOND, "timestamp") + INTERVAL {WINDOW} SECOND AS we
        FROM processed)),
{feature_ctes(extra=', chunk')}
SELECT {IDENTITY}, chunk, {ROUNDED_FEATURES} FROM vectors""")
def window_features_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    capped = features.capped_window_features(stored_events(spark, sf_dir), WINDOW, max_events=10)
    return flat(capped, "chunk")


_LENGTHS = (1800, 21600, 86400)


@query(f"""WITH {RUNTIME},
placed AS (
  SELECT *, time_bucket(to_seconds(secs), "timestamp") AS ws,
         time_bucket(to_seconds(secs), "timestamp") + to_seconds(secs) AS we
  FROM processed, (SELECT unnest({list(_LENGTHS)}) AS secs)),
{feature_ctes(extra=', secs', seconds='secs')}
SELECT {IDENTITY}, {ROUNDED_FEATURES} FROM vectors""")
def window_features_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(features.multi_resolution_features(stored_events(spark, sf_dir), _LENGTHS))


@query(f"""WITH {RUNTIME},
placed AS (
  SELECT *, ws + INTERVAL {WINDOW} SECOND AS we FROM (
    SELECT *, time_bucket(INTERVAL 2 HOUR, "timestamp") - to_hours(2 * CAST(unnest(range(3)) AS INT)) AS ws
    FROM processed)),
{feature_ctes()}
SELECT {IDENTITY}, {ROUNDED_FEATURES} FROM vectors""")
def window_features_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(features.window_features(processed_events(spark, sf_dir), WINDOW, slide_seconds=7200))


@query(f"""WITH {VECTORS}, {LONG}
SELECT vector_id, pos, round(CASE WHEN (pos + total_events) % 7 < 3 THEN 0 ELSE value END, 6) AS value
FROM long""")
def clean_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NaN, inf and -inf planted by position, then cleaned away."""
    def damage(x, i):
        spot = (i + F.col("total_events")) % 7
        return (F.when(spot == 0, F.lit(float("nan"))).when(spot == 1, F.lit(float("inf")))
                .when(spot == 2, F.lit(float("-inf"))).otherwise(x))

    damaged = feature_vectors(spark, sf_dir).withColumn("features", F.transform("features", damage))
    rows = damaged.select("vector_id", F.posexplode(clean_vector(F.col("features"))).alias("pos", "value"))
    return rounded(rows.withColumn("pos", F.col("pos").cast("bigint")), "value")


_GLOBAL = f"""WITH {VECTORS}, {LONG}
SELECT pos, feature, count(*) AS n, round(avg(value), {_DIGITS}) AS mean,
       round(greatest(stddev_pop(value), 1e-8), {_DIGITS}) AS std
FROM long GROUP BY pos, feature"""


def _long_baseline(df: DataFrame) -> DataFrame:
    rows = baseline.baseline_rows(df)
    return rounded(rows.withColumn("pos", F.col("pos").cast("bigint")), "mean", "std", digits=_DIGITS)


@query(_GLOBAL)
def global_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long_baseline(baseline.global_baseline(feature_vectors(spark, sf_dir)))


_IMAGE = f"""SELECT image_name, pos, feature, count(*) AS n, round(avg(value), {_DIGITS}) AS mean,
       CASE WHEN count(*) > 1 THEN round(sqrt(greatest(var_samp(value), 1e-8)), {_DIGITS}) END AS std
FROM long GROUP BY image_name, pos, feature"""


@query(f"WITH {VECTORS}, {LONG} {_IMAGE}")
def image_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long_baseline(baseline.image_baseline(feature_vectors(spark, sf_dir)))


@query(f"WITH {VECTORS}, {LONG} {_IMAGE}")
def image_baseline_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same baseline, folded from two halves of the vectors."""
    vectors = stored_vectors(spark, sf_dir)
    early = F.hour("window_start") < 12
    halves = [baseline.image_moments(vectors.filter(c)) for c in (early, ~early)]
    return _long_baseline(baseline.baseline_of_moments(baseline.merge_moments(*halves)))


@query(f"""WITH {VECTORS}, {LONG}
SELECT vector_id, pos, count(*) OVER w AS n, round(avg(value) OVER w, {_DIGITS}) AS mean,
       CASE WHEN count(*) OVER w > 1
            THEN round(sqrt(greatest(var_samp(value) OVER w, 1e-8)), {_DIGITS}) END AS std
FROM long
WINDOW w AS (PARTITION BY image_name, pos ORDER BY window_end, vector_id
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def online_image_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    online = baseline.online_image_baseline(stored_vectors(spark, sf_dir))
    rows = baseline.baseline_rows(online).select(
        "vector_id", F.col("pos").cast("bigint").alias("pos"), "n", "mean", "std")
    return rounded(rows, "mean", "std", digits=_DIGITS)


_MIDDLE = "2024-01-16 00:00:00"


@query(f"""WITH {VECTORS}, {LONG},
old AS (SELECT pos, avg(value) AS m, greatest(stddev_pop(value), 1e-8) AS s
        FROM long WHERE window_end <= TIMESTAMP '{_MIDDLE}' GROUP BY pos),
new AS (SELECT pos, avg(value) AS m FROM long WHERE window_end > TIMESTAMP '{_MIDDLE}' GROUP BY pos)
SELECT round(avg(abs(new.m - old.m) / old.s), 6) AS drift_score FROM new JOIN old USING (pos)""")
def drift_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = stored_vectors(spark, sf_dir)
    early = F.col("window_end") <= F.lit(_MIDDLE).cast("timestamp_ntz")
    drift = baseline.drift_score(
        baseline.global_baseline(vectors.filter(~early)), baseline.global_baseline(vectors.filter(early)))
    return rounded(drift, "drift_score")


_TOP = """
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY vector_id ORDER BY round(deviation, 9) DESC, pos) AS nth FROM deviations)
SELECT vector_id, string_agg(feature, ',' ORDER BY nth) AS contributing_features
FROM ranked WHERE nth <= 5 GROUP BY vector_id"""


@query(f"""WITH {VECTORS}, {LONG},
images AS (SELECT image_name, pos, avg(value) AS m, sqrt(greatest(var_samp(value), 1e-8)) AS s
           FROM long GROUP BY image_name, pos HAVING count(*) > 1),
overall AS (SELECT pos, avg(value) AS m, greatest(stddev_pop(value), 1e-8) AS s FROM long GROUP BY pos),
deviations AS (
  SELECT vector_id, l.pos, feature, abs(value - coalesce(i.m, o.m)) / coalesce(i.s, o.s) AS deviation
  FROM long l JOIN overall o USING (pos) LEFT JOIN images i ON i.image_name = l.image_name AND i.pos = l.pos),
{_TOP}""")
def contributing_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = stored_vectors(spark, sf_dir)
    explained = baseline.contributing_features(
        vectors, durable(baseline.image_baseline(vectors)), durable(baseline.global_baseline(vectors)))
    return explained.select("vector_id", F.concat_ws(",", "contributing_features").alias("contributing_features"))


@query(f"""WITH {VECTORS}, {LONG},
deviations AS (SELECT vector_id, pos, feature, abs(value) AS deviation FROM long),
{_TOP}""")
def contributing_features_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without any baseline the largest values count."""
    explained = baseline.contributing_features(feature_vectors(spark, sf_dir))
    return explained.select("vector_id", F.concat_ws(",", "contributing_features").alias("contributing_features"))


@query(f"WITH {VECTORS} SELECT vector_id, window_end FROM vectors")
def training_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return baseline.training_buffer(feature_vectors(spark, sf_dir)).select("vector_id", "window_end")


@query(f"""WITH {VECTORS} SELECT vector_id, window_end FROM vectors WHERE window_end >= TIMESTAMP '{_MIDDLE}'""")
def training_buffer_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    return baseline.training_buffer(feature_vectors(spark, sf_dir), since=_MIDDLE).select("vector_id", "window_end")


@query(f"""WITH {VECTORS}
SELECT vector_id, window_end FROM vectors ORDER BY window_end DESC, vector_id LIMIT 200""")
def training_buffer_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return baseline.training_buffer(stored_vectors(spark, sf_dir), size=200).select("vector_id", "window_end")

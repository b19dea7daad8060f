"""Registered queries: forest, scoring, results, registry, evaluation."""

from __future__ import annotations

from datetime import datetime
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fingerspark.functions.fixed import (
    FEATURE_COUNT,
    FEATURE_NAMES,
    FEATURE_SCHEMA_VERSION,
)

from fingerspark.operators import alerts, baseline, evaluation, features, forest, registry, results
from fingerspark.operators.paging import by_id
from fingerspark.plans.check_sql import LONG, RESULTS, VECTORS, severity as sql_severity
from fingerspark.plans.feature_queries import rounded
from fingerspark.plans.registered import query
from fingerspark.plans.retrain import REGISTRY, keep_samples, read_versions, retrain, stored_samples
from fingerspark.plans.telemetry import AS_OF, anomaly_results, feature_vectors, read, stored_vectors
from fingerspark.sources.schemas import FOREST_NODE
from fingerspark.sources.tables import durable, shared_folder, write_clustered

# Trees, rows of a tree, and rows to train on at least.
TREES, SAMPLE, MINIMUM = 200, 1024, 100


def _training(vectors: DataFrame) -> DataFrame:
    return durable(baseline.training_buffer(vectors))


_SAMPLE_SQL = """WITH {vectors},
hashed AS (SELECT vector_id, md5(concat_ws('|', '42', vector_id)) AS h FROM vectors),
halves AS (SELECT vector_id, CAST(concat('0x', substr(h, 1, 8)) AS BIGINT) AS a,
                  CAST(concat('0x', substr(h, 9, 8)) AS BIGINT) | 1 AS b FROM hashed),
drawn AS (SELECT tree_id, vector_id, (a + tree_id * b) % 4294967296 AS number
          FROM halves, (SELECT unnest(range({trees})) AS tree_id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY tree_id ORDER BY number, vector_id) AS nth FROM drawn)
SELECT CAST(tree_id AS INT) AS tree_id, vector_id FROM ranked WHERE nth <= {sample}"""


@query(_SAMPLE_SQL.format(vectors=VECTORS, trees=TREES, sample=SAMPLE))
def tree_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.tree_samples(_training(stored_vectors(spark, sf_dir)), one_hash=True).select("tree_id", "vector_id")


@query(f"""WITH {VECTORS},
drawn AS (SELECT tree_id, vector_id,
                 CAST(concat('0x', substr(md5(concat_ws('|', '42', tree_id, vector_id)), 1, 8)) AS BIGINT) AS number
          FROM vectors, (SELECT unnest(range(20)) AS tree_id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY tree_id ORDER BY number, vector_id) AS nth FROM drawn)
SELECT CAST(tree_id AS INT) AS tree_id, vector_id FROM ranked WHERE nth <= 64""")
def tree_samples_of_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fewer rows a tree than there are vectors, so that the draw decides."""
    return forest.tree_samples(_training(stored_vectors(spark, sf_dir)), 20, 64).select("tree_id", "vector_id")


@query(_SAMPLE_SQL.format(vectors=VECTORS, trees=20, sample=64))
def tree_samples_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples drawn by one hash a vector, kept in three batches without looking at earlier ones again."""
    root = f"{shared_folder(spark)}/samples-{uuid4().hex}"
    vectors = stored_vectors(spark, sf_dir)
    for batch_id in range(3):
        batch = vectors.filter(F.crc32(F.col("vector_id").cast("binary")) % 3 == batch_id)
        keep_samples(batch, root, batch_id, 20, 64, one_hash=True)
    return stored_samples(spark, root, 20, 64).select("tree_id", "vector_id")


@query()
def forest_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.grow_forest(forest.tree_samples(_training(stored_vectors(spark, sf_dir))))


def _model(vectors: DataFrame) -> forest.Model:
    trained = forest.train(_training(vectors), "20240131000000")
    if trained is None:
        raise ValueError("too few vectors to train on")
    return trained[0]


@query()
def forest_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train on all vectors, then score them."""
    vectors = stored_vectors(spark, sf_dir)
    scored = results.decide(forest.raw_decision(vectors, _model(vectors)))
    return scored.select("vector_id", "forest_score", "anomaly_score", "is_anomalous", "severity")


# A small forest written out, to check the scoring arithmetic against SQL:
# (tree_id, node_id, depth, size, feature, threshold), feature -1 for a leaf.
FIXED_FOREST = [
    (0, 1, 0, 8, 10, 0.0001), (0, 2, 1, 3, -1, 0.0), (0, 3, 1, 5, 8, 6.0),
    (0, 6, 2, 4, -1, 0.0), (0, 7, 2, 1, -1, 0.0),
    (1, 1, 0, 8, 13, 0.25), (1, 2, 1, 6, 17, 0.1), (1, 3, 1, 2, -1, 0.0),
    (1, 4, 2, 4, -1, 0.0), (1, 5, 2, 2, -1, 0.0),
    (2, 1, 0, 8, 14, 2.5), (2, 2, 1, 1, -1, 0.0), (2, 3, 1, 7, 9, 9.0),
    (2, 6, 2, 5, 0, 0.1), (2, 7, 2, 2, -1, 0.0), (2, 12, 3, 3, -1, 0.0), (2, 13, 3, 2, -1, 0.0),
]


def _length(n: str) -> str:
    return f"(2 * (ln({n} - 1) + 0.5772156649015329e0) - 2e0 * ({n} - 1) / {n})"


@query(f"""WITH {VECTORS},
paths AS (SELECT vector_id,
  CASE WHEN process_creation_rate < 0.0001e0 THEN 1 + {_length('3e0')}
       WHEN unique_process_count < 6 THEN 2 + {_length('4e0')} ELSE 2 END
  + CASE WHEN network_event_ratio >= 0.25e0 THEN 2
         WHEN uid_zero_ratio < 0.1e0 THEN 2 + {_length('4e0')} ELSE 3 END
  + CASE WHEN syscall_entropy < 2.5e0 THEN 1 WHEN unique_syscall_count >= 9 THEN 3
         WHEN syscall_read_freq < 0.1e0 THEN 3 + {_length('3e0')} ELSE 4 END AS path FROM vectors)
SELECT vector_id, round(pow(2e0, -(path / 3e0) / {_length('8e0')}), 6) AS forest_score FROM paths""")
def fixed_forest_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = spark.createDataFrame(FIXED_FOREST, FOREST_NODE)
    scored = forest.forest_scores(feature_vectors(spark, sf_dir), forest.load_forest(nodes))
    return rounded(scored.select("vector_id", "forest_score"), "forest_score")


@query(f"""WITH {RESULTS} SELECT round(quantile_cont(anomaly_score, 0.95), 6) AS "offset" FROM results""")
def contamination_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(forest.contamination_offset(
        anomaly_results(spark, sf_dir), score="anomaly_score"), "offset")


# A raw decision value per event in [-0.75, 0.74], past both ends of the clip.
def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("double")
    return read(spark, sf_dir, "events").select(
        F.concat(F.lit("v-"), F.col("event_id").cast("string")).alias("vector_id"),
        F.concat(F.lit("c"), (F.col("user_id") % 40).cast("string")).alias("container_id"),
        ((k * F.lit(1.5) - F.lit(75.0)) / F.lit(100.0)).alias("raw_score"),
        (F.col("event_id") % 50).alias("total_events"),
        F.when(F.col("event_id") % 3 != 0, F.array(*[F.lit(n) for n in FEATURE_NAMES[:5]]))
         .otherwise(F.array().cast("array<string>")).alias("contributing_features"),
        F.col("ts").alias("window_end"),
    )


_RAW = """
raw AS (SELECT concat('v-', event_id) AS vector_id, concat('c', user_id % 40) AS container_id,
               event_id % 50 AS total_events, event_id % 3 <> 0 AS named,
               least(1e0, greatest(0e0, (CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) * 1.5e0 - 75e0) / 100e0 + 0.5e0)) AS s
        FROM events)"""


@query(f"""WITH {_RAW}
SELECT vector_id, round(s, 6) AS anomaly_score, s > 0.5e0 AS is_anomalous, {sql_severity('s')} AS severity FROM raw""")
def severity_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.decide(_raw(spark, sf_dir)).select(
        "vector_id", "anomaly_score", "is_anomalous", "severity")


_FIRST_THREE = ", ".join(FEATURE_NAMES[:3])
_FIRST_FIVE = ",".join(FEATURE_NAMES[:5])


@query(f"""WITH {_RAW}
SELECT md5(concat_ws('|', vector_id, '20240131000000')) AS result_id, vector_id, container_id,
  round(s, 6) AS anomaly_score, s > 0.5e0 AS is_anomalous, {sql_severity('s')} AS severity,
  '20240131000000' AS model_version, CASE WHEN named THEN '{_FIRST_FIVE}' END AS contributing_features,
  CASE WHEN s > 0.5e0 THEN concat('Anomalous behavior detected (score: ', printf('%.3f', round(s, 6)), '). ',
         CASE WHEN named THEN 'Top contributing features: {_FIRST_THREE}. ' ELSE '' END,
         'Window contained ', total_events, ' events')
       ELSE 'Normal behavior observed' END AS description,
  TIMESTAMP '{AS_OF}' AS detected_at
FROM raw""")
def anomaly_results_from_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    assembled = results.assemble(results.decide(_raw(spark, sf_dir)), "20240131000000", AS_OF)
    return results.stored_form(assembled).drop("window_start", "window_end")


_DAMAGE = "substr(vector_id, 1, 1)"


@query(f"""WITH {VECTORS},
damaged AS (SELECT vector_id, {_DAMAGE} AS d FROM vectors)
SELECT vector_id, d NOT IN ('0', '1') AS scored, CASE WHEN d IN ('0', '1') THEN 'features must have 18 values' END AS reason,
       CASE WHEN d NOT IN ('0', '1') THEN 'NONE' END AS severity FROM damaged""")
def unscorable_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of which some are too short, null, or hold NaN and infinities: which get a result,
    under a model that finds nothing unusual, and which go to the dead letters."""
    vectors, d = feature_vectors(spark, sf_dir), F.expr(_DAMAGE)
    nan, infinite = F.lit(float("nan")), F.lit(float("inf"))
    damaged = vectors.withColumn("features", F.when(d == "0", F.slice("features", 1, 17)).when(
        d == "2", F.transform("features", lambda x: x * nan)).when(
        d == "3", F.transform("features", lambda x: x + infinite)).when(d != "1", F.col("features")))
    model = forest.Model("20240131000000", forest.load_forest(spark.createDataFrame(FIXED_FOREST, FOREST_NODE)), 2.0, 8)
    found = results.score_vectors(damaged, model, AS_OF).select(
        "vector_id", F.lit(True).alias("scored"), F.lit(None).cast("string").alias("reason"), "severity")
    return found.unionByName(results.unscorable(damaged, AS_OF).select(
        "vector_id", F.lit(False).alias("scored"), "reason", F.lit(None).cast("string").alias("severity")))


@query(f"""WITH {VECTORS}
SELECT vector_id, 0e0 AS anomaly_score, FALSE AS is_anomalous, 'LOW' AS severity, 'none' AS model_version,
       'Normal behavior observed' AS description FROM vectors""")
def no_model_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.score_vectors(feature_vectors(spark, sf_dir), None, AS_OF).select(
        "vector_id", "anomaly_score", "is_anomalous", "severity", "model_version", "description")


@query()
def scored_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events to explained anomaly results under a model trained on the same table."""
    vectors = stored_vectors(spark, sf_dir)
    scored = results.score_vectors(
        vectors, _model(vectors), AS_OF, durable(baseline.image_baseline(vectors)),
        durable(baseline.global_baseline(vectors)))
    return results.stored_form(scored)


_VERSIONED = f"""WITH {VECTORS}, {LONG},
daily AS (SELECT strftime(date_trunc('day', window_start), '%Y%m%d%H%M%S') AS version, pos, count(*) AS n,
                 avg(value) AS m, greatest(stddev_pop(value), 1e-8) AS s FROM long GROUP BY 1, 2),
paired AS (SELECT *, lag(m) OVER w AS pm, lag(s) OVER w AS ps FROM daily
           WINDOW w AS (PARTITION BY pos ORDER BY version)),
registry AS (SELECT version, max(n) AS samples, {FEATURE_COUNT} AS features, '{FEATURE_SCHEMA_VERSION}' AS schema_version,
                    round(coalesce(avg(abs(m - pm) / ps), 0), 6) AS drift_score
             FROM paired GROUP BY version)"""
_LISTED = ("version", "samples", "features", "schema_version", "drift_score")


def _registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model version per day: its vectors' count and the drift of their baseline."""
    day = F.date_format(F.date_trunc("DAY", "window_start"), "yyyyMMddHHmmss")
    daily = baseline.global_baseline(feature_vectors(spark, sf_dir).withColumn("version", day), ["version"])
    drifted = baseline.drift_history(daily)
    return drifted.select(
        "version", F.col("n").alias("samples"), F.lit(FEATURE_COUNT).alias("features"),
        F.lit(FEATURE_SCHEMA_VERSION).alias("schema_version"),
        F.round("drift_score", 6).alias("drift_score"))


@query(f"{_VERSIONED} SELECT * FROM registry ORDER BY version DESC LIMIT 1")
def registry_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.latest_model(_registry(spark, sf_dir))


@query(f"""{_VERSIONED} SELECT *, version = max(version) OVER () AS is_current, count(*) OVER () AS registry_size
FROM registry""")
def registry_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.registry_listing(durable(_registry(spark, sf_dir)))


@query(f"""{_VERSIONED} SELECT *, 0.9e0 AS threshold_critical, 0.75e0 AS threshold_high, 0.6e0 AS threshold_medium,
  0.5e0 AS threshold_low, 100 AS min_training_samples, (SELECT count(*) FROM registry) AS registry_size
FROM registry ORDER BY version DESC LIMIT 1""")
def model_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.model_info(durable(_registry(spark, sf_dir)))


@query(f"""WITH {RESULTS}
SELECT severity, count(*) AS scored, count(*) FILTER (is_anomalous) AS anomalies FROM results GROUP BY severity""")
def scoring_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.scoring_metrics(anomaly_results(spark, sf_dir))


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results labelled by the kind of the event behind them; errors and purchases are attacks."""
    attack = F.when(F.col("event_type").isin("error", "purchase"), F.col("event_type"))
    return anomaly_results(spark, sf_dir, keep=("event_type",)).withColumns(
        {"attack": attack, "is_attack": attack.isNotNull()})


_LABELLED = f"""WITH {RESULTS},
labelled AS (SELECT r.*, e.event_type IN ('error', 'purchase') AS is_attack,
                    CASE WHEN e.event_type IN ('error', 'purchase') THEN e.event_type END AS attack
             FROM results r JOIN events e ON r.result_id = concat('r-', e.event_id))"""


@query(f"""{_LABELLED},
c AS (SELECT count(*) FILTER (is_attack AND is_anomalous) AS tp, count(*) FILTER (NOT is_attack AND is_anomalous) AS fp,
             count(*) FILTER (is_attack AND NOT is_anomalous) AS fn, count(*) FILTER (NOT is_attack AND NOT is_anomalous) AS tn
      FROM labelled)
SELECT *, round(tp / (tp + fn), 6) AS recall, round(fp / (fp + tn), 6) AS false_positive_rate,
       round(tp / (tp + fp), 6) AS "precision", round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c""")
def evaluation_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluation.confusion_metrics(_labelled(spark, sf_dir)),
                   "recall", "false_positive_rate", "precision", "f1")


@query(f"""{_LABELLED},
ranked AS (SELECT is_attack, rank() OVER (ORDER BY anomaly_score) AS low,
                  count(*) OVER (PARTITION BY anomaly_score) AS same FROM labelled)
SELECT round((sum(low + (same - 1) / 2e0) FILTER (is_attack)
              - count(*) FILTER (is_attack) * (count(*) FILTER (is_attack) + 1) / 2e0)
             / (count(*) FILTER (is_attack) * CAST(count(*) FILTER (NOT is_attack) AS DOUBLE)), 6) AS auc FROM ranked""")
def evaluation_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluation.area_under_roc(_labelled(spark, sf_dir)), "auc")


@query(f"""{_LABELLED}
SELECT attack, count(*) AS n, round(avg(CAST(is_anomalous AS INT)), 6) AS detection_rate
FROM labelled WHERE attack IS NOT NULL GROUP BY attack""")
def evaluation_by_attack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluation.detection_rate(_labelled(spark, sf_dir)), "detection_rate")


_DECIDED = f"""decided AS (SELECT *, CAST(total_events % 10 AS DOUBLE) / 10e0 AS s FROM vectors)"""


def _decided(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The vectors, and results of them whose score is given by their event counts."""
    vectors = stored_vectors(spark, sf_dir)
    raw = (F.col("total_events") % 10).cast("double") / F.lit(10.0) - F.lit(0.5)
    contributors = F.when(F.col("total_events") % 3 == 0, F.array().cast("array<string>")).otherwise(
        F.array(*[F.lit(n) for n in FEATURE_NAMES[:5]]))
    scored = vectors.withColumns({"raw_score": raw, "contributing_features": contributors})
    return vectors, results.assemble(results.decide(scored), "20240131000000", AS_OF)


@query(f"""WITH {VECTORS}, {LONG}, {_DECIDED},
ids AS (SELECT *, md5(concat_ws('|', vector_id, '20240131000000')) AS result_id FROM decided WHERE s >= 0.75e0)
SELECT md5(concat_ws('|', 'alert', result_id)) AS alert_id, result_id, vector_id, ids.container_id, {sql_severity('s')} AS severity,
       ids.total_events, pos, feature, round(value, 6) AS value
FROM ids JOIN long USING (vector_id)""")
def alert_lineage_of_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From alerts to the features of the vectors behind them."""
    vectors, found = _decided(spark, sf_dir)
    lineage = alerts.alert_lineage(alerts.raise_alerts(found), found, vectors)
    rows = lineage.select("alert_id", "result_id", "vector_id", "container_id", "severity", "total_events",
                          F.posexplode("features").alias("pos", "value"))
    names = F.array(*[F.lit(n) for n in FEATURE_NAMES])
    return rounded(rows.withColumns({"feature": F.get(names, F.col("pos")), "pos": F.col("pos").cast("bigint")}), "value")


@query(f"""WITH {VECTORS}, {_DECIDED}
SELECT md5(concat_ws('|', vector_id, '20240131000000')) AS result_id, {sql_severity('s')} AS severity, s > 0.5e0 AS is_anomalous,
       CAST(CASE WHEN total_events % 3 = 0 THEN 0 ELSE 5 END AS INT) AS contributors,
       CASE WHEN total_events % 3 = 0 THEN '' ELSE '{_FIRST_FIVE}' END AS names FROM decided""")
def result_rows_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results written in their flat form and read again."""
    stored = durable(results.stored_form(_decided(spark, sf_dir)[1]))
    return results.of_stored_form(stored).select(
        "result_id", "severity", "is_anomalous", F.size("contributing_features").alias("contributors"),
        F.array_join("contributing_features", ",").alias("names"))


@query(f"WITH {VECTORS}, {LONG} SELECT vector_id, pos, feature, round(value, 6) AS value FROM long")
def vector_rows_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors written in their flat form and read again."""
    stored = durable(features.stored_form(feature_vectors(spark, sf_dir)))
    rows = features.feature_rows(features.of_stored_form(stored))
    return rounded(rows.select("vector_id", F.col("pos").cast("bigint").alias("pos"), "feature", "value"), "value")


_FIRST_HALF = "2024-01-16 00:00:00"


@query(f"""WITH {VECTORS}, {LONG},
old AS (SELECT pos, avg(value) AS m, greatest(stddev_pop(value), 1e-8) AS s
        FROM long WHERE window_end <= TIMESTAMP '{_FIRST_HALF}' GROUP BY pos),
new AS (SELECT pos, avg(value) AS m FROM long GROUP BY pos)
SELECT '20240131000000' AS version, count(*) AS samples, {FEATURE_COUNT} AS features, '{FEATURE_SCHEMA_VERSION}' AS schema_version,
       (SELECT round(avg(abs(new.m - old.m) / old.s), 6) FROM new JOIN old USING (pos)) AS drift_score,
       0.05e0 AS contamination, 10 AS n_estimators, 'IsolationForest' AS model_type, '{",".join(FEATURE_NAMES)}' AS feature_names,
       0.9e0 AS threshold_critical, 0.75e0 AS threshold_high, 0.6e0 AS threshold_medium, 0.5e0 AS threshold_low,
       100 AS min_training_samples, CAST(2 AS BIGINT) AS registry_size, count(*) AS training_buffer_size,
       count(DISTINCT image_name) AS image_baselines_tracked FROM vectors""")
def model_info_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is said of the current model after two have been trained and stored."""
    root = f"{shared_folder(spark)}/registry-{uuid4().hex}"
    vectors = stored_vectors(spark, sf_dir)
    early = F.col("window_end") <= F.lit(_FIRST_HALF).cast("timestamp_ntz")
    retrain(vectors.filter(early), root, datetime(2024, 1, 16), trees=10, sample_size=64)
    retrain(vectors, root, datetime(2024, 1, 31), trees=10, sample_size=64)
    stored = read_versions(spark, root, REGISTRY)
    return registry.model_info(stored, baseline.training_buffer(vectors), baseline.image_moments(vectors)).drop(
        "offset", "trained_at", "tree_count")


@query(f"""WITH {VECTORS} SELECT vector_id, container_id, total_events FROM vectors
WHERE vector_id = (SELECT max(vector_id) FROM vectors WHERE total_events = (SELECT max(total_events) FROM vectors))""")
def vector_by_id_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vector of one id, from a table that is laid out for lookups."""
    path = f"{shared_folder(spark)}/clustered-{uuid4().hex}"
    vectors = stored_vectors(spark, sf_dir)
    write_clustered(vectors, path, "vector_id")
    wanted = vectors.agg(F.max(F.struct("total_events", "vector_id"))["vector_id"].alias("id")).first()["id"]
    return by_id(spark.read.schema(vectors.schema).parquet(path), "vector_id", wanted).select(
        "vector_id", "container_id", "total_events")

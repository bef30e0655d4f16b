"""Queries on features, scaling, thresholds, forests, stacking, sequence models and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import META_SEQUENCE
from ..models import forest, scaling, sequence, stack, thresholds
from ..operators import features, report, timeseries
from ..sources import driver, files
from ..sources.scratch import kept, scratch
from . import views
from .registry import query
from .signals import SCALED, filled, rounded, scaled
from .views import SCORED_SQL, scored

MEDIANS = "SELECT unnest(['error', 'purchase', 'signup']) AS \"column\", unnest([me, mp, ms]) AS median, unnest([ae, ap, asg]) AS mean, unnest([se, sp, ss]) AS scale FROM med, stat"


@query("k1_standard_scaler", f"WITH {SCALED}, x AS ({MEDIANS}) SELECT \"column\", round(median, 6) AS median, round(mean, 6) AS mean, round(scale, 6) AS scale FROM x")
def k1(spark, sf_dir):
    return rounded(scaling.fit_scaler(views.matrix(spark, sf_dir), views.BIZ_COLUMNS), ["median", "mean", "scale"])


@query("k1_scaled_matrix", f"WITH {SCALED} SELECT lift_id, bucket_start_unix, round(error, 6) AS error, round(purchase, 6) AS purchase, round(signup, 6) AS signup FROM scaled")
def k1_apply(spark, sf_dir):
    return rounded(scaled(spark, sf_dir), views.BIZ_COLUMNS)


@query("k2_batch_imputation", f"""
WITH {SCALED}, tm AS (SELECT median(error) AS me, median(purchase) AS mp, median(signup) AS ms FROM biz)
SELECT lift_id, bucket_start_unix, round((coalesce(error, tm.me) - ae) / se, 6) AS error, round((coalesce(purchase, tm.mp) - ap) / sp, 6) AS purchase, round((coalesce(signup, tm.ms) - asg) / ss, 6) AS signup
FROM biz, tm, stat""")  # fmt: skip
def k2(spark, sf_dir):
    m = views.matrix(spark, sf_dir)
    scaler = scaling.fit_scaler(m, views.BIZ_COLUMNS)
    return rounded(scaling.apply_scaler(m, scaler, views.BIZ_COLUMNS, "batch"), views.BIZ_COLUMNS)


@query("k3_isolation_forest")
def k3(spark, sf_dir):
    s = scaled(spark, sf_dir)
    model = forest.collect(forest.fit(s, views.BIZ_COLUMNS, ["lift_id", "bucket_start_unix"], trees=300))
    return forest.score(s, model, views.BIZ_COLUMNS).select("lift_id", "bucket_start_unix", F.round("score", 9).alias("score"))


FEATURE_SQL = """s AS (SELECT lift_id AS k, us, value AS v, lag(value) OVER w AS b, lead(value) OVER w AS n1, lead(value, 5) OVER w AS n5, row_number() OVER w AS i,
  count(*) OVER (PARTITION BY lift_id) AS n, avg(value) OVER (PARTITION BY lift_id) AS m FROM sensor WINDOW w AS (PARTITION BY lift_id ORDER BY us, value)),
t AS (SELECT *, last_value(CASE WHEN b IS NULL OR b <> v THEN coalesce(b < v, false) END IGNORE NULLS) OVER (PARTITION BY k ORDER BY us, v ROWS UNBOUNDED PRECEDING) AND coalesce(n1 < v, false) AS peak FROM s WHERE n >= 20),
g AS (SELECT k AS lift_id, avg(v) AS mean, stddev_pop(v) AS std, median(v) AS median, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS iqr,
  (avg(v * v * v) - 3 * avg(v) * avg(v * v) + 2 * pow(avg(v), 3)) / pow(stddev_pop(v), 3) AS skew, kurtosis_pop(v) AS kurtosis, min(v) AS min, max(v) AS max, max(v) - min(v) AS ptp,
  quantile_cont(v, 0.05) AS p05, quantile_cont(v, 0.95) AS p95, (sum(v * v) - sum(v * v) FILTER (i = 1 OR i = n) / 2) AS e, avg(abs(n1 - v)) * count(*) AS d, count(*) FILTER (peak) AS np,
  coalesce(avg(v) FILTER (peak), 0) AS mean_peak_height, sum(v) FILTER (i = n) - sum(v) FILTER (i = 1) AS sl, sum(abs(CAST(n1 - m < 0 AS INT) - CAST(v - m < 0 AS INT))) AS zc,
  corr(v, n1) AS autocorr_lag1, corr(v, n5) AS autocorr_lag5, CAST(count(*) AS DOUBLE) AS n_samples, (max(us) - min(us)) / 1e6 AS sec FROM t GROUP BY k)"""
PLAIN = ("mean", "std", "median", "iqr", "skew", "kurtosis", "min", "max", "ptp", "p05", "p95", "mean_peak_height", "autocorr_lag1", "autocorr_lag5", "n_samples")
PER_SECOND = {"energy_per_sec": "e", "abs_mean_diff_per_sec": "d", "n_peaks_per_sec": "np", "net_slope_per_sec": "sl", "zero_cross_per_sec": "zc"}


@query("k4_lift_features", f"WITH {FEATURE_SQL} SELECT lift_id, {', '.join(f'round({c}, 5) AS {c}' for c in PLAIN)}, {', '.join(f'round({v} / sec * 1000, 5) AS {c}' for c, v in PER_SECOND.items())} FROM g WHERE sec > 0")
def k4(spark, sf_dir):
    out = features.basic_features(driver.sensor_log(spark, sf_dir), ["lift_id"])
    return out.select("lift_id", *[F.round(F.col(c) * (1000 if c in PER_SECOND else 1), 5).alias(c) for c in features.BASIC])


@query("k4_spectral_features")
def k4_spectral(spark, sf_dir):
    return rounded(features.spectral_features(driver.sensor_log(spark, sf_dir), ["lift_id"]), features.SPECTRAL)


@query("k5_feature_gate", "SELECT tagname, lift_id, count(*) AS n FROM sensor GROUP BY ALL HAVING count(*) >= 20 AND max(us) > min(us)")
def k5(spark, sf_dir):
    out = features.basic_features(driver.sensor_log(spark, sf_dir))
    return out.select("tagname", "lift_id", F.col("n_samples").cast("long").alias("n"))


def area_features(spark, sf_dir):
    """Features by lift and area (Sys.Ui, Sys.Biz): of tags with enough rows for the gate of 20."""
    log = driver.sensor_log(spark, sf_dir).withColumn("tagname", F.substring_index("tagname", ".", 2))
    return features.features(log)


@query("k6_forest_per_tag")
def k6(spark, sf_dir):
    return rounded(forest.fit_score_by_tag(area_features(spark, sf_dir), features.FEATURES), ["anomaly_score"])


@query("k7_stored_forest_per_tag")
def k7(spark, sf_dir):
    """Models of three quarters of the lifts, stored, read again, and applied to the others."""
    f = area_features(spark, sf_dir)
    with scratch(spark) as path:
        models = forest.fit_by_tag(f.filter("lift_id % 4 <> 0"), features.FEATURES)
        files.write_model(spark, path, {"features": features.FEATURES}, {"models": models})
        config, tables = files.read_model(spark, path)
        return kept(rounded(forest.score_by_tag(f.filter("lift_id % 4 = 0"), tables["models"], config["features"]), ["anomaly_score"]))


LIMITS = """counts AS (SELECT tag_group, count(*) FILTER (active = 1) AS n FROM raw_scores GROUP BY 1), used AS (SELECT * FROM raw_scores JOIN counts USING (tag_group) WHERE n < 50 OR active = 1)"""
RAW = SCORED_SQL.strip().split("counts AS")[0].strip().rstrip(",")


def training_scores(spark, sf_dir):
    return thresholds.training_rows(scored(spark, sf_dir).select("tag_group", "score", "active"), "active", ["tag_group"])


@query("k8_lower_threshold_iqr", f"WITH {RAW}, {LIMITS} SELECT tag_group, round(quantile_cont(score, 0.25) - 3 * (quantile_cont(score, 0.75) - quantile_cont(score, 0.25)), 6) AS threshold FROM used GROUP BY 1")
def k8(spark, sf_dir):
    return rounded(thresholds.thresholds(training_scores(spark, sf_dir), "score", ["tag_group"]), ["threshold"])


@query("k8_lower_threshold_mad", f"WITH {RAW}, {LIMITS}, md AS (SELECT tag_group, median(score) AS m FROM used GROUP BY 1) SELECT tag_group, round(any_value(m) - 3 * 1.4826 * median(abs(score - m)), 6) AS threshold FROM used JOIN md USING (tag_group) GROUP BY 1")
def k8_mad(spark, sf_dir):
    return rounded(thresholds.thresholds(training_scores(spark, sf_dir), "score", ["tag_group"], "mad"), ["threshold"])


@query("k9_upper_threshold", f"WITH {RAW}, {LIMITS} SELECT tag_group, round(quantile_cont(-score, 0.75) + 3 * (quantile_cont(-score, 0.75) - quantile_cont(-score, 0.25)), 6) AS threshold FROM used GROUP BY 1")
def k9(spark, sf_dir):
    errors = training_scores(spark, sf_dir).withColumn("error", -F.col("score"))
    return rounded(thresholds.thresholds(errors, "error", ["tag_group"], side="upper"), ["threshold"])


@query("k10_specialist_prediction", f"WITH {SCORED_SQL} SELECT tag_group, lift_id, ts, pred FROM scored")
def k10(spark, sf_dir):
    return scored(spark, sf_dir).select("tag_group", "lift_id", "ts", "pred")


@query("k11_percentile_fallback", f"WITH {RAW} SELECT tag_group, round(quantile_cont(score, 0.01), 6) AS threshold FROM raw_scores GROUP BY 1")
def k11(spark, sf_dir):
    return rounded(thresholds.percentile_threshold(scored(spark, sf_dir), "score", ["tag_group"]), ["threshold"])


@query("k11_complete_rows", "SELECT lift_id, bucket_start_unix FROM biz WHERE error IS NOT NULL AND purchase IS NOT NULL AND signup IS NOT NULL")
def k11_rows(spark, sf_dir):
    rows = scaling.complete_rows(views.matrix(spark, sf_dir), views.BIZ_COLUMNS)
    return (rows if rows is not None else views.matrix(spark, sf_dir).limit(0)).select("lift_id", "bucket_start_unix")


META = f"""{SCORED_SQL.strip()}, base AS (SELECT DISTINCT lift_id, ts FROM scored WHERE tag_group = 'ui'),
meta AS (SELECT b.lift_id, b.ts, u.score AS ui_score, u.pred AS ui_pred, u.active AS ui_active, z.score AS biz_score, z.pred AS biz_pred, z.active AS biz_active,
  coalesce(u.active, 0) + coalesce(z.active, 0) AS n_active_groups FROM base b ASOF LEFT JOIN (SELECT * FROM scored WHERE tag_group = 'ui') u ON b.lift_id = u.lift_id AND b.ts >= u.ts
  ASOF LEFT JOIN (SELECT * FROM scored WHERE tag_group = 'biz') z ON b.lift_id = z.lift_id AND b.ts >= z.ts),
active_meta AS (SELECT * FROM meta WHERE n_active_groups >= 1)"""


def meta(spark, sf_dir):
    s = scored(spark, sf_dir)
    sides = {g: s.filter(F.col("tag_group") == g).drop("tag_group") for g in ("ui", "biz")}
    return stack.stacked(sides["ui"], sides)


@query("k12_meta_features", f"WITH {META} SELECT * FROM active_meta")
def k12(spark, sf_dir):
    return meta(spark, sf_dir)


@query("k12_meta_training_rows", f"WITH {META} SELECT count(*) AS n FROM active_meta WHERE n_active_groups >= 2 OR ((SELECT count(*) FROM active_meta WHERE n_active_groups >= 2) < 50 AND n_active_groups >= 1)")
def k12_rows(spark, sf_dir):
    return thresholds.meta_training_rows(meta(spark, sf_dir)).agg(F.count(F.lit(1)).alias("n"))


@query("k12_stacked_model")
def k12_model(spark, sf_dir):
    out, _ = stack.meta_model(meta(spark, sf_dir), ["ui", "biz"])
    return report.ranked_summary(out, driver.lift_types(spark, sf_dir))


@query("k12_specialists_end_to_end")
def k12_specialists(spark, sf_dir):
    groups = {"biz": (views.BIZ, filled(spark, sf_dir)), "ui": (views.UI, views.matrix(spark, sf_dir, views.UI))}
    scores = {n: stack.specialist(m, g)[0] for n, (g, m) in groups.items()}
    out, _ = stack.meta_model(stack.stacked(scores["ui"], scores), list(scores))
    return report.lift_summary(out)


@query("k12_stored_models")
def k12_stored(spark, sf_dir):
    """Specialists and the meta model of three quarters of the lifts, stored, read again, and applied to the others."""
    groups = {"biz": (views.BIZ, filled(spark, sf_dir)), "ui": (views.UI, views.matrix(spark, sf_dir, views.UI))}
    old, new = {}, {}
    with scratch(spark) as path:
        for n, (g, m) in groups.items():
            old[n], parts = stack.specialist(m.filter("lift_id % 4 <> 0"), g)
            stack.save(spark, f"{path}/{n}", parts)
            new[n] = stack.apply_specialist(m.filter("lift_id % 4 = 0"), stack.load(spark, f"{path}/{n}"))
        _, parts = stack.meta_model(stack.stacked(old["ui"], old), list(old))
        stack.save(spark, f"{path}/meta", parts)
        return kept(report.lift_summary(stack.apply_meta(stack.stacked(new["ui"], new), stack.load(spark, f"{path}/meta"))))


def model_sequences(spark, sf_dir):
    m = scaled(spark, sf_dir).withColumnRenamed("bucket_start_unix", "ts").withColumn("on", timeseries.activity(views.BIZ_COLUMNS, 0.9).cast("int"))
    return timeseries.sequences(m, views.BIZ_COLUMNS, 3, "on")


def reconstruction_errors(spark, sf_dir):
    s = model_sequences(spark, sf_dir)
    train = thresholds.training_rows(s, "active")
    model = sequence.Autoencoder.start(3).fit_all(train, ["lift_id", "ts"])
    return sequence.errors(s, model)


@query("k13_lstm_autoencoder")
def k13(spark, sf_dir):
    return reconstruction_errors(spark, sf_dir).select("lift_id", "ts", "active", F.round("error", 6).alias("error"))


@query("k14_reconstruction_error")
def k14(spark, sf_dir):
    """The autoencoder's errors by sequence and feature."""
    by_feature = F.transform("error_by_feature", lambda x: F.round(x, 6)).alias("error_by_feature")
    return reconstruction_errors(spark, sf_dir).select("lift_id", "ts", F.round("error", 6).alias("error"), by_feature)


@query("k14_linear_baseline")
def k14_linear(spark, sf_dir):
    s = model_sequences(spark, sf_dir)
    model = sequence.reconstruction_of(s)
    return sequence.errors(s, model).select("lift_id", "ts", F.round("error", 6).alias("error"), F.transform("error_by_feature", lambda x: F.round(x, 6)).alias("error_by_feature"))


LAST = ", ".join(f"lag({c}, 1, {c}) OVER (PARTITION BY lift_id ORDER BY bucket_start_unix) AS l_{c}" for c in views.BIZ_COLUMNS)


@query("k16_forecaster_error", f"WITH {SCALED}, before AS (SELECT *, row_number() OVER (PARTITION BY lift_id ORDER BY bucket_start_unix) AS n, count(*) OVER (PARTITION BY lift_id) AS size, {LAST} FROM scaled) SELECT lift_id, bucket_start_unix AS ts, round(((error - l_error) ** 2 + (purchase - l_purchase) ** 2 + (signup - l_signup) ** 2) / 3, 6) AS error FROM before WHERE n > 3 OR size <= 3 AND n = size")
def k16(spark, sf_dir):
    """Errors of a model whose output is one step: the forecast that nothing changes."""
    m = scaled(spark, sf_dir).withColumnRenamed("bucket_start_unix", "ts").withColumn("on", F.lit(1))
    w = timeseries.prediction_windows(m, views.BIZ_COLUMNS, 3, "on")
    out = sequence.errors(w, sequence.Persistence(), "target")
    return out.select("lift_id", "ts", F.round("error", 6).alias("error"))


@query("k15_sequence_meta_model")
def k15(spark, sf_dir):
    columns = stack.meta_columns(["ui", "biz"])
    m = meta(spark, sf_dir)
    m = scaling.apply_scaler(m.withColumns({c: F.col(c).cast("double") for c in columns}), scaling.fit_scaler(m, columns), columns)
    s = timeseries.sequences(m.withColumn("on", (F.col("n_active_groups") > 0).cast("int")), columns, META_SEQUENCE, "on")
    train = thresholds.training_rows(s, "active")
    model = sequence.Autoencoder.start(len(columns)).fit_all(train, ["lift_id", "ts"])
    errors = sequence.errors(s, model)
    limit = thresholds.thresholds(thresholds.training_rows(errors, "active", least=1), "error", side="upper")
    return errors.crossJoin(F.broadcast(limit)).select("lift_id", "ts", F.round("error", 6).alias("error"), thresholds.predict(F.col("error"), F.col("threshold"), F.col("active"), "upper").alias("pred"))


SUMMARY = """summary AS (SELECT lift_id, count(*) AS total_samples, count(*) FILTER (pred = -1) AS anomalies, min(score) AS worst_score, round(avg(score), 9) AS mean_score, round(avg(active), 6) AS active_groups_mean,
  round(100 * count(*) FILTER (pred = -1) / count(*), 6) AS anomaly_pct FROM scored GROUP BY 1)"""


def _summary(spark, sf_dir):
    out = report.lift_summary(scored(spark, sf_dir), active="active")
    return rounded(rounded(out, ["mean_score"], 9), ["active_groups_mean", "anomaly_pct"])


@query("d15_lift_anomaly_summary", f"WITH {SCORED_SQL.strip()}, {SUMMARY} SELECT * FROM summary")
def d15(spark, sf_dir):
    return _summary(spark, sf_dir)


@query("f5_lift_ranking", f"WITH {SCORED_SQL.strip()}, {SUMMARY} SELECT lift_id, anomalies, worst_score, CAST(row_number() OVER (ORDER BY anomalies DESC, worst_score, lift_id) AS INTEGER) AS rank FROM summary")
def f5(spark, sf_dir):
    return report.rank_lifts(_summary(spark, sf_dir)).select("lift_id", "anomalies", "worst_score", "rank")


@query("k17_summary_with_type", f"WITH {SCORED_SQL.strip()}, {SUMMARY} SELECT s.lift_id, s.anomalies, t.movementtype, CAST(row_number() OVER (ORDER BY anomalies DESC, worst_score, s.lift_id) AS INTEGER) AS rank FROM summary s LEFT JOIN lift_types t USING (lift_id)")
def k17(spark, sf_dir):
    return report.ranked_summary(scored(spark, sf_dir), driver.lift_types(spark, sf_dir), active="active").select("lift_id", "anomalies", "movementtype", "rank")


TAG_SCORES = """ts AS (SELECT tagname, lift_id, round(avg(value) / 100, 6) AS anomaly_score, CAST(max(value) > 150 AS INTEGER) AS is_anomaly FROM sensor GROUP BY ALL)"""


def rule_scores(spark, sf_dir):
    return driver.sensor_log(spark, sf_dir).groupBy("tagname", "lift_id").agg(F.round(F.avg("value") / 100, 6).alias("anomaly_score"), (F.max("value") > 150).cast("int").alias("is_anomaly"))


@query("d16_tag_scores_by_lift", f"WITH {TAG_SCORES} SELECT lift_id, count(*) AS n_tag_scores, CAST(sum(is_anomaly) AS BIGINT) AS n_anomalous_tags, round(avg(anomaly_score), 6) AS mean_anomaly_score, max(anomaly_score) AS max_anomaly_score, round(sum(is_anomaly) / count(*), 6) AS anomalous_tag_rate FROM ts GROUP BY 1")
def d16(spark, sf_dir):
    return rounded(report.tag_scores_by_lift(rule_scores(spark, sf_dir)), ["mean_anomaly_score", "anomalous_tag_rate"])


@query("d17_scores_by_tag", f"WITH {TAG_SCORES} SELECT tagname, count(*) AS n_lifts, CAST(sum(is_anomaly) AS BIGINT) AS n_anomalies, round(avg(is_anomaly), 6) AS anomaly_rate, round(avg(anomaly_score), 6) AS score_mean, round(stddev_samp(anomaly_score), 6) AS score_std FROM ts GROUP BY 1")
def d17(spark, sf_dir):
    return rounded(report.scores_by_tag(rule_scores(spark, sf_dir)), ["anomaly_rate", "score_mean", "score_std"])


@query("d18_overall_summary", f"WITH {TAG_SCORES} SELECT count(*) AS n_scores, count(DISTINCT lift_id) AS n_lifts, count(DISTINCT tagname) AS n_tags, CAST(sum(is_anomaly) AS BIGINT) AS n_anomalies, round(avg(anomaly_score), 6) AS mean_score, max(anomaly_score) AS max_score FROM ts")
def d18(spark, sf_dir):
    return rounded(report.overall(rule_scores(spark, sf_dir)), ["mean_score"])


@query("d19_specialist_rates", f"WITH {SCORED_SQL} SELECT tag_group, count(*) AS total, count(*) FILTER (active = 1) AS active, count(*) FILTER (pred = -1) AS anomalies, round(100 * count(*) FILTER (pred = -1) / count(*), 6) AS pct_all, round(100 * count(*) FILTER (pred = -1) / count(*) FILTER (active = 1), 6) AS pct_active FROM scored GROUP BY 1")
def d19(spark, sf_dir):
    return rounded(report.specialist_rates(scored(spark, sf_dir)), ["pct_all", "pct_active"])


@query("k18_driver_analysis", f"WITH {META}, {SUMMARY}, worst AS (SELECT lift_id FROM summary ORDER BY anomalies DESC, worst_score, lift_id LIMIT 1) SELECT specialist, round(avg(value) FILTER (pred = 1), 6) AS mean_normal, round(avg(value) FILTER (pred = -1), 6) AS mean_anomalous FROM (SELECT 'ui_score' AS specialist, ui_score AS value, ui_pred AS pred FROM active_meta JOIN worst USING (lift_id) UNION ALL SELECT 'biz_score', biz_score, ui_pred FROM active_meta JOIN worst USING (lift_id)) GROUP BY 1")
def k18(spark, sf_dir):
    out = report.driver_analysis(meta(spark, sf_dir), report.worst_lifts(_summary(spark, sf_dir), 1), ["ui_score", "biz_score"], "ui_pred")
    return rounded(out, ["mean_normal", "mean_anomalous"])


@query("k19_detection_check", f"WITH {SCORED_SQL} SELECT count(*) FILTER (pred = -1) AS n_anomalies, count(DISTINCT lift_id) FILTER (pred = -1) AS n_lifts_with_anomaly, count(DISTINCT lift_id) AS n_lifts, count(*) FILTER (pred = -1) > 0 AS detected FROM scored")
def k19(spark, sf_dir):
    return report.detection_check(scored(spark, sf_dir))


@query("f3_top_windows", f"WITH {SCORED_SQL} SELECT tag_group, lift_id, ts, score FROM scored ORDER BY score, lift_id, ts LIMIT 50")
def f3_windows(spark, sf_dir):
    return report.top_windows(scored(spark, sf_dir)).select("tag_group", "lift_id", "ts", "score")


HITS = "hits AS (SELECT i.iv_id AS lift_id, a.id, a.text, a.us FROM alarms a JOIN intervals i ON a.timestamp_utc BETWEEN i.iv_start AND i.iv_end)"


def alarm_hits(spark, sf_dir):
    from ..operators import ingest

    return ingest.interval_join(driver.alarm_log(spark, sf_dir), views.intervals(spark, sf_dir), "timestamp_utc", "iv_start", "iv_end").withColumnRenamed("iv_id", "lift_id")


@query("d14_alarm_rollup", f"WITH {HITS} SELECT lift_id, id, text, count(*) AS n, min(us) AS first_us, max(us) AS last_us FROM hits GROUP BY ALL")
def d14(spark, sf_dir):
    return report.alarm_rollup(alarm_hits(spark, sf_dir))


@query("k20_alarm_drilldown", f"WITH {HITS} SELECT lift_id, id, text, count(*) AS n, min(us) AS first_us, max(us) AS last_us FROM hits WHERE lift_id IN (SELECT i.iv_id FROM sensor s JOIN intervals i ON s.timestamp_utc BETWEEN i.iv_start AND i.iv_end WHERE s.value > 150) GROUP BY ALL")
def k20(spark, sf_dir):
    """The alarms of all intervals with an odd observation."""
    from ..operators import ingest

    odd = driver.sensor_log(spark, sf_dir).filter("value > 150").select("timestamp_utc")
    lifts = ingest.interval_join(odd, views.intervals(spark, sf_dir), "timestamp_utc", "iv_start", "iv_end").select(F.col("iv_id").alias("lift_id"))
    return report.alarm_drilldown(alarm_hits(spark, sf_dir), lifts)


@query("d9_presence_counters", "SELECT lift_id, CAST(sum(CAST(error IS NOT NULL AS INT) + CAST(purchase IS NOT NULL AS INT) + CAST(signup IS NOT NULL AS INT)) AS BIGINT) AS observed, CAST(sum(CAST(error IS NULL AS INT) + CAST(purchase IS NULL AS INT) + CAST(signup IS NULL AS INT)) AS BIGINT) AS missing FROM biz GROUP BY 1")
def d9(spark, sf_dir):
    out = timeseries.coverage(views.matrix(spark, sf_dir), views.BIZ_COLUMNS)
    return out.select("lift_id", F.col("observed_values").alias("observed"), F.col("missing_values").alias("missing"))

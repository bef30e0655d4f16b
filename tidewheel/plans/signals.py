"""Queries on bucketing, gap filling, as-of alignment, sequences and coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ingest, timeseries
from ..sources import driver
from . import views
from .registry import query

ROUNDED = "round({0}, 6) AS {0}"


def rounded(df, columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query("i1_bucketing", "SELECT event_id, tag_group, bucket_size_s, ts_unix, bucket_start_unix, epoch_us(make_timestamp(bucket_start_unix * 1000000)) AS start_us, lift_id || '_' || bucket_start_unix AS lift_group_bucket FROM bucketed")
def i1(spark, sf_dir):
    b = views.bucketed(spark, sf_dir)
    return b.select("event_id", "tag_group", "bucket_size_s", "ts_unix", "bucket_start_unix", F.unix_micros("bucket_start_ts").alias("start_us"), "lift_group_bucket")


@query("i1_unmapped_tags", "SELECT tagname, count(*) AS n FROM sensor WHERE tagname NOT LIKE 'Sys.Ui.%' GROUP BY 1")
def i1_unmapped(spark, sf_dir):
    return timeseries.unmapped_tags(driver.sensor_log(spark, sf_dir), [views.UI])


@query("i2_group_matrix", "SELECT lift_id, bucket_start_unix, round(click, 6) AS click, round(view, 6) AS view FROM ui")
def i2(spark, sf_dir):
    return rounded(views.matrix(spark, sf_dir, views.UI), views.UI_COLUMNS)


@query("i3_included_lifts", "SELECT lift_id, bucket_start_unix FROM ui WHERE lift_id IN (SELECT lift_id FROM lift_types WHERE movementtype <> 5)")
def i3(spark, sf_dir):
    rows = ingest.keep_lifts(views.bucketed(spark, sf_dir), driver.lift_types(spark, sf_dir), 5, "include")
    return timeseries.group_matrix(rows, views.UI).select("lift_id", "bucket_start_unix")


#: The model's fill, in SQL: neighbours by row, one column at a time.
FILL_NEAR = """n AS (SELECT *, row_number() OVER (PARTITION BY lift_id ORDER BY bucket_start_unix) AS n, count(*) OVER (PARTITION BY lift_id) AS size FROM biz),
f AS (SELECT *, {columns} FROM n WINDOW
  b AS (PARTITION BY lift_id ORDER BY bucket_start_unix ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  a AS (PARTITION BY lift_id ORDER BY bucket_start_unix ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""


def _near(position: str) -> str:
    each = []
    for c in views.BIZ_COLUMNS:
        for short, call, w in (("p", "last_value", "b"), ("f", "first_value", "a")):
            each.append(f"{call}({c} IGNORE NULLS) OVER {w} AS {short}v_{c}")
            each.append(f"{call}(CASE WHEN {c} IS NOT NULL THEN {position} END IGNORE NULLS) OVER {w} AS {short}n_{c}")
    return FILL_NEAR.format(columns=", ".join(each))


def _fill_model_sql(max_gap: int, zero: tuple[str, ...]) -> str:
    out = []
    for c in views.BIZ_COLUMNS:
        zeros = f"WHEN pv_{c} = 0 AND fv_{c} = 0 THEN 0.0" if c in zero else ""
        out.append(
            f"""CASE WHEN {c} IS NOT NULL THEN {c} {zeros}
            WHEN coalesce(fn_{c}, size + 1) - coalesce(pn_{c}, 0) - 1 > {max_gap} THEN NULL
            WHEN pv_{c} IS NOT NULL AND fv_{c} IS NOT NULL THEN (pv_{c} / (n - pn_{c}) + fv_{c} / (fn_{c} - n)) / (1.0 / (n - pn_{c}) + 1.0 / (fn_{c} - n))
            ELSE coalesce(pv_{c}, fv_{c}) END AS {c}"""
        )
    return f"{_near('n')}, filled AS (SELECT lift_id, bucket_start_unix, {', '.join(out)} FROM f)"


FILLED = _fill_model_sql(3, ("error", "signup"))
ALL3 = ", ".join(ROUNDED.format(c) for c in views.BIZ_COLUMNS)


def filled(spark, sf_dir):
    return timeseries.fill_model(views.matrix(spark, sf_dir), views.BIZ_COLUMNS, 3, ("error", "signup"))


@query("i4_gap_fill_model", f"WITH {FILLED} SELECT lift_id, bucket_start_unix, {ALL3} FROM filled")
def i4(spark, sf_dir):
    return rounded(filled(spark, sf_dir), views.BIZ_COLUMNS)


def _fill_time_sql(size: int, max_gap: int, zero: tuple[str, ...]) -> str:
    out = []
    for c in views.BIZ_COLUMNS:
        zeros = f"WHEN pv_{c} = 0 AND fv_{c} = 0 THEN 0.0" if c in zero else ""
        out.append(
            f"""CASE WHEN {c} IS NOT NULL THEN {c} WHEN pv_{c} IS NULL OR fv_{c} IS NULL OR (fn_{c} - pn_{c}) / {size}.0 - 1 > {max_gap} THEN NULL {zeros}
            ELSE pv_{c} + (fv_{c} - pv_{c}) * (bucket_start_unix - pn_{c}) / (fn_{c} - pn_{c}) END AS {c}"""
        )
    return f"{_near('bucket_start_unix')}, filled AS (SELECT lift_id, bucket_start_unix, {', '.join(out)} FROM f)"


@query("i5_gap_fill_time", f"WITH {_fill_time_sql(86_400, 3, ('error',))} SELECT lift_id, bucket_start_unix, {ALL3} FROM filled")
def i5(spark, sf_dir):
    return rounded(timeseries.fill_time(views.matrix(spark, sf_dir), views.BIZ_COLUMNS, 86_400, 3, ("error",)), views.BIZ_COLUMNS)


def _recursive(c: str) -> str:
    """The value of a null at distance d from the value behind, where the first in reach is at distance r."""
    r, d = f"least(2, f_{c} - p_{c} - 1)", f"(f_{c} - n)"
    between = f"pv_{c} * {d} / ({r} + 1) + fv_{c} * (1 - {d} / ({r} + 1))"
    return f"round(CASE WHEN {c} IS NOT NULL THEN {c} WHEN pv_{c} IS NULL THEN CASE WHEN {d} <= 2 THEN fv_{c} END WHEN fv_{c} IS NULL OR {d} > 2 THEN pv_{c} ELSE {between} END, 6) AS {c}"


NEAR = ", ".join(f"last_value({v} IGNORE NULLS) OVER (w ROWS UNBOUNDED PRECEDING) AS p{k}_{c}, first_value({v} IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS f{k}_{c}" for c in views.BIZ_COLUMNS for k, v in (("", f"CASE WHEN {c} IS NOT NULL THEN n END"), ("v", c)))


@query("i6_gap_fill_recursive", f"""
WITH numbered AS (SELECT *, row_number() OVER (PARTITION BY lift_id ORDER BY bucket_start_unix) AS n FROM biz),
near AS (SELECT *, {NEAR} FROM numbered WINDOW w AS (PARTITION BY lift_id ORDER BY bucket_start_unix))
SELECT lift_id, bucket_start_unix, {', '.join(map(_recursive, views.BIZ_COLUMNS))} FROM near""")  # fmt: skip
def i6(spark, sf_dir):
    return rounded(timeseries.fill_recursive(views.matrix(spark, sf_dir), views.BIZ_COLUMNS, 2), views.BIZ_COLUMNS)


@query("i7_asof_all_groups", """
SELECT u.lift_id, u.bucket_start_unix AS ts, round(u.click, 6) AS click, round(b.error, 6) AS biz_error, round(b.signup, 6) AS biz_signup, l.n AS log_n
FROM ui u ASOF LEFT JOIN biz b ON u.lift_id = b.lift_id AND u.bucket_start_unix >= b.bucket_start_unix
ASOF LEFT JOIN (SELECT lift_id, ts_unix, count(*) AS n FROM sensor GROUP BY ALL) l ON u.lift_id = l.lift_id AND u.bucket_start_unix >= l.ts_unix""")  # fmt: skip
def i7(spark, sf_dir):
    base = views.matrix(spark, sf_dir, views.UI).select("lift_id", F.col("bucket_start_unix").alias("ts"), "click")
    biz = views.matrix(spark, sf_dir).withColumnRenamed("bucket_start_unix", "ts")
    log = driver.sensor_log(spark, sf_dir).groupBy("lift_id", F.unix_timestamp("timestamp_utc").alias("ts")).agg(F.count(F.lit(1)).alias("n"))
    out = timeseries.asof_align(base, {"biz": (biz, ["error", "signup"]), "log": (log, ["n"])})
    return rounded(out, ["click", "biz_error", "biz_signup"])


@query("i7_asof_in_chunks", """
SELECT b.lift_id, b.bucket_start_unix AS ts, round(u.click, 6) AS ui_click, round(u.view, 6) AS ui_view
FROM biz b ASOF LEFT JOIN ui u ON b.lift_id = u.lift_id AND b.bucket_start_unix >= u.bucket_start_unix""")  # fmt: skip
def i7_chunks(spark, sf_dir):
    base = views.matrix(spark, sf_dir).select("lift_id", F.col("bucket_start_unix").alias("ts"))
    ui = views.matrix(spark, sf_dir, views.UI).withColumnRenamed("bucket_start_unix", "ts")
    return rounded(timeseries.asof_align(base, {"ui": (ui, views.UI_COLUMNS)}, chunk=5 * 86_400), ["ui_click", "ui_view"])


@query("i8_update_gaps", """
WITH g AS (SELECT tagname, (us - lag(us) OVER (PARTITION BY tagname ORDER BY us)) / 1e6 AS gap FROM sensor)
SELECT tagname, count(*) AS n_gaps, round(quantile_cont(gap, 0.5), 6) AS median_gap_s, round(quantile_cont(gap, 0.9), 6) AS p90_gap_s FROM g WHERE gap > 0 GROUP BY 1""")  # fmt: skip
def i8(spark, sf_dir):
    return rounded(timeseries.update_gaps(driver.sensor_log(spark, sf_dir)), ["median_gap_s", "p90_gap_s"])


@query("i9_gap_statistics", """
WITH long AS (SELECT 'error' AS tagname, lift_id, bucket_start_unix, error AS v FROM biz UNION ALL SELECT 'purchase', lift_id, bucket_start_unix, purchase FROM biz
  UNION ALL SELECT 'signup', lift_id, bucket_start_unix, signup FROM biz),
s AS (SELECT *, count(v) OVER (PARTITION BY tagname, lift_id ORDER BY bucket_start_unix) AS seen, count(v) OVER (PARTITION BY tagname, lift_id) AS total FROM long),
r AS (SELECT tagname, lift_id, seen, count(*) AS len FROM s WHERE v IS NULL AND seen > 0 AND seen < total GROUP BY ALL)
SELECT tagname, count(*) AS num_gaps, CAST(trunc(quantile_cont(len, 0.5)) AS BIGINT) * 86400 AS median_s, CAST(trunc(quantile_cont(len, 0.9)) AS BIGINT) * 86400 AS p90_s,
  CAST(trunc(quantile_cont(len, 0.99)) AS BIGINT) * 86400 AS p99_s, max(len) * 86400 AS max_s, round(avg(len) * 86400, 4) AS mean_s FROM r GROUP BY 1""")  # fmt: skip
def i9(spark, sf_dir):
    return rounded(timeseries.gap_statistics(views.matrix(spark, sf_dir), views.BIZ_COLUMNS, 86_400), ["mean_s"], 4)


MISSING = """ff AS (SELECT lift_id, error, purchase, signup, last_value(error IGNORE NULLS) OVER w AS e2, last_value(purchase IGNORE NULLS) OVER w AS p2, last_value(signup IGNORE NULLS) OVER w AS s2
  FROM biz WINDOW w AS (PARTITION BY lift_id ORDER BY bucket_start_unix ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
missing AS (
  SELECT 'error' AS tagname, 100 * avg(CAST(error IS NULL AS INT)) AS b, 100 * avg(CAST(e2 IS NULL AS INT)) AS a FROM ff
  UNION ALL SELECT 'purchase', 100 * avg(CAST(purchase IS NULL AS INT)), 100 * avg(CAST(p2 IS NULL AS INT)) FROM ff
  UNION ALL SELECT 'signup', 100 * avg(CAST(signup IS NULL AS INT)), 100 * avg(CAST(s2 IS NULL AS INT)) FROM ff)"""


@query("i10_missingness", f"WITH {MISSING} SELECT tagname, round(b, 6) AS all_before, round(b, 6) AS active_before, round(a, 6) AS all_after, round(a, 6) AS active_after FROM missing")
def i10(spark, sf_dir):
    out = timeseries.missingness(views.matrix(spark, sf_dir), views.BIZ_COLUMNS)
    return rounded(out, ["all_before", "active_before", "all_after", "active_after"])


@query("i11_group_health", f"WITH {MISSING} SELECT round(avg(a), 6) AS mean_residual, CASE WHEN avg(a) < 10 THEN 'GOOD' WHEN avg(a) < 25 THEN 'OK' ELSE 'BAD' END AS verdict FROM missing")
def i11(spark, sf_dir):
    return rounded(timeseries.health(timeseries.missingness(views.matrix(spark, sf_dir), views.BIZ_COLUMNS)), ["mean_residual"])


SCALED = """med AS (SELECT median(error) AS me, median(purchase) AS mp, median(signup) AS ms FROM biz),
imputed AS (SELECT lift_id, bucket_start_unix, coalesce(error, me) AS error, coalesce(purchase, mp) AS purchase, coalesce(signup, ms) AS signup FROM biz, med),
stat AS (SELECT avg(error) AS ae, stddev_pop(error) AS se, avg(purchase) AS ap, stddev_pop(purchase) AS sp, avg(signup) AS asg, stddev_pop(signup) AS ss FROM imputed),
scaled AS (SELECT lift_id, bucket_start_unix, (error - ae) / se AS error, (purchase - ap) / sp AS purchase, (signup - asg) / ss AS signup FROM imputed, stat)"""


def scaled(spark, sf_dir):
    from ..models import scaling

    m = views.matrix(spark, sf_dir)
    return scaling.apply_scaler(m, scaling.fit_scaler(m, views.BIZ_COLUMNS), views.BIZ_COLUMNS)


@query("i12_row_activity", f"WITH {SCALED} SELECT lift_id, bucket_start_unix, greatest(abs(error), abs(purchase), abs(signup)) > 0.9 AS active FROM scaled")
def i12(spark, sf_dir):
    return scaled(spark, sf_dir).select("lift_id", "bucket_start_unix", timeseries.activity(views.BIZ_COLUMNS, 0.9).alias("active"))


@query("i13_active_groups", "SELECT lift_id, bucket_start_unix, CAST(coalesce(CAST(error > 50 AS INT), 0) + coalesce(CAST(signup > 50 AS INT), 0) AS INT) AS n_active_groups FROM biz")
def i13(spark, sf_dir):
    m = views.matrix(spark, sf_dir).withColumns({"a": F.col("error") > 50, "b": F.col("signup") > 50})
    return m.select("lift_id", "bucket_start_unix", timeseries.active_groups(["a", "b"]).alias("n_active_groups"))


@query("i14_base_timeline", "SELECT 'ui' AS base_group, count(*) AS n FROM ui")
def i14(spark, sf_dir):
    group = timeseries.base_group(driver.GROUPS)
    return timeseries.group_matrix(views.bucketed(spark, sf_dir), group).agg(F.count(F.lit(1)).alias("n")).select(F.lit(group.name).alias("base_group"), "n")


COVERAGE = """cov AS (SELECT lift_id, 3 AS n_tags, count(*) AS n_buckets, min(bucket_start_unix) AS first_bucket, max(bucket_start_unix) AS last_bucket,
  count(*) * 3 AS expected_values, count(error) + count(purchase) + count(signup) AS observed_values FROM {0} GROUP BY 1),
quality AS (SELECT *, expected_values - observed_values AS missing_values, round((last_bucket - first_bucket) / 60, 2) AS duration_min,
  round(observed_values / expected_values * 100, 2) AS coverage_pct, round((expected_values - observed_values) / expected_values * 100, 2) AS missing_pct FROM cov),
flagged AS (SELECT *, CASE WHEN coverage_pct >= 95 THEN 'excellent' WHEN coverage_pct >= 80 THEN 'good' WHEN coverage_pct >= 60 THEN 'usable_with_caution' ELSE 'poor' END AS lift_quality_flag FROM quality)"""


@query("i15_lift_coverage", f"WITH {COVERAGE.format('biz')} SELECT * FROM flagged")
def i15(spark, sf_dir):
    return timeseries.coverage(views.matrix(spark, sf_dir), views.BIZ_COLUMNS)


def flagship(spark, sf_dir):
    """Bucket, pivot, fill the gaps, and rank the lifts by what is covered then."""
    return timeseries.coverage(filled(spark, sf_dir), views.BIZ_COLUMNS).orderBy(F.desc("coverage_pct"), "lift_id")


query("flagship_preprocessing", f"WITH {FILLED}, {COVERAGE.format('filled')} SELECT * FROM flagged")(flagship)


@query("e7_sequences", """
WITH s AS (SELECT lift_id, bucket_start_unix AS ts, list([round(error, 4), round(signup, 4)]) OVER w AS steps, max(CAST(coalesce(error > 50, false) AS INT)) OVER w AS active,
  row_number() OVER (PARTITION BY lift_id ORDER BY bucket_start_unix) AS n FROM biz WHERE error IS NOT NULL AND signup IS NOT NULL
  WINDOW w AS (PARTITION BY lift_id ORDER BY bucket_start_unix ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))
SELECT lift_id, ts, CAST(len(steps) AS INTEGER) AS n_steps, round(list_sum(list_transform(steps, lambda x: x[1])), 3) AS total_first, round(steps[1][2], 4) AS first_signup, active FROM s WHERE n >= 3""")  # fmt: skip
def e7(spark, sf_dir):
    m = views.matrix(spark, sf_dir).filter("error IS NOT NULL AND signup IS NOT NULL").withColumnRenamed("bucket_start_unix", "ts")
    m = rounded(m, ["error", "signup"], 4).withColumn("on", (F.col("error") > 50).cast("int"))
    s = timeseries.sequences(m, ["error", "signup"], 3, "on")
    total = F.round(F.aggregate("steps", F.lit(0.0), lambda a, x: a + x[0]), 3)
    return s.select("lift_id", "ts", F.size("steps").alias("n_steps"), total.alias("total_first"), F.round(F.col("steps")[0][1], 4).alias("first_signup"), "active")


@query("e8_prediction_windows", """
WITH m AS (SELECT lift_id, bucket_start_unix AS ts, round(click, 4) AS v, CAST(click > 50 AS INT) AS act FROM ui WHERE click IS NOT NULL),
s AS (SELECT lift_id, ts, v, row_number() OVER (PARTITION BY lift_id ORDER BY ts) AS n, count(*) OVER (PARTITION BY lift_id) AS size,
  sum(v) OVER (PARTITION BY lift_id ORDER BY ts ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS x, count(*) OVER (PARTITION BY lift_id ORDER BY ts ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS k,
  max(act) OVER (PARTITION BY lift_id ORDER BY ts ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS active, first_value(v) OVER (PARTITION BY lift_id ORDER BY ts) AS head FROM m)
SELECT lift_id, ts, 4 AS n_steps, round(coalesce(x, 0) + (4 - k) * head, 3) AS total, v AS target, active FROM s WHERE n > 4 OR (size <= 4 AND n = size)""")  # fmt: skip
def e8(spark, sf_dir):
    m = views.matrix(spark, sf_dir, views.UI).filter("click IS NOT NULL").withColumnRenamed("bucket_start_unix", "ts")
    m = rounded(m, ["click"], 4).withColumn("on", (F.col("click") > 50).cast("int"))
    w = timeseries.prediction_windows(m, ["click"], 4, "on")
    total = F.round(F.aggregate("steps", F.lit(0.0), lambda a, x: a + x[0]), 3)
    return w.select("lift_id", "ts", F.size("steps").alias("n_steps"), total.alias("total"), F.col("target")[0].alias("target"), "active")


@query("e9_forward_fill", """
SELECT lift_id, bucket_start_unix, round(last_value(error IGNORE NULLS) OVER w, 6) AS error, round(last_value(purchase IGNORE NULLS) OVER w, 6) AS purchase, round(last_value(signup IGNORE NULLS) OVER w, 6) AS signup
FROM biz WINDOW w AS (PARTITION BY lift_id ORDER BY bucket_start_unix ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")  # fmt: skip
def e9(spark, sf_dir):
    return rounded(timeseries.forward_fill(views.matrix(spark, sf_dir), views.BIZ_COLUMNS), views.BIZ_COLUMNS)


@query("e10_null_runs", """
WITH s AS (SELECT lift_id, bucket_start_unix, error, count(error) OVER (PARTITION BY lift_id ORDER BY bucket_start_unix) AS seen, count(error) OVER (PARTITION BY lift_id) AS total FROM biz)
SELECT 'error' AS tagname, lift_id, count(*) AS length FROM s WHERE error IS NULL AND seen > 0 AND seen < total GROUP BY lift_id, seen""")  # fmt: skip
def e10(spark, sf_dir):
    return timeseries.null_runs(views.matrix(spark, sf_dir), ["error"])

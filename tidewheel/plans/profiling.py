"""Queries on profiles, drift, co-activity and clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import coactivity, drift, profile, timeseries
from ..sources import driver
from . import views
from .registry import query
from .relational import LONG_BIZ, PROFILE
from .signals import FILLED, rounded

TRAIN, TEST = "(SELECT * FROM sensor WHERE lift_id % 4 <> 0)", "(SELECT * FROM sensor WHERE lift_id % 4 = 0)"


@query("j1_basic_profile", "SELECT 'sensor' AS dataset, count(*) AS rows, 5 AS columns, count(DISTINCT lift_id) AS lifts FROM sensor")
def j1(spark, sf_dir):
    log = driver.sensor_log(spark, sf_dir)
    return log.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("lift_id").alias("lifts")).select(F.lit("sensor").alias("dataset"), "rows", F.lit(len(log.columns)).alias("columns"), "lifts")


@query("j2_lift_leakage", "SELECT 'lift_leakage' AS \"check\", count(*) AS value, CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM (SELECT DISTINCT lift_id FROM sensor WHERE lift_id % 4 <> 0 INTERSECT SELECT DISTINCT lift_id FROM sensor WHERE lift_id % 4 = 0)")
def j2(spark, sf_dir):
    return profile.lift_overlap(views.train(spark, sf_dir), views.test(spark, sf_dir))


TAGS = """a AS (SELECT tagname, count(*) AS train_count, count(DISTINCT lift_id) AS train_lifts FROM {0} GROUP BY 1), b AS (SELECT tagname, count(*) AS test_count, count(DISTINCT lift_id) AS test_lifts FROM {1} GROUP BY 1),
j AS (SELECT coalesce(a.tagname, b.tagname) AS tagname, coalesce(train_count, 0) AS train_count, coalesce(test_count, 0) AS test_count, coalesce(train_lifts, 0) AS train_lifts, coalesce(test_lifts, 0) AS test_lifts FROM a FULL JOIN b ON a.tagname = b.tagname),
p AS (SELECT *, train_count / sum(train_count) OVER () AS tr, test_count / sum(test_count) OVER () AS te,
  CASE WHEN train_count > 0 AND test_count > 0 THEN 'present_in_both' WHEN train_count > 0 THEN 'missing_in_test' ELSE 'new_in_test' END AS coverage_status FROM j)"""
SHIFT = """SELECT tagname, coverage_status, CASE WHEN coverage_status <> 'present_in_both' THEN 'coverage_issue' WHEN abs(round((te - tr) * 100, 4)) >= 1.0 THEN 'large_proportion_shift'
  WHEN abs(round((te - tr) * 100, 4)) >= 0.1 THEN 'moderate_proportion_shift' ELSE 'similar_proportion' END AS tag_shift_flag, train_count, round(tr * 100, 4) AS train_pct, train_lifts,
  test_count, round(te * 100, 4) AS test_pct, test_lifts, round((te - tr) * 100, 4) AS prop_diff_pct, round(test_count / nullif(train_count, 0), 6) AS test_train_count_ratio FROM p"""
PARTIAL = ("(SELECT * FROM sensor WHERE lift_id % 4 <> 0 AND tagname <> 'Sys.Ui.view')", "(SELECT * FROM sensor WHERE lift_id % 4 = 0 AND tagname <> 'Sys.Biz.error')")


@query("j3_tag_coverage", f"WITH {TAGS.format(*PARTIAL)} SELECT coverage_status, count(*) AS n FROM p GROUP BY 1")
def j3(spark, sf_dir):
    both = profile.tag_comparison(views.train(spark, sf_dir).filter("tagname <> 'Sys.Ui.view'"), views.test(spark, sf_dir).filter("tagname <> 'Sys.Biz.error'"))
    return both.groupBy("coverage_status").agg(F.count(F.lit(1)).alias("n"))


@query("j9_tag_counts", f"WITH {TAGS.format(TRAIN, TEST)} SELECT tagname, train_count, test_count, round(tr * 100, 4) AS train_pct, round(te * 100, 4) AS test_pct FROM p")
def j9(spark, sf_dir):
    return profile.tag_comparison(views.train(spark, sf_dir), views.test(spark, sf_dir)).select("tagname", "train_count", "test_count", "train_pct", "test_pct")


@query("j10_tag_shift", f"WITH {TAGS.format(*PARTIAL)} {SHIFT}")
def j10(spark, sf_dir):
    return profile.tag_comparison(views.train(spark, sf_dir).filter("tagname <> 'Sys.Ui.view'"), views.test(spark, sf_dir).filter("tagname <> 'Sys.Biz.error'"))


@query("j4_category_comparison", """
WITH a AS (SELECT l_returnflag AS value, count(*) AS n FROM lineitem WHERE l_orderkey % 4 <> 0 GROUP BY 1), b AS (SELECT l_returnflag AS value, count(*) AS n FROM lineitem WHERE l_orderkey % 4 = 0 GROUP BY 1)
SELECT 'l_returnflag' AS "column", value, a.n AS train_count, round(a.n / sum(a.n) OVER () * 100, 3) AS train_pct, b.n AS test_count, round(b.n / sum(b.n) OVER () * 100, 3) AS test_pct,
  round(abs(b.n / sum(b.n) OVER () - a.n / sum(a.n) OVER ()) * 100, 3) AS abs_pct_diff FROM a JOIN b USING (value)""")  # fmt: skip
def j4(spark, sf_dir):
    lines = driver.table(spark, sf_dir, "lineitem")
    return profile.compare_categories(lines.filter("l_orderkey % 4 <> 0"), lines.filter("l_orderkey % 4 = 0"), "l_returnflag")


COLUMNS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def long_lines(spark, sf_dir):
    lines = driver.table(spark, sf_dir, "lineitem")
    side = lambda c: lines.filter(c).unpivot(["l_orderkey"], list(COLUMNS), "column", "value").select("column", "value")
    return side("l_orderkey % 4 <> 0"), side("l_orderkey % 4 = 0 AND l_quantity > 10")


#: Edges as columns e1 .. e7 of each variable, then buckets by comparison: distinct edges only.
BUCKETS = """long AS ({long}), edges AS (SELECT v, list_sort(list_distinct(quantile_cont(x, [0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]))) AS e FROM long WHERE side = 0 GROUP BY v),
numbered AS (SELECT long.v, side, e, CASE WHEN len(e) < 2 THEN NULL WHEN x IS NULL THEN 0 WHEN x < e[1] OR x > e[len(e)] THEN -1
  ELSE least(len(list_filter(e, lambda y: y <= x)), len(e) - 1) END AS b FROM long JOIN edges ON long.v = edges.v),
labelled AS (SELECT v, side, CASE WHEN b IS NULL THEN 'single_value_or_no_bucket' WHEN b = 0 THEN 'missing' WHEN b = -1 THEN 'outside_training_range'
  ELSE '[' || printf('%.3f', e[b]) || ', ' || printf('%.3f', e[b + 1]) || CASE WHEN b = len(e) - 1 THEN ']' ELSE ')' END END AS bucket FROM numbered),
counted AS (SELECT v, bucket, count(*) FILTER (side = 0) AS n0, count(*) FILTER (side = 1) AS n1 FROM labelled GROUP BY ALL),
prop AS (SELECT *, n0 / sum(n0) OVER (PARTITION BY v) AS p, n1 / sum(n1) OVER (PARTITION BY v) AS q FROM counted),
psi AS (SELECT *, CASE WHEN p > 0 AND q > 0 THEN (q - p) * ln(q / p) ELSE 0.0 END AS term FROM prop)"""
LONG_LINES = " UNION ALL ".join(f"SELECT '{c}' AS v, {c} AS x, CASE WHEN l_orderkey % 4 <> 0 THEN 0 ELSE 1 END AS side FROM lineitem WHERE l_orderkey % 4 <> 0 OR l_quantity > 10" for c in COLUMNS)
LONG_TAGS = "SELECT tagname AS v, value AS x, CASE WHEN lift_id % 4 <> 0 THEN 0 ELSE 1 END AS side FROM sensor"


@query("j5_quantile_buckets", f"WITH {BUCKETS.format(long=LONG_LINES)} SELECT v AS \"column\", bucket, n0 AS train_count, round(p * 100, 3) AS train_pct, n1 AS test_count, round(q * 100, 3) AS test_pct, round(abs(q - p) * 100, 3) AS abs_pct_diff, round(term, 8) AS psi_component FROM psi")
def j5(spark, sf_dir):
    return rounded(drift.compare_buckets(*long_lines(spark, sf_dir)), ["psi_component"], 8)


VERDICT = "CASE WHEN sum(term) < 0.10 THEN 'low_shift' WHEN sum(term) < 0.25 THEN 'moderate_shift' ELSE 'large_shift' END AS distribution_shift"


@query("j6_psi_verdict", f"WITH {BUCKETS.format(long=LONG_LINES)} SELECT v AS \"column\", round(sum(term), 8) AS psi, {VERDICT} FROM psi GROUP BY 1")
def j6(spark, sf_dir):
    return rounded(drift.psi(drift.compare_buckets(*long_lines(spark, sf_dir))), ["psi"], 8)


@query("j6_psi_smoothed", f"WITH {BUCKETS.format(long=LONG_LINES)}, eps AS (SELECT v, greatest(round(p * 100, 3) / 100, 1e-4) AS p, greatest(round(q * 100, 3) / 100, 1e-4) AS q FROM psi) SELECT v AS \"column\", round(sum((q - p) * ln(q / p)), 8) AS psi_eps FROM eps GROUP BY 1")
def j6_smoothed(spark, sf_dir):
    return rounded(drift.smoothed_psi(drift.compare_buckets(*long_lines(spark, sf_dir))), ["psi_eps"], 8)


@query("j7_psi_by_tag", f"WITH {BUCKETS.format(long=LONG_TAGS)}, ok AS (SELECT tagname FROM sensor GROUP BY 1 HAVING count(*) FILTER (lift_id % 4 <> 0) >= 1000 AND count(*) FILTER (lift_id % 4 = 0) >= 100) SELECT v AS tagname, round(sum(term), 8) AS psi, {VERDICT} FROM psi WHERE v IN (SELECT tagname FROM ok) GROUP BY 1")
def j7(spark, sf_dir):
    return rounded(drift.psi_by_tag(views.train(spark, sf_dir), views.test(spark, sf_dir)), ["psi"], 8)


@query("j8_conclusion", f"""
WITH {TAGS.format(*PARTIAL)} SELECT 'lift_leakage' AS "check", count(*) AS value, CASE WHEN count(*) > 0 THEN 'FAIL' ELSE 'PASS' END AS status, 'lifts in both' AS interpretation
FROM (SELECT DISTINCT lift_id FROM sensor WHERE lift_id % 4 <> 0 INTERSECT SELECT DISTINCT lift_id FROM sensor WHERE lift_id % 4 = 0)
UNION ALL SELECT 'raw_sensor_missing_in_test', count(*), CASE WHEN count(*) > 0 THEN 'WARN' ELSE 'PASS' END, 'tags only in training' FROM p WHERE coverage_status = 'missing_in_test'
UNION ALL SELECT 'raw_sensor_present_in_both', count(*), 'INFO', 'tags in both' FROM p WHERE coverage_status = 'present_in_both'""")  # fmt: skip
def j8(spark, sf_dir):
    tags = profile.tag_comparison(views.train(spark, sf_dir).filter("tagname <> 'Sys.Ui.view'"), views.test(spark, sf_dir).filter("tagname <> 'Sys.Biz.error'"))
    count = lambda s: tags.filter(F.col("coverage_status") == s).agg(F.count(F.lit(1)).alias("n"))
    leak = profile.lift_overlap(views.train(spark, sf_dir), views.test(spark, sf_dir)).select("value")
    return profile.conclusion([
        ("lift_leakage", leak, "FAIL", "lifts in both"),
        ("raw_sensor_missing_in_test", count("missing_in_test"), "WARN", "tags only in training"),
        ("raw_sensor_present_in_both", count("present_in_both"), "INFO", "tags in both"),
    ])


def _profile(df):
    return rounded(profile.numeric_profile(df, views.BIZ_COLUMNS), ["mean", "stddev"])


@query("j11_profile_after_fill", f"WITH {FILLED} SELECT {PROFILE.replace('min(v) AS min', 'round(min(v), 6) AS min').replace('max(v) AS max', 'round(max(v), 6) AS max')} FROM {LONG_BIZ.format('filled')} GROUP BY tagname")
def j11(spark, sf_dir):
    from .signals import filled

    return rounded(_profile(filled(spark, sf_dir)), ["min", "max"])


@query("j12_before_after", f"""
WITH {FILLED}, x AS (SELECT {PROFILE} FROM {LONG_BIZ.format('biz')} GROUP BY tagname), y AS (SELECT {PROFILE} FROM {LONG_BIZ.format('filled')} GROUP BY tagname)
SELECT x.tagname, x.rows AS rows_before, x.null_pct AS null_pct_before, x.mean AS mean_before, x.stddev AS stddev_before, y.rows AS rows_after, y.null_pct AS null_pct_after, y.mean AS mean_after, y.stddev AS stddev_after,
  round(x.null_pct - y.null_pct, 3) AS null_pct_reduction FROM x JOIN y USING (tagname)""")  # fmt: skip
def j12(spark, sf_dir):
    from .signals import filled

    return profile.before_after(_profile(views.matrix(spark, sf_dir)), _profile(filled(spark, sf_dir)), ["tagname"])


@query("j12_train_vs_test", f"""
WITH x AS (SELECT CASE WHEN lift_id % 4 = 0 THEN 'test' ELSE 'training' END AS dataset, {PROFILE} FROM {LONG_BIZ.format('biz')} GROUP BY ALL)
SELECT a.tagname, a.null_pct AS training_null_pct, b.null_pct AS test_null_pct, a.mean AS training_mean, b.mean AS test_mean, a.stddev AS training_stddev, b.stddev AS test_stddev, round(b.null_pct - a.null_pct, 3) AS null_pct_difference
FROM x a JOIN x b ON a.tagname = b.tagname AND a.dataset = 'training' AND b.dataset = 'test'""")  # fmt: skip
def j12_sides(spark, sf_dir):
    m = views.matrix(spark, sf_dir).withColumn("dataset", F.when(F.col("lift_id") % 4 == 0, "test").otherwise("training"))
    return profile.train_vs_test(rounded(profile.numeric_profile(m, views.BIZ_COLUMNS, ["dataset"]), ["mean", "stddev"]))


@query("j13_master_profile", """
SELECT tag_group, tagname, count(*) AS rows, count(value) AS non_null_count, count(*) - count(value) AS null_count, CAST(0 AS DOUBLE) AS null_pct, min(value) AS min, max(value) AS max, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS stddev
FROM bucketed GROUP BY ALL""")  # fmt: skip
def j13(spark, sf_dir):
    return rounded(profile.long_profile(views.bucketed(spark, sf_dir), ["tag_group", "tagname"]), ["mean", "stddev"])


@query("j14_movement_distribution", """
WITH d AS (SELECT movementtype, count(*) AS deduplicated_count FROM (SELECT user_id, min(movementtype) AS movementtype FROM lifts GROUP BY 1) GROUP BY 1), r AS (SELECT movementtype, count(*) AS raw_count FROM lifts GROUP BY 1)
SELECT movementtype, raw_count, coalesce(deduplicated_count, 0) AS deduplicated_count, round(raw_count / sum(raw_count) OVER (), 9) AS share FROM r LEFT JOIN d USING (movementtype)""")  # fmt: skip
def j14(spark, sf_dir):
    e = driver.table(spark, sf_dir, "events").filter("event_type = 'signup'").select("user_id", (1 + F.col("user_id") % 5).cast("int").alias("movementtype"))
    return rounded(profile.raw_and_deduplicated(e, "movementtype", "user_id"), ["share"], 9)


@query("j15_file_representativeness", """
WITH o AS (SELECT 'file' || (o_custkey % 7) AS file, o_orderpriority AS c FROM orders), full_ AS (SELECT c, count(*) / sum(count(*)) OVER () AS fs FROM o GROUP BY 1),
n AS (SELECT file, count(*) AS rows FROM o GROUP BY 1 HAVING count(*) >= 100), own AS (SELECT file, c, count(*) AS k FROM o GROUP BY ALL)
SELECT n.file, n.rows, round(sqrt(sum(pow(coalesce(k, 0) / rows - fs, 2))), 9) AS distance FROM n CROSS JOIN full_ LEFT JOIN own ON own.file = n.file AND own.c = full_.c GROUP BY ALL""")  # fmt: skip
def j15(spark, sf_dir):
    orders = driver.table(spark, sf_dir, "orders").select(F.concat(F.lit("file"), (F.col("o_custkey") % 7).cast("string")).alias("file"), "o_orderpriority")
    return rounded(profile.file_distance(orders, "file", "o_orderpriority"), ["distance"], 9)


PRESENCE = "present AS (SELECT DISTINCT lift_id, CAST(floor(ts_unix / 86400) AS BIGINT) * 86400 AS bucket, tagname FROM sensor)"


@query("j16_activity_rate", f"WITH {PRESENCE}, k AS (SELECT count(*) AS n_buckets FROM (SELECT DISTINCT lift_id, bucket FROM present)) SELECT tagname, count(*) AS n, any_value(n_buckets) AS n_buckets, round(100 * count(*) / any_value(n_buckets), 6) AS activity_pct FROM present, k GROUP BY 1")
def j16(spark, sf_dir):
    return rounded(coactivity.activity_rate(coactivity.presence(driver.sensor_log(spark, sf_dir), 86_400)), ["activity_pct"])


JACCARD = f"""{PRESENCE}, cnt AS (SELECT tagname, count(*) AS n FROM present GROUP BY 1),
met AS (SELECT a.tagname AS tag_a, b.tagname AS tag_b, count(*) AS both_ FROM present a JOIN present b ON a.lift_id = b.lift_id AND a.bucket = b.bucket AND a.tagname < b.tagname GROUP BY ALL),
pairs AS (SELECT a.tagname AS tag_a, b.tagname AS tag_b, coalesce(both_, 0) AS both_, a.n + b.n - coalesce(both_, 0) AS either FROM cnt a JOIN cnt b ON a.tagname < b.tagname LEFT JOIN met ON met.tag_a = a.tagname AND met.tag_b = b.tagname)"""


@query("j17_jaccard", f"WITH {JACCARD} SELECT tag_a, tag_b, both_ AS both, either, round(both_ / either, 9) AS jaccard FROM pairs")
def j17(spark, sf_dir):
    return rounded(coactivity.jaccard(coactivity.presence(driver.sensor_log(spark, sf_dir), 86_400)), ["jaccard"], 9)


@query("j18_top_partners", f"""
WITH {JACCARD}, x AS (SELECT tag_a AS tagname, tag_b AS partner, both_ / either AS j FROM pairs UNION ALL SELECT tag_b, tag_a, both_ / either FROM pairs)
SELECT tagname, partner, round(j, 9) AS jaccard, CAST(row_number() OVER (PARTITION BY tagname ORDER BY j DESC, partner) AS INTEGER) AS rank FROM x QUALIFY rank <= 2""")  # fmt: skip
def j18(spark, sf_dir):
    similar = coactivity.jaccard(coactivity.presence(driver.sensor_log(spark, sf_dir), 86_400))
    return rounded(coactivity.top_partners(similar, 2), ["jaccard"], 9)


@query("j19_clusters")
def j19(spark, sf_dir):
    return coactivity.clusters(coactivity.jaccard(coactivity.presence(driver.sensor_log(spark, sf_dir), 86_400)), 0.9)


@query("j20_subsystem_rollup", """
WITH t AS (SELECT tagname, count(*) AS n FROM sensor GROUP BY 1)
SELECT split_part(tagname, '.', 1) AS source, split_part(tagname, '.', 2) AS subsystem, split_part(tagname, '.', 2) AS label, count(*) AS n_tags, CAST(sum(n) AS BIGINT) AS n_observations,
  round(count(*) / sum(count(*)) OVER (), 9) AS tag_share, round(sum(n) / sum(sum(n)) OVER (), 9) AS observation_share FROM t GROUP BY ALL""")  # fmt: skip
def j20(spark, sf_dir):
    return rounded(profile.subsystem_rollup(driver.sensor_log(spark, sf_dir)), ["tag_share", "observation_share"], 9)


@query("j21_magnitude_bins", """
WITH b(bin, label, low, high) AS (VALUES (1, '<1k', 0, 1e3), (2, '1k-10k', 1e3, 1e4), (3, '10k-100k', 1e4, 1e5), (4, '100k-1M', 1e5, 1e6), (5, '1M-10M', 1e6, 1e7), (6, '>10M', 1e7, 1e300)),
t AS (SELECT lift_id, count(*) AS c FROM sensor GROUP BY 1), x AS (SELECT bin, label, count(c) AS n, CAST(coalesce(sum(c), 0) AS BIGINT) AS total FROM b LEFT JOIN t ON c >= low AND c < high GROUP BY ALL)
SELECT bin, label, n, total, round(n / sum(n) OVER (), 9) AS n_share, round(total / sum(total) OVER (), 9) AS total_share FROM x""")  # fmt: skip
def j21(spark, sf_dir):
    counts = driver.sensor_log(spark, sf_dir).groupBy("lift_id").agg(F.count(F.lit(1)).alias("c"))
    return rounded(profile.histogram(counts, "c", *profile.MAGNITUDES, weight="c"), ["n_share", "total_share"], 9)

"""Queries on scans, projections, joins, aggregates, sorting, sets and scalar functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..config import ALARM_BLACKLIST, group_table
from ..functions.quantiles import exact_quantiles
from ..operators import ingest, profile, timeseries
from ..sources import driver, files
from ..sources.scratch import kept, scratch
from . import views
from .registry import query


# --- A -----------------------------------------------------------------------------------------


@query("a3_csv_scan", "SELECT movementid, movementtype, epoch_us(started) AS started_us, movementduration FROM lifts")
def a3(spark, sf_dir):
    with scratch(spark) as path:
        driver.lift_log(spark, sf_dir).write.option("header", True).option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").csv(path)
        df = files.read_csv(spark, path, files.LIFTLOG_SCHEMA)
        return kept(df.select("movementid", "movementtype", F.unix_micros("started").alias("started_us"), "movementduration"))


@query("a4_csv_scan_with_file", "SELECT movementtype, count(*) AS n, true AS named FROM lifts GROUP BY 1")
def a4(spark, sf_dir):
    with scratch(spark) as path:
        driver.lift_log(spark, sf_dir).write.partitionBy("movementtype").option("header", True).csv(path)
        df = files.read_csv(spark, path, None, file_column="file")
        return kept(df.groupBy(F.col("movementtype").cast("int").alias("movementtype")).agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("file").contains("movementtype=")).alias("named")))


@query("a6_table_scan", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 300000")
def a6(spark, sf_dir):
    return driver.table(spark, sf_dir, "orders").filter("o_totalprice > 300000").select("o_orderkey", "o_totalprice")


@query("a8_parquet_sink", "SELECT tagname, count(*) AS n, round(sum(value), 4) AS total FROM sensor GROUP BY 1")
def a8(spark, sf_dir):
    with scratch(spark) as path:
        driver.sensor_log(spark, sf_dir).write.partitionBy("tagname").parquet(path)
        return kept(spark.read.parquet(path).groupBy("tagname").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")))


@query("a7_table_overwrite", "SELECT movementid, movementtype, movementduration * 2 AS doubled, CAST(NULL AS DOUBLE) AS movementduration FROM lifts WHERE movementtype <> 5")
def a7(spark, sf_dir):
    """A managed table, overwritten by fewer rows with another column; the old columns stay, as nulls."""
    import uuid

    name = f"tidewheel_{uuid.uuid4().hex}"
    try:
        files.save_table(driver.lift_log(spark, sf_dir).select("movementid", "movementtype", "movementduration"), name)
        new = driver.lift_log(spark, sf_dir).filter("movementtype <> 5").select("movementid", "movementtype", (F.col("movementduration") * 2).alias("doubled"))
        files.save_table(new, name, merge_schema=True)
        return kept(spark.table(name))
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


@query("a9_literal_relation", "SELECT * FROM (VALUES ('Sys.Ui.click', 'ui', 43200), ('Sys.Ui.view', 'ui', 43200), ('Sys.Biz.error', 'biz', 86400), ('Sys.Biz.purchase', 'biz', 86400), ('Sys.Biz.signup', 'biz', 86400)) t(tagname, tag_group, bucket_size_s)")
def a9(spark, sf_dir):
    return group_table(spark, driver.GROUPS)


@query("a11_tsv_sink", "SELECT movementtype, count(*) AS n FROM lifts GROUP BY 1")
def a11(spark, sf_dir):
    with scratch(spark) as path:
        files.write_tsv(driver.lift_log(spark, sf_dir).groupBy("movementtype").agg(F.count(F.lit(1)).alias("n")), path)
        return kept(files.read_tsv(spark, path, "movementtype int, n long"))


# --- B -----------------------------------------------------------------------------------------


@query("b1_typed_union", """
SELECT event_id, tagname, CASE event_id % 4 WHEN 0 THEN CAST(value > 50 AS DOUBLE) WHEN 1 THEN floor(value) ELSE value END AS value,
       CASE event_id % 4 WHEN 0 THEN 'bool' WHEN 1 THEN 'int' ELSE 'float' END AS datatype
FROM sensor WHERE event_id % 4 < 3""")  # fmt: skip
def b1(spark, sf_dir):
    columns = {"bool": "bool_val", "int": "int_val", "float": "float_val"}
    return ingest.decode_typed_union(driver.raw_log(spark, sf_dir), columns).select("event_id", "tagname", "value", "datatype")


@query("b2_interval_end", "SELECT iv_id, epoch_us(iv_start) AS start_us, epoch_us(iv_end) AS end_us FROM intervals")
def b2(spark, sf_dir):
    return views.intervals(spark, sf_dir).select("iv_id", F.unix_micros("iv_start").alias("start_us"), F.unix_micros("iv_end").alias("end_us"))


@query("b3_reorder_drop", "SELECT movementid AS lift_id, movementid, movementtype, movementduration FROM lifts")
def b3(spark, sf_dir):
    return ingest.with_interval(driver.lift_log(spark, sf_dir), "started", "movementduration", "movementid").drop("lift_start_ts", "lift_end_ts")


@query("b4_blacklist", "SELECT event_id, id FROM alarms WHERE id NOT IN (3, 5, 7)")
def b4(spark, sf_dir):
    alarms = ingest.without(driver.alarm_log(spark, sf_dir), "id", ALARM_BLACKLIST)
    return ingest.without(alarms, "id", (3, 5, 7)).select("event_id", "id")


@query("b5_type_partition", "SELECT movementtype = 5 AS excluded, count(*) AS n FROM lifts GROUP BY 1")
def b5(spark, sf_dir):
    log = driver.lift_log(spark, sf_dir)
    same, other = log.filter("movementtype = 5"), log.filter("movementtype <> 5")
    count = lambda df, flag: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(flag).alias("excluded"), "n")
    return count(same, True).unionByName(count(other, False))


@query("b6_null_predicates", "SELECT movementtype IS NULL AS missing, count(*) AS n FROM lift_types GROUP BY 1")
def b6(spark, sf_dir):
    return driver.lift_types(spark, sf_dir).groupBy(F.col("movementtype").isNull().alias("missing")).agg(F.count(F.lit(1)).alias("n"))


@query("b7_tag_group_case", "SELECT tagname, CASE WHEN tagname LIKE 'Sys.Ui.%' THEN 'ui' WHEN tagname = 'Sys.Biz.error' THEN 'errors' ELSE 'other' END AS tag_group, count(*) AS n FROM sensor GROUP BY ALL")
def b7(spark, sf_dir):
    names = {"Sys.Ui.click": "ui", "Sys.Ui.view": "ui", "Sys.Biz.error": "errors"}
    table = F.broadcast(spark.createDataFrame(list(names.items()), "tagname string, tag_group string"))
    out = driver.sensor_log(spark, sf_dir).groupBy("tagname").agg(F.count(F.lit(1)).alias("n")).join(table, "tagname", "left")
    return out.na.fill("other", ["tag_group"])


@query("b8_map_lookup", "SELECT DISTINCT tagname, bucket_size_s FROM bucketed")
def b8(spark, sf_dir):
    sizes = F.create_map(*[F.lit(x) for g in driver.GROUPS for t in g.tags for x in (t, g.bucket_s)])
    return driver.sensor_log(spark, sf_dir).select("tagname").distinct().select("tagname", F.try_element_at(sizes, "tagname").alias("bucket_size_s"))


@query("b9_add_columns", "SELECT l_orderkey AS order_key, l_linenumber, 'line' AS kind, CAST(l_quantity AS BIGINT) AS quantity FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-08-01'")
def b9(spark, sf_dir):
    df = driver.table(spark, sf_dir, "lineitem").filter("l_shipdate >= timestamp '1998-08-01'")
    df = df.withColumns({"kind": F.lit("line"), "quantity": F.col("l_quantity").cast("long")}).withColumnsRenamed({"l_orderkey": "order_key"})
    return df.select("order_key", "l_linenumber", "kind", "quantity")


@query("b10_exclude_lifts", "SELECT lift_id, count(*) AS n FROM biz WHERE lift_id NOT IN (SELECT lift_id FROM lift_types WHERE movementtype = 5) GROUP BY 1")
def b10(spark, sf_dir):
    rows = ingest.keep_lifts(views.bucketed(spark, sf_dir), driver.lift_types(spark, sf_dir), 5)
    return timeseries.group_matrix(rows, views.BIZ).groupBy("lift_id").agg(F.count(F.lit(1)).alias("n"))


@query("b11_fill_constants", "SELECT lift_id, coalesce(movementtype, 0) AS movementtype FROM lift_types")
def b11(spark, sf_dir):
    return driver.lift_types(spark, sf_dir).na.fill({"movementtype": 0})


@query("b14_complete_rows", "SELECT lift_id, bucket_start_unix, error, purchase, signup FROM biz WHERE error IS NOT NULL AND purchase IS NOT NULL AND signup IS NOT NULL")
def b14(spark, sf_dir):
    return views.matrix(spark, sf_dir).na.drop("any", subset=views.BIZ_COLUMNS)


@query("b15_all_null_rows", "SELECT lift_id, bucket_start_unix, error, purchase FROM biz WHERE error IS NOT NULL OR purchase IS NOT NULL")
def b15(spark, sf_dir):
    return views.matrix(spark, sf_dir).drop("signup").na.drop("all", subset=["error", "purchase"])


@query("b16_active_rows", "SELECT lift_id, bucket_start_unix FROM biz WHERE coalesce(CAST(error > 40 AS INT), 0) + coalesce(CAST(signup > 40 AS INT), 0) >= 1")
def b16(spark, sf_dir):
    m = views.matrix(spark, sf_dir).withColumns({"a": F.col("error") > 40, "b": F.col("signup") > 40})
    return m.filter(timeseries.active_groups(["a", "b"]) >= 1).select("lift_id", "bucket_start_unix")


@query("b17_numeric_columns", "SELECT p_partkey, p_size, p_retailprice FROM part")
def b17(spark, sf_dir):
    """Numeric columns only; of two groups of columns, the one without any is skipped."""
    part = driver.table(spark, sf_dir, "part")
    groups = [profile.numeric_only(part.select("p_partkey", *columns), ["p_partkey"]) for columns in (("p_name", "p_brand"), ("p_type", "p_size", "p_retailprice"))]
    return next(df for df in groups if df is not None)


@query("b18_expected_columns", "SELECT CAST(NULL AS DOUBLE) AS torque, signup, error FROM biz")
def b18(spark, sf_dir):
    return profile.with_columns_of(views.matrix(spark, sf_dir), ["torque", "signup", "error"])


# --- C -----------------------------------------------------------------------------------------

JOINED = "sensor s JOIN intervals i ON s.timestamp_utc BETWEEN i.iv_start AND i.iv_end"


@query("c1_interval_join_inner", f"SELECT s.event_id, i.iv_id, i.movementtype FROM {JOINED}")
def c1(spark, sf_dir):
    points = driver.sensor_log(spark, sf_dir)
    return ingest.interval_join(points, views.intervals(spark, sf_dir), "timestamp_utc", "iv_start", "iv_end").select("event_id", "iv_id", "movementtype")


@query("c2_interval_join_left", "SELECT a.event_id, a.id, i.iv_id FROM alarms a LEFT JOIN intervals i ON a.timestamp_utc BETWEEN i.iv_start AND i.iv_end")
def c2(spark, sf_dir):
    alarms = driver.alarm_log(spark, sf_dir)
    joined = ingest.interval_join(alarms, views.intervals(spark, sf_dir), "timestamp_utc", "iv_start", "iv_end", "left", "event_id")
    return joined.select("event_id", "id", "iv_id")


@query("c3_alarm_counts", """
WITH hits AS (SELECT i.iv_id, count(*) AS n FROM alarms a JOIN intervals i ON a.timestamp_utc BETWEEN i.iv_start AND i.iv_end GROUP BY 1)
SELECT i.iv_id, coalesce(n, 0) AS alarm_count FROM intervals i LEFT JOIN hits USING (iv_id)""")  # fmt: skip
def c3(spark, sf_dir):
    iv = views.intervals(spark, sf_dir)
    hits = ingest.interval_join(driver.alarm_log(spark, sf_dir), iv, "timestamp_utc", "iv_start", "iv_end")
    return ingest.with_counts(iv, hits, "iv_id", "alarm_count").select("iv_id", "alarm_count")


@query("c4_full_outer_compare", """
WITH a AS (SELECT o_orderpriority AS value, count(*) AS n FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1),
b AS (SELECT o_orderpriority AS value, count(*) AS n FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderpriority <> '1-URGENT' GROUP BY 1)
SELECT 'o_orderpriority' AS "column", coalesce(a.value, b.value) AS value, coalesce(a.n, 0) AS train_count,
  round(coalesce(a.n, 0) / (SELECT sum(n) FROM a) * 100, 3) AS train_pct, coalesce(b.n, 0) AS test_count,
  round(coalesce(b.n, 0) / (SELECT sum(n) FROM b) * 100, 3) AS test_pct,
  round(abs(coalesce(b.n, 0) / (SELECT sum(n) FROM b) - coalesce(a.n, 0) / (SELECT sum(n) FROM a)) * 100, 3) AS abs_pct_diff
FROM a FULL JOIN b ON a.value = b.value""")  # fmt: skip
def c4(spark, sf_dir):
    orders = driver.table(spark, sf_dir, "orders")
    return profile.compare_categories(orders.filter("o_orderkey % 3 = 0"), orders.filter("o_orderkey % 3 <> 0 AND o_orderpriority <> '1-URGENT'"), "o_orderpriority")


@query("c5_lift_overlap", "SELECT 'lift_leakage' AS \"check\", count(*) AS value, CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM (SELECT DISTINCT lift_id FROM sensor WHERE lift_id % 4 <> 0 INTERSECT SELECT DISTINCT lift_id FROM sensor WHERE lift_id % 3 = 0)")
def c5(spark, sf_dir):
    log = driver.sensor_log(spark, sf_dir)
    return profile.lift_overlap(log.filter("lift_id % 4 <> 0"), log.filter("lift_id % 3 = 0"))


@query("c6_valid_lifts", "SELECT tagname, count(*) AS n FROM sensor WHERE lift_id IN (SELECT lift_id FROM lift_types WHERE movementtype <> 5) GROUP BY 1")
def c6(spark, sf_dir):
    kept = ingest.keep_lifts(driver.sensor_log(spark, sf_dir), driver.lift_types(spark, sf_dir), 5, "include")
    return kept.groupBy("tagname").agg(F.count(F.lit(1)).alias("n"))


@query("c7_common_tags", """
WITH a AS (SELECT tagname, count(*) AS train_count FROM sensor WHERE lift_id % 4 <> 0 GROUP BY 1), b AS (SELECT tagname, count(*) AS test_count FROM sensor WHERE lift_id % 4 = 0 GROUP BY 1)
SELECT tagname, train_count, test_count FROM a JOIN b USING (tagname) WHERE train_count >= 1000 AND test_count >= 100 ORDER BY train_count DESC, tagname LIMIT 200""")  # fmt: skip
def c7(spark, sf_dir):
    from ..operators import drift

    return drift.common_tags(views.train(spark, sf_dir), views.test(spark, sf_dir))


@query("c10_asof_backward", """
SELECT b.lift_id, b.bucket_start_unix AS ts, b.error, u.click AS ui_click, u.view AS ui_view
FROM biz b ASOF LEFT JOIN ui u ON b.lift_id = u.lift_id AND b.bucket_start_unix >= u.bucket_start_unix""")  # fmt: skip
def c10(spark, sf_dir):
    base = views.matrix(spark, sf_dir).select("lift_id", F.col("bucket_start_unix").alias("ts"), "error")
    ui = views.matrix(spark, sf_dir, views.UI).withColumnRenamed("bucket_start_unix", "ts")
    return timeseries.asof_align(base, {"ui": (ui, views.UI_COLUMNS)})


@query("c11_union_timeline", """
WITH t AS (SELECT lift_id, bucket_start_unix AS ts FROM biz UNION SELECT lift_id, bucket_start_unix FROM ui)
SELECT t.lift_id, t.ts, b.error AS biz_error, u.click AS ui_click FROM t ASOF LEFT JOIN biz b ON t.lift_id = b.lift_id AND t.ts >= b.bucket_start_unix
ASOF LEFT JOIN ui u ON t.lift_id = u.lift_id AND t.ts >= u.bucket_start_unix""")  # fmt: skip
def c11(spark, sf_dir):
    frames = [views.matrix(spark, sf_dir, g).withColumnRenamed("bucket_start_unix", "ts") for g in (views.BIZ, views.UI)]
    return timeseries.asof_align(timeseries.timeline(frames), {"biz": (frames[0], ["error"]), "ui": (frames[1], ["click"])})


@query("c12_lookup_join", "SELECT l.iv_id, m.movementtype FROM intervals l LEFT JOIN (SELECT user_id % 7 AS k, max(movementtype) AS movementtype FROM lifts WHERE user_id % 7 < 5 GROUP BY 1) m ON l.iv_id % 7 = m.k")
def c12(spark, sf_dir):
    events = driver.table(spark, sf_dir, "events").filter("event_type = 'signup' AND user_id % 7 < 5")
    dimension = events.select((F.col("user_id") % 7).alias("k"), (1 + F.col("user_id") % 5).cast("int").alias("movementtype"))
    base = views.intervals(spark, sf_dir).select("iv_id", (F.col("iv_id") % 7).alias("k"))
    return ingest.with_lookup(base, dimension, "k", "movementtype").select("iv_id", "movementtype")


@query("c14_left_join_metadata", "SELECT s.lift_id, t.movementtype, count(*) AS n FROM sensor s LEFT JOIN lift_types t USING (lift_id) GROUP BY ALL")
def c14(spark, sf_dir):
    joined = driver.sensor_log(spark, sf_dir).join(driver.lift_types(spark, sf_dir), "lift_id", "left")
    return joined.groupBy("lift_id", "movementtype").agg(F.count(F.lit(1)).alias("n"))


# --- D -----------------------------------------------------------------------------------------


@query("d1_group_count", "SELECT movementtype, count(*) AS n FROM lifts GROUP BY 1")
def d1(spark, sf_dir):
    return driver.lift_log(spark, sf_dir).groupBy("movementtype").agg(F.count(F.lit(1)).alias("n")).orderBy("movementtype")


@query("d2_global_counts", "SELECT count(*) AS n, count(DISTINCT tagname) AS tags, count(DISTINCT lift_id) AS lifts FROM sensor")
def d2(spark, sf_dir):
    return driver.sensor_log(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("tagname").alias("tags"), F.count_distinct("lift_id").alias("lifts"))


@query("d3_grouped_distinct", "SELECT tagname, count(DISTINCT lift_id) AS lifts FROM sensor GROUP BY 1")
def d3(spark, sf_dir):
    return driver.sensor_log(spark, sf_dir).groupBy("tagname").agg(F.count_distinct("lift_id").alias("lifts"))


@query("d4_values_per_lift", "WITH p AS (SELECT lift_id, count(*) AS n FROM sensor GROUP BY 1) SELECT min(n) AS least, max(n) AS most, round(avg(n), 6) AS mean, CAST(sum(n) AS BIGINT) AS total, count(*) AS lifts FROM p")
def d4(spark, sf_dir):
    per = driver.sensor_log(spark, sf_dir).groupBy("lift_id").agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.min("n").alias("least"), F.max("n").alias("most"), F.round(F.avg("n"), 6).alias("mean"), F.sum("n").alias("total"), F.count(F.lit(1)).alias("lifts"))


@query("d5_percentiles", "SELECT tagname, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.95), 6) AS p95 FROM sensor GROUP BY 1")
def d5(spark, sf_dir):
    found = exact_quantiles(driver.sensor_log(spark, sf_dir), ["tagname"], "value", [0.5, 0.9, 0.95])
    return found.select("tagname", *[F.round(F.col("quantiles")[i], 6).alias(n) for i, n in enumerate(("p50", "p90", "p95"))])


@query("d5_percentiles_approx", "SELECT tagname, count(*) AS n, true AS close FROM sensor GROUP BY 1")
def d5_approx(spark, sf_dir):
    """Approximate percentiles, held against the ranks they really have."""
    log, points = driver.sensor_log(spark, sf_dir), (0.5, 0.9, 0.95)
    found = log.groupBy("tagname").agg(F.percentile_approx("value", list(points), 10_000).alias("q"))
    ranks = log.join(found, "tagname").groupBy("tagname").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("value") < F.col("q")[i]).alias(f"b{i}") for i in range(3)], *[F.count_if(F.col("value") <= F.col("q")[i]).alias(f"u{i}") for i in range(3)])
    within = [(F.col(f"b{i}") <= p * F.col("n") + F.col("n") / 10_000 + 1) & (F.col(f"u{i}") >= p * F.col("n") - F.col("n") / 10_000 - 1) for i, p in enumerate(points)]
    return ranks.select("tagname", "n", (within[0] & within[1] & within[2]).alias("close"))


@query("d6_duration_profile", "SELECT movementtype, count(*) AS n, round(avg(movementduration), 6) AS mean_s, round(median(movementduration), 6) AS median_s, max(movementduration) AS max_s FROM lifts GROUP BY 1")
def d6(spark, sf_dir):
    log = driver.lift_log(spark, sf_dir)
    out = log.groupBy("movementtype").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("movementduration"), 6).alias("mean_s"), F.max("movementduration").alias("max_s"))
    middle = exact_quantiles(log, ["movementtype"], "movementduration", [0.5]).select("movementtype", F.round(F.col("quantiles")[0], 6).alias("median_s"))
    return out.join(middle, "movementtype", "left").select("movementtype", "n", "mean_s", "median_s", "max_s")


PROFILE = """tagname, count(*) AS rows, count(v) AS non_null_count, count(*) - count(v) AS null_count, round((count(*) - count(v)) / count(*) * 100, 3) AS null_pct,
  min(v) AS min, max(v) AS max, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS stddev"""
LONG_BIZ = "(SELECT lift_id, 'error' AS tagname, error AS v FROM {0} UNION ALL SELECT lift_id, 'purchase', purchase FROM {0} UNION ALL SELECT lift_id, 'signup', signup FROM {0})"


@query("d7_column_statistics", f"SELECT {PROFILE} FROM {LONG_BIZ.format('biz')} GROUP BY tagname")
def d7(spark, sf_dir):
    out = profile.numeric_profile(views.matrix(spark, sf_dir), views.BIZ_COLUMNS)
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "stddev")})


@query("d8_missing_profile", """
SELECT 'error' AS "column", count(*) AS rows, count(*) - count(error) AS missing, round(100 * (count(*) - count(error)) / count(*), 3) AS missing_pct FROM biz
UNION ALL SELECT 'purchase', count(*), count(*) - count(purchase), round(100 * (count(*) - count(purchase)) / count(*), 3) FROM biz
UNION ALL SELECT 'lift_id', count(*), count(*) - count(lift_id), round(100 * (count(*) - count(lift_id)) / count(*), 3) FROM biz""")  # fmt: skip
def d8(spark, sf_dir):
    return profile.missing_profile(views.matrix(spark, sf_dir), ["error", "purchase", "lift_id"])


@query("d10_pivot", "SELECT lift_id, bucket_start_unix, round(error, 6) AS error, round(purchase, 6) AS purchase, round(signup, 6) AS signup FROM biz")
def d10(spark, sf_dir):
    return views.matrix(spark, sf_dir).withColumns({c: F.round(c, 6) for c in views.BIZ_COLUMNS})


@query("d11_presence_pivot", "SELECT lift_id, bucket_start_unix, max(CASE WHEN tagname = 'Sys.Ui.click' THEN 1 ELSE 0 END) AS click, max(CASE WHEN tagname = 'Sys.Ui.view' THEN 1 ELSE 0 END) AS view FROM bucketed WHERE tag_group = 'ui' GROUP BY ALL")
def d11(spark, sf_dir):
    rows = views.bucketed(spark, sf_dir).filter("tag_group = 'ui'")
    return rows.groupBy("lift_id", "bucket_start_unix").pivot("tagname", list(views.UI.tags)).agg(F.max(F.lit(1))).na.fill(0).withColumnsRenamed(views.SHORT)


@query("d13_share", "SELECT tagname, count(*) AS count, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM sensor GROUP BY 1")
def d13(spark, sf_dir):
    return profile.shares(driver.sensor_log(spark, sf_dir), "tagname").withColumn("share", F.round("share", 9))


@query("d20_medians", "SELECT round(median(error), 6) AS error, round(median(purchase), 6) AS purchase, round(median(signup), 6) AS signup FROM biz")
def d20(spark, sf_dir):
    return views.matrix(spark, sf_dir).agg(*[F.round(F.median(c), 6).alias(c) for c in views.BIZ_COLUMNS])


@query("d21_group_summary", "SELECT movementtype, round(avg(movementduration), 3) AS mean, max(movementduration) AS most, min(movementid) AS first FROM lifts GROUP BY 1")
def d21(spark, sf_dir):
    return driver.lift_log(spark, sf_dir).groupBy("movementtype").agg(F.round(F.avg("movementduration"), 3).alias("mean"), F.max("movementduration").alias("most"), F.min("movementid").alias("first"))


@query("d22_histogram", """
WITH b(bin, label, low, high) AS (VALUES (1, 'low', 0, 25), (2, 'mid', 25, 100), (3, 'high', 100, 1e4), (4, 'never', 1e4, 1e300)),
c AS (SELECT bin, label, count(value) AS n, coalesce(sum(value), 0.0) AS total FROM b LEFT JOIN sensor ON value >= low AND value < high GROUP BY ALL)
SELECT bin, label, n, round(total, 4) AS total, round(n / sum(n) OVER (), 9) AS n_share, round(total / sum(total) OVER (), 9) AS total_share FROM c""")  # fmt: skip
def d22(spark, sf_dir):
    out = profile.histogram(driver.sensor_log(spark, sf_dir), "value", (0, 25, 100, 1e4), ("low", "mid", "high", "never"), "value")
    return out.withColumns({"total": F.round("total", 4), "n_share": F.round("n_share", 9), "total_share": F.round("total_share", 9)})


# --- E, F --------------------------------------------------------------------------------------


@query("e1_lag_gaps", "SELECT event_id, (us - lag(us) OVER (PARTITION BY tagname ORDER BY us)) AS gap_us FROM sensor QUALIFY gap_us > 0")
def e1(spark, sf_dir):
    w = Window.partitionBy("tagname").orderBy("timestamp_utc")
    gap = F.unix_micros("timestamp_utc") - F.unix_micros(F.lag("timestamp_utc").over(w))
    return driver.sensor_log(spark, sf_dir).select("event_id", gap.alias("gap_us")).filter("gap_us > 0")


@query("e2_last_and_first_value", """
SELECT lift_id, bucket_start_unix, round(last_value(error IGNORE NULLS) OVER w, 6) AS before, round(first_value(error IGNORE NULLS) OVER v, 6) AS after FROM biz
WINDOW w AS (PARTITION BY lift_id ORDER BY bucket_start_unix ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
v AS (PARTITION BY lift_id ORDER BY bucket_start_unix ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""")  # fmt: skip
def e2(spark, sf_dir):
    w = Window.partitionBy("lift_id").orderBy("bucket_start_unix")
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    return views.matrix(spark, sf_dir).select("lift_id", "bucket_start_unix", F.round(F.last("error", True).over(back), 6).alias("before"), F.round(F.first("error", True).over(ahead), 6).alias("after"))


PARETO = """ranked AS (SELECT lift_id, count(*) AS count, row_number() OVER (ORDER BY count(*) DESC, lift_id) AS rank, count(*) / sum(count(*)) OVER () AS share,
  sum(count(*)) OVER (ORDER BY count(*) DESC, lift_id ROWS UNBOUNDED PRECEDING) / sum(count(*)) OVER () AS cumulative_share FROM sensor GROUP BY 1)"""


@query("e5_pareto", f"WITH {PARETO} SELECT lift_id, count, CAST(rank AS INTEGER) AS rank, round(share, 9) AS share, round(cumulative_share, 9) AS cumulative_share FROM ranked")
def e5(spark, sf_dir):
    return profile.pareto(driver.sensor_log(spark, sf_dir), "lift_id").withColumns({"share": F.round("share", 9), "cumulative_share": F.round("cumulative_share", 9)})


@query("e6_pareto_summary", f"WITH {PARETO} SELECT CAST(min(rank) FILTER (cumulative_share >= 0.8) AS INTEGER) AS rank_reaching, round(sum(share) FILTER (rank <= 6), 9) AS top6_share, round(sum(share) FILTER (rank <= 10), 9) AS top10_share, round(sum(share) FILTER (rank <= 30), 9) AS top30_share FROM ranked")
def e6(spark, sf_dir):
    out = profile.pareto_summary(profile.pareto(driver.sensor_log(spark, sf_dir), "lift_id"))
    return out.withColumns({f"top{k}_share": F.round(f"top{k}_share", 9) for k in (6, 10, 30)})


@query("f1_sort_by_expression", "SELECT event_id, abs(value - 50) AS distance FROM sensor ORDER BY distance DESC, event_id")
def f1(spark, sf_dir):
    return driver.sensor_log(spark, sf_dir).select("event_id", F.abs(F.col("value") - 50).alias("distance")).orderBy(F.desc("distance"), "event_id")


@query("f3_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 30")
def f3(spark, sf_dir):
    return driver.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(30)


@query("f6_argmin", "SELECT lift_id, arg_min(event_id, us) AS first_event FROM sensor GROUP BY 1")
def f6(spark, sf_dir):
    return driver.sensor_log(spark, sf_dir).groupBy("lift_id").agg(F.min_by("event_id", "timestamp_utc").alias("first_event"))


# --- G, H --------------------------------------------------------------------------------------


@query("g1_union_missing", "SELECT lift_id, error, CAST(NULL AS DOUBLE) AS click FROM biz UNION ALL SELECT lift_id, NULL, click FROM ui")
def g1(spark, sf_dir):
    a, b = views.matrix(spark, sf_dir).select("lift_id", "error"), views.matrix(spark, sf_dir, views.UI).select("lift_id", "click")
    return a.unionByName(b, allowMissingColumns=True)


@query("g2_distinct", "SELECT DISTINCT lift_id, tagname FROM sensor")
def g2(spark, sf_dir):
    return driver.sensor_log(spark, sf_dir).select("lift_id", "tagname").distinct()


@query("g3_key_dedup", "SELECT lift_id, max(event_id) AS event_id FROM sensor GROUP BY 1")
def g3(spark, sf_dir):
    w = Window.partitionBy("lift_id").orderBy(F.desc("event_id"))
    return driver.sensor_log(spark, sf_dir).withColumn("n", F.row_number().over(w)).filter("n = 1").select("lift_id", "event_id")


@query("g4_duplicate_rows", "SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT lift_id, tagname FROM sensor)) AS duplicates FROM sensor")
def g4(spark, sf_dir):
    return driver.sensor_log(spark, sf_dir).agg((F.count(F.lit(1)) - F.count_distinct("lift_id", "tagname")).alias("duplicates"))


@query("h1_split_and_labels", "SELECT DISTINCT tagname, split_part(tagname, '.', 1) AS source, nullif(split_part(tagname, '.', 2), '') AS subsystem, nullif(split_part(tagname, '.', 4), '') AS fourth, replace(tagname, 'Sys.', '') AS stripped, replace(replace(tagname, '.', '_'), '-', '_') AS safe, split_part(tagname, '.', 3) AS short FROM sensor")
def h1(spark, sf_dir):
    from ..functions import names

    df = driver.sensor_log(spark, sf_dir).select("tagname").distinct()
    t = F.col("tagname")
    return df.select(t, names.part(t, 0).alias("source"), names.part(t, 1).alias("subsystem"), names.part(t, 3).alias("fourth"), names.strip_prefix(t, ["Sys."]).alias("stripped"), names.safe(t).alias("safe"), names.last_part(t).alias("short"))


@query("h2_key_codec", "SELECT DISTINCT lift_id || '_' || bucket_start_unix AS lift_group_bucket, CAST(lift_id AS VARCHAR) AS lift, bucket_start_unix AS bucket FROM bucketed")
def h2(spark, sf_dir):
    from ..functions import names

    k = F.col("lift_group_bucket")
    return views.bucketed(spark, sf_dir).select(k).distinct().select(k, names.key_lift(k).alias("lift"), names.key_bucket(k).alias("bucket"))


@query("h7_epoch_and_bucket", "SELECT event_id, ts_unix, CAST(floor(ts_unix / 300) AS BIGINT) * 300 AS bucket FROM sensor")
def h7(spark, sf_dir):
    return driver.sensor_log(spark, sf_dir).select("event_id", F.unix_timestamp("timestamp_utc").alias("ts_unix"), timeseries.bucket_start(F.col("timestamp_utc"), 300).alias("bucket"))


@query("h9_rounding", "SELECT event_id, round(value / 7.3, 1) AS r1, round(value / 7.3, 4) AS r4, round(ln(value + 1), 6) AS log FROM sensor")
def h9(spark, sf_dir):
    v = F.col("value")
    return driver.sensor_log(spark, sf_dir).select("event_id", F.round(v / 7.3, 1).alias("r1"), F.round(v / 7.3, 4).alias("r4"), F.round(F.ln(v + 1), 6).alias("log"))

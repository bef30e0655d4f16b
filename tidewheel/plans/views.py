"""Tables that several queries start from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ingest, timeseries
from ..sources import driver

SHORT = {"Sys.Biz.error": "error", "Sys.Biz.purchase": "purchase", "Sys.Biz.signup": "signup", "Sys.Ui.click": "click", "Sys.Ui.view": "view"}
UI, BIZ = driver.GROUPS
BIZ_COLUMNS, UI_COLUMNS = ["error", "purchase", "signup"], ["click", "view"]


def bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeseries.bucketed(driver.sensor_log(spark, sf_dir), driver.GROUPS)


def matrix(spark: SparkSession, sf_dir: str, group=BIZ) -> DataFrame:
    """A group's matrix with short column names."""
    return timeseries.group_matrix(bucketed(spark, sf_dir), group).withColumnsRenamed(SHORT)


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = ingest.with_interval(driver.lift_log(spark, sf_dir), "started", "movementduration", "movementid", ("iv_id", "iv_start", "iv_end"))
    return log.select("iv_id", "movementtype", "iv_start", "iv_end")


def train(spark: SparkSession, sf_dir: str) -> DataFrame:
    return driver.sensor_log(spark, sf_dir).filter("lift_id % 4 <> 0")


def test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return driver.sensor_log(spark, sf_dir).filter("lift_id % 4 = 0")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lift_id, ts, tag_group, score, active, pred: specialist scores made of the data by a rule, so
    that what follows from scores can be checked exactly."""
    from ..models import thresholds

    b = bucketed(spark, sf_dir).groupBy("tag_group", "lift_id", "bucket_start_unix").agg(F.avg("value").alias("m"), F.max("value").alias("x"))
    b = b.select("tag_group", "lift_id", F.col("bucket_start_unix").alias("ts"), (-F.round("m", 6)).alias("score"), (F.col("x") > 20).cast("int").alias("active"))
    limits = thresholds.thresholds(thresholds.training_rows(b, "active", ["tag_group"]), "score", ["tag_group"], factor=1.5)
    both = b.join(F.broadcast(limits), "tag_group")  # one row per group of the configuration
    return both.withColumn("pred", thresholds.predict(F.col("score"), F.col("threshold"), F.col("active")))


SCORED_SQL = """
raw_scores AS (
  SELECT tag_group, lift_id, bucket_start_unix AS ts, -round(avg(value), 6) AS score, CAST(max(value) > 20 AS INTEGER) AS active
  FROM bucketed GROUP BY tag_group, lift_id, bucket_start_unix),
counts AS (SELECT tag_group, count(*) FILTER (active = 1) AS n FROM raw_scores GROUP BY 1),
limits AS (
  SELECT tag_group, quantile_cont(score, 0.25) - 1.5 * (quantile_cont(score, 0.75) - quantile_cont(score, 0.25)) AS threshold
  FROM raw_scores JOIN counts USING (tag_group) WHERE n < 50 OR active = 1 GROUP BY tag_group),
scored AS (
  SELECT *, CASE WHEN active = 1 AND score < threshold THEN -1 ELSE 1 END AS pred FROM raw_scores JOIN limits USING (tag_group))
"""

"""The driver's tables as sensor data: which column plays which part."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import TagGroup

GROUPS = (
    TagGroup("ui", ("Sys.Ui.click", "Sys.Ui.view"), 43_200, 4, 0.3, 4, ("Sys.Ui.click",)),
    TagGroup("biz", ("Sys.Biz.error", "Sys.Biz.purchase", "Sys.Biz.signup"), 86_400, 3, 0.2, 3, ("Sys.Biz.error", "Sys.Biz.signup")),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, with time stamps without zone taken as UTC (the session's zone)."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    plain = [f.name for f in df.schema if f.dataType.typeName() == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in plain}) if plain else df


def raw_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, timestamp_utc, tagname, bool_val, int_val, float_val: an export of mixed types."""
    e = table(spark, sf_dir, "events")
    kind = F.col("event_id") % 4
    return e.select(
        "event_id",
        F.col("ts").alias("timestamp_utc"),
        tagname().alias("tagname"),
        F.when(kind == 0, F.col("value") > 50).alias("bool_val"),
        F.when(kind == 1, F.floor("value").cast("int")).alias("int_val"),
        F.when(kind == 2, F.col("value")).alias("float_val"),
    )


def tagname():
    area = F.when(F.col("event_type").isin("click", "view"), "Ui").otherwise("Biz")
    return F.concat(F.lit("Sys."), area, F.lit("."), F.col("event_type"))


def sensor_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, timestamp_utc, tagname, value, lift_id."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.col("ts").alias("timestamp_utc"), tagname().alias("tagname"), "value", F.col("user_id").alias("lift_id"))


def lift_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """movementid, movementtype, started, movementduration: the intervals."""
    e = table(spark, sf_dir, "events").filter("event_type = 'signup'")
    return e.select(
        F.col("event_id").alias("movementid"),
        (1 + F.col("user_id") % 5).cast("int").alias("movementtype"),
        F.col("ts").alias("started"),
        F.floor(F.col("value") * 60).cast("double").alias("movementduration"),
    )


def alarm_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, timestamp_utc, id, text: the point events."""
    e = table(spark, sf_dir, "events").filter("event_type = 'error'")
    return e.select(
        "event_id", F.col("ts").alias("timestamp_utc"), (F.col("event_id") % 20).cast("int").alias("id"),
        F.concat(F.lit("alarm "), (F.col("event_id") % 20).cast("string")).alias("text"),
    )


def lift_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lift_id, movementtype of the series of sensor_log: null for one in eleven."""
    users = table(spark, sf_dir, "events").select(F.col("user_id").alias("lift_id")).distinct()
    return users.select("lift_id", F.when(F.col("lift_id") % 11 != 0, 1 + F.col("lift_id") % 5).cast("int").alias("movementtype"))

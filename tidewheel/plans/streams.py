"""Queries that run a stream to its end over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import driver
from ..sources.scratch import kept, scratch
from ..streaming import buckets
from .registry import query


@query("l1_streaming_buckets", "SELECT tag_group, lift_id, tagname, bucket_start_unix, count(*) AS n, round(avg(value), 6) AS value FROM bucketed GROUP BY ALL")
def l1(spark, sf_dir):
    """All buckets. A row of no group, years after the last one, moves the watermark past them."""
    log = driver.sensor_log(spark, sf_dir)
    end = log.agg((F.max("timestamp_utc") + F.expr("INTERVAL 1000 DAYS")).alias("timestamp_utc")).select("timestamp_utc", F.lit("end of the stream").alias("tagname"))
    with scratch(spark) as path:
        log.unionByName(end, allowMissingColumns=True).write.parquet(f"{path}/in")
        stream = spark.readStream.schema(log.schema).parquet(f"{path}/in")
        out = buckets.bucket_means(stream, driver.GROUPS, "1 hour").writeStream.format("parquet").outputMode("append")
        run = out.option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
        run.awaitTermination()
        return kept(spark.read.parquet(f"{path}/out").select("tag_group", "lift_id", "tagname", "bucket_start_unix", "n", F.round("value", 6).alias("value")))

"""Streaming forms of bucketing and alignment: an extension, the reference has no streams."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import TagGroup, group_table


def bucket_means(stream: DataFrame, groups: Iterable[TagGroup], delay: str = "10 minutes", ts: str = "timestamp_utc") -> DataFrame:
    """tag_group, lift_id, tagname, bucket_start_unix, value, n: means per bucket of a stream of
    observations, emitted once the watermark has passed the bucket. Rows later than delay are
    dropped. Works on tables as well."""
    table = F.broadcast(group_table(stream.sparkSession, groups))  # one row per configured tag
    rows = stream.withWatermark(ts, delay).join(table, "tagname")
    # windows need a constant width: the widths of the configuration are few
    out = None
    for size in sorted({g.bucket_s for g in groups}):
        own = rows.filter(F.col("bucket_size_s") == size).groupBy("tag_group", "lift_id", "tagname", F.window(ts, f"{size} seconds").alias("w"))
        part = own.agg(F.avg("value").alias("value"), F.count(F.lit(1)).alias("n"))
        part = part.select("tag_group", "lift_id", "tagname", F.unix_timestamp("w.start").alias("bucket_start_unix"), "value", "n")
        out = part if out is None else out.unionByName(part)
    return out


def alarm_counts(stream: DataFrame, delay: str = "10 minutes", width: str = "1 hour", ts: str = "timestamp_utc") -> DataFrame:
    """id, start_unix, n: alarms per window of a stream."""
    rows = stream.withWatermark(ts, delay).groupBy("id", F.window(ts, width).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return rows.select("id", F.unix_timestamp("w.start").alias("start_unix"), "n")

"""Which signals are active together: presence, Jaccard similarity, clusters."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .timeseries import bucket_start


def presence(df: DataFrame, size_s: int = 10, ts: str = "timestamp_utc", tag: str = "tagname", lift: str = "lift_id") -> DataFrame:
    """The distinct lift_id, bucket, tagname."""
    return df.select(lift, bucket_start(F.col(ts), size_s).alias("bucket"), tag).distinct()


def activity_rate(present: DataFrame, tag: str = "tagname", lift: str = "lift_id") -> DataFrame:
    """tagname, n, n_buckets, activity_pct: share of the buckets with any signal that have the tag."""
    buckets = present.select(lift, "bucket").distinct().agg(F.count(F.lit(1)).alias("n_buckets"))
    per = present.groupBy(tag).agg(F.count(F.lit(1)).alias("n"))
    return per.crossJoin(F.broadcast(buckets)).withColumn("activity_pct", 100 * F.col("n") / F.col("n_buckets"))


def jaccard(present: DataFrame, tag: str = "tagname", lift: str = "lift_id") -> DataFrame:
    """tag_a, tag_b (a before b), both, either, jaccard for all pairs of tags, 0 where they never meet.

    A bucket's tags are gathered in an array, at most one entry per tag, and its pairs counted with
    partial sums. The pairs of tags that never meet come from the table of tags alone.
    """
    sets = present.groupBy(lift, "bucket").agg(F.sort_array(F.collect_set(tag)).alias("tags"))
    pairs = sets.select(F.explode("tags").alias("tag_a"), "tags").select("tag_a", F.explode(F.filter("tags", lambda t: t > F.col("tag_a"))).alias("tag_b"))
    met = pairs.groupBy("tag_a", "tag_b").agg(F.count(F.lit(1)).alias("both"))
    n = present.groupBy(tag).agg(F.count(F.lit(1)).alias("n"))
    a, b = n.select(F.col(tag).alias("tag_a"), F.col("n").alias("n_a")), n.select(F.col(tag).alias("tag_b"), F.col("n").alias("n_b"))
    names = n.agg(F.sort_array(F.collect_list(tag)).alias("tags"))
    every = names.select(F.explode("tags").alias("tag_a"), "tags").select("tag_a", F.explode(F.filter("tags", lambda t: t > F.col("tag_a"))).alias("tag_b"))
    out = every.join(met, ["tag_a", "tag_b"], "left").na.fill(0, ["both"]).join(a, "tag_a").join(b, "tag_b")
    out = out.withColumn("either", F.col("n_a") + F.col("n_b") - F.col("both"))
    return out.select("tag_a", "tag_b", "both", "either", F.coalesce(F.try_divide(F.col("both"), F.col("either")), F.lit(0.0)).alias("jaccard"))


def top_partners(similar: DataFrame, k: int = 5) -> DataFrame:
    """tagname, partner, jaccard, rank: each tag's k most similar ones, ties by name."""
    both = similar.select(F.col("tag_a").alias("tagname"), F.col("tag_b").alias("partner"), "jaccard").unionByName(
        similar.select(F.col("tag_b").alias("tagname"), F.col("tag_a").alias("partner"), "jaccard")
    )
    order = Window.partitionBy("tagname").orderBy(F.desc("jaccard"), "partner")
    return both.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


MOST_TAGS = 5_000


def clusters(similar: DataFrame, cut: float = 0.5) -> DataFrame:
    """tagname, cluster: average linkage on 1 - jaccard, cut at a distance; a cluster is named by
    its first tag.

    The matrix of tags is worked on by the driver. Its size is that of the configuration, and is
    checked: ValueError beyond MOST_TAGS tags.
    """
    spark = similar.sparkSession
    names = [r[0] for r in similar.select(F.col("tag_a").alias("t")).union(similar.select("tag_b")).distinct().orderBy("t").limit(MOST_TAGS + 1).collect()]
    if len(names) > MOST_TAGS:
        raise ValueError(f"more than {MOST_TAGS} tags")
    at = {t: i for i, t in enumerate(names)}
    distance = np.full((len(names), len(names)), np.inf)
    for r in similar.select("tag_a", "tag_b", "jaccard").toLocalIterator():
        distance[at[r[0]], at[r[1]]] = distance[at[r[1]], at[r[0]]] = 1 - r[2]
    member = average_linkage(distance, cut)
    return spark.createDataFrame([(t, names[member[i]]) for i, t in enumerate(names)], "tagname string, cluster string")


def average_linkage(distance: np.ndarray, cut: float) -> list[int]:
    """For each item the first item of its cluster. Merges the nearest two clusters, whose distance
    is the mean over their pairs, while it is at most cut; ties go to the first."""
    d = distance.copy()
    n = len(d)
    np.fill_diagonal(d, np.inf)
    size, member, alive = np.ones(n), list(range(n)), np.ones(n, bool)
    while alive.sum() > 1:
        i, j = divmod(int(np.argmin(d)), n)
        if d[i, j] > cut:
            break
        i, j = min(i, j), max(i, j)
        merged = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        d[i, :] = d[:, i] = merged
        d[i, i] = np.inf
        d[j, :] = d[:, j] = np.inf
        size[i] += size[j]
        alive[j] = False
        member = [i if m == j else m for m in member]
    return member

"""Exact quantiles of groups of any size."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import kept


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str, points: Sequence[float], accuracy: int = 10_000, most_broadcast: int = 10_000) -> DataFrame:
    """by, quantiles (one for each of points, interpolated between neighbours): a row for each group
    with a value that isn't null.

    An approximate quantile on both sides of each point gives bounds between which the exact one
    must lie; what lies below is counted, and only the values between are ranked. So no aggregate
    holds a group's values, as that of percentile() does; a window ranks some 6 / accuracy of them
    (all, of a group of at most accuracy values). by and value are materialised in the shared folder;
    the bounds of at most most_broadcast groups are broadcast, those of more are joined.
    """
    key = F.struct(*[F.col(f"`{c}`") for c in by]) if by else F.lit(0)
    rows = df.select(key.alias("key"), F.col(f"`{value}`").cast("double").alias("v")).filter("v IS NOT NULL")
    rows = kept(rows)  # read three times; what df takes to compute is done once
    places, reach = range(len(points)), 2 / accuracy
    around = [max(0.0, p - reach) for p in points] + [min(1.0, p + reach) for p in points]
    bounds = rows.groupBy("key").agg(
        F.percentile_approx("v", around, accuracy).alias("around"), F.count(F.lit(1)).alias("n"), F.min("v").alias("least"), F.max("v").alias("most")
    )
    few = F.col("n") <= accuracy
    sides = [F.when(few, F.array_repeat(x, len(points))).otherwise(F.slice("around", at, len(points))) for x, at in ((F.col("least"), 1), (F.col("most"), len(points) + 1))]
    bounds = bounds.select("key", "n", sides[0].alias("low"), sides[1].alias("high"))
    # one short row a group: materialised, counted, and broadcast if there are few of them
    bounds = kept(bounds)
    few_groups = bounds.count() <= most_broadcast
    near = rows.join(F.broadcast(bounds) if few_groups else bounds, "key")
    low, high = [F.get("low", F.lit(i)) for i in places], [F.get("high", F.lit(i)) for i in places]
    below = near.groupBy("key").agg(F.first("n").alias("n"), F.array(*[F.count_if(F.col("v") < x) for x in low]).alias("below"))
    inside = [F.col("v").between(x, y) for x, y in zip(low, high, strict=True)]
    here = F.array_compact(F.array(*[F.when(ok, F.lit(i)) for i, ok in enumerate(inside)]))
    between = near.filter(reduce(or_, inside)).select("key", "v", F.explode(here).alias("i")).groupBy("key", "i", "v").agg(F.count(F.lit(1)).alias("m"))
    ranked = between.join(below, "key")
    until = F.sum("m").over(Window.partitionBy("key", "i").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    ranked = ranked.withColumn("until", until + F.col("below")[F.col("i")])
    at = F.array(*[F.lit(float(p)) for p in points])[F.col("i")] * (F.col("n") - 1)
    ranked = ranked.withColumns({"at": at, "first": F.floor(at), "second": F.ceil(at)})
    found = ranked.groupBy("key", "i").agg(
        F.min(F.when(F.col("until") > F.col("first"), F.col("v"))).alias("a"), F.min(F.when(F.col("until") > F.col("second"), F.col("v"))).alias("b"),
        F.first(F.col("at") - F.col("first")).alias("share"),
    )
    one = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("a") * (1 - F.col("share")) + F.col("b") * F.col("share"))
    out = found.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("i", one.alias("q")))).alias("found"))
    return out.select(*[F.col("key")[c].alias(c) for c in by], F.transform("found", lambda x: x["q"]).alias("quantiles"))

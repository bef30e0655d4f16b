"""Quantile buckets and the population stability index, for all columns or tags in one pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quantiles import exact_quantiles

GRID = (0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0)


def quantile_edges(train: DataFrame, by: str, value: str = "value", grid: Sequence[float] = GRID, accuracy: int | None = None) -> DataFrame:
    """by, edges: the distinct quantiles of value, exact (see exact_quantiles), or approximate with an
    accuracy, in one pass."""
    if accuracy:
        found = train.groupBy(by).agg(F.percentile_approx(value, list(grid), accuracy).alias("quantiles"))
    else:
        found = exact_quantiles(train, [by], value, grid)
    return found.select(by, F.sort_array(F.array_distinct("quantiles")).alias("edges"))


def bucket_number(value: Column, edges: Column, most: int = len(GRID)) -> Column:
    """1 .. n for the buckets between edges (most of them, or fewer), closed on the left, the last on
    both sides; 0 for nulls, -1 outside, null if there are fewer than two edges."""
    n = F.size(edges)
    # no lambda over the edges: this way it is compiled code
    below = sum((F.coalesce(F.get(edges, F.lit(i)) <= value, F.lit(False)).cast("int") for i in range(most)), F.lit(0))
    inside = F.when((value < F.element_at(edges, 1)) | (value > F.element_at(edges, -1)), F.lit(-1)).otherwise(F.least(below, n - 1))
    return F.when(edges.isNull() | (n < 2), F.lit(None).cast("int")).when(value.isNull(), F.lit(0)).otherwise(inside)


def bucket_label(number: Column, edges: Column) -> Column:
    low, high = F.try_element_at(edges, number), F.try_element_at(edges, number + 1)
    shut = F.when(number == F.size(edges) - 1, "]").otherwise(")")
    label = F.concat(F.lit("["), F.format_string("%.3f", low), F.lit(", "), F.format_string("%.3f", high), shut)
    return F.when(number.isNull(), "single_value_or_no_bucket").when(number == 0, "missing").when(number == -1, "outside_training_range").otherwise(label)


def compare_buckets(train: DataFrame, test: DataFrame, by: str = "column", value: str = "value", grid: Sequence[float] = GRID, accuracy: int | None = None) -> DataFrame:
    """by, bucket, train and test counts and percentages, their difference and psi_component.

    train and test are long: by, value. Edges come from train; both sides go through one
    aggregate. Buckets with equal labels are one. The component is 0 if either side is empty.
    The edges, one short row for each group, are joined, copied for 16 shares of each group's rows, so
    that a group of any size is spread; where they turn out small, Spark broadcasts them.
    """
    edges = quantile_edges(train, by, value, grid, accuracy)
    rows = train.select(by, value, F.lit(0).alias("side")).unionByName(test.select(by, value, F.lit(1).alias("side")))
    shares = F.explode(F.sequence(F.lit(0), F.lit(15)))
    rows = rows.withColumn("share", F.pmod(F.monotonically_increasing_id(), F.lit(16)).cast("int")).join(edges.withColumn("share", shares), [by, "share"])
    number = bucket_number(F.col(value), F.col("edges"), len(grid))
    counts = rows.withColumn("__n", number).groupBy(by, "edges", "__n").agg(
        F.count_if(F.col("side") == 0).alias("train_count"), F.count_if(F.col("side") == 1).alias("test_count")
    )
    counts = counts.groupBy(by, bucket_label(F.col("__n"), F.col("edges")).alias("bucket")).agg(F.sum("train_count").alias("train_count"), F.sum("test_count").alias("test_count"))
    whole = Window.partitionBy(by)
    p, q = (F.try_divide(F.col(f"{n}_count"), F.sum(f"{n}_count").over(whole)) for n in ("train", "test"))
    out = counts.withColumns({"p": p, "q": q})
    term = F.when((F.col("p") > 0) & (F.col("q") > 0), (F.col("q") - F.col("p")) * F.ln(F.col("q") / F.col("p"))).otherwise(F.lit(0.0))
    return out.select(
        by, "bucket", "train_count", F.round(F.col("p") * 100, 3).alias("train_pct"), "test_count", F.round(F.col("q") * 100, 3).alias("test_pct"),
        F.round(F.abs(F.col("q") - F.col("p")) * 100, 3).alias("abs_pct_diff"), term.alias("psi_component"),
    )


def psi(buckets: DataFrame, by: str = "column") -> DataFrame:
    """by, psi, distribution_shift: low below 0.10, moderate below 0.25, else large."""
    out = buckets.groupBy(by).agg(F.sum("psi_component").alias("psi"))
    return out.withColumn("distribution_shift", F.when(F.col("psi") < 0.10, "low_shift").when(F.col("psi") < 0.25, "moderate_shift").otherwise("large_shift"))


def smoothed_psi(buckets: DataFrame, by: str = "column", eps: float = 1e-4) -> DataFrame:
    """psi with eps in the place of empty shares, so that a test set outside the range shows."""
    p, q = (F.greatest(F.col(f"{n}_pct") / 100, F.lit(eps)) for n in ("train", "test"))
    return buckets.groupBy(by).agg(F.sum((q - p) * F.ln(q / p)).alias("psi_eps"))


def common_tags(train: DataFrame, test: DataFrame, tag: str = "tagname", least: tuple[int, int] = (1000, 100), most: int = 200) -> DataFrame:
    """The tags with enough rows on both sides; the `most` most frequent in training."""
    a = train.groupBy(tag).agg(F.count(F.lit(1)).alias("train_count")).filter(F.col("train_count") >= least[0])
    b = test.groupBy(tag).agg(F.count(F.lit(1)).alias("test_count")).filter(F.col("test_count") >= least[1])
    return a.join(b, tag).orderBy(F.desc("train_count"), tag).limit(most)


def psi_by_tag(train: DataFrame, test: DataFrame, tag: str = "tagname", value: str = "value", **limits) -> DataFrame:
    """psi() of each common tag, all tags in one job."""
    tags = common_tags(train, test, tag, **limits).select(tag)
    return psi(compare_buckets(train.join(tags, tag, "left_semi"), test.join(tags, tag, "left_semi"), tag, value), tag)

"""Robust thresholds of scores, and what they make of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.quantiles import exact_quantiles


def _finite(score: str) -> Column:
    v = F.col(score)
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))


def thresholds(df: DataFrame, score: str, by: Sequence[str] = (), method: str = "iqr", factor: float = 3.0, side: str = "lower", accuracy: int | None = None) -> DataFrame:
    """by, threshold of the finite scores: quartile -+ factor * IQR, or median -+ factor * 1.4826 *
    MAD (a MAD of 0: just beyond the extreme), on the lower or upper side. Percentiles are exact (see
    exact_quantiles), or approximate with an accuracy. What is joined has a row for each group."""
    if method not in ("iqr", "mad") or side not in ("lower", "upper"):
        raise ValueError("method: iqr or mad; side: lower or upper")
    rows, sign = df.filter(_finite(score)), -1 if side == "lower" else 1
    if method == "iqr":
        q1, q3 = F.col("quantiles")[0], F.col("quantiles")[1]
        found = _quantiles(rows, by, score, [0.25, 0.75], accuracy)
        return found.select(*by, ((q1 if side == "lower" else q3) + sign * factor * (q3 - q1)).alias("threshold"))
    median = _quantiles(rows, by, score, [0.5], accuracy).select(*by, F.col("quantiles")[0].alias("m"))
    near = rows.join(median, list(by)) if by else rows.crossJoin(median)
    near = near.withColumn("__off", F.abs(F.col(score) - F.col("m")))
    off = _quantiles(near, by, "__off", [0.5], accuracy).select(*by, F.col("quantiles")[0].alias("mad"))
    extreme = rows.groupBy(*by).agg((F.min(score) - 1e-9 if side == "lower" else F.max(score) + 1e-9).alias("extreme"))
    out = median
    for more in (off, extreme):
        out = out.join(more, list(by)) if by else out.crossJoin(more)
    value = F.when(F.col("mad") == 0, F.col("extreme")).otherwise(F.col("m") + sign * factor * 1.4826 * F.col("mad"))
    return out.select(*by, value.alias("threshold"))


def _quantiles(rows: DataFrame, by: Sequence[str], value: str, points: list[float], accuracy: int | None) -> DataFrame:
    """by, quantiles; without by, one row, of nulls if there are no rows."""
    if accuracy:
        return rows.groupBy(*by).agg(F.percentile_approx(value, points, accuracy).alias("quantiles"))
    found = exact_quantiles(rows, by, value, points)
    return found if by else found.agg(F.first("quantiles").alias("quantiles"))


def percentile_threshold(df: DataFrame, score: str, by: Sequence[str] = (), percent: float = 1.0) -> DataFrame:
    """by, threshold: the fallback of the null-row variant."""
    found = _quantiles(df.filter(_finite(score)), by, score, [percent / 100], None)
    return found.select(*by, F.col("quantiles")[0].alias("threshold"))


def predict(score: Column, threshold: Column, active: Column, side: str = "lower") -> Column:
    """-1 for an active row beyond the threshold, else 1."""
    beyond = score < threshold if side == "lower" else score > threshold
    return F.when(F.coalesce(active.cast("boolean") & beyond, F.lit(False)), -1).otherwise(1)


def training_rows(df: DataFrame, active: str, by: Sequence[str] = (), least: int = 50) -> DataFrame:
    """The active rows of each group of by, or all of its rows if fewer than least are active."""
    counts = df.groupBy(*by).agg(F.count_if(F.col(active).cast("boolean")).alias("__active"))
    rows = df.join(F.broadcast(counts), list(by)) if by else df.crossJoin(F.broadcast(counts))
    return rows.filter((F.col("__active") < least) | F.col(active).cast("boolean")).drop("__active")


def meta_training_rows(df: DataFrame, n_active: str = "n_active_groups", least: int = 50) -> DataFrame:
    """Rows with two active groups or more; with one or more if there are fewer than least of them."""
    n = df.agg(F.count_if(F.col(n_active) >= 2).alias("__n"))
    return df.crossJoin(F.broadcast(n)).filter((F.col(n_active) >= 2) | ((F.col("__n") < least) & (F.col(n_active) >= 1))).drop("__n")

"""Features of a signal during a lift that don't depend on how long the lift is."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BASIC = (
    "mean", "std", "median", "iqr", "skew", "kurtosis", "min", "max", "ptp", "p05", "p95", "energy_per_sec", "abs_mean_diff_per_sec",
    "n_peaks_per_sec", "mean_peak_height", "net_slope_per_sec", "zero_cross_per_sec", "autocorr_lag1", "autocorr_lag5", "n_samples",
)
SPECTRAL = ("spectral_centroid", "spectral_bandwidth", "spectral_entropy", "fft_top1_rel", "fft_top2_rel", "fft_top3_rel")
FEATURES = (*BASIC, *SPECTRAL)


def basic_features(df: DataFrame, keys: Sequence[str] = ("tagname", "lift_id"), ts: str = "timestamp_utc", value: str = "value", min_samples: int = 20) -> DataFrame:
    """keys and the twenty features of BASIC, from built-in aggregates and two windows.

    Rows go in the order of time, then value; null values are left out. Groups with fewer than
    min_samples values or no duration are left out. A peak is a value, or a run of equal values,
    higher than those before and after it. Skew, kurtosis and autocorrelation of a constant are 0.
    """
    rows = df.filter(F.col(value).isNotNull()).select(*keys, F.unix_micros(ts).alias("t"), F.col(value).cast("double").alias("v"))
    by_key = Window.partitionBy(*keys)
    order = by_key.orderBy("t", "v")
    seen = rows.select(
        *keys, "t", "v",
        F.lag("v").over(order).alias("before"), F.lead("v").over(order).alias("next"), F.lead("v", 5).over(order).alias("fifth"),
        F.row_number().over(order).alias("i"), F.count(F.lit(1)).over(by_key).alias("n"), F.avg("v").over(by_key).alias("m"),
    ).filter(F.col("n") >= min_samples)
    # runs of equal values: the height before a run is that of the row before its first row
    starts = F.col("before").isNull() | (F.col("before") != F.col("v"))
    rise = F.last(F.when(starts, F.coalesce(F.col("before") < F.col("v"), F.lit(False))), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    seen = seen.withColumn("peak", rise & F.coalesce(F.col("next") < F.col("v"), F.lit(False)))
    low = lambda x: F.when(x < 0, 1).otherwise(0)
    crossing = F.when(F.col("next").isNotNull(), F.abs(low(F.col("next") - F.col("m")) - low(F.col("v") - F.col("m"))))
    n = F.count(F.lit(1))
    ends = (F.col("i") == 1) | (F.col("i") == F.col("n"))
    q = lambda p: F.expr(f"percentile(v, {p})")

    def pair(other: str) -> Column:
        """The correlation of v with other over the rows that have both; null if either is constant."""
        spread = F.stddev_pop(F.when(F.col(other).isNotNull(), F.col("v"))) * F.stddev_pop(other)
        return F.when(spread > 0, F.try_divide(F.covar_pop("v", F.col(other)), spread))

    agg = seen.groupBy(*keys).agg(
        F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), q(0.5).alias("median"), (q(0.75) - q(0.25)).alias("iqr"),
        F.skewness("v").alias("skew"), F.kurtosis("v").alias("kurtosis"), F.min("v").alias("min"), F.max("v").alias("max"),
        (F.max("v") - F.min("v")).alias("ptp"), q(0.05).alias("p05"), q(0.95).alias("p95"),
        (F.sum(F.col("v") * F.col("v")) - F.sum(F.when(ends, F.col("v") * F.col("v"))) / 2).alias("energy_per_sec"),
        (F.avg(F.abs(F.col("next") - F.col("v"))) * n).alias("abs_mean_diff_per_sec"), F.count_if("peak").alias("n_peaks_per_sec"),
        F.avg(F.when(F.col("peak"), F.col("v"))).alias("mean_peak_height"),
        (F.sum(F.when(F.col("i") == F.col("n"), F.col("v"))) - F.sum(F.when(F.col("i") == 1, F.col("v")))).alias("net_slope_per_sec"),
        F.sum(crossing).alias("zero_cross_per_sec"), pair("next").alias("autocorr_lag1"), pair("fifth").alias("autocorr_lag5"), n.cast("double").alias("n_samples"),
        ((F.max("t") - F.min("t")) / 1e6).alias("seconds"),
    ).filter("seconds > 0")
    zero = {"skew", "kurtosis", "mean_peak_height", "autocorr_lag1", "autocorr_lag5"}
    final = [(F.coalesce(F.nanvl(F.col(c), F.lit(0.0)), F.lit(0.0)) if c in zero else F.col(c) / F.col("seconds") if c.endswith("_per_sec") else F.col(c)).alias(c) for c in BASIC]
    return agg.select(*keys, *final)


def spectrum(v: np.ndarray) -> list[float]:
    """The six features of SPECTRAL: moments, entropy and largest shares of the spectrum's magnitudes."""
    size = np.abs(np.fft.rfft(v - v.mean()))
    total = size.sum()
    if not total > 0:
        return [0.0] * 6
    share = size / (total + 1e-12)
    at = np.arange(len(size))
    centre = float((at * share).sum())
    width = float(np.sqrt((((at - centre) ** 2) * share).sum()))
    power = size[size > 0] ** 2
    power = power[power > 0] / power.sum()
    top = [*np.sort(size)[::-1][:3] / (total + 1e-12), 0.0, 0.0][:3]
    return [centre, width, float(-(power * np.log(power)).sum()), *map(float, top)]


def spectral_features(df: DataFrame, keys: Sequence[str] = ("tagname", "lift_id"), ts: str = "timestamp_utc", value: str = "value", min_samples: int = 20) -> DataFrame:
    """keys and the six features of SPECTRAL; the same gate and order as basic_features().

    Groups are gathered as sorted arrays by Spark; the transform runs on batches of groups.
    """
    rows = df.filter(F.col(value).isNotNull()).select(*keys, F.struct(F.unix_micros(ts).alias("t"), F.col(value).cast("double").alias("v")).alias("x"))
    series = rows.groupBy(*keys).agg(F.sort_array(F.collect_list("x")).alias("x"))
    series = series.filter((F.size("x") >= min_samples) & (F.element_at("x", -1)["t"] > F.element_at("x", 1)["t"]))
    series = series.select(*keys, F.transform("x", lambda r: r["v"]).alias("v"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in series.schema.fields[:-1]), *(f"{c} double" for c in SPECTRAL)])

    def run(batches):
        for batch in batches:
            values = [spectrum(np.asarray(x)) for x in batch.column(batch.num_columns - 1).to_pylist()]
            columns = [pa.array([r[i] for r in values], pa.float64()) for i in range(len(SPECTRAL))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], names=[*batch.schema.names[:-1], *SPECTRAL])

    return series.mapInArrow(run, schema)


def features(df: DataFrame, keys: Sequence[str] = ("tagname", "lift_id"), **options) -> DataFrame:
    """keys and all of FEATURES."""
    return basic_features(df, keys, **options).join(spectral_features(df, keys, **options), list(keys))

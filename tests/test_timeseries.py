import math
import random

import numpy as np
import pytest

from tidewheel.config import TagGroup, group_of
from tidewheel.operators import features, timeseries


def matrix(spark, rows):
    return spark.createDataFrame(rows, "lift_id int, bucket_start_unix long, `a.b` double, c double")


@pytest.fixture(scope="module")
def data(spark):
    draw, rows = random.Random(3), []
    for lift in range(25):
        t = 0
        for _ in range(draw.randint(1, 25)):
            t += draw.choice([10, 10, 10, 20, 50])
            value = lambda: None if draw.random() < 0.5 else draw.choice([0.0, 0.0, 1.5, 4.0, -2.0])
            rows.append((lift, t, value(), value()))
    return rows


def column(rows, lift, i):
    own = sorted(((r[1], r[i]) for r in rows if r[0] == lift), key=lambda x: x[0])
    return [t for t, _ in own], [v for _, v in own]


def by_lift(df, name):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.lift_id, r.bucket_start_unix)):
        out.setdefault(r.lift_id, []).append(r[name])
    return out


def close(a, b):
    return all((x is None and y is None) or (x is not None and y is not None and math.isclose(x, y, abs_tol=1e-9)) for x, y in zip(a, b, strict=True))


def sequential_model(v, max_gap, zero):
    out, i = list(v), 0
    while i < len(v):
        if v[i] is not None:
            i += 1
            continue
        j = i
        while j < len(v) and v[j] is None:
            j += 1
        p, f = (v[i - 1] if i else None), (v[j] if j < len(v) else None)
        for k in range(i, j):
            if zero and p == 0 and f == 0:
                out[k] = 0.0
            elif j - i <= max_gap and not (p is None and f is None):
                a, b = k - i + 1, j - k
                out[k] = (p / a + f / b) / (1 / a + 1 / b) if p is not None and f is not None else p if p is not None else f
        i = j
    return out


def sequential_time(t, v, size, max_gap, zero):
    out = list(v)
    for k, x in enumerate(v):
        before = [i for i in range(k) if v[i] is not None]
        after = [i for i in range(k + 1, len(v)) if v[i] is not None]
        if x is None and before and after:
            p, f = before[-1], after[0]
            if (t[f] - t[p]) / size - 1 <= max_gap:
                out[k] = 0.0 if zero and v[p] == v[f] == 0 else v[p] + (v[f] - v[p]) * (t[k] - t[p]) / (t[f] - t[p])
    return out


def sequential_recursive(v, max_gap):
    out = list(v)
    for k in range(len(out)):
        if out[k] is None:
            left = next(((out[k - d], d) for d in range(1, max_gap + 1) if k - d >= 0 and out[k - d] is not None), None)
            right = next(((v[k + d], d) for d in range(1, max_gap + 1) if k + d < len(v) and v[k + d] is not None), None)
            near = [x for x in (left, right) if x]
            if near:
                out[k] = sum(x / d for x, d in near) / sum(1 / d for _, d in near)
    return out


@pytest.mark.parametrize("max_gap", [0, 1, 3, 100])
def test_fills_match_sequential_rules(spark, data, max_gap):
    m = matrix(spark, data)
    model = timeseries.fill_model(m, ["a.b", "c"], max_gap, ["c"])
    time = timeseries.fill_time(m, ["a.b", "c"], 10, max_gap, ["c"])
    for name, i, zero in (("a.b", 2, False), ("c", 3, True)):
        got, got_time = by_lift(model, name), by_lift(time, name)
        for lift in got:
            t, v = column(data, lift, i)
            assert close(got[lift], sequential_model(v, max_gap, zero))
            assert close(got_time[lift], sequential_time(t, v, 10, max_gap, zero))


@pytest.mark.parametrize("max_gap", [1, 2, 4])
def test_recursive_fill(spark, data, max_gap):
    got = by_lift(timeseries.fill_recursive(matrix(spark, data), ["a.b"], max_gap), "a.b")
    for lift in got:
        assert close(got[lift], sequential_recursive(column(data, lift, 2)[1], max_gap))


def test_recursive_fill_ignores_the_limit_after_a_value(spark):
    rows = [(1, i, {8: 1.0, 25: 2.0}.get(i), None) for i in range(30)]
    got = by_lift(timeseries.fill_recursive(matrix(spark, rows), ["a.b"], 3), "a.b")[1]
    assert [i for i, v in enumerate(got) if v is None] == [0, 1, 2, 3, 4]


def test_bucket_start_floors_before_the_epoch(spark):
    from pyspark.sql import functions as F

    df = spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in (-1, 0, 4, 5)])).alias("s")).select("s", timeseries.bucket_start(F.timestamp_seconds("s"), 5).alias("b"))
    assert {r.s: r.b for r in df.collect()} == {-1: -5, 0: 0, 4: 0, 5: 5}


def test_asof_ties_and_nulls(spark):
    base = spark.createDataFrame([(1, 10), (1, 20), (2, 10), (3, 5)], "lift_id int, ts int")
    right = spark.createDataFrame([(1, 10, 1.0), (1, 19, 2.0), (1, 21, 3.0), (2, 11, 4.0)], "lift_id int, ts int, v double")
    for chunk in (None, 1, 7, 1000):
        got = {(r.lift_id, r.ts): r.r_v for r in timeseries.asof_align(base, {"r": (right, ["v"])}, chunk=chunk).collect()}
        assert got == {(1, 10): 1.0, (1, 20): 2.0, (2, 10): None, (3, 5): None}


def test_update_gaps_across_chunks(spark):
    draw = random.Random(9)
    rows = [(draw.choice("ab"), draw.randint(0, 400)) for _ in range(300)]
    df = spark.createDataFrame(rows, "tagname string, s int").selectExpr("tagname", "timestamp_seconds(s) AS timestamp_utc")
    for tag in "ab":
        t = sorted(s for k, s in rows if k == tag)
        gaps = [b - a for a, b in zip(t, t[1:], strict=False) if b > a]
        for chunk in (1, 50, 10_000):
            r = next(r for r in timeseries.update_gaps(df, chunk_s=chunk).collect() if r.tagname == tag)
            assert (r.n_gaps, r.median_gap_s) == (len(gaps), float(np.median(gaps)))


@pytest.mark.parametrize(("observed", "flag"), [(95, "excellent"), (94, "good"), (80, "good"), (60, "usable_with_caution"), (59, "poor")])
def test_quality_flags(spark, observed, flag):
    rows = [(1, i, 1.0 if i < observed else None) for i in range(100)]
    df = spark.createDataFrame(rows, "lift_id int, bucket_start_unix long, a double")
    assert timeseries.coverage(df, ["a"]).first().lift_quality_flag == flag


def test_short_lifts_are_padded(spark):
    df = spark.createDataFrame([(1, 0, 1.0, 1), (1, 1, 2.0, 0), (2, 0, 5.0, 0)], "lift_id int, ts int, v double, on int")
    got = {r.lift_id: r for r in timeseries.prediction_windows(df, ["v"], 3, "on").collect()}
    assert got[1].steps == [[1.0], [1.0], [1.0]] and got[1].target == [2.0] and got[1].active == 1
    assert got[2].steps == [[5.0]] * 3 and got[2].target == [5.0] and got[2].active == 0


def test_unknown_tags_are_reported(spark):
    df = spark.createDataFrame([("x",), ("y",), ("y",)], "tagname string")
    assert [(r.tagname, r.n) for r in timeseries.unmapped_tags(df, [TagGroup("g", ("x",), 5)]).collect()] == [("y", 2)]
    assert group_of("slew_power", ["t"]).max_gap == 2 and group_of("slew_power", ["t"], study=True).max_gap == 4


def peaks(v):
    runs = [(x, i) for i, x in enumerate(v) if i == 0 or v[i - 1] != x]
    return [runs[i][0] for i in range(1, len(runs) - 1) if runs[i - 1][0] < runs[i][0] > runs[i + 1][0]]


def test_features_match_numpy(spark):
    draw, rows, series = np.random.default_rng(1), [], {}
    kinds = {"flat top": [0, 1, 1, 0] * 6, "flat end": [0.0, 1, 2, 2, 2] * 5 + [9, 9, 9], "rising": list(range(25)), "constant": [3.0] * 25, "random": np.round(draw.normal(size=60), 1).tolist()}
    for k, v in kinds.items():
        series[k] = [float(x) for x in v]
        rows += [(k, i, float(x)) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "k string, s int, value double").selectExpr("k", "timestamp_seconds(s) AS timestamp_utc", "value")
    got = {r.k: r for r in features.features(df, ["k"]).collect()}
    for k, v in series.items():
        x, r, sec = np.array(v), got[k], len(v) - 1
        p = peaks(v)
        sd = x.std()
        expect = {
            "mean": x.mean(), "std": sd, "median": np.median(x), "p05": np.percentile(x, 5), "energy_per_sec": np.trapezoid(x * x) / sec,
            "abs_mean_diff_per_sec": np.abs(np.diff(x)).mean() * len(x) / sec, "n_peaks_per_sec": len(p) / sec, "mean_peak_height": np.mean(p) if p else 0.0,
            "net_slope_per_sec": (x[-1] - x[0]) / sec, "zero_cross_per_sec": np.sum(np.diff(np.signbit(x - x.mean()))) / sec,
            "skew": ((x - x.mean()) ** 3).mean() / sd**3 if sd else 0.0, "kurtosis": ((x - x.mean()) ** 4).mean() / sd**4 - 3 if sd else 0.0,
            "autocorr_lag1": np.corrcoef(x[:-1], x[1:])[0, 1] if x[:-1].std() and x[1:].std() else 0.0, "n_samples": len(x),
        }
        for name, value in expect.items():
            assert math.isclose(r[name], float(value), abs_tol=1e-8), (k, name, r[name], value)
        assert all(math.isclose(r[c], e, abs_tol=1e-9) for c, e in zip(features.SPECTRAL, features.spectrum(x), strict=True))
    assert got["constant"].spectral_entropy == 0

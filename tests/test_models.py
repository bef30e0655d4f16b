import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewheel.functions.quantiles import exact_quantiles
from tidewheel.models import forest, scaling, sequence, stack, thresholds
from tidewheel.operators import coactivity, drift, profile


def points(spark, n=600, partitions=4):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(n, 3))
    x[:3] = [[9, 9, 9], [-8, 9, 0], [0, -9, 8]]
    rows = [(i, *map(float, r)) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "k int, a double, b double, c double").repartition(partitions)


def scores(df, trees=60):
    model = forest.collect(forest.fit(df, ["a", "b", "c"], ["k"], trees))
    return {r.k: r.score for r in forest.score(df, model, ["a", "b", "c"]).collect()}, model


def test_forest_finds_outliers_and_ignores_partitioning(spark):
    one, model = scores(points(spark))
    two, _ = scores(points(spark, partitions=7))
    assert one == two
    assert set(sorted(one, key=one.get)[:3]) == {0, 1, 2}
    assert all(-1 <= s <= 0 for s in one.values()) and len(model.trees) == 60
    assert all(t[0, 5] == 256 for t in model.trees)


def test_forest_scores_nulls_as_null(spark):
    df = points(spark, 50)
    _, model = scores(df)
    odd = df.withColumn("b", F.when(F.col("k") == 7, None).otherwise(F.col("b")))
    got = {r.k: r.score for r in forest.score(odd, model, ["a", "b", "c"]).collect()}
    assert got[7] is None and got[8] is not None


def test_forest_of_equal_rows_and_few_rows(spark):
    same = spark.createDataFrame([(i, 1.0, 1.0, 1.0) for i in range(10)], "k int, a double, b double, c double")
    got, _ = scores(same, 5)
    assert len(set(got.values())) == 1
    assert forest.average_path(1) == 0 and forest.average_path(2) == 1


def test_forest_per_tag_drops_small_tags(spark):
    rows = [("big", i, float(i % 7), None) for i in range(40)] + [("small", i, 1.0, 1.0) for i in range(5)]
    df = spark.createDataFrame(rows, "tagname string, lift_id int, a double, b double")
    out = forest.fit_score_by_tag(df, ["a", "b"], trees=20).collect()
    assert {r.tagname for r in out} == {"big"} and len(out) == 40 and sum(r.is_anomaly for r in out) <= 2


def test_scaler_equals_impute_then_scale(spark):
    v = [1.0, None, 2.0, 10.0, None, 3.0]
    df = spark.createDataFrame([(i, x, 5.0, None) for i, x in enumerate(v)], "i int, x double, y double, z double")
    r = {r["column"]: r for r in scaling.fit_scaler(df, ["x", "y"]).collect()}
    full = np.array([x if x is not None else np.median([1, 2, 10, 3]) for x in v])
    assert math.isclose(r["x"]["mean"], full.mean()) and math.isclose(r["x"]["scale"], full.std()) and r["y"]["scale"] == 1.0
    out = scaling.apply_scaler(df, scaling.fit_scaler(df, ["x", "y"]), ["x", "y"]).orderBy("i").collect()
    assert np.allclose([o.x for o in out], (full - full.mean()) / full.std())


def test_thresholds(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4, 100)] + [(None,), (math.inf,), (math.nan,)], "s double")
    x = np.array([1, 2, 3, 4, 100.0])
    q1, q3 = np.percentile(x, [25, 75])
    get = lambda **k: thresholds.thresholds(df, "s", **k).first()[0]
    assert math.isclose(get(), q1 - 3 * (q3 - q1)) and math.isclose(get(side="upper"), q3 + 3 * (q3 - q1))
    assert math.isclose(get(method="mad"), 3 - 3 * 1.4826)
    flat = spark.createDataFrame([(2.0,)] * 4, "s double")
    assert math.isclose(thresholds.thresholds(flat, "s", method="mad").first()[0], 2 - 1e-9, abs_tol=1e-12)
    with pytest.raises(ValueError):
        thresholds.thresholds(df, "s", method="sd")


def test_lstm_gradient_and_learning():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(5, 4, 2))
    model = sequence.Autoencoder.start(2)
    _, parts = model.loss_and_gradient(x)
    for weights, gradient in parts:
        for k, g in gradient.items():
            at = tuple(rng.integers(0, n) for n in g.shape)
            kept, h = weights[k][at], 1e-6
            weights[k][at] = kept + h
            up = model.loss_and_gradient(x)[0]
            weights[k][at] = kept - h
            down = model.loss_and_gradient(x)[0]
            weights[k][at] = kept
            assert math.isclose((up - down) / (2 * h), g[at], rel_tol=1e-4, abs_tol=1e-8)
    t = np.linspace(0, 6, 300)
    waves = np.stack([np.stack([np.sin(t[i : i + 6]), np.cos(t[i : i + 6])], 1) for i in range(280)])
    fitted = sequence.Autoencoder.start(2).fit(waves, epochs=15, rate=1e-2)
    assert fitted.history[-1][0] < 0.5 * fitted.history[0][0] and sequence.latent_size(100) == 64
    again = sequence.Autoencoder.start(2).fit(waves, epochs=15, rate=1e-2)
    assert np.allclose(again.predict(waves[:3]), fitted.predict(waves[:3]))


def test_autoencoder_takes_all_sequences(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 4, 2))
    x[11] += 30  # one rare mode
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "lift_id long, steps array<array<double>>").repartition(5)
    loss = sequence.Autoencoder.start(2).loss_and_gradient(x)[0]
    whole = sequence.Autoencoder.start(2).fit(x, epochs=3, batch=300, validation=0)
    same = sequence.Autoencoder.start(2).fit_all(df, ["lift_id"], epochs=3, batch=300, validation=0)
    assert np.allclose(whole.predict(x), same.predict(x)) and math.isclose(same.history[0][1], loss)
    parts = lambda d, **more: sequence.Autoencoder.start(2).fit_all(d, ["lift_id"], part_rows=50, rate=1e-2, **more)
    split = parts(df, validation=0, epochs=8)
    assert math.isclose(split.history[0][1], loss) and split.history[-1][1] < loss
    held = parts(df, epochs=8)
    assert np.allclose(held.predict(x), parts(df.repartition(2), epochs=8).predict(x))
    assert held.history[-1][1] < held.history[0][1] != loss
    nothing = parts(df.limit(0))
    assert np.array_equal(nothing.flat(), sequence.Autoencoder.start(2).flat()) and nothing.history == []


def test_linear_reconstruction_takes_all_sequences(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 3, 2)) * [[1, 5], [2, 1], [1, 3]] + 4
    x[7] += 1000
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "lift_id long, steps array<array<double>>").repartition(5)
    whole, got = sequence.reconstruction(x), sequence.reconstruction_of(df)
    assert np.allclose(got.mean, whole.mean) and np.allclose(got.predict(x[:50]), whole.predict(x[:50]))


def test_average_linkage():
    d = np.array([[0, 0.1, 0.9, 0.8], [0.1, 0, 0.7, 0.9], [0.9, 0.7, 0, 0.2], [0.8, 0.9, 0.2, 0]])
    assert coactivity.average_linkage(d, 0.5) == [0, 0, 2, 2]
    assert coactivity.average_linkage(d, 0.05) == [0, 1, 2, 3]
    assert coactivity.average_linkage(d, 0.83) == [0, 0, 0, 0] and coactivity.average_linkage(d, 0.82) == [0, 0, 2, 2]


def test_psi_edges(spark):
    side = lambda rows: spark.createDataFrame(rows, "column string, value double")
    train = side([("flat", 1.0)] * 5 + [("x", float(i)) for i in range(10)] + [("x", None)])
    test = side([("flat", 1.0), ("x", 99.0), ("x", None)])
    got = {(r.column, r.bucket): r for r in drift.compare_buckets(train, test).collect()}
    again = drift.compare_buckets(train.repartition(7), test.repartition(3)).collect()
    assert got == {(r.column, r.bucket): r for r in again}
    assert got["flat", "single_value_or_no_bucket"].train_count == 5
    assert got["x", "outside_training_range"].test_count == 1 and got["x", "outside_training_range"].psi_component == 0
    assert got["x", "missing"].train_count == got["x", "missing"].test_count == 1
    assert got["x", "[8.100, 9.000]"].train_count == 1


def test_null_categories_come_once_a_side(spark):
    one = spark.createDataFrame([("a",), (None,)], "c string")
    rows = profile.compare_categories(one, one, "c").collect()
    assert sorted((r.value or "", r.train_count, r.test_count) for r in rows) == [("", 0, 1), ("", 1, 0), ("a", 1, 1)]


def test_published_arithmetic():
    """Shares and totals that were published agree among each other."""
    counts = {1: 1_983, 2: 122, 3: 133, 4: 39, 5: 6_658}
    assert sum(counts.values()) == 8_935 and round(100 * counts[5] / 8_935, 2) == 74.52
    assert round(903_989_913 / 1_189_544_747, 4) == 0.7599 and sum((47, 431, 118, 37, 68, 22)) == 723


@pytest.mark.parametrize("accuracy", [50, 1000, 10_000])
def test_exact_quantiles(spark, accuracy):
    rng = np.random.default_rng(5)
    groups = {None: rng.normal(size=3000), "ties": rng.integers(0, 9, 2000).astype(float), "one": np.array([4.0]), "few": rng.normal(size=37), "more": rng.exponential(size=12_000)}
    rows = [(k, float(v)) for k, x in groups.items() for v in x] + [("ties", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    points = [0.0, 0.01, 0.25, 0.5, 0.9, 0.95, 1.0]
    got = {r.g: r.quantiles for r in exact_quantiles(df, ["g"], "v", points, accuracy).collect()}
    assert set(got) == set(groups)
    for k, x in groups.items():
        assert np.allclose(got[k], np.quantile(x, points), rtol=1e-12, atol=1e-12), k
    joined = {r.g: r.quantiles for r in exact_quantiles(df, ["g"], "v", points, accuracy, most_broadcast=0).collect()}
    assert joined == got
    whole = exact_quantiles(df.filter("g = 'few'"), [], "v", [0.5]).collect()
    assert len(whole) == 1 and math.isclose(whole[0].quantiles[0], np.median(groups["few"]))


def test_stored_forests_per_tag(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(t, i, *map(float, rng.normal(size=2)), None if t == "b" else float(i)) for t in ("a", "b") for i in range(60)]
    df = spark.createDataFrame(rows, "tagname string, lift_id int, x double, y double, z double").withColumn("y", F.when(F.col("lift_id") % 9 == 0, None).otherwise(F.col("y")))
    names = ["x", "y", "z"]
    forest.fit_by_tag(df, names, trees=30, sample=32).write.parquet(f"{tmp_path}/m")
    models = spark.read.parquet(f"{tmp_path}/m")
    stored = {r.tagname: r for r in models.collect()}
    assert stored["a"].columns == names and stored["b"].columns == ["x", "y"]
    # direct computation: impute, scale, walk each tree
    new = [("a", 100, 5.0, None, 70.0), ("a", 101, 0.1, 0.2, 30.0), ("b", 102, 0.1, -4.0, None), ("c", 103, 1.0, 1.0, 1.0)]
    got = {r.lift_id: r for r in forest.score_by_tag(spark.createDataFrame(new, df.schema), models, names).collect()}
    assert set(got) == {100, 101, 102}
    for tag, lift, *x in new[:3]:
        m = stored[tag]
        v = [(m.median[i] if x[names.index(c)] is None else x[names.index(c)]) for i, c in enumerate(m.columns)]
        v = [(a - b) / s for a, b, s in zip(v, m.mean, m.scale, strict=True)]
        nodes, depths, at = np.frombuffer(m.nodes).reshape(-1, 7), [], 0
        for size in m.sizes:
            tree, k = nodes[at : at + size], 0
            while tree[k][1] >= 0:
                k = int(tree[k][3] if v[int(tree[k][1])] <= tree[k][2] else tree[k][4])
            depths.append(tree[k][6] + forest.average_path(tree[k][5]))
            at += size
        score = 2 ** (-np.mean(depths) / forest.average_path(m.sample))
        assert math.isclose(got[lift].anomaly_score, score, rel_tol=1e-12) and got[lift].is_anomaly == int(score > m.cut)
    # another number of features: the tag is skipped
    less = spark.createDataFrame([("a", 1, 1.0, 1.0, None), ("b", 1, 1.0, 1.0, None)], df.schema)
    assert {r.tagname for r in forest.score_by_tag(less, models, names).collect()} == {"b"}
    same = {(r.tagname, r.lift_id): r.anomaly_score for r in forest.score_by_tag(df, models, names).collect()}
    assert same == {(r.tagname, r.lift_id): r.anomaly_score for r in forest.fit_score_by_tag(df, names, trees=30, sample=32).collect()}


def test_stored_specialist_scores_alike(spark, tmp_path):
    from tidewheel.config import TagGroup

    rng = np.random.default_rng(4)
    rows = [(i % 7, 60 * i, *[None if rng.random() < 0.1 else float(v) for v in rng.normal(size=2)]) for i in range(300)]
    matrix = spark.createDataFrame(rows, "lift_id int, bucket_start_unix long, a double, b double")
    scored, parts = stack.specialist(matrix, TagGroup("g", ("a", "b"), 60, 4, 0.3, 4, ()), trees=20)
    stack.save(spark, f"{tmp_path}/g", parts)
    again = stack.apply_specialist(matrix, stack.load(spark, f"{tmp_path}/g"))
    key = lambda r: (r.lift_id, r.ts, r.score, r.pred, r.active)
    assert sorted(map(key, scored.collect())) == sorted(map(key, again.collect()))
    features = scored.selectExpr("lift_id", "ts", "score AS g_score", "pred AS g_pred", "2 AS n_active_groups")
    out, meta = stack.meta_model(features, ["g"], trees=15)
    stack.save(spark, f"{tmp_path}/m", meta)
    again = stack.apply_meta(features, stack.load(spark, f"{tmp_path}/m"))
    key = lambda r: (r.lift_id, r.ts, r.score, r.pred)
    assert sorted(map(key, out.collect())) == sorted(map(key, again.collect()))


def test_errors_follow_the_shape_of_the_output(spark):
    rows = [(1, [[1.0, 2.0], [3.0, 4.0]], [4.0, 4.0]), (2, [[0.0, 0.0], [1.0, 1.0]], [1.0, 3.0])]
    df = spark.createDataFrame(rows, "k int, steps array<array<double>>, target array<double>")
    for model in (sequence.Persistence(), sequence.Persistence(flat=True)):
        got = {r.k: (r.error, r.error_by_feature) for r in sequence.errors(df, model, "target").collect()}
        assert got == {1: (0.5, [1.0, 0.0]), 2: (2.0, [0.0, 4.0])}
    nothing = sequence.Linear(np.zeros(4), np.zeros((1, 4)))
    assert {r.k: r.error for r in sequence.errors(df, nothing).collect()} == {1: 7.5, 2: 0.5}
    with pytest.raises(Exception, match="a model that gives"):
        sequence.errors(df, sequence.Persistence()).collect()

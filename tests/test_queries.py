"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import numpy as np
import pytest

from tidewheel.config import META_SEQUENCE
from tidewheel.models import forest, sequence
from tidewheel.plans import catalog

DATA = os.environ.get("TIDEWHEEL_TEST_DATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = catalog.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return tuple(plain(x) for x in v) if isinstance(v, list | tuple) else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, name):
    df = catalog.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    rows = duck.execute(SQL[name])
    names = [d[0] for d in rows.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in rows.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(SQL)))
def test_query_without_sql_is_stable(spark, name):
    data = DATA
    if name in ("k6_forest_per_tag", "k7_stored_forest_per_tag"):  # the smallest tables have too few lifts for a model
        data = DATA.replace("sf0.001", "sf0.01")
    run = lambda: sorted(map(repr, catalog.queries()[name](spark, data).collect()))
    first = run()
    assert first and first == run()


def test_meta_model_is_the_autoencoder(spark, monkeypatch):
    shapes, fit = [], sequence.Autoencoder.fit_all
    shape = lambda df: (df.count(), *np.array(df.first()["steps"]).shape)
    monkeypatch.setattr(sequence.Autoencoder, "fit_all", lambda self, df, key, **more: shapes.append(shape(df)) or fit(self, df, key, **more))
    rows = catalog.queries()["k15_sequence_meta_model"](spark, DATA).collect()
    per_lift = catalog.queries()["k12_meta_features"](spark, DATA).groupBy("lift_id").count().collect()
    assert len(rows) == sum(max(0, r["count"] - META_SEQUENCE + 1) for r in per_lift) > 0
    assert [x[1:] for x in shapes] == [(META_SEQUENCE, 4)] and shapes[0][0] == len(rows)


def test_sequence_models_train_on_production_settings(spark, monkeypatch):
    seen, fit = [], sequence.Autoencoder.fit_all
    monkeypatch.setattr(sequence.Autoencoder, "fit_all", lambda self, df, key, **more: seen.append((df.count(), more)) or fit(self, df, key, **more))
    rows = catalog.queries()["k13_lstm_autoencoder"](spark, DATA).collect()
    active = sum(r["active"] or 0 for r in rows)
    assert seen == [(active if active >= 50 else len(rows), {})]
    monkeypatch.setattr(sequence.Autoencoder, "fit_all", None)
    assert catalog.queries()["k14_linear_baseline"](spark, DATA).count() == len(rows)


def test_forests_grow_production_trees(spark, monkeypatch):
    seen = []

    def fit(df, columns, key, trees=300, *args, **more):
        seen.append(trees)
        raise LookupError

    monkeypatch.setattr(forest, "fit", fit)
    for name in ("k3_isolation_forest", "k12_specialists_end_to_end", "k12_stacked_model"):
        with pytest.raises(LookupError):
            catalog.queries()[name](spark, DATA)
    assert seen == [300, 300, 400]

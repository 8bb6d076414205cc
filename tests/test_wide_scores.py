"""Steps that serve large tables against the plain way: walks inside a row, a fit from a start, picked neighbours."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskloom.operators import explain as ex
from riskloom.operators import kernel, knn
from riskloom.operators import models as md


def _table(spark, n, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)).round(2)
    y = (x[:, 0] + x[:, 1] ** 2 + rng.normal(size=n) * 0.5 > 0.8).astype(int)
    return spark.createDataFrame([(i, int(t), *map(float, v)) for i, (v, t) in enumerate(zip(x, y))], "id long, y int, a double, b double, c double").repartition(4)


def test_walks_inside_a_row_equal_walks_as_rows(spark):
    rng = np.random.default_rng(1)
    model = md.RbfModel(rng.normal(size=(9, 3)), rng.normal(size=9), 0.2, [1.5, -0.1], ["a", "b", "c"], 0.7)
    rows = _table(spark, 40).unionByName(_table(spark, 3))
    back = rows.limit(6).select("a", "b", "c", F.lit(1 / 6).alias("weight"))
    args = (rows, "id", ["a", "b", "c"], model.predict, back, 5)
    plain, inside = (ex.explain_sampled(*args, gains_of=g).toPandas().sort_values(["id", "feature"]) for g in (None, model.walk_gains))
    assert len(plain) == 120 and plain["id"].tolist() == inside["id"].tolist()
    assert np.allclose(plain[["phi", "base_value"]], inside[["phi", "base_value"]], rtol=0, atol=1e-12)


def test_a_fit_from_a_start_ends_where_the_whole_fit_does(spark, monkeypatch):
    rows = _table(spark, 1_500)
    x = F.array("a", "b", "c")
    rows = rows.select(x.alias("_x"), F.when(F.col("y") == 1, 1.0).otherwise(-1.0).alias("_y"), F.pmod("id", F.lit(3)).cast("int").alias("_fold"), F.col("id").alias("_key")).coalesce(1).cache()
    marks = kernel.Landmarks.of(np.random.default_rng(2).normal(size=(4, 3)), 0.5)
    steps = []
    whole = kernel._summed
    monkeypatch.setattr(kernel, "_summed", lambda df, *a: (steps.append(df), whole(df, *a))[1])
    plain, settled = kernel.fit_margins(rows.drop("_key"), marks, 1.0, 100, 1e-7, [])
    before = len(steps)
    steps.clear()
    monkeypatch.setattr(kernel, "START_ROWS", 300)
    got, also = kernel.fit_from_start(rows, "_key", 1_500, marks, 1.0, 100, 1e-7, [])
    full = sum(df is rows for df in steps)
    assert settled and also and 0 < full < before
    for a, b in zip(plain, got):
        assert np.allclose(a, b, atol=2e-3)


@pytest.mark.parametrize("shift", [0.0, 1e6])
def test_picked_pairs_hold_the_nearest(shift):
    rng = np.random.default_rng(3)
    y = rng.normal(size=(500, 20)).round(1) + shift
    x = np.vstack([y[:50], rng.normal(size=(50, 20)) + shift])
    true = knn._distances(x, y)
    kth = np.sort(true, axis=1)[:, 6]
    q, s, d = knn._near(x, y, 7, np.full(len(x), np.inf))
    assert (d == true[q, s]).all()
    got = np.zeros(true.shape, bool)
    got[q, s] = True
    assert got[true <= kth[:, None]].all() and (shift or len(q) < 1_500)
    q, s, _ = knn._near(x, y, 7, kth / 2)
    got = np.zeros(true.shape, bool)
    got[q, s] = True
    assert got[true <= kth[:, None] / 2].all()


def test_rows_beyond_a_bound_stay_behind():
    queries = pd.DataFrame({"_q": [1, 2], "_x": [[0.0, 0.0], [5.0, 0.0]], "bound": [2.0, 1.0]})
    rows = pd.DataFrame({"_s": [7, 8, 9], "_x": [[1.0, 1.0], [1.0, 0.0], [5.0, 1.0]], "_y": [0.0, 1.0, 0.0]})
    got = knn._block_top_k(3)(queries, rows)
    assert list(map(tuple, got[["_q", "_s", "_d"]].to_numpy())) == [(1, 8, 1.0), (1, 7, 2.0), (2, 9, 1.0)]

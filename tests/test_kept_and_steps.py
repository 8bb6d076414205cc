"""Whole tables that passes share lie on disk; a pass of the kernel fit maps only rows in the corner to features."""

import os

import numpy as np
import pandas as pd

from riskloom.functions.session import Kept
from riskloom.operators import clean as cl
from riskloom.operators import kernel
from riskloom.operators import models as md


def _held(spark) -> int:
    return spark.sparkContext._jsc.getPersistentRDDs().size()


def test_kept_table_is_read_as_written(spark):
    rows = [(1, None, float("nan"), "a"), (None, 2, -0.0, None), (1, None, float("nan"), "a")]
    df = spark.createDataFrame(rows, "`a b` int, k long, v double, s string").selectExpr("*", "null as nothing")
    kept = Kept(df)
    assert kept.df.columns == df.columns and [t for _, t in kept.df.dtypes] == [t for _, t in df.dtypes]
    assert sorted(map(str, kept.df.collect())) == sorted(map(str, df.collect()))
    assert Kept(df.limit(0)).df.collect() == []
    folder = "/" + kept.path.split(":", 1)[-1].lstrip("/")
    assert os.path.isdir(folder)
    kept.unpersist()
    assert not os.path.exists(folder)
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_whole_tables_are_not_held_by_executors(spark):
    r, before = np.random.default_rng(5), _held(spark)
    x = r.standard_normal((600, 2))
    rows = pd.DataFrame({"id": range(600), "a": x[:, 0], "b": x[:, 1], "y": (x.sum(axis=1) + r.standard_normal(600) > 0).astype(int)})
    done = cl.clean(spark.createDataFrame(rows), "y", ["a", "b"], carry=["id"])
    assert done.df.count() == 600 and _held(spark) == before
    train, test = (done.df.where(f"id % 4 {sign} 0") for sign in ("<>", "="))
    fitted = md.train_all(train, test, done.features, "y", "id", [md.spec_of("tree")])
    assert fitted.predictions.count() == 150 and _held(spark) == before
    fitted.unpersist()
    done.unpersist()


def test_step_sums_equal_plain_sums_and_map_few_rows(monkeypatch):
    r = np.random.default_rng(6)
    x, y, fold = r.standard_normal((500, 3)), r.choice([-1.0, 1.0], 500), r.integers(0, 3, 500)
    marks = kernel.Landmarks.of(r.standard_normal((20, 3)), 0.4)
    size, without = marks.lift.shape[1] + 1, [-1, 0, 2]
    at = [r.standard_normal(size) for _ in without]
    phi = np.hstack([marks.features(x), np.ones((500, 1))])
    lifted = []

    class Lift(np.ndarray):
        def __rmatmul__(self, other):
            lifted.append(len(other))
            return other @ np.asarray(self)

    for corner in (2.0, 0.005):
        lifted.clear()
        watched = kernel.Landmarks(marks.places, marks.lift.view(Lift), marks.gamma)
        got = kernel.step_sums(x, y, fold, watched, at, without, corner)
        corners = np.zeros(500, dtype=bool)
        for (line, curves), w, f in zip(got, at, without):
            mine = fold != f
            p, side = phi[mine], y[mine]
            loss, slope, curve = kernel.rounded_hinge(side * (p @ w), corner)
            corners[np.flatnonzero(mine)[curve > 0]] = True
            gradient = np.append(marks.lift.T @ line[:-2], line[-2])
            np.testing.assert_allclose(gradient, (slope * side) @ p, rtol=1e-8, atol=1e-8)
            np.testing.assert_allclose(line[-1], loss.sum(), rtol=1e-10)
            np.testing.assert_allclose(curves, (p.T * curve) @ p, rtol=1e-8, atol=1e-8)
        assert max(lifted) == corners.sum() < (500 if corner > 1 else 50)

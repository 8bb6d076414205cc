"""Attribution with one base value, folds by row, empty classes in the density."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators import explain as ex
from riskloom.operators.models import ModelSpec, fit_model
from riskloom.operators.profile import density


def test_sampled_attribution_has_one_base_and_is_exact_for_a_linear_score(spark):
    rows = spark.createDataFrame([(i, float(i), float(i % 3)) for i in range(12)], "id int, a double, b double")
    back = spark.createDataFrame([(0, 0.5, 1.0, 2.0), (1, 0.5, 3.0, -2.0)], "centroid int, weight double, a double, b double")
    line = lambda t: t.withColumn("probability", 0.3 + 2 * F.col("a") - F.col("b"))
    got = ex.explain_sampled(rows, "id", ["a", "b"], line, back, n_perm=4).collect()
    assert len(got) == 24 and all(r["base_value"] == pytest.approx(0.3 + 2 * 2.0 - 0.0) for r in got)
    values = {r["id"]: r for r in rows.collect()}
    for r in got:
        own = values[r["id"]]
        assert r["phi"] == pytest.approx(2 * (own["a"] - 2.0) if r["feature"] == "a" else -(own["b"] - 0.0))


def test_neighbouring_values_are_those_of_all_rows(spark):
    values = [0.0, 1.0, 2.5, 7.0, None, 7.0]
    df = spark.createDataFrame([(v,) for v in values], "a double").repartition(3)
    got = {r["centroid"]: (r["below"], r["above"]) for r in ex._neighbours(df, ["a"], [[2.0], [7.0], [9.0], [-1.0]]).collect()}
    assert got == {0: (1.0, 2.5), 1: (7.0, 7.0), 2: (7.0, np.inf), 3: (-np.inf, 0.0)}


def test_margin_classifier_on_two_different_vectors(spark):
    train = spark.createDataFrame([(i, i % 2, float(i % 2), 1.0 - i % 2) for i in range(40)], "id int, y int, a double, b double")
    model = fit_model(ModelSpec("Rbf", "rbf_svc", "sampled", {"waves": 16, "max_iter": 10}), train, ["a", "b"], "y", "id")
    got = model.predict(train).select("y", "prediction", "probability").distinct().collect()
    assert len(got) == 2 and all(r["y"] == r["prediction"] for r in got)


def test_a_class_without_spread_has_a_null_density(spark):
    df = spark.createDataFrame([(1.0, 0), (2.0, 0), (4.0, 0), (3.0, 1), (3.0, 1), (2.0, 2)], "v double, k int")
    rows = density(df, "v", "k", 5).collect()
    assert sorted((r["k"], r["x"]) for r in rows) == [(k, 1.0 + 0.75 * i) for k in (0, 1, 2) for i in range(5)]
    assert all((r["density"] is None) == (r["k"] != 0) for r in rows)

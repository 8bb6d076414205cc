"""Least squares over coalitions against all coalitions."""

from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators import coalitions as co
from riskloom.operators import explain as ex


def shapley(value, d):
    phi = np.zeros(d)
    for j in range(d):
        for size in range(d):
            for s in combinations([i for i in range(d) if i != j], size):
                phi[j] += factorial(size) * factorial(d - size - 1) / factorial(d) * (value({*s, j}) - value({*s}))
    return phi


@pytest.mark.parametrize("d", [1, 2, 3, 5, 8])
def test_all_coalitions_give_shapley_values(d):
    rng = np.random.default_rng(d)
    table = {frozenset(s): rng.normal() for k in range(d + 1) for s in combinations(range(d), k)}
    rows, weights = co.chosen_coalitions(d)
    assert len(rows) == 2**d - 2
    values = [table[frozenset()], table[frozenset(range(d))], *[table[frozenset(np.flatnonzero(z).tolist())] for z in rows]]
    if d == 1:
        values = values[:2]
    assert np.allclose(co.solution(rows, weights) @ values, shapley(lambda s: table[frozenset(s)], d), atol=1e-10)


def test_many_features_are_sampled_and_add_up():
    d = 14
    rows, weights = co.chosen_coalitions(d, 600, seed=3)
    assert len(rows) <= 600 and (rows.sum(axis=1) > 0).all() and (rows.sum(axis=1) < d).all()
    rng = np.random.default_rng(1)
    w = rng.normal(size=d)
    # A value that adds up over features is found without an error, and any attribution adds up to the difference.
    matrix = co.solution(rows, weights)
    assert np.allclose(matrix @ [0.0, w.sum(), *(rows @ w)], w, atol=1e-9)
    values = rng.normal(size=len(rows) + 2)
    assert (matrix @ values).sum() == pytest.approx(values[1] - values[0])


def test_records_against_brute_force(spark):
    rng = np.random.default_rng(5)
    x, back, weight = rng.normal(size=(12, 3)), rng.normal(size=(5, 3)), [1.0, 2.0, 0.5, 4.0, 0.0]
    names = ["a", "b", "c"]
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "id long, a double, b double, c double").withColumn("w", F.lit("kept apart"))
    ground = spark.createDataFrame([(*map(float, b), w) for b, w in zip(back, weight)], "a double, b double, c double, weight double")
    score = lambda t: t.withColumn("probability", F.col("a") * F.col("b") + F.sin("c") * F.col("a"))
    f = lambda v: v[0] * v[1] + np.sin(v[2]) * v[0]
    got = ex.explain_coalitions(df, "id", names, score, ground).toPandas()
    phi = got.pivot(index="id", columns="feature", values="phi")[names].to_numpy()
    share = np.array(weight) / sum(weight)
    for i in range(12):
        mean = lambda s: sum(p * f([x[i][j] if j in s else b[j] for j in range(3)]) for p, b in zip(share, back))
        assert np.allclose(phi[i], shapley(mean, 3), atol=1e-10)
    assert np.allclose(got["base_value"], sum(p * f(b) for p, b in zip(share, back)))
    assert ex.explain_coalitions(df, "id", names, score, ground, top=1).count() == 12
    assert ex.explain_coalitions(df.limit(0), "id", names, score, ground).collect() == []
    with pytest.raises(ValueError, match="background"):
        ex.explain_coalitions(df, "id", names, score, ground.limit(0))

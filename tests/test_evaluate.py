import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskloom.operators import evaluate as ev

TIES = [(1, 0.9), (0, 0.9), (1, 0.5), (0, 0.5), (0, 0.1), (1, 0.1), (1, 0.7)]


def brute_auc(y, s):
    pos, neg = s[y == 1], s[y == 0]
    d = pos[:, None] - neg[None, :]
    return ((d > 0) + 0.5 * (d == 0)).mean()


def brute_curve(y, s):
    """Points of the full curve, then without those whose step equals the next one's."""
    values = np.unique(s)[::-1]
    tps = np.array([((s >= v) & (y == 1)).sum() for v in values], float)
    fps = np.array([((s >= v) & (y == 0)).sum() for v in values], float)
    keep = np.ones(len(values), bool)
    if len(values) > 2:
        keep[1:-1] = (np.diff(fps, 2) != 0) | (np.diff(tps, 2) != 0)
    pts = [(math.inf, 0.0, 0.0)] + list(zip(values[keep], fps[keep] / fps[-1], tps[keep] / tps[-1]))
    return [tuple(map(float, p)) for p in pts]


@pytest.fixture(scope="module")
def scores(spark):
    rng = np.random.default_rng(3)
    n = 1200
    pdf = pd.DataFrame({"model": rng.choice(["p", "q"], n), "y": rng.integers(0, 2, n)})
    pdf["s"] = np.where(rng.random(n) < 0.33, 0.5, (rng.random(n) + 0.3 * pdf.y).round(3))
    return pdf, spark.createDataFrame(pdf).repartition(3)


def test_auc_with_ties(spark):
    df = spark.createDataFrame(TIES, "y int, s double")
    assert ev.roc_auc(df, "y", "s").first().roc_auc == pytest.approx(0.5416666667)
    flipped = df.withColumn("s", 1 - F.col("s"))
    assert ev.roc_auc(flipped, "y", "s").first().roc_auc == pytest.approx(1 - 0.5416666667)


def test_auc_and_curve_equal_brute_force(scores):
    pdf, df = scores
    for buckets in (None, 29):
        got = {r.model: r.roc_auc for r in ev.roc_auc(df, "y", "s", ["model"], buckets).collect()}
        curves = ev.roc_curve(df, "y", "s", ["model"], buckets=buckets).toPandas()
        for m, part in pdf.groupby("model"):
            y, s = part.y.to_numpy(), part.s.to_numpy()
            assert got[m] == pytest.approx(brute_auc(y, s))
            mine = curves[curves.model == m].sort_values("threshold", ascending=False)
            assert np.allclose(mine[["fpr", "tpr"]].to_numpy(), np.array(brute_curve(y, s))[:, 1:])
    whole = ev.roc_curve(df, "y", "s", drop_collinear=False)
    assert whole.count() == pdf.s.nunique() + 1


def test_single_class(spark):
    df = spark.createDataFrame([(1, 0.2, 1), (1, 0.8, 0)], "y int, s double, p int")
    assert ev.roc_auc(df, "y", "s").first().roc_auc is None
    assert {r.cell: r["count"] for r in ev.confusion_matrix(df, "y", "p").collect()} == {"TN": 0, "FP": 0, "FN": 1, "TP": 1}


def test_no_positive_prediction(spark):
    df = spark.createDataFrame([(1, 0), (0, 0), (1, 0)], "y int, p int")
    r = ev.classification_metrics(df, "y", "p").first()
    assert (r.accuracy, r.precision, r.recall, r.f1, r.roc_auc) == (0.3333, 0.0, 0.0, 0.0, None)


def test_empty_scores(spark):
    df = spark.createDataFrame([], "y int, p int, s double")
    assert ev.classification_metrics(df, "y", "p", "s").first().accuracy is None
    assert ev.roc_curve(df, "y", "s").count() == 0


def test_leaderboard(spark):
    rows = [("c", 0.5, 0.5, 0.5, 0.5, None), ("b", 0.5, 0.5, 0.5, 0.5, 0.9), ("a", 0.5, 0.5, 0.5, 0.5, 0.9),
            ("d", 0.5, 0.5, 0.5, 0.5, 0.7)]
    m = spark.createDataFrame(rows, "model string, accuracy double, precision double, recall double, f1 double, roc_auc double")
    board = ev.leaderboard(m, ["b", "a", "c", "d"]).collect()
    assert [r.model for r in board] == ["b", "a", "d", "c"]
    assert board[3].medal == "#4" and board[0].medal == "\U0001F947" and board[3].roc_auc == 0.0
    assert ev.best_model(m, ["a", "b"]).first().model == "a"
    long = ev.metrics_long(m)
    assert long.count() == 20 and long.where("value IS NULL").count() == 0
    roc = spark.createDataFrame([("a", 0.1)], "model string, fpr double")
    assert [r.model for r in ev.with_curve(m, roc).collect()] == ["a"]

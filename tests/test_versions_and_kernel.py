"""Ragged text lines, whole versions of saved folders, training that goes on, and the landmark kernel classifier."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators import kernel
from riskloom.operators import models as md
from riskloom.operators import profile as pr
from riskloom.sources import artifacts, versions
from riskloom.sources.tables import read_checked_table

LINES = ['1,2,3', '4,5', '6,7,8,9', '"a, b",?,1', '"x, ""y""",1,2,3', '10', '1,"2,2",3', ',,']


def test_ragged_lines_are_told_apart(spark, tmp_path):
    path = str(tmp_path / "t.csv")
    open(path, "w").write("\n".join(LINES) + "\n")
    got = read_checked_table(spark, path, ["a", "b", "_line"])
    rows = sorted(map(str, (tuple(r) for r in got.rows.collect())))
    assert rows == sorted(map(str, [("1", "2", "3"), ("4", "5", None), ("a, b", None, "1"), ("10", None, None), ("1", "2,2", "3"), (None, None, None)]))
    assert sorted((r.line, r.fields, r.reason) for r in got.rejected.collect()) == [('"x, ""y""",1,2,3', 4, "surplus"), ("6,7,8,9", 4, "surplus")]
    strict = read_checked_table(spark, path, ["a", "b", "c"], reject_short=True)
    assert {r.reason: r["lines"] for r in strict.counts().collect()} == {"surplus": 2, "short": 2} and strict.rows.count() == 4


def test_ragged_lines_below_a_header(spark, tmp_path):
    path = str(tmp_path / "t.csv")
    open(path, "w").write(" Age ,num\n1,2\n3,4,5\n6\n")
    got = read_checked_table(spark, path, header=True, renames={"num": "target"})
    assert got.rows.columns == ["age", "target"] and sorted(map(str, map(tuple, got.rows.collect()))) == ["('1', '2')", "('6', None)"]
    assert [tuple(r) for r in got.rejected.collect()] == [("3,4,5", 3, "surplus")]
    open(path, "w").write("a,b\n")
    assert read_checked_table(spark, path, header=True).rows.count() == 0


def results(spark, auc):
    return (
        spark.createDataFrame([("m", 0.5, 0.5, 0.5, 0.5, round(auc, 4))], artifacts.METRICS_SCHEMA),
        spark.createDataFrame([("m", 0.5, 0.0, 1.0)], artifacts.ROC_SCHEMA),
        spark.createDataFrame([("m", "tree", auc)], artifacts.NOTES_SCHEMA),
    )


def test_an_interrupted_save_leaves_the_former_version(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "r")
    metrics, roc, notes = results(spark, 0.123456789)
    artifacts.save_results(metrics, roc, path, notes)
    assert tuple(artifacts.load_notes(spark, path).first()) == ("m", "tree", 0.123456789)

    def stop(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(versions, "publish", stop)
        with pytest.raises(KeyboardInterrupt):
            artifacts.save_results(*results(spark, 0.9)[:2], path)
    assert artifacts.load_notes(spark, path).first()["auc"] == 0.123456789
    for auc in (0.2, 0.3, 0.4):
        metrics, roc, notes = results(spark, auc)
        artifacts.save_results(metrics, roc, path, notes)
    assert artifacts.load_notes(spark, path).first()["auc"] == 0.4
    # The last two versions are kept; the newest one that is whole is read.
    last = versions.current(spark, path)[1]
    os.rename(f"{last}/notes", f"{last}/gone")
    assert artifacts.load_notes(spark, path).first()["auc"] == 0.3
    assert len([f for f in os.listdir(f"{path}/manifests") if f.endswith(".json")]) == versions.KEPT_VERSIONS


def ring(spark, n=300, seed=4):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, 2))
    y = ((x**2).sum(axis=1) + r.normal(scale=0.3, size=n) < 1.2).astype(int)
    return x, y, spark.createDataFrame([(i, float(a), float(b), int(t)) for i, ((a, b), t) in enumerate(zip(x, y))], "id long, a double, b double, y int")


def test_training_goes_on_where_it_stopped(spark, tmp_path, monkeypatch):
    *_, df = ring(spark)
    train, test = df.where("id % 4 <> 0"), df.where("id % 4 = 0")
    specs = [
        md.ModelSpec("Tree", "tree", "tree", {"depth": 3}), md.ModelSpec("Knn", "knn", "sampled", {"k": 3}),
        md.ModelSpec("Logistic", "logistic", "linear", {"max_iter": 50, "C": 1.0}),
    ]
    store, fitted, real = artifacts.ModelStore(spark, str(tmp_path / "store")), [], md.fit_model

    def counted(spec, *args):
        if len(fitted) == 2 and spec.name == "Logistic" and "stopped" not in fitted:
            fitted.append("stopped")
            raise KeyboardInterrupt
        fitted.append(spec.name)
        return real(spec, *args)

    monkeypatch.setattr(md, "fit_model", counted)
    with pytest.raises(KeyboardInterrupt):
        md.train_all(train, test, ["a", "b"], "y", "id", specs, store=store)
    assert fitted == ["Tree", "Knn", "stopped"]
    done = md.train_all(train, test, ["a", "b"], "y", "id", specs, store=store)
    assert fitted == ["Tree", "Knn", "stopped", "Logistic"] and set(done.fitted) == {"Tree", "Knn", "Logistic"}
    whole = md.train_all(train, test, ["a", "b"], "y", "id", specs)
    key = ["model", "id"]
    assert done.predictions.select(*key, "probability").exceptAll(whole.predictions.select(*key, "probability")).count() == 0
    assert {r.model: r.explains for r in done.notes("y").collect()} == {"Tree": "tree", "Knn": "sampled", "Logistic": "linear"}
    # Other rows or settings are other models.
    before = len(fitted)
    md.train_all(train.where("id <> 1"), test, ["a", "b"], "y", "id", specs[:1], store=store)
    md.train_all(train, test, ["a", "b"], "y", "id", specs[:1], seed=7, store=store)
    assert len(fitted) == before + 2


def dual_optimum(k, y, cost, steps=20_000):
    """The objective of the exact dual, by maximal violating pairs."""
    a, g = np.zeros(len(y)), -np.ones(len(y))
    for _ in range(steps):
        up, low = (a < cost) & (y > 0) | (a > 0) & (y < 0), (a < cost) & (y < 0) | (a > 0) & (y > 0)
        v = -y * g
        i, j = np.where(up, v, -np.inf).argmax(), np.where(low, v, np.inf).argmin()
        if v[i] - v[j] < 1e-6:
            break
        step = (v[i] - v[j]) / max(k[i, i] + k[j, j] - 2 * k[i, j], 1e-12)
        step = min(step, cost - a[i] if y[i] > 0 else a[i], a[j] if y[j] > 0 else cost - a[j])
        a[i] += y[i] * step
        a[j] -= y[j] * step
        g += step * y * (k[:, i] - k[:, j])
    return a.sum() - (a * y) @ k @ (a * y) / 2


@pytest.mark.parametrize("cost", [1.0, 10.0])
def test_kernel_fit_reaches_the_exact_dual(spark, cost):
    x, y, df = ring(spark, 200)
    rows = df.selectExpr("array(a, b) as _x", "if(y = 1, 1.0D, -1.0D) as _y", "cast(id % 3 as int) as _fold").repartition(3)
    marks = kernel.Landmarks.of(x, 0.5)
    weights, settled = kernel.fit_margins(rows, marks, cost, 100, 1e-7, [0, 2])
    assert settled and len(weights) == 3
    for w, some in zip(weights, (np.ones(200, bool), np.arange(200) % 3 != 0, np.arange(200) % 3 != 2)):
        side = np.where(y == 1, 1.0, -1.0)[some]
        k = kernel.kernel(x[some], x[some], 0.5)
        margins = marks.features(x[some]) @ w[:-1] + w[-1]
        primal = w[:-1] @ w[:-1] / 2 + cost * np.maximum(0, 1 - side * margins).sum()
        best = dual_optimum(k, side, cost)
        assert best - 1e-6 <= primal <= best * (1 + 1e-3) + 1e-9


def test_kernel_classifier_says_nothing_and_finds_the_ring(spark):
    x, y, df = ring(spark, 600)
    spec = md.ModelSpec("Rbf", "rbf_svc", "sampled", {"C": 1.0, "landmarks": 40})
    model = md.fit_model(spec, df.where("id % 3 <> 0"), ["a", "b"], "y", "id")
    assert not getattr(model, "note", "") and len(model.places) == 40
    got = model.predict(df.where("id % 3 = 0"))
    assert got.where("prediction = y").count() > 0.85 * got.count()
    assert got.where("probability is null or probability < 0 or probability > 1").count() == 0
    assert model.predict(df.limit(0)).count() == 0


def test_one_place_and_few_rows(spark):
    df = spark.createDataFrame([(i, 1.0, i % 2) for i in range(8)], "id long, a double, y int")
    model = md.fit_model(md.ModelSpec("Rbf", "rbf_svc", "sampled", {}), df, ["a"], "y", "id")
    assert len(model.places) == 1 and model.predict(df).select("probability").distinct().count() == 1


def test_density_far_from_zero_and_with_outliers(spark):
    r = np.random.default_rng(2)
    v = np.concatenate([1e6 + r.normal(size=500), [1e6 + 500.0], np.repeat(1e6 + 0.25, 300)])
    df = spark.createDataFrame([(float(a), 1) for a in v] + [(1e6, 2)] * 5, "v double, y int")
    got = pr.density(df, "v", "y", 50).toPandas().sort_values(["y", "x"])
    iqr = np.quantile(v, 0.75) - np.quantile(v, 0.25)
    h = 1.059 * min(v.std(ddof=1), iqr / 1.349 if iqr > 0 else np.inf) * len(v) ** -0.2
    one = got[got.y == 1]
    want = np.exp(-0.5 * ((one.x.to_numpy()[:, None] - v) / h) ** 2).sum(1) / (len(v) * h * np.sqrt(2 * np.pi))
    assert np.allclose(one.density, want, rtol=1e-6, atol=1e-10) and got[got.y == 2].density.isna().all()

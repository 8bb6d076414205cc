import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskloom.operators import evaluate as ev
from riskloom.operators import explain as ex
from riskloom.operators import models as md
from riskloom.operators.knn import nearest_neighbours
from riskloom.operators.score import score
from riskloom.sources.artifacts import load_fitted, load_results, save_fitted, save_results

X = ["u", "v", "w"]


@pytest.fixture(scope="module")
def ring(spark):
    """Label: inside a circle. No straight line separates it."""
    rng = np.random.default_rng(11)
    pdf = pd.DataFrame(rng.uniform(-1, 1, size=(900, 3)), columns=X)
    pdf["y"] = ((pdf.u**2 + pdf.v**2) < 0.55).astype(int)
    pdf["id"] = np.arange(len(pdf))
    df = spark.createDataFrame(pdf).repartition(3)
    return pdf, df.where("id % 4 != 0"), df.where("id % 4 = 0")


@pytest.fixture(scope="module")
def trained(ring):
    _, train, test = ring
    specs = [
        md.spec_of("logistic"),
        md.ModelSpec("Forest", "forest", "tree", {"trees": 8, "depth": 4}),
        md.ModelSpec("Tree", "tree", "tree", {"depth": 4}),
        md.ModelSpec("Knn", "knn", "sampled", {"k": 7}),
        md.ModelSpec("Rbf", "rbf_svc", "sampled", {"C": 1.0, "waves": 64}),
        md.ModelSpec("Boosted", "gbt", "tree", {"rounds": 4, "rate": 0.3, "depth": 3}),
        md.ModelSpec("Broken", "nothing", "sampled", {}),
    ]
    return md.train_all(train, test, X, "y", "id", specs)


def scaled_test(ring, trained):
    from riskloom.operators.scale import apply_scaler

    return apply_scaler(ring[2], trained.fitted["Tree"].scaler)


def test_models_find_the_ring(trained):
    status = {r.model: r.status for r in trained.status.collect()}
    assert status.pop("Broken") == "failed" and set(status.values()) == {"ok"}
    auc = {r.model: r.roc_auc for r in trained.metrics("y").collect()}
    assert set(auc) == set(status)
    assert auc["Logistic Regression"] < 0.65
    for m in ("Forest", "Tree", "Knn", "Rbf", "Boosted"):
        assert auc[m] > 0.85, (m, auc)
    assert trained.roc("y").select("model").distinct().count() == 6


def test_all_failing_is_an_error(ring):
    with pytest.raises(RuntimeError, match="Broken"):
        md.train_all(ring[1], ring[2], X, "y", "id", [md.ModelSpec("Broken", "nothing", "sampled")])


def test_knn_equals_brute_force(spark, ring):
    pdf, train, test = ring
    hot = train.where("id < 200").select(*[F.lit(0.25).alias(c) for c in X], "y", (F.col("id") + 5000).alias("id"))
    many = train.unionByName(hot)
    t, q = many.toPandas().sort_values("id"), test.toPandas()
    d = ((q[X].to_numpy()[:, None, :] - t[X].to_numpy()[None]) ** 2).sum(2)
    order = np.argsort(d, axis=1, kind="stable")[:, :7]
    want = {i: t["id"].to_numpy()[o].tolist() for i, o in zip(q["id"], order)}
    for blocks in ({}, {"train_block": 23, "query_block": 17}, {"train_block": 7, "query_block": 1000}):
        near = nearest_neighbours(many, test, X, "y", "id", "id", 7, **blocks).toPandas()
        got = near.sort_values(["_q", "_d", "_s"]).groupby("_q")["_s"].apply(list).to_dict()
        assert got == want, blocks
    with pytest.raises(ValueError, match="neighbours"):
        nearest_neighbours(train.limit(3), test, X, "y", "id", "id", 7)


def test_logistic_solves_the_stated_objective(ring, trained):
    pdf, train, _ = ring
    from riskloom.operators.scale import apply_scaler

    f = trained.fitted["Logistic Regression"]
    t = apply_scaler(train, f.scaler).toPandas()
    x, y = np.c_[t[X].to_numpy(), np.ones(len(t))], t["y"].to_numpy()
    w, ridge = np.zeros(4), np.diag([1.0, 1.0, 1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (p - y) + ridge @ w)
    assert np.allclose([*f.model.model.coefficients, f.model.model.intercept], w, atol=1e-4)


def test_importance(trained):
    rows = md.feature_importance(trained.fitted["Tree"]).collect()
    assert [r.importance for r in rows] == sorted(r.importance for r in rows) and rows[0].feature == "w"
    assert md.feature_importance(trained.fitted["Logistic Regression"]).count() == 3
    assert md.feature_importance(trained.fitted["Knn"]).count() == 0


def test_linear_attribution_sums_to_log_odds(ring, trained):
    f = trained.fitted["Logistic Regression"]
    rows = scaled_test(ring, trained)
    inside = ex.explain(rows, "id", f, top=2)
    stored = ex.top_contributions(ex.explain(rows, "id", f), "id", 2).select(*inside.columns)
    assert inside.exceptAll(stored).count() == 0 and inside.count() == stored.count() == 2 * rows.count()
    phi = ex.explain(rows, "id", f).groupBy("id").agg((F.sum("phi") + F.first("base_value")).alias("z"))
    p = f.model.predict(rows).select("id", F.log(F.col("probability") / (1 - F.col("probability"))).alias("logit"))
    gap = phi.join(p, "id").agg(F.max(F.abs(F.col("z") - F.col("logit")))).first()[0]
    assert gap < 1e-9
    fast = md.LinearScore.of(f.model).predict(rows).select("id", F.col("probability").alias("p2"))
    both = f.model.predict(rows).join(fast, "id")
    assert both.agg(F.max(F.abs(F.col("p2") - F.col("probability")))).first()[0] < 1e-12


def tree_shapley(node, x, d):
    """All coalitions: a feature outside the coalition follows both branches by their cover."""
    from itertools import combinations
    from math import factorial

    def expect(n, inside):
        if n.numDescendants() == 0:
            c = [n.impurityStats().stats()[i] for i in range(2)]
            return c[1] / sum(c)
        s = n.split()
        l, r = n.leftChild(), n.rightChild()
        if s.featureIndex() in inside:
            return expect(l if x[s.featureIndex()] <= s.threshold() else r, inside)
        a, b = l.impurityStats().count(), r.impurityStats().count()
        return (a * expect(l, inside) + b * expect(r, inside)) / (a + b)

    phi = np.zeros(d)
    for j in range(d):
        others = [i for i in range(d) if i != j]
        for size in range(d):
            for s in combinations(others, size):
                weight = factorial(size) * factorial(d - size - 1) / factorial(d)
                phi[j] += weight * (expect(node, {*s, j}) - expect(node, {*s}))
    return phi


def test_tree_attribution_equals_all_coalitions(ring, trained):
    f = trained.fitted["Tree"]
    rows = scaled_test(ring, trained).orderBy("id").limit(6)
    got = ex.explain(rows, "id", f).toPandas().pivot(index="id", columns="feature", values="phi")
    root = f.model.model._java_obj.rootNode()
    jvm_stats = root.impurityStats()
    assert jvm_stats.count() > 0
    for r in rows.collect():
        want = tree_shapley(root, [r[c] for c in X], 3)
        assert np.allclose(got.loc[r["id"], X].to_numpy(), want, atol=1e-9)


@pytest.mark.parametrize("name", ["Forest", "Boosted"])
def test_ensemble_attribution_sums_to_the_score(ring, trained, name, monkeypatch):
    f, rows = trained.fitted[name], scaled_test(ring, trained)
    p = F.col("probability")
    goal = F.log(p / (1 - p)) if name == "Boosted" else p
    scored = f.model.predict(rows).select("id", goal.alias("goal"))
    for size in (ex.LEAVES_PER_CALL, 10):
        monkeypatch.setattr(ex, "LEAVES_PER_CALL", size)
        total = ex.explain(rows, "id", f).groupBy("id").agg((F.sum("phi") + F.first("base_value")).alias("z"))
        assert total.join(scored, "id").agg(F.max(F.abs(F.col("z") - F.col("goal")))).first()[0] < 1e-8


def test_sampled_attribution(ring, trained):
    f = trained.fitted["Logistic Regression"]
    rows = scaled_test(ring, trained).orderBy("id").limit(5)
    back = ex.background_summary(f.background, X, k=10)
    assert back.count() == 10 and back.agg(F.sum("weight")).first()[0] == pytest.approx(1)
    values = {c: {r[c] for r in f.background.select(c).collect()} for c in X}
    assert all(r[c] in values[c] for r in back.collect() for c in X)
    # With a linear score every order gives the same gain, so one background point is exact.
    line = lambda t: t.withColumn("probability", F.col("u") * 2 - F.col("v") + F.lit(0.5))
    one = back.limit(1).withColumn("weight", F.lit(1.0)).collect()
    single = rows.sparkSession.createDataFrame(one, back.schema)
    phi = ex.explain_sampled(rows, "id", X, line, single, n_perm=3).toPandas().pivot(index="id", columns="feature", values="phi")
    for r in rows.collect():
        want = [2 * (r["u"] - one[0]["u"]), -(r["v"] - one[0]["v"]), 0.0]
        assert np.allclose(phi.loc[r["id"], X].to_numpy(), want)
    wide = ex.explain(rows, "id", trained.fitted["Rbf"], n_perm=4)
    total = wide.groupBy("id").agg((F.sum("phi") + F.first("base_value")).alias("z"))
    scored = trained.fitted["Rbf"].model.predict(rows)
    assert total.join(scored, "id").agg(F.max(F.abs(F.col("z") - F.col("probability")))).first()[0] < 1e-9
    near = ex.explain(rows.limit(2), "id", trained.fitted["Knn"], n_perm=2)
    assert near.count() == 6 and near.where("phi IS NULL").count() == 0


def test_top_and_global(spark):
    rows = [(1, "a", 0.1), (1, "b", -0.5), (1, "c", 0.5), (2, "a", -0.2), (2, "b", 0.0), (2, "c", 0.1)]
    df = spark.createDataFrame(rows, "id int, feature string, phi double")
    top = ex.top_contributions(df, "id", 2).orderBy("id", "rank").collect()
    assert [(r.id, r.feature, r.direction, r.text) for r in top] == [
        (1, "b", "lowers", "-0.500"), (1, "c", "raises", "+0.500"), (2, "a", "lowers", "-0.200"), (2, "c", "raises", "+0.100")
    ]
    assert [r.feature for r in ex.global_importance(df).collect()] == ["c", "b", "a"]


@pytest.mark.parametrize("name", ["Logistic Regression", "Forest", "Tree", "Boosted", "Rbf", "Knn"])
def test_save_and_load(spark, ring, trained, name, tmp_path):
    f = trained.fitted[name]
    path = str(tmp_path / "model")
    assert load_fitted(spark, path) is None
    save_fitted(f, path)
    again = load_fitted(spark, path)
    assert again.features == X and again.spec == f.spec
    test = ring[2].drop("y")
    a = score(test, f).select("id", "probability", "risk")
    b = score(test, again).select("id", F.col("probability").alias("p2"), F.col("risk").alias("r2"))
    assert a.join(b, "id").where("abs(probability - p2) > 1e-12 OR risk <> r2").count() == 0
    assert a.count() == test.count()
    if name == "Rbf":
        assert again.background.count() == 50
        few = scaled_test(ring, trained).orderBy("id").limit(2)
        assert ex.explain(few, "id", again, n_perm=2).count() == 6


def test_save_and_load_results(spark, trained, tmp_path):
    path = str(tmp_path / "results")
    assert [t.count() for t in load_results(spark, path)] == [0, 0]
    metrics = trained.metrics("y")
    save_results(metrics, trained.roc("y"), path)
    got, roc = load_results(spark, path)
    assert got.count() == 6 and ev.with_curve(got, roc).count() == 6


def test_bounded_rows_keep_the_tables_order_and_are_read_by_many_tasks(spark):
    from pyspark.sql import functions as F

    from riskloom.operators.models import bounded_rows
    from riskloom.operators.split import first_rows

    rows = spark.range(4_000, numPartitions=8).select(F.col("id").alias("k"), (F.col("id") % 3 == 0).cast("int").alias("y"))
    few = bounded_rows(rows, "y", "k", 200, 42)
    assert few.rdd.getNumPartitions() == 1 and "Coalesce" not in few._jdf.queryExecution().executedPlan().toString()
    assert [r["k"] for r in few.collect()] == [r["k"] for r in first_rows(rows, "y", ["k"], 200, 42).coalesce(1).collect()]

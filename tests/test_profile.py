import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskloom.operators import profile as pr


@pytest.fixture(scope="module")
def gaps(spark):
    rng = np.random.default_rng(5)
    n = 400
    pdf = pd.DataFrame({"a": rng.normal(size=n), "b": rng.integers(0, 9, n).astype(float), "flat": 2.0})
    pdf["c"] = pdf["a"] * 2 + rng.normal(size=n)
    pdf.loc[rng.random(n) < 0.2, "b"] = np.nan
    pdf.loc[rng.random(n) < 0.1, "c"] = np.nan
    pdf["y"] = (rng.random(n) < 0.4).astype(int)
    return pdf, spark.createDataFrame(pdf)


def test_correlation_equals_pandas(gaps):
    pdf, df = gaps
    pdf = pdf.assign(far=pdf["a"] + 1e6, third=1 / 3)
    df = df.withColumns({"far": F.col("a") + 1e6, "third": F.lit(1 / 3)})
    want = pdf.corr()
    for cols in (["a", "b", "c", "flat", "third", "far", "y"], ["a", "flat", "third", "far", "y"]):
        got = {(r.a, r.b): r.r for r in pr.correlation_matrix(df, cols, places=9).collect()}
        assert len(got) == len(cols) ** 2
        for (a, b), r in got.items():
            assert (r is None) if {"flat", "third"} & {a, b} else r == pytest.approx(want.loc[a, b], abs=1e-7)
    assert all(r.r is None for r in pr.correlation_matrix(df.limit(0), ["a", "y"]).collect())


def test_target_correlation_is_sorted(gaps):
    rows = pr.target_correlation(gaps[1], "y").collect()
    rs = [r.r for r in rows if r.r is not None]
    assert rs == sorted(rs) and rows[-1].feature == "flat" and rows[-1].direction is None


def test_describe_equals_pandas(gaps):
    pdf, df = gaps
    want = pdf.describe()
    for r in pr.describe(df, ["a", "b", "c", "flat"], places=9).collect():
        w = want[r["feature"]]
        got = [r["count"], r["mean"], r["std"], r["min"], r["p25"], r["p50"], r["p75"], r["max"]]
        assert got == pytest.approx(w.tolist(), abs=1e-8)
    assert pr.describe(df, ["a"], exact=False).count() == 1


def test_histogram_keeps_every_row(gaps):
    pdf, df = gaps
    h = pr.histogram_all(df, ["a", "b", "flat"], "y", 20).toPandas()
    assert h.groupby("feature")["count"].sum().to_dict() == pdf[["a", "b", "flat"]].count().to_dict()
    assert (h[h.feature == "a"].groupby("y").size() == 20).all()
    assert (h[h.feature == "flat"].groupby("y").size() == 1).all()
    top = h[(h.feature == "b") & (h.bin == 19)]["count"].sum()
    assert top == (pdf["b"] > 8 - 8 / 20).sum()
    nice = pr.histogram(df, "a", "y", 25, edges="nice").toPandas()
    assert nice["count"].sum() == 400 and nice["bin"].max() < 25
    assert nice["lo"].min() <= pdf["a"].min() and nice["hi"].max() >= pdf["a"].max()


def test_box_and_outliers(gaps):
    pdf, df = gaps
    df = df.withColumn("id", F.monotonically_increasing_id())
    box = {(r.feature, r.y): r for r in pr.box_stats(df, ["a", "c"], "y", limit=30).collect()}
    far = pr.outliers(df, ["id"], ["a", "c"], "y").toPandas()
    for (f, y), r in box.items():
        x = pdf.loc[pdf.y == y, f].dropna()
        q1, q3 = x.quantile(0.25), x.quantile(0.75)
        inside = x[(x >= q1 - 1.5 * (q3 - q1)) & (x <= q3 + 1.5 * (q3 - q1))]
        assert (r.q1, r.q3, r.whisker_lo, r.whisker_hi) == pytest.approx((q1, q3, inside.min(), inside.max()))
        assert r.n == len(x) and r.sd == pytest.approx(x.std(ddof=0))
        assert len(far[(far.feature == f) & (far.y == y)]) == len(x) - len(inside)


def test_density_integrates_to_one(gaps):
    pdf, df = gaps
    for col in ("a", "b"):
        d = pr.density(df, col, "y", 200).toPandas().sort_values("x")
        for y, part in d.groupby("y"):
            x = pdf.loc[pdf.y == y, col].dropna().to_numpy()
            h = 1.059 * min(x.std(ddof=1), (np.quantile(x, 0.75) - np.quantile(x, 0.25)) / 1.349) * len(x) ** -0.2
            want = np.exp(-0.5 * ((part.x.to_numpy()[:, None] - x) / h) ** 2).sum(1) / (len(x) * h * np.sqrt(2 * np.pi))
            assert np.allclose(part.density, want)


def test_quality_of_empty_table(spark):
    df = spark.createDataFrame([], "a double, y int")
    report = pr.quality_report(df, "y")
    assert tuple(report.summary.first()) == (0, 2, 0, 0)
    assert all(r.missing_pct is None for r in report.columns.collect())
    assert report.classes.count() == 0
    assert pr.class_distribution(df, "absent").count() == 0
    assert pr.histogram(df, "a", "y").count() == 0 and pr.density(df, "a", "y").count() == 0
    assert tuple(pr.dataset_card(df, "y").first())[0] == 0
    assert pr.describe(df, ["a"]).first()["count"] == 0


def test_missing_summary(gaps):
    pdf, df = gaps
    rows = pr.missing_summary(df, {"b": "Bee"}, only_missing=True).collect()
    assert [r.feature for r in rows] == ["Bee", "c"]
    assert rows[0].missing_pct == round(pdf["b"].isna().mean() * 100, 2)
    assert pr.quality_summary(df.unionByName(df)).first().duplicates == len(pdf)


def test_card_cuts_the_share(spark):
    df = spark.createDataFrame([(1,)] * 2 + [(0,)], "y int")
    assert tuple(pr.dataset_card(df, "y").first()) == (3, 0, 66, 34)

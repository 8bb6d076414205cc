import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from riskloom.operators import quantiles as qt
from riskloom.operators.running import running_totals


def hot_values(n=3000, seed=1):
    """A third of the rows hold one value; the rest are spread and repeated."""
    rng = np.random.default_rng(seed)
    x = np.where(rng.random(n) < 0.34, 5.0, rng.gamma(2.0, 4.0, n).round(2))
    x[rng.random(n) < 0.05] = np.nan
    return pd.DataFrame({"g": np.where(rng.random(n) < 0.8, "a", "b"), "x": x, "y": rng.integers(0, 4, n).astype(float)})


def test_percentiles_equal_pandas_on_both_ways(spark):
    pdf = hot_values()
    df = spark.createDataFrame(pdf)
    probs = [0.0, 0.25, 0.333, 0.5, 0.75, 0.9, 1.0]
    want = {(g, c): part[c].quantile(probs).to_numpy() for g, part in pdf.groupby("g") for c in ("x", "y")}
    for limit in (10, 10**6):
        rows = qt.exact_percentiles(df, ["x", "y"], probs, ["g"], limit=limit).collect()
        got = {(r["g"], r["feature"]): np.array(r["q"]) for r in rows}
        assert got.keys() == want.keys()
        for k in want:
            assert np.allclose(got[k], want[k], rtol=1e-12, atol=1e-12), (limit, k)


def test_every_pair_of_neighbours(spark):
    """Each percentile falls between two ranks; many of the pairs cross the end of a run of ties."""
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame({"x": np.where(rng.random(120) < 0.5, rng.integers(0, 6, 120), rng.random(120) * 6)})
    probs = [(i + 0.5) / 119 for i in range(0, 119, 2)]
    row = qt.exact_percentiles(spark.createDataFrame(pdf), ["x"], probs, limit=1).first()
    assert np.allclose(row["q"], pdf["x"].quantile(probs), rtol=1e-12)


def test_small_and_large_groups_together(spark):
    pdf = hot_values(800, 2)
    rows = qt.exact_percentiles(spark.createDataFrame(pdf), ["x"], [0.5], ["g"], limit=300).collect()
    want = pdf.groupby("g")["x"].median().to_dict()
    assert {r["g"]: r["q"][0] for r in rows} == want


def test_median_without_group(spark):
    pdf = hot_values(500, 3)
    df = spark.createDataFrame(pdf)
    assert qt.exact_medians(df, ["x"], limit=20) == {"x": pdf["x"].median()}
    empty = spark.createDataFrame([], "x double")
    assert qt.exact_medians(empty, ["x"]) == {"x": None}


def test_modes(spark):
    df = spark.createDataFrame(
        [(1, "b", None), (1, "a", None), (2, "a", None), (2, "b", None), (None, None, None)], "i int, s string, e int"
    )
    assert qt.modes(df, ["i", "s", "e"]) == {"i": 1, "s": "a", "e": None}


def test_running_totals_over_many_buckets(spark):
    pdf = hot_values(1500, 4).dropna()
    df = spark.createDataFrame(pdf)
    for descending in (False, True):
        got = (
            running_totals(df, ["g"], "x", {"n": F.lit(1)}, descending=descending, buckets=37)
            .toPandas().sort_values(["g", "x"], ascending=[True, not descending]).reset_index(drop=True)
        )
        want = pdf.groupby(["g", "x"]).size().reset_index(name="n")
        want = want.sort_values(["g", "x"], ascending=[True, not descending]).reset_index(drop=True)
        by = want.groupby("g")["n"]
        assert (got["n"] == want["n"]).all()
        assert (got["run_n"] == by.cumsum()).all()
        assert (got["all_n"] == by.transform("sum")).all()
        assert got["next_n"].fillna(-1).tolist() == by.shift(-1).fillna(-1).tolist()


def test_all_doubles_nulls_and_null_groups(spark):
    rng = np.random.default_rng(8)
    x = np.concatenate([
        rng.standard_normal(300), 10.0 ** rng.uniform(-300, 300, 300) * rng.choice([-1, 1], 300),
        [5e-324, -5e-324, 2.2250738585072014e-308, 1.7976931348623157e308, -1.7976931348623157e308, 0.0, -0.0, 0.1, 0.1, np.nextafter(0.1, 1)],
    ])
    rows = [(None if i % 3 == 0 else "g", float(v)) for i, v in enumerate(x)] + [("g", None), (None, float("nan")), ("empty", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    probs = [0.0, 0.1, 0.5, 0.501, 0.9, 1.0]
    got = {r["g"]: r["q"] for r in qt.exact_percentiles(df, ["x"], probs, ["g"]).collect()}
    assert got["empty"] is None and got.keys() == {None, "g", "empty"}
    for g in (None, "g"):
        want = np.sort([v for h, v in rows if h == g and v is not None and v == v])
        for p, q in zip(probs, got[g]):
            at = p * (len(want) - 1)
            a, b = want[int(np.floor(at))], want[int(np.ceil(at))]
            assert q == (a if a == b else a * (1 - (at - np.floor(at))) + b * (at - np.floor(at)))
    ends = qt.exact_percentiles(spark.createDataFrame([(float(v),) for v in ("-inf", "inf", "1", "2", "1.7976931348623157e308")], "x double"), ["x"], [0.0, 0.25, 0.75, 1.0])
    assert ends.first()["q"] == [float("-inf"), 1.0, 1.7976931348623157e308, float("inf")]


def test_many_groups_take_no_more_jobs(spark):
    rng = np.random.default_rng(9)
    sc, jobs = spark.sparkContext, {}
    for groups in (20, 300):
        pdf = pd.DataFrame({"g": np.arange(12_000) % groups, "x": rng.gamma(2.0, 300.0, 12_000).round(2)})
        df = spark.createDataFrame(pdf)
        sc.setJobGroup(f"cells-{groups}", "percentiles")
        rows = qt.exact_percentiles(df, ["x"], [0.25, 0.5, 0.75], ["g"]).collect()
        jobs[groups] = len(sc.statusTracker().getJobIdsForGroup(f"cells-{groups}"))
        sc.setLocalProperty("spark.jobGroup.id", None)
        want = pdf.groupby("g")["x"].quantile([0.25, 0.5, 0.75]).unstack().to_numpy()
        assert np.allclose([r["q"] for r in sorted(rows, key=lambda r: r["g"])], want, rtol=1e-12)
    assert jobs[300] <= jobs[20] + 2


def test_more_ranges_than_are_sent(spark, monkeypatch):
    monkeypatch.setattr(qt, "SENT_RANGES", 3)
    pdf = hot_values(1200, 5)
    got = qt.exact_percentiles(spark.createDataFrame(pdf), ["x", "y"], [0.25, 0.5], ["g"], limit=40).collect()
    for r in got:
        assert np.allclose(r["q"], pdf[pdf.g == r["g"]][r["feature"]].quantile([0.25, 0.5]), rtol=1e-12)

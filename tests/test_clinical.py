import numpy as np
import pandas as pd
import pytest

from riskloom import config
from riskloom.operators.models import ModelSpec, spec_of
from riskloom.plans import clinical
from riskloom.sources.tables import Source, read_first_available


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    """A headerless text table as published: numbers, '?' for missing, and a severity of 0 to 4."""
    rng = np.random.default_rng(9)
    n = 260
    pdf = pd.DataFrame({
        "age": rng.integers(30, 75, n), "sex": rng.integers(0, 2, n), "cp": rng.integers(0, 4, n),
        "trestbps": rng.integers(95, 190, n), "chol": rng.integers(130, 400, n), "fbs": rng.integers(0, 2, n),
        "restecg": rng.integers(0, 3, n), "thalach": rng.integers(90, 200, n), "exang": rng.integers(0, 2, n),
        "oldpeak": rng.uniform(0, 5, n).round(1), "slope": rng.integers(0, 3, n),
        "ca": rng.integers(0, 4, n), "thal": rng.integers(1, 4, n),
    }).astype(object)
    risk = (pdf.age.astype(float) - 50) / 10 + pdf.cp.astype(float) - 1.5 + rng.normal(size=n)
    pdf["target"] = np.clip(np.ceil(risk.to_numpy()), 0, 4).astype(int)
    pdf.loc[rng.random(n) < 0.05, "slope"] = "?"
    pdf.loc[rng.random(n) < 0.10, "ca"] = "?"
    pdf.loc[rng.random(n) < 0.40, "thal"] = "?"
    path = tmp_path_factory.mktemp("in") / "processed.data"
    pd.concat([pdf, pdf.head(5)]).to_csv(path, header=False, index=False)
    df, _ = read_first_available(spark, [Source(str(path), columns=config.RAW_COLUMNS, binarise="target")])
    return df


def test_explore(table):
    out = clinical.explore(table)
    assert out["quality"].first().total_rows == 265 and out["quality"].first().duplicates == 5
    assert out["columns"].count() == 14 and out["preview"].columns[0] == "Age"
    assert out["correlations"].count() == 14 * 14
    assert {r.sex for r in out["sex_counts"].collect()} == {"Female", "Male"}
    assert out["boxes"].count() == 26


def test_train_save_assess(spark, table, tmp_path):
    tree = ModelSpec("Decision Tree", "tree", "tree", {"depth": 3})
    done = clinical.train(table, [spec_of("logistic"), tree])
    assert done.cleaned.features == [*config.CORE_FEATURES, "ca"]
    assert done.cleaned.df.count() == 260
    assert done.trained.predictions.count() == 2 * 52
    board = done.leaderboard.collect()
    assert board[0].model == done.best.spec.name and board[0].roc_auc > 0.75
    tables = clinical.deep_dive(done)
    assert {m: n for m, n in tables["confusion"].groupBy("model").sum("count").collect()} == {m: 52 for m in done.trained.fitted}
    assert tables["roc"].select("model").distinct().count() == tables["importances"].select("model").distinct().count() == 2
    assert tables["metrics"].count() == 10 and tables["status"].where("status = 'ok'").count() == 2
    path = str(tmp_path / "saved")
    with pytest.raises(ValueError, match="train and save"):
        clinical.assess(spark, table, path, "id")
    clinical.save(done, path)
    records = spark.createDataFrame(
        [(1, *[float(config.DOMAINS[c].default) for c in config.CORE_FEATURES]),
         (2, *[float(config.DOMAINS[c].high or 1) for c in config.CORE_FEATURES]),
         (3, 19.0, *[1.0 for _ in config.CORE_FEATURES[1:]])],
        "id int, " + ", ".join(f"{c} double" for c in config.CORE_FEATURES),
    )
    got = clinical.assess(spark, records, path, "id", "2024-03-05 14:07:09")
    scored = {r.id: r for r in got.scored.collect()}
    assert scored[1].n_defaulted == 1 and scored[1].ca == 0.0 and scored[2].risk in ("Low", "Moderate", "High")
    assert {r.feature for r in got.violations.where("id = 3").collect()} >= {"age", "trestbps", "chol", "thalach"}
    assert got.violations.where("id = 1").count() == 0
    assert got.contributions.groupBy("id").count().where("count = 10").count() == 3
    report = got.report.where("id = 1").collect()
    assert [r.position for r in report] == list(range(1, len(report) + 1))
    assert {r.section for r in report} == {"header", "summary", "input", "metrics"}

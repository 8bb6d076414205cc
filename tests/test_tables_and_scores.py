import datetime

import pytest
from pyspark.sql import functions as F

from riskloom import config
from riskloom.operators import score as sc
from riskloom.operators.models import Fitted, LinearScore, ModelSpec, fit_model, spec_of
from riskloom.operators.report import report_file_name, report_rows
from riskloom.operators.scale import fit_scaler
from riskloom.sources import tables as tb
from riskloom.streaming.score import score_stream, write_scores


def test_headerless_text(spark, tmp_path):
    path = tmp_path / "raw.data"
    path.write_text("63.0,1.0,?,2\n 41 ,,5d,0\nabc,NA,3.5,?\n")
    raw = tb.read_text_table(spark, str(path), ["age", "sex", "ca", "target"])
    assert [tuple(r) for r in raw.collect()][0] == ("63.0", "1.0", None, "2")
    assert tb.malformed_counts(raw).first().asDict() == {"age": 1, "sex": 0, "ca": 1, "target": 0}
    df = tb.read_table(spark, str(path), ["age", "sex", "ca", "target"])
    assert [tuple(r) for r in df.collect()] == [(63.0, 1.0, None, 2.0), (41.0, None, None, 0.0), (None, None, 3.5, None)]
    with pytest.raises(ValueError, match="name the columns"):
        tb.read_table(spark, str(path))


def test_header_is_normalised(spark, tmp_path):
    path = tmp_path / "mirror.csv"
    path.write_text(" Age ,CONDITION\n50,1\n")
    df = tb.read_table(spark, str(path), header=True, renames={"condition": "target"})
    assert df.columns == ["age", "target"] and df.first().target == 1.0
    path.write_text("age,condition,target\n50,1,0\n")
    with pytest.raises(ValueError, match="both"):
        tb.read_table(spark, str(path), header=True, renames={"condition": "target"})


def test_first_available(spark, tmp_path):
    cached, primary, mirror = (str(tmp_path / n) for n in ("cached", "primary.data", "mirror.csv"))
    sources = [
        tb.Source(cached, "parquet"),
        tb.Source(primary, columns=["age", "target"], binarise="target"),
        tb.Source(mirror, header=True, renames={"condition": "target"}),
    ]
    with pytest.raises(RuntimeError, match="cached"):
        tb.read_first_available(spark, sources)
    (tmp_path / "mirror.csv").write_text("Age,Condition\n50,1\n")
    df, used = tb.read_first_available(spark, sources)
    assert used.path == mirror and df.columns == ["age", "target"]
    (tmp_path / "primary.data").write_text("63,3\n64,0\n65,?\n")
    df, used = tb.read_first_available(spark, sources)
    assert used.path == primary and [r.target for r in df.orderBy("age").collect()] == [1, 0, 0]
    tb.write_table(df, cached)
    df, used = tb.read_first_available(spark, sources)
    assert used.path == cached and df.count() == 3
    tb.write_table(df, str(tmp_path / "text"), "csv")
    assert tb.read_table(spark, str(tmp_path / "text"), header=True).count() == 3


def test_bands(spark):
    df = spark.createDataFrame([(p,) for p in (0.3499, 0.35, 0.6499, 0.65, None, float("nan"))], "p double")
    assert [r.risk for r in sc.risk_band(df, "p").collect()] == ["Low", "Moderate", "Moderate", "High", None, None]
    g = sc.gauge(df.limit(2), "p").collect()
    assert [r.gauge_band for r in g] == ["Low", "Low"] and g[1].gauge_delta == pytest.approx(-15)


def records(spark):
    rows = [(i, float(i % 7), float(i % 11)) for i in range(200)]
    return spark.createDataFrame(rows, "id int, age double, chol double")


def fitted(spark):
    features = ["age", "chol", "ca"]
    scaler = fit_scaler(records(spark).withColumn("ca", F.lit(1.0)), features)
    return Fitted(spec_of("logistic"), LinearScore(features, [1.5, -2.0, 0.1], 0.2), scaler, features)


def test_stream_equals_batch(spark, tmp_path):
    df, f = records(spark), fitted(spark)
    source = str(tmp_path / "in")
    df.repartition(4).write.parquet(source)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source)
    out = str(tmp_path / "out")
    write_scores(score_stream(stream, f, {"ca": 1.0}), out, str(tmp_path / "state")).awaitTermination(120)
    got, want = spark.read.parquet(out), sc.score(df, f, {"ca": 1.0})
    assert got.columns == want.columns
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    knn = Fitted(spec_of("knn"), None, f.scaler, f.features)
    with pytest.raises(ValueError, match="foreachBatch"):
        score_stream(stream, knn)


def test_score_keeps_raw_values(spark):
    row = sc.score(records(spark).where("id = 5"), fitted(spark)).first()
    assert (row.age, row.chol, row.ca, row.n_defaulted) == (5.0, 5.0, 0.0, 1)
    assert row.confidence == max(row.probability, 1 - row.probability)
    assert row.diagnosis == ("Positive" if row.prediction == 1 else "Negative")


def test_gap_has_no_score(spark, ring_free_model):
    df = spark.createDataFrame([(1, 2.0, 3.0), (2, None, 3.0), (3, float("nan"), 3.0)], "id int, age double, chol double")
    for f in (fitted(spark), ring_free_model):
        rows = {r.id: r for r in sc.score(df, f).collect()}
        assert rows[1].probability is not None and rows[2].chol == 3.0
        for i in (2, 3):
            assert (rows[i].probability, rows[i].prediction, rows[i].risk, rows[i].diagnosis) == (None,) * 4


@pytest.fixture
def ring_free_model(spark):
    train = records(spark).withColumn("y", (F.col("age") > 3).cast("int")).withColumn("ca", F.lit(0.0))
    scaler = fit_scaler(train, ["age", "chol", "ca"])
    model = fit_model(ModelSpec("Tree", "tree", "tree", {"depth": 2}), train, ["age", "chol", "ca"], "y", "id")
    return Fitted(spec_of("tree"), model, scaler, ["age", "chol", "ca"])


def test_report(spark):
    scored = spark.createDataFrame(
        [(7, 54.0, 0.3455, 0, 0.6545, "Negative", "Low")],
        "id int, st_x double, probability double, prediction int, confidence double, diagnosis string, risk string",
    )
    m = spark.createDataFrame([(0.9, 0.8, 0.7, 0.75, None)], "accuracy double, precision double, recall double, f1 double, roc_auc double")
    at = "2024-03-05 14:07:09"
    rows = {(r.section, r.label): r.value for r in report_rows(scored, "id", ["st_x"], "M", {}, m, at).collect()}
    when = datetime.datetime(2024, 3, 5, 14, 7, 9)
    assert rows["header", "Generated on"] == when.strftime("%B %d, %Y at %H:%M")
    assert rows["header", "Report ID"] == when.strftime("%Y%m%d%H%M%S") + "-7"
    assert rows["summary", "PROBABILITY"] == f"{0.3455 * 100:.1f}%"
    assert rows["input", "St_X"] == "54.0" and rows["metrics", "F1 Score"] == "0.7500" and rows["metrics", "ROC-AUC"] == "None"
    assert spark.range(1).select(report_file_name("id", at)).first()[0] == "risk_report_20240305_140709_0"


def test_every_default_feature_is_known():
    assert set(config.DOMAINS) == set(config.CORE_FEATURES)
    assert [*config.CORE_FEATURES, *config.SPARSE_CANDIDATES, config.LABEL] == config.RAW_COLUMNS

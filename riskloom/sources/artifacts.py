"""Saving and loading fitted models and evaluation results."""

from __future__ import annotations

from pyspark.ml.classification import (
    DecisionTreeClassificationModel,
    GBTClassificationModel,
    LogisticRegressionModel,
    RandomForestClassificationModel,
)
from pyspark.sql import DataFrame, SparkSession

from riskloom.operators.explain import summary_of
from riskloom.operators.models import Fitted, KnnModel, ModelSpec, RbfModel, SparkModel
from riskloom.sources import versions

LOADERS = {
    "logistic": LogisticRegressionModel,
    "forest": RandomForestClassificationModel,
    "tree": DecisionTreeClassificationModel,
    "gbt": GBTClassificationModel,
}
METRICS_SCHEMA = "model string, accuracy double, precision double, recall double, f1 double, roc_auc double"
ROC_SCHEMA = "model string, threshold double, fpr double, tpr double"
NOTES_SCHEMA = "model string, explains string, auc double"


def save_fitted(fitted: Fitted, path: str) -> None:
    """Model, scaler and columns as a new version; until it is whole, readers get the former one.

    A model whose scores are attributed by sampling also keeps the summary of its training rows.
    """
    spark, folder, parts = fitted.scaler.sparkSession, versions.new_folder(path), ["scaler"]
    fitted.scaler.write.parquet(f"{folder}/scaler")
    summarised = fitted.spec.explains == "sampled" and fitted.background is not None
    if summarised:
        summary_of(fitted).write.parquet(f"{folder}/background")
        parts.append("background")
    m, meta = fitted.model, {
        "name": fitted.spec.name, "kind": fitted.spec.kind, "explains": fitted.spec.explains,
        "params": fitted.spec.params, "features": fitted.features, "background": summarised, "note": getattr(fitted.model, "note", ""),
    }
    if isinstance(m, KnnModel):
        m.train.write.parquet(f"{folder}/train")
        parts.append("train")
        meta |= {"label": m.label, "row_id": m.row_id, "k": m.k}
    elif isinstance(m, RbfModel):
        rows = [(p.tolist(), float(a)) for p, a in zip(m.places, m.alpha)]
        spark.createDataFrame(rows, "place array<double>, weight double").write.parquet(f"{folder}/landmarks")
        parts.append("landmarks")
        meta |= {"gamma": m.gamma, "shift": m.shift, "curve": m.curve}
    else:
        m.model.save(f"{folder}/model")
        parts.append("model")
    versions.publish(spark, path, folder, parts, meta)


def load_fitted(spark: SparkSession, path: str) -> Fitted | None:
    """The saved model of the last whole version, or None."""
    found = versions.current(spark, path)
    if found is None:
        return None
    meta, folder = found
    features = meta["features"]
    if meta["kind"] == "knn":
        model = KnnModel(spark.read.parquet(f"{folder}/train"), features, meta["label"], meta["row_id"], meta["k"])
    elif meta["kind"] == "rbf_svc":
        # As many rows as landmarks.
        rows = spark.read.parquet(f"{folder}/landmarks").collect()
        model = RbfModel([r["place"] for r in rows], [r["weight"] for r in rows], meta["shift"], meta["curve"], features, meta["gamma"])
    else:
        model = SparkModel(LOADERS[meta["kind"]].load(f"{folder}/model"), features)
    if meta["note"]:
        model.note = meta["note"]
    spec = ModelSpec(meta["name"], meta["kind"], meta["explains"], meta["params"])
    background = spark.read.parquet(f"{folder}/background") if meta["background"] else None
    return Fitted(spec, model, spark.read.parquet(f"{folder}/scaler"), features, background)


class ModelStore:
    """Fitted models and their held-out predictions by key, so that a training that stopped goes on where it was."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def load(self, key: str) -> tuple[Fitted, DataFrame] | None:
        fitted, scores = load_fitted(self.spark, f"{self.path}/{key}/model"), versions.current(self.spark, f"{self.path}/{key}/scores")
        return (fitted, self.spark.read.parquet(f"{scores[1]}/rows")) if fitted and scores else None

    def save(self, key: str, fitted: Fitted, scores: DataFrame) -> DataFrame:
        """The predictions as stored. They are written behind the model, so that a key is found only with both."""
        save_fitted(fitted, f"{self.path}/{key}/model")
        folder = versions.new_folder(f"{self.path}/{key}/scores")
        scores.write.parquet(f"{folder}/rows")
        versions.publish(self.spark, f"{self.path}/{key}/scores", folder, ["rows"], {})
        return self.spark.read.parquet(f"{folder}/rows")


def save_results(metrics: DataFrame, roc: DataFrame, path: str, notes: DataFrame | None = None) -> None:
    """Metrics, curve points and, per model, its kind of explanation and unrounded AUC, as a new version; predictions are not kept."""
    spark, folder = metrics.sparkSession, versions.new_folder(path)
    notes = spark.createDataFrame([], NOTES_SCHEMA) if notes is None else notes
    for part, df in (("metrics", metrics), ("roc", roc), ("notes", notes)):
        df.write.parquet(f"{folder}/{part}")
    versions.publish(spark, path, folder, ["metrics", "roc", "notes"], {})


def _result(spark: SparkSession, path: str, part: str, schema: str) -> DataFrame:
    found = versions.current(spark, path)
    return spark.read.parquet(f"{found[1]}/{part}") if found else spark.createDataFrame([], schema)


def load_results(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Metrics and curve points of the last whole version; empty ones when there is none."""
    return _result(spark, path, "metrics", METRICS_SCHEMA), _result(spark, path, "roc", ROC_SCHEMA)


def load_notes(spark: SparkSession, path: str) -> DataFrame:
    """(model, explains, auc) of the last whole version."""
    return _result(spark, path, "notes", NOTES_SCHEMA)

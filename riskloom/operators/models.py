"""Classifiers: registry, training, held-out predictions, importances."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.columns import require_columns
from riskloom.functions.session import Kept, cut_lineage, reuse
from riskloom.operators import kernel
from riskloom.operators.evaluate import classification_metrics, roc_auc, roc_curve
from riskloom.operators.knn import QUERY_SLICE, NeighbourIndex, share_of_positive, vector_of
from riskloom.operators.scale import apply_scaler, fit_scaler
from riskloom.operators.split import first_rows

FEATURES = "_features"
# Split candidates per column of every tree model: no fewer than any code column has values.
BINS = 256


@dataclass(frozen=True)
class ModelSpec:
    """A classifier by kind; `explains` names how its scores are attributed to features.

    Parameters beside the fixed ones: `bins`, the split candidates of a column in trees, forests and boosting;
    `fit_rows`, how many labelled rows a fit may use (by default all): the first of each class by the hash of the row id.
    """

    name: str
    kind: str
    explains: str
    params: dict = field(default_factory=dict)


# The models, their order and settings.
REGISTRY = [
    ModelSpec("Logistic Regression", "logistic", "linear", {"max_iter": 1000, "C": 1.0}),
    ModelSpec("Random Forest", "forest", "tree", {"trees": 200, "depth": 30}),
    ModelSpec("Decision Tree", "tree", "tree", {"depth": 8}),
    ModelSpec("K-Nearest Neighbors", "knn", "sampled", {"k": 7}),
    ModelSpec("Support Vector Machine", "rbf_svc", "sampled", {"C": 1.0, "landmarks": 128, "max_iter": 100}),
    ModelSpec("Gradient Boosting", "gbt", "tree", {"rounds": 200, "rate": 0.05, "depth": 6}),
]
ORDER = [m.name for m in REGISTRY]


def spec_of(kind: str) -> ModelSpec:
    found = [m for m in REGISTRY if m.kind == kind]
    if not found:
        raise ValueError(f"unknown model kind: {kind}; known: {', '.join(m.kind for m in REGISTRY)}")
    return found[0]


def assembled(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol=FEATURES, handleInvalid="error").transform(df)


class SparkModel:
    """A fitted Spark classifier on named columns."""

    def __init__(self, model, features: Sequence[str]):
        self.model, self.features = model, list(features)

    def predict(self, df: DataFrame) -> DataFrame:
        scored = self.model.transform(assembled(df, self.features))
        return scored.withColumns(
            {"probability": vector_to_array("probability")[1], "prediction": F.col("prediction").cast("int")}
        ).drop(FEATURES, "rawPrediction")


class LinearScore:
    """A logistic model as one column expression: nothing to assemble, and any table or stream will do."""

    def __init__(self, features: Sequence[str], weights: Sequence[float], intercept: float):
        self.features, self.intercept = list(features), float(intercept)
        self.weights = [float(w) for w in weights]

    @classmethod
    def of(cls, fitted: SparkModel) -> LinearScore:
        return cls(fitted.features, fitted.model.coefficients.toArray(), fitted.model.intercept)

    def predict(self, df: DataFrame) -> DataFrame:
        z = F.lit(self.intercept)
        for c, w in zip(self.features, self.weights):
            z = z + F.col(c) * F.lit(w)
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(-z))
        return df.withColumn("probability", p).withColumn("prediction", (F.col("probability") > 0.5).cast("int"))


class RbfModel:
    """Gaussian-kernel margins as a weighted sum over landmarks, with a logistic curve on them. It holds numbers only."""

    def __init__(self, places, alpha, shift: float, curve: Sequence[float], features: Sequence[str], gamma: float):
        self.places, self.alpha, self.shift = np.asarray(places, dtype=float), np.asarray(alpha, dtype=float), float(shift)
        self.curve, self.features, self.gamma = [float(c) for c in curve], list(features), float(gamma)

    def predict(self, df: DataFrame) -> DataFrame:
        x = F.array(*[F.col(c).cast("double") for c in self.features])
        scored = df.withColumn("_margin", kernel.margin_at(x, self.places, self.alpha, self.shift, self.gamma))
        slope, level = self.curve
        chance = F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.col("_margin") * slope + level)))
        return scored.withColumns({"probability": chance, "prediction": (F.col("_margin") > 0).cast("int")}).drop("_margin")

    def walk_gains(self, points: np.ndarray, turns: np.ndarray):
        """The gains of all walks of a row in one column; see `kernel.walk_gains`."""
        x = F.array(*[F.col(c).cast("double") for c in self.features])
        return kernel.walk_gains(x, points, turns, self.places, self.alpha, self.shift, self.gamma, self.curve)


class KnnModel:
    """The training rows and their partition tree, which is built at the first use and serves every later one."""

    def __init__(self, train: DataFrame, features: Sequence[str], label: str, row_id: str, k: int):
        self.train = train.select(row_id, label, *features)
        self.features, self.label, self.row_id, self.k = list(features), label, row_id, k
        self._index = None

    def index(self) -> NeighbourIndex:
        if self._index is None:
            self._index = NeighbourIndex.build(self.train, vector_of(self.features), self.label, self.row_id, self.k)
        return self._index

    def predict(self, df: DataFrame, query_id: str | None = None) -> DataFrame:
        """A score depends on the features alone: each different vector is asked once, whatever ids the rows have."""
        # 128 bits of a digest name a vector.
        asked = df.withColumn("_vector", F.unhex(F.md5(F.to_json(F.struct(*self.features)))))
        vectors = Kept(asked.select("_vector", *self.features).dropDuplicates(["_vector"]))
        slices = max(1, -(-vectors.df.count() // QUERY_SLICE))
        found = []
        # What a search lays on disk grows with its queries; it is removed before the next ones are asked.
        for i in range(slices):
            mine = vectors.df.where(F.pmod(F.xxhash64("_vector"), F.lit(slices)) == i)
            near, used = self.index().search_kept(mine, vector_of(self.features), "_vector", self.k)
            # Metrics and curves read the scores again; the neighbour join runs once.
            found.append(Kept(share_of_positive(near, "_vector")).df)
            for table in used:
                table.unpersist()
        vectors.unpersist()
        scores = reduce(DataFrame.unionByName, found)
        return asked.join(scores, "_vector").drop("_vector")


def _fit_rbf(train, features, label, row_id, n, params, seed, folds=3):
    """Margin classifier, and a curve on the margins of rows that a classifier has not seen.

    Folds follow from the row id, so that equal vectors fall into all of them. Where leaving out a fold leaves one class only,
    the curve is fitted on the margins of the whole fit.
    """
    gamma = params.get("gamma")
    if gamma is None:
        # 1 / (number of features * variance over all entries of the feature table).
        # Columns without gaps: the mean of their variances and the variance of their means.
        each = train.agg(*[f(c).alias(f"{n}{i}") for i, c in enumerate(features) for n, f in (("v", F.var_pop), ("m", F.avg))]).first()
        means = [each[f"m{i}"] or 0.0 for i in range(len(features))]
        middle = sum(means) / len(means)
        spread = sum((each[f"v{i}"] or 0.0) + (means[i] - middle) ** 2 for i in range(len(features))) / len(means)
        gamma = 1.0 / (len(features) * (spread or 1.0))
    x = F.array(*[F.col(c).cast("double") for c in features])
    kept = Kept(train.select(
        *features, (F.when(F.col(label) == 1, 1.0).otherwise(-1.0)).alias("_y"),
        F.pmod(F.xxhash64(F.lit(seed), F.col(row_id)), F.lit(folds)).cast("int").alias("_fold"), F.col(label).cast("double").alias(label),
        F.xxhash64(F.col(row_id)).alias("_key"),
    ))
    rows = kept.df.select("*", x.alias("_x"), array_to_vector(x).alias(FEATURES))
    marks = kernel.Landmarks.of(kernel.choose_landmarks(rows, features, FEATURES, params.get("landmarks", 128), seed), gamma)
    counted = {(r["_fold"], r[label]): r["n"] for r in rows.groupBy("_fold", label).agg(F.count("*").alias("n")).collect()}
    # The curve is fitted on margins of rows that the classifier has not seen.
    whole = any(len({y for (g, y) in counted if g != f}) < 2 for f in range(folds))
    left_out = [] if whole else list(range(folds))
    weights, settled = kernel.fit_from_start(
        rows.select("_x", "_y", "_fold", "_key"), "_key", n, marks, params.get("C", 1.0), params.get("max_iter", 100),
        params.get("tol", 1e-7), left_out,
    )
    parts = [(rows, weights[0])] if whole else [(rows.where(F.col("_fold") == f), weights[1 + f]) for f in range(folds)]
    unseen = None
    for part, w in parts:
        got = part.select(label, array_to_vector(F.array(kernel.margin_of(F.col("_x"), marks, w))).alias("_m"))
        unseen = got if unseen is None else unseen.unionByName(got)
    curve = LogisticRegression(featuresCol="_m", labelCol=label).fit(unseen)
    kept.unpersist()
    w = weights[0]
    model = RbfModel(marks.places, marks.lift @ w[:-1], w[-1], [curve.coefficients[0], curve.intercept], features, gamma)
    if not settled:
        model.note = f"stopped after {params.get('max_iter', 100)} steps, before its tolerance"
    return model


def make_classifier(kind: str, label: str, n_train: int, params: dict, seed: int):
    """The Spark estimator of a kind, with the settings that give the same objective.

    For the logistic model: the sum of losses weighted by C plus half the squared norm is, divided
    by C * n, the mean loss plus 1/(C * n) times that half.
    """
    common = {"featuresCol": FEATURES, "labelCol": label}
    if kind == "logistic":
        return LogisticRegression(
            **common, maxIter=params["max_iter"], elasticNetParam=0.0,
            regParam=1.0 / (params["C"] * n_train), standardization=False,
        )
    if kind == "forest":
        return RandomForestClassifier(
            **common, numTrees=params["trees"], maxDepth=params["depth"], featureSubsetStrategy="sqrt", seed=seed,
            maxMemoryInMB=params.get("memory", 1024), maxBins=params.get("bins", BINS),
        )
    if kind == "tree":
        return DecisionTreeClassifier(**common, maxDepth=params["depth"], maxBins=params.get("bins", BINS), seed=seed)
    if kind == "gbt":
        return GBTClassifier(
            **common, maxIter=params["rounds"], stepSize=params["rate"], maxDepth=params["depth"],
            lossType="logistic", maxBins=params.get("bins", BINS), seed=seed,
        )
    raise ValueError(f"no Spark estimator for {kind}")


def bounded_rows(train: DataFrame, label: str, row_id: str, bound: int, seed: int) -> DataFrame:
    """The rows of a bounded fit in few partitions and in the table's order. They are shuffled: merged partitions would have one
    task read the whole table."""
    few = first_rows(train, label, [row_id], bound, seed).withColumn("_at", F.monotonically_increasing_id())
    return few.repartitionByRange(1 + bound // 50_000, "_at").sortWithinPartitions("_at").drop("_at")


def fit_model(
    spec: ModelSpec, train: DataFrame, features: Sequence[str], label: str, row_id: str, seed: int = 42,
    n_train: int | None = None,
):
    """Fit one model on scaled training rows."""
    require_columns(train, label, row_id, *features)
    n = n_train if n_train is not None else train.count()
    if spec.kind == "knn":
        return KnnModel(train, features, label, row_id, spec.params["k"])
    if spec.kind == "rbf_svc":
        return _fit_rbf(train, features, label, row_id, n, spec.params, seed)
    bound = spec.params.get("fit_rows")
    if bound is not None and bound < n:
        train = reuse(bounded_rows(train, label, row_id, bound, seed))
    estimator = make_classifier(spec.kind, label, n if bound is None else min(n, bound), spec.params, seed)
    fitted = SparkModel(estimator.fit(assembled(train, features).select(label, FEATURES)), features)
    if bound is not None and bound < n:
        train.unpersist()
    return fitted


@dataclass
class Fitted:
    """Everything scoring needs: the model, its scaler, its columns."""

    spec: ModelSpec
    model: object
    scaler: DataFrame
    features: list[str]
    background: DataFrame | None = None


@dataclass
class Trained:
    fitted: dict[str, Fitted]
    predictions: DataFrame
    status: DataFrame
    order: list[str]
    _kept: Kept

    def unpersist(self) -> None:
        self._kept.unpersist()

    def metrics(self, label: str) -> DataFrame:
        return classification_metrics(self.predictions, label, "prediction", "probability", ["model"])

    def roc(self, label: str) -> DataFrame:
        return roc_curve(self.predictions, label, "probability", ["model"])

    def notes(self, label: str) -> DataFrame:
        """(model, explains, auc): how each model's scores are explained, and its AUC unrounded."""
        kinds = self.predictions.sparkSession.createDataFrame([(m, f.spec.explains) for m, f in self.fitted.items()], "model string, explains string")
        area = roc_auc(self.predictions, label, "probability", ["model"]).withColumnRenamed("roc_auc", "auc")
        return F.broadcast(kinds).join(area, "model", "left").select("model", "explains", "auc")


def table_digest(df: DataFrame) -> list:
    """Number of rows and two sums over hashes of the rows: the same for any order and partitioning, in one pass without a shuffle."""
    wide = lambda seed: F.xxhash64(F.lit(seed), *df.columns).cast("decimal(38,0)")
    row = df.agg(F.count("*").alias("n"), F.sum(wide(1)).alias("a"), F.sum(wide(2)).alias("b")).first()
    return [row["n"], str(row["a"]), str(row["b"])]


def digest_of(settings: list) -> str:
    return hashlib.sha256(json.dumps(settings, sort_keys=True, default=str).encode()).hexdigest()


def train_all(
    train: DataFrame,
    test: DataFrame,
    features: Sequence[str],
    label: str,
    row_id: str,
    models: Sequence[ModelSpec] = tuple(REGISTRY),
    seed: int = 42,
    store=None,
) -> Trained:
    """Scale, fit every model, and predict the held-out rows.

    A model that fails is left out and named in `status`; if all fail, that is an error. The scaled
    rows are written once for the passes of the fits; each model's predictions are written once, for every metric.
    With a `store` (`sources.artifacts.ModelStore`) each fitted model is kept under a digest of the rows and settings, and one
    that is there already is not fitted again.
    """
    spark = train.sparkSession
    scaler = fit_scaler(train, features)
    params = spark.createDataFrame(scaler.collect(), scaler.schema)
    columns = [row_id, label, *features]
    kept = Kept(apply_scaler(train.select(*columns), params))
    scaled_train = kept.df
    scaled_test = apply_scaler(test.select(*columns), params)
    n = scaled_train.count()
    data = [table_digest(train.select(*columns)), table_digest(test.select(*columns))] if store else []
    fitted, parts, status = {}, [], []
    for spec in models:
        try:
            key = digest_of([spec.name, spec.kind, spec.explains, spec.params, list(features), label, row_id, seed, data])
            had = store.load(key) if store else None
            if had:
                done, scores = had
                done.background = scaled_train
            else:
                model = fit_model(spec, scaled_train, features, label, row_id, seed, n)
                scores = model.predict(scaled_test).select(F.lit(spec.name).alias("model"), row_id, label, "prediction", "probability")
                done = Fitted(spec, model, params, list(features), scaled_train)
                scores = store.save(key, done, scores) if store else cut_lineage(scores)
            parts.append(scores)
            fitted[spec.name] = done
            status.append((spec.name, "ok", getattr(done.model, "note", "")))
        except Exception as e:
            status.append((spec.name, "failed", str(e)))
    if not parts:
        raise RuntimeError("no model could be trained: " + "; ".join(f"{n}: {m}" for n, _, m in status))
    predictions = parts[0]
    for p in parts[1:]:
        predictions = predictions.unionByName(p)
    return Trained(
        fitted, predictions, spark.createDataFrame(status, "model string, status string, message string"),
        [m.name for m in models],
        kept,
    )


def feature_importance(fitted: Fitted) -> DataFrame:
    """(feature, importance) ascending: tree importances or absolute coefficients, else no rows."""
    spark = fitted.scaler.sparkSession
    inner = getattr(fitted.model, "model", None)
    if fitted.spec.kind in ("forest", "tree", "gbt"):
        values = inner.featureImportances.toArray()
    elif fitted.spec.kind == "logistic":
        values = np.abs(inner.coefficients.toArray())
    else:
        values = []
    rows = [(f, float(v)) for f, v in zip(fitted.features, values)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy("importance", "feature")

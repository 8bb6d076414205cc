"""The clinical tasks end to end: explore a table, train and choose, score and explain records."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom import config
from riskloom.functions.columns import nan_to_null
from riskloom.operators import profile
from riskloom.operators.clean import Cleaned, clean, validate_domain
from riskloom.operators.codes import count_by, feature_dictionary, numeric_columns, rename_display
from riskloom.operators.evaluate import best_model, confusion_matrix, leaderboard, metrics_long
from riskloom.operators.explain import explain
from riskloom.operators.models import REGISTRY, Fitted, ModelSpec, Trained, feature_importance, train_all
from riskloom.operators.report import report_rows
from riskloom.operators.scale import apply_scaler
from riskloom.operators.score import score, with_defaults
from riskloom.operators.split import split_frames
from riskloom.sources.artifacts import ModelStore, load_fitted, load_results, save_fitted, save_results

ROW_ID = "row_id"


def with_row_id(df: DataFrame) -> DataFrame:
    """Distinct rows with a key made from the whole row, the same on every run.

    NaN is a gap and -0.0 is 0.0 before rows are compared and keyed.
    """
    plain = nan_to_null(df)
    plain = plain.withColumns({c: F.col(c) + F.lit(0.0).cast(t) for c, t in plain.dtypes if t in ("double", "float")})
    return plain.dropDuplicates().withColumn(ROW_ID, F.sha2(F.to_json(F.struct(*plain.columns)), 256))


def explore(df: DataFrame, label: str = config.LABEL) -> dict[str, DataFrame]:
    """Every table of the exploration view, by name."""
    shown = rename_display(df, config.DISPLAY_NAMES)
    features = [c for c in numeric_columns(df) if c != label]
    quality = profile.quality_report(df, label)
    out = {
        "card": profile.dataset_card(df, label),
        "quality": quality.summary,
        "columns": quality.columns,
        "classes": quality.classes,
        "preview": profile.preview(shown, 20, shown.columns),
        "describe": profile.describe(df),
        "dictionary": feature_dictionary(df, config.DISPLAY_NAMES, config.DESCRIPTIONS),
        "missing": profile.missing_summary(df, config.DISPLAY_NAMES),
        "histograms": profile.histogram_all(df, features, label),
        "boxes": profile.box_stats(df, features, label),
        "correlations": profile.correlation_matrix(df),
        "target_correlations": profile.target_correlation(df, label),
    }
    if "age" in df.columns:
        out["age_density"] = profile.density(df, "age", label)
    for code in ("sex", "cp"):
        if code in df.columns:
            labels = {code: config.CODE_LABELS[code], label: config.CODE_LABELS["target"]}
            out[f"{code}_counts"] = count_by(df, [code, label], labels)
    return out


@dataclass
class Training:
    cleaned: Cleaned
    trained: Trained
    leaderboard: DataFrame
    best: Fitted


def train(
    df: DataFrame,
    models: Sequence[ModelSpec] = tuple(REGISTRY),
    label: str = config.LABEL,
    test_fraction: float = 0.2,
    seed: int = 42,
    store: ModelStore | None = None,
) -> Training:
    """Clean, split, scale, fit every model, and choose the best by AUC on the held-out rows.

    With a store, a training that stopped goes on with the models that are not in it yet.
    """
    cleaned = clean(
        with_row_id(df), label, config.CORE_FEATURES + config.SPARSE_CANDIDATES, config.CODE_COLUMNS,
        config.SPARSE_CANDIDATES, carry=[ROW_ID],
    )
    rows, held_out = split_frames(cleaned.df, label, [ROW_ID], test_fraction, seed)
    done = train_all(rows, held_out, cleaned.features, label, ROW_ID, models, seed, store)
    metrics = done.metrics(label)
    best = best_model(metrics, done.order).first()["model"]
    return Training(cleaned, done, leaderboard(metrics, done.order), done.fitted[best])


def deep_dive(training: Training, label: str = config.LABEL) -> dict[str, DataFrame]:
    """The tables behind the leaderboard, by name: one row set for all models."""
    done = training.trained
    metrics = done.metrics(label)
    importances = None
    for name, fitted in done.fitted.items():
        rows = feature_importance(fitted).select(F.lit(name).alias("model"), "feature", "importance")
        importances = rows if importances is None else importances.unionByName(rows)
    return {
        "confusion": confusion_matrix(done.predictions, label, "prediction", ["model"]),
        "roc": done.roc(label),
        "metrics": metrics_long(metrics, names=config.METRIC_NAMES),
        "importances": importances,
        "status": done.status,
    }


def save(training: Training, path: str, label: str = config.LABEL) -> None:
    save_fitted(training.best, f"{path}/best")
    save_results(training.trained.metrics(label), training.trained.roc(label), f"{path}/results", training.trained.notes(label))


@dataclass
class Assessment:
    scored: DataFrame
    violations: DataFrame
    contributions: DataFrame
    report: DataFrame


def assess(
    spark: SparkSession, records: DataFrame, path: str, row_id: str, as_of: str | None = None, top: int = 10
) -> Assessment:
    """Score records with the saved model, check their limits, explain and report each of them."""
    fitted = load_fitted(spark, f"{path}/best")
    if fitted is None:
        raise ValueError(f"no trained model under {path}; train and save one first")
    metrics, _ = load_results(spark, f"{path}/results")
    scored = score(records, fitted)
    scaled = apply_scaler(with_defaults(records, fitted.features), fitted.scaler)
    own = metrics.where(F.col("model") == fitted.spec.name)
    return Assessment(
        scored,
        validate_domain(records, row_id, config.DOMAINS),
        explain(scaled, row_id, fitted, top=top),
        report_rows(scored, row_id, fitted.features, fitted.spec.name, config.REPORT_NAMES, own, as_of),
    )

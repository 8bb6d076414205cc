"""Evaluation of scores and predictions, exact and grouped by model."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.config import MEDALS
from riskloom.functions.columns import lookup, ratio, require_columns, rows_of
from riskloom.operators.running import running_totals

METRICS = ["accuracy", "precision", "recall", "f1", "roc_auc"]


def _cells(label: str, pred: str) -> dict:
    l, p = F.col(label), F.col(pred)
    return {
        "TN": F.count_if((l == 0) & (p == 0)),
        "FP": F.count_if((l == 0) & (p == 1)),
        "FN": F.count_if((l == 1) & (p == 0)),
        "TP": F.count_if((l == 1) & (p == 1)),
    }


def confusion_matrix(df: DataFrame, label: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """Four rows per group, with 0 for a cell that does not occur."""
    require_columns(df, label, pred, *by)
    wide = df.groupBy(*by).agg(*[c.alias(n) for n, c in _cells(label, pred).items()])
    cells = [("TN", 0, 0), ("FP", 0, 1), ("FN", 1, 0), ("TP", 1, 1)]
    return rows_of(
        wide,
        [
            F.struct(
                F.lit(l).alias("label"), F.lit(p).alias("prediction"), F.col(n).alias("count"), F.lit(n).alias("cell")
            )
            for n, l, p in cells
        ],
        by,
    )


def _scored(df: DataFrame, label: str, score: str, by: Sequence[str], buckets: int | None) -> DataFrame:
    is_pos = (F.col(label) == 1).cast("bigint")
    rows = df.where(F.col(label).isNotNull()).select(*by, label, score)
    return running_totals(
        rows, by, score, {"pos": is_pos, "neg": F.lit(1).cast("bigint") - is_pos}, descending=True, buckets=buckets
    )


def roc_auc(df: DataFrame, label: str, score: str, by: Sequence[str] = (), buckets: int | None = None) -> DataFrame:
    """Area under the curve, ties counted one half; NULL when a group has a single class."""
    require_columns(df, label, score, *by)
    t = _scored(df, label, score, by, buckets)
    area = F.sum(F.col("neg").cast("double") * (F.col("run_pos") - F.col("pos") / 2))
    return t.groupBy(*by).agg(
        ratio(area, F.max(F.col("all_pos").cast("double") * F.col("all_neg"))).alias("roc_auc")
    )


def roc_curve(
    df: DataFrame,
    label: str,
    score: str,
    by: Sequence[str] = (),
    drop_collinear: bool = True,
    buckets: int | None = None,
) -> DataFrame:
    """(by..., threshold, fpr, tpr), highest threshold first, from (0, 0) at +infinity.

    A point between two equal steps lies on their line and is left out with `drop_collinear`.
    The order of a curve is that of its falling thresholds.
    """
    require_columns(df, label, score, *by)
    t = _scored(df, label, score, by, buckets)
    points = t.where(~_on_line()) if drop_collinear else t
    # The first point also brings the origin, so the table is not read a second time for it.
    is_first = (F.col("run_pos") == F.col("pos")) & (F.col("run_neg") == F.col("neg"))
    here = F.struct(
        F.col(score).alias("threshold"),
        ratio(F.col("run_neg"), F.col("all_neg")).alias("fpr"),
        ratio(F.col("run_pos"), F.col("all_pos")).alias("tpr"),
    )
    origin = F.struct(
        F.lit(float("inf")).alias("threshold"),
        ratio(F.lit(0), F.col("all_neg")).alias("fpr"),
        ratio(F.lit(0), F.col("all_pos")).alias("tpr"),
    )
    return points.select(*by, F.inline(F.when(is_first, F.array(origin, here)).otherwise(F.array(here))))


def _on_line():
    is_first = (F.col("run_pos") == F.col("pos")) & (F.col("run_neg") == F.col("neg"))
    same_step = (F.col("next_pos") == F.col("pos")) & (F.col("next_neg") == F.col("neg"))
    return ~is_first & F.coalesce(same_step, F.lit(False))


def classification_metrics(
    df: DataFrame,
    label: str,
    pred: str,
    score: str | None = None,
    by: Sequence[str] = (),
    places: int = 4,
    buckets: int | None = None,
) -> DataFrame:
    """Accuracy, precision, recall, F1 and AUC per group; a zero denominator gives 0."""
    by = list(by)
    wide = df.groupBy(*by).agg(*[c.alias(n) for n, c in _cells(label, pred).items()])
    tn, fp, fn, tp = (F.col(c) for c in ("TN", "FP", "FN", "TP"))
    zero = F.lit(0.0)
    values = {
        "accuracy": ratio(tp + tn, tp + tn + fp + fn),
        "precision": F.coalesce(ratio(tp, tp + fp), zero),
        "recall": F.coalesce(ratio(tp, tp + fn), zero),
        "f1": F.coalesce(ratio(2 * tp, 2 * tp + fp + fn), zero),
    }
    out = wide.select(*by, *[F.bround(v, places).alias(n) for n, v in values.items()])
    if score is None:
        return out.withColumn("roc_auc", F.lit(None).cast("double"))
    auc = roc_auc(df, label, score, by, buckets).withColumn("roc_auc", F.bround("roc_auc", places))
    if not by:
        one = F.lit(1).alias("_one")
        return out.select(one, "*").join(auc.select(one, "*"), "_one").drop("_one")
    return out.join(auc, by, "left")


def metrics_long(metrics: DataFrame, model: str = "model", names: Mapping[str, str] | None = None) -> DataFrame:
    """(model, metric, value) with 0 for a metric a model does not have."""
    long = metrics.unpivot([model], METRICS, "metric", "value").withColumn("value", F.coalesce("value", F.lit(0.0)))
    return long.withColumn("metric", lookup(F.col("metric"), names, F.col("metric"))) if names else long


def leaderboard(metrics: DataFrame, order: Sequence[str], model: str = "model") -> DataFrame:
    """Models by AUC; equal ones in registry order. One row per model, so one window is enough."""
    place = F.coalesce(lookup(F.col(model), {m: i for i, m in enumerate(order)}), F.lit(len(order)))
    auc = F.coalesce("roc_auc", F.lit(0.0))
    rank = F.row_number().over(Window.orderBy(auc.desc(), place, model))
    return (
        metrics.withColumn("roc_auc", auc)
        .withColumn("rank", rank)
        .select(
            "rank",
            lookup(F.col("rank"), MEDALS, F.concat(F.lit("#"), F.col("rank").cast("string"))).alias("medal"),
            model,
            *METRICS,
        )
        .orderBy("rank")
    )


def best_model(metrics: DataFrame, order: Sequence[str], model: str = "model") -> DataFrame:
    return leaderboard(metrics, order, model).where("rank = 1").select(model, "roc_auc")


def with_curve(metrics: DataFrame, roc: DataFrame, model: str = "model") -> DataFrame:
    """Only the models that have curve points."""
    return metrics.join(roc.select(model).distinct(), model, "left_semi")

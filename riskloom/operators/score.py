"""Scoring: defaults, probability, prediction, confidence, risk bands."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.config import GAUGE_CUTS, RISK_BANDS, RISK_CUTS, RISK_MESSAGES
from riskloom.functions.columns import lookup, nan_to_null, require_columns
from riskloom.operators.scale import apply_scaler


def band(p: Column, cuts: Sequence[float] = RISK_CUTS) -> Column:
    """Low below the first cut, Moderate below the second, else High; missing stays missing."""
    low, moderate, high = RISK_BANDS
    return F.when(p < cuts[0], low).when(p < cuts[1], moderate).when(p.isNotNull(), high)


def risk_band(df: DataFrame, prob: str, cuts: Sequence[float] = RISK_CUTS) -> DataFrame:
    require_columns(df, prob)
    df = nan_to_null(df, [prob]).withColumn("risk", band(F.col(prob), cuts))
    return df.withColumn("message", lookup(F.col("risk"), RISK_MESSAGES))


def gauge(df: DataFrame, prob: str, cuts: Sequence[float] = GAUGE_CUTS) -> DataFrame:
    """Per cent, its difference from 50, and the band on the dial's own cuts."""
    p = F.col(prob)
    return nan_to_null(df, [prob]).withColumns(
        {"gauge_value": p * 100, "gauge_delta": p * 100 - 50, "gauge_band": band(p, cuts)}
    )


def confidence(df: DataFrame, prob: str, pred: str = "prediction") -> DataFrame:
    """Confidence in the predicted class, and the diagnosis word."""
    p = F.col(prob)
    return df.withColumns(
        {
            "confidence": F.when(p.isNotNull(), F.greatest(p, 1 - p)),
            "diagnosis": F.when(F.col(pred) == 1, "Positive").when(F.col(pred).isNotNull(), "Negative"),
        }
    )


def with_defaults(df: DataFrame, features: Sequence[str], defaults: Mapping[str, float] | None = None) -> DataFrame:
    """Adds feature columns the records lack; 0.0 unless `defaults` names another value.

    `n_defaulted` counts them, so that a reader sees that a score rests on defaults.
    """
    defaults = defaults or {}
    absent = [c for c in features if c not in df.columns]
    df = df.withColumns({c: F.lit(float(defaults.get(c, 0.0))) for c in absent}) if absent else df
    return df.withColumn("n_defaulted", F.lit(len(absent)))


def score(df: DataFrame, fitted, defaults: Mapping[str, float] | None = None, cuts: Sequence[float] = RISK_CUTS):
    """Probability, prediction, confidence, diagnosis and risk band for each record.

    The raw columns stay; the scaled ones live only inside. A record with a missing feature keeps its
    row and has no score. Works the same on a stream.
    """
    raw = nan_to_null(with_defaults(df, fitted.features, defaults), fitted.features)
    hidden = {c: f"_raw_{c}" for c in fitted.features}
    kept = raw.withColumns({h: F.col(c) for c, h in hidden.items()})
    scaled = apply_scaler(kept, fitted.scaler)
    # A gap must not stop the batch or the stream: it is filled for the model and its score taken back.
    filled = scaled.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in fitted.features})
    whole = F.lit(True)
    for h in hidden.values():
        whole = whole & F.col(h).isNotNull()
    scored = fitted.model.predict(filled)
    scored = scored.withColumns({c: F.when(whole, F.col(c)) for c in ("probability", "prediction")})
    scored = scored.withColumns({c: F.col(h) for c, h in hidden.items()}).drop(*hidden.values())
    return risk_band(confidence(scored, "probability"), "probability", cuts)

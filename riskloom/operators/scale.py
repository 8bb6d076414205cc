"""Standard scaling with the population sd, fitted on the training rows only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.columns import nan_to_null, require_columns, rows_of


def fit_scaler(train: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(position, feature, mean, sd): one pass over all columns; sd 0 is replaced by 1 when applied."""
    require_columns(train, *cols)
    wide = nan_to_null(train.select(*cols)).agg(
        *[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)],
        *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(cols)],
    )
    return rows_of(
        wide,
        [
            F.struct(
                F.lit(i).alias("position"),
                F.lit(c).alias("feature"),
                F.col(f"m{i}").alias("mean"),
                F.col(f"s{i}").alias("sd"),
            )
            for i, c in enumerate(cols)
        ],
    )


def apply_scaler(df: DataFrame, scaler: DataFrame) -> DataFrame:
    """(x - mean) / sd with the fitted numbers as literals: works on tables, one record, and streams."""
    params = scaler.collect()
    require_columns(df, *[p["feature"] for p in params])
    return df.withColumns(
        {
            p["feature"]: (F.col(p["feature"]).cast("double") - F.lit(p["mean"])) / F.lit(p["sd"] or 1.0)
            for p in params
        }
    )

"""Names and labels: display names, code labels, melting, record rows, the feature dictionary."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.functions.columns import lookup, require_columns


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def rename_display(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed({c: names[c] for c in df.columns if c in names})


def raw_name(display: str, names: Mapping[str, str]) -> str:
    """Column behind a display name; a name without an entry stands for itself."""
    return {v: k for k, v in names.items()}.get(display, display)


def map_codes(df: DataFrame, col: str, mapping: Mapping, to: str | None = None) -> DataFrame:
    """Label of each code in `to`; a code without a label gives NULL."""
    require_columns(df, col)
    c = F.col(col)
    if isinstance(df.schema[col].dataType, T.NumericType) and all(isinstance(k, (int, float)) for k in mapping):
        # As double on both sides: 1.0 finds code 1, and 1.5 finds none.
        c, mapping = c.cast("double"), {float(k): v for k, v in mapping.items()}
    return df.withColumn(to or col, lookup(c, mapping))


def melt(
    df: DataFrame,
    ids: Sequence[str],
    values: Sequence[str],
    names: Mapping[str, str] | None = None,
    variable: str = "feature",
    value: str = "value",
) -> DataFrame:
    """One row per (row, column); `names` relabels the column names."""
    require_columns(df, *ids, *values)
    long = df.select(*ids, *[F.col(c).cast("double").alias(c) for c in values]).unpivot(
        list(ids), list(values), variable, value
    )
    return long.withColumn(variable, lookup(F.col(variable), names, F.col(variable))) if names else long


def record_to_rows(df: DataFrame, row_id: str, values: Sequence[str], names: Mapping[str, str]) -> DataFrame:
    """(row_id, position, parameter, value): one record as a two-column list, in column order."""
    long = melt(df, [row_id], values, variable="parameter")
    position = {c: i for i, c in enumerate(values, 1)}
    return long.select(
        row_id,
        lookup(F.col("parameter"), position).alias("position"),
        lookup(F.col("parameter"), names, F.col("parameter")).alias("parameter"),
        "value",
    )


def feature_dictionary(df: DataFrame, names: Mapping[str, str], descriptions: Mapping[str, str]) -> DataFrame:
    """(column, feature, description) for each column of `df` that has a description."""
    rows = [(c, names.get(c, c), descriptions[c]) for c in df.columns if c in descriptions]
    return df.sparkSession.createDataFrame(rows, "column string, feature string, description string")


def count_by(
    df: DataFrame,
    keys: Sequence[str],
    labels: Mapping[str, Mapping] | None = None,
    keep_unmapped: bool = False,
) -> DataFrame:
    """Rows per combination of keys, labelled where `labels` has a mapping.

    A missing or unlabelled key drops its rows, or with `keep_unmapped` counts them under NULL.
    """
    require_columns(df, *keys)
    df = df.select(*keys)
    for k, mapping in (labels or {}).items():
        df = map_codes(df, k, mapping)
    if not keep_unmapped:
        df = df.dropna(subset=list(keys))
    return df.groupBy(*keys).agg(F.count("*").alias("count")).orderBy(*keys)

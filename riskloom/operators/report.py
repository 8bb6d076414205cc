"""Report rows per scored record."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.config import METRIC_NAMES
from riskloom.functions.columns import fixed, lookup, plain_number, title_case


def _stamp(as_of: str | None) -> Column:
    return F.lit(as_of).cast("timestamp") if as_of else F.current_timestamp()


def report_rows(
    scored: DataFrame,
    row_id: str,
    features: Sequence[str],
    model: str,
    names: Mapping[str, str],
    metrics: DataFrame | None = None,
    as_of: str | None = None,
) -> DataFrame:
    """(row_id, section, position, label, value): header, summary, inputs, model metrics.

    `metrics` is one row of model metrics. All rows of a record are built inside its own row, so
    nothing is shuffled or joined by record. `as_of` fixes the time stamps.
    """
    stamp = _stamp(as_of)
    percent = lambda c: F.concat(fixed(F.col(c) * 100, 1), F.lit("%"))
    items = [
        ("header", "Generated on", F.date_format(stamp, "MMMM dd, yyyy 'at' HH:mm")),
        ("header", "Report ID", F.concat(F.date_format(stamp, "yyyyMMddHHmmss"), F.lit("-"), F.col(row_id).cast("string"))),
        ("summary", "PREDICTION RESULT", F.coalesce("risk", F.lit("Unknown"))),
        ("summary", "PROBABILITY", percent("probability")),
        ("summary", "CONFIDENCE", percent("confidence")),
        ("summary", "DIAGNOSIS", F.col("diagnosis")),
        ("summary", "MODEL USED", F.lit(model)),
    ]
    for c in features:
        shown = lookup(F.lit(c), names, title_case(F.lit(c)))
        items.append(("input", shown, plain_number(c)))
    if metrics is not None:
        row = metrics.first()
        for c, shown in METRIC_NAMES.items():
            value = row[c] if row is not None and c in metrics.columns else None
            items.append(("metrics", shown, F.lit("None" if value is None else f"{value:.4f}")))
    structs = [
        F.struct(
            F.lit(section).alias("section"),
            F.lit(i).alias("position"),
            (F.lit(label) if isinstance(label, str) else label).alias("label"),
            value.alias("value"),
        )
        for i, (section, label, value) in enumerate(items, 1)
    ]
    return scored.select(row_id, F.inline(F.array(*structs)))


def report_file_name(row_id: str, as_of: str | None = None) -> Column:
    return F.concat(
        F.lit("risk_report_"), F.date_format(_stamp(as_of), "yyyyMMdd_HHmmss"), F.lit("_"), F.col(row_id).cast("string")
    )

"""Running totals in value order without a global sort in one task."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_BUCKETS = 4096


def default_buckets(df: DataFrame) -> int:
    return max(2, min(MAX_BUCKETS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def value_splits(df: DataFrame, order: str, buckets: int) -> list[float]:
    """Distinct approximate quantiles; they only balance the buckets and never change a result."""
    probs = [i / buckets for i in range(1, buckets)]
    found = df.stat.approxQuantile(order, probs, 1.0 / (4 * buckets))
    return sorted({v for v in found if math.isfinite(v)})


def running_totals(
    df: DataFrame,
    by: Sequence[str],
    order: str,
    sums: Mapping[str, Column],
    descending: bool = False,
    buckets: int | None = None,
) -> DataFrame:
    """One row per (by, order) with the totals there, up to there, overall, and at the next value.

    Rows without a value or without a group are left out.

    Equal values are added up first, so a value held by a third of the rows is one row. The values
    are then cut into buckets: totals per bucket give each bucket's offset (a window over at most
    `buckets` rows per group), and the sorted windows run inside (by, bucket).
    """
    by = list(by)
    rows = df.withColumn(order, F.col(order).cast("double")).where(F.col(order).isNotNull() & ~F.isnan(order))
    rows = rows.dropna(subset=by) if by else rows
    splits = value_splits(rows, order, buckets or default_buckets(df))
    at_value = rows.groupBy(*by, order).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    edges = [float("-inf"), *(splits or [0.0]), float("inf")]
    placed = Bucketizer(splits=edges, inputCol=order, outputCol="_bucket").transform(at_value)

    names = list(sums)
    here = F.struct(*names)
    direction = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    first = F.max_by if descending else F.min_by
    per_bucket = placed.groupBy(*by, "_bucket").agg(
        *[F.sum(n).alias(f"_b_{n}") for n in names], first(here, order).alias("_first")
    )
    across = Window.partitionBy(*by).orderBy(direction("_bucket"))
    whole = Window.partitionBy(*by)
    offsets = per_bucket.select(
        *by,
        "_bucket",
        *[(F.sum(f"_b_{n}").over(across) - F.col(f"_b_{n}")).alias(f"_off_{n}") for n in names],
        *[F.sum(f"_b_{n}").over(whole).alias(f"all_{n}") for n in names],
        F.lead("_first").over(across).alias("_next_bucket"),
    )
    within = Window.partitionBy(*by, "_bucket").orderBy(direction(order))
    joined = placed.join(offsets, [*by, "_bucket"])
    upto = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    nxt = F.coalesce(F.lead(here).over(within), F.col("_next_bucket"))
    out = joined.select(
        *by,
        order,
        *names,
        *[(F.sum(n).over(upto) + F.col(f"_off_{n}")).alias(f"run_{n}") for n in names],
        *[F.col(f"all_{n}") for n in names],
        nxt.alias("_next"),
    )
    return out.select("*", *[F.col(f"_next.{n}").alias(f"next_{n}") for n in names]).drop("_next")

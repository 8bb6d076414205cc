"""Profiles: quality, description, histograms, boxes, densities, correlations."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from typing import NamedTuple

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.columns import lookup, nan_to_null, ratio, require_columns, rows_of
from riskloom.functions.session import broadcast_if_small
from riskloom.operators.clean import missing_counts, with_digest
from riskloom.operators.codes import melt, numeric_columns
from riskloom.operators.quantiles import BUCKETS, exact_percentiles

# Terms of the kernel's series within a bin.
SERIES = 12


def preview(df: DataFrame, n: int, order_by: Sequence[str]) -> DataFrame:
    return df.orderBy(*order_by).limit(n)


def dataset_card(df: DataFrame, label: str) -> DataFrame:
    """Rows, features, and the whole per cent of each class (the positive one cut, not rounded)."""
    require_columns(df, label)
    df = nan_to_null(df, [label])
    share = F.avg(F.col(label).cast("double")) * 100
    return df.agg(F.count("*").alias("n_rows"), share.cast("int").alias("positive_pct")).select(
        "n_rows",
        F.lit(len(df.columns) - 1).alias("n_features"),
        "positive_pct",
        (F.lit(100) - F.col("positive_pct")).alias("negative_pct"),
    )


class Quality(NamedTuple):
    summary: DataFrame
    columns: DataFrame
    classes: DataFrame


def quality_summary(df: DataFrame) -> DataFrame:
    """Rows, columns, copies and gaps. Digests are shuffled for the count, and whole rows only where digests repeat."""
    rows = nan_to_null(df)
    gaps = sum((F.col(c).isNull().cast("bigint") for c in df.columns), F.lit(0).cast("bigint"))
    hashed = with_digest(rows)
    once = hashed.groupBy("_d1", "_d2").agg(F.count("*").alias("_n"), F.sum(gaps).alias("_gaps"))
    repeated = once.where("_n > 1").select("_d1", "_d2")
    copies = hashed.join(repeated, ["_d1", "_d2"], "left_semi").groupBy(*df.columns).agg((F.count("*") - 1).alias("_more"))
    counted = once.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("total_rows"), F.coalesce(F.sum("_gaps"), F.lit(0)).alias("missing_total"))
    return counted.join(copies.agg(F.coalesce(F.sum("_more"), F.lit(0)).alias("duplicates"))).select(
        "total_rows", F.lit(len(df.columns)).cast("bigint").alias("total_cols"), "duplicates", "missing_total"
    )


def quality_columns(df: DataFrame) -> DataFrame:
    """(feature, missing_count, missing_pct, dtype) in column order."""
    counts = missing_counts(df)
    return rows_of(
        counts,
        [
            F.struct(
                F.lit(c).alias("feature"),
                F.col(c).alias("missing_count"),
                F.bround(ratio(F.col(c), F.col("n_rows")) * 100, 2).alias("missing_pct"),
                F.lit(df.schema[c].dataType.simpleString()).alias("dtype"),
            )
            for c in df.columns
        ],
    )


def class_distribution(df: DataFrame, label: str) -> DataFrame:
    """Rows per class, most frequent first; no rows when the label column is absent."""
    if label not in df.columns:
        return df.sparkSession.createDataFrame([], f"{label} int, count bigint")
    return (
        nan_to_null(df.select(label))
        .where(F.col(label).isNotNull())
        .groupBy(label)
        .agg(F.count("*").alias("count"))
        .orderBy(F.desc("count"), label)
    )


def quality_report(df: DataFrame, label: str) -> Quality:
    return Quality(quality_summary(df), quality_columns(df), class_distribution(df, label))


def missing_summary(df: DataFrame, names: Mapping[str, str] | None = None, only_missing: bool = False) -> DataFrame:
    table = quality_columns(df).drop("dtype")
    if names:
        table = table.withColumn("feature", lookup(F.col("feature"), names, F.col("feature")))
    if only_missing:
        table = table.where("missing_count > 0")
    return table.orderBy(F.desc("missing_pct"), "feature")


def describe(
    df: DataFrame,
    cols: Sequence[str] | None = None,
    exact: bool = True,
    places: int = 3,
    limit: int = BUCKETS,
) -> DataFrame:
    """count, mean, sd, minimum, quartiles and maximum per numeric column."""
    cols = list(cols or numeric_columns(df))
    df = nan_to_null(df.select(*[F.col(c).cast("double").alias(c) for c in cols]))
    probs = [0.25, 0.5, 0.75]
    names = ("count", "mean", "std", "min", "max")
    measures = (F.count, F.avg, F.stddev_samp, F.min, F.max)
    wide = df.agg(*[f(c).alias(f"{n}_{i}") for i, c in enumerate(cols) for n, f in zip(names, measures)]).first()
    basic = df.sparkSession.createDataFrame(
        [(c, *[wide[f"{n}_{i}"] for n in names]) for i, c in enumerate(cols)],
        "feature string, count bigint, mean double, std double, min double, max double",
    )
    if exact:
        quartiles = exact_percentiles(df, cols, probs, limit=limit)
    else:
        quartiles = rows_of(
            df.agg(*[F.percentile_approx(c, probs).alias(c) for c in cols]),
            [F.struct(F.lit(c).alias("feature"), F.col(c).alias("q")) for c in cols],
        )
    rounded = [F.bround(c, places).alias(n) for n, c in (
        ("mean", F.col("mean")), ("std", F.col("std")), ("min", F.col("min")),
        ("p25", F.col("q")[0]), ("p50", F.col("q")[1]), ("p75", F.col("q")[2]), ("max", F.col("max")),
    )]
    return basic.join(quartiles, "feature").select("feature", "count", *rounded)


def _nice_width(width: float) -> float:
    """The next of 1, 2, 5 times a power of ten."""
    power = 10.0 ** math.floor(math.log10(width))
    return next(m * power for m in (1, 2, 5, 10) if m * power >= width * (1 - 1e-12))


def histogram_all(
    df: DataFrame, cols: Sequence[str], by: str, bins: int = 20, edges: str = "equal"
) -> DataFrame:
    """(feature, by, bin, lo, hi, count) with at most `bins` bins per feature, zero bins included.

    Edges are shared by the classes. The raw rows are only counted; what is shuffled is one row per
    (feature, class, bin).
    """
    require_columns(df, by, *cols)
    df = nan_to_null(df)
    ends = df.where(F.col(by).isNotNull()).agg(
        *[F.min(c).cast("double").alias(f"lo_{i}") for i, c in enumerate(cols)],
        *[F.max(c).cast("double").alias(f"hi_{i}") for i, c in enumerate(cols)],
    ).first()
    low, width, number = {}, {}, {}
    for i, c in enumerate(cols):
        lo, hi = ends[f"lo_{i}"], ends[f"hi_{i}"]
        if lo is None:
            continue
        if hi == lo:
            low[c], width[c], number[c] = lo, 1.0, 1
        elif edges == "nice":
            w = _nice_width((hi - lo) / bins)
            start = w * int(lo // w)
            while (hi - start) / w > bins:
                w = _nice_width(w * 1.01)
                start = w * int(lo // w)
            low[c], width[c], number[c] = start, w, int((hi - start) // w) + (0 if (hi - start) % w == 0 else 1)
        else:
            low[c], width[c], number[c] = lo, (hi - lo) / bins, bins
    feature = F.col("feature")
    if not low:
        return df.sparkSession.createDataFrame(
            [], f"feature string, {by} {df.schema[by].dataType.simpleString()}, "
            "bin int, lo double, hi double, count bigint"
        )
    placed = (
        melt(df, [by], [c for c in cols if c in low])
        .where(F.col("value").isNotNull() & F.col(by).isNotNull())
        .select(
            by,
            feature,
            F.least(
                F.floor((F.col("value") - lookup(feature, low)) / lookup(feature, width)).cast("int"),
                lookup(feature, number) - 1,
            ).alias("bin"),
        )
        .groupBy("feature", by, "bin")
        .agg(F.count("*").alias("count"))
    )
    # At most `bins` entries per (feature, class): bins without rows are read from this small map as 0.
    filled = placed.groupBy("feature", by).agg(
        F.map_from_entries(F.collect_list(F.struct("bin", "count"))).alias("_counts")
    )
    # Every class of the table meets every feature that has values, also where the class has none.
    classes = df.where(F.col(by).isNotNull()).select(by).distinct()
    full = classes.select(by, F.explode(F.array(*map(F.lit, number)).cast("array<string>")).alias("feature")).join(filled, ["feature", by], "left")
    bin_ = F.col("bin")
    return full.select(
        "feature", by, "_counts", F.explode(F.sequence(F.lit(0), lookup(feature, number) - 1)).alias("bin")
    ).select(
        "feature",
        by,
        "bin",
        (lookup(feature, low) + bin_ * lookup(feature, width)).alias("lo"),
        (lookup(feature, low) + (bin_ + 1) * lookup(feature, width)).alias("hi"),
        F.coalesce(F.try_element_at("_counts", bin_), F.lit(0).cast("long")).alias("count"),
    )


def histogram(df: DataFrame, col: str, by: str, bins: int = 25, edges: str = "equal") -> DataFrame:
    return histogram_all(df, [col], by, bins, edges)


def _fences(df: DataFrame, cols: Sequence[str], by: str, limit: int) -> DataFrame:
    q = exact_percentiles(df.where(F.col(by).isNotNull()), cols, [0.25, 0.5, 0.75], [by], limit)
    spread = (F.col("q")[2] - F.col("q")[0]) * 1.5
    return q.where(F.col("q").isNotNull()).select(
        by,
        "feature",
        F.col("q")[0].alias("q1"),
        F.col("q")[1].alias("median"),
        F.col("q")[2].alias("q3"),
        (F.col("q")[0] - spread).alias("fence_lo"),
        (F.col("q")[2] + spread).alias("fence_hi"),
    )


def box_stats(df: DataFrame, cols: Sequence[str], by: str, limit: int = BUCKETS) -> DataFrame:
    """Quartiles, whiskers inside 1.5 IQR, mean, population sd and count per class and feature."""
    require_columns(df, by, *cols)
    df = nan_to_null(df.select(by, *cols))
    fences = broadcast_if_small(_fences(df, cols, by, limit))
    long = melt(df, [by], cols).where(F.col("value").isNotNull())
    v = F.col("value")
    inside = F.when(v.between(F.col("fence_lo"), F.col("fence_hi")), v)
    return (
        long.join(fences, ["feature", by])
        .groupBy("feature", by, "q1", "median", "q3")
        .agg(
            F.min(inside).alias("whisker_lo"),
            F.max(inside).alias("whisker_hi"),
            F.avg(v).alias("mean"),
            F.stddev_pop(v).alias("sd"),
            F.count("*").alias("n"),
        )
    )


def outliers(
    df: DataFrame, ids: Sequence[str], cols: Sequence[str], by: str, limit: int = BUCKETS
) -> DataFrame:
    """(ids..., by, feature, value) for every value outside the fences of its class."""
    df = nan_to_null(df.select(*ids, by, *cols))
    fences = broadcast_if_small(_fences(df, cols, by, limit))
    v = F.col("value")
    return (
        melt(df, [*ids, by], cols)
        .join(fences, ["feature", by])
        .where((v < F.col("fence_lo")) | (v > F.col("fence_hi")))
        .select(*ids, by, "feature", "value")
    )


def density(df: DataFrame, col: str, by: str, grid_points: int = 64, limit: int = BUCKETS) -> DataFrame:
    """Gaussian kernel density per class on an even grid over the column's range: (by, x, density).

    Every row counts. Rows are summed to moments in bins of half a bandwidth, which are combined before their shuffle; a
    bin's kernel sum at a grid point is the Taylor series of the kernel around its middle, whose rest is below 1e-11 of the
    peak. A row costs as many products as the series has terms, whatever the grid. A class whose values are all the same has no
    bandwidth: its density is NULL.
    """
    require_columns(df, col, by)
    rows = nan_to_null(df.select(by, F.col(col).cast("double").alias("v"))).where(
        F.col("v").isNotNull() & F.col(by).isNotNull()
    )
    ends = rows.agg(F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    schema = f"{by} {df.schema[by].dataType.simpleString()}, x double, density double"
    if ends["lo"] is None or grid_points < 2:
        return df.sparkSession.createDataFrame([], schema)
    step = (ends["hi"] - ends["lo"]) / (grid_points - 1)
    grid = [ends["lo"] + i * step for i in range(grid_points)]
    q = exact_percentiles(rows, ["v"], [0.25, 0.75], [by], limit).select(
        by, (F.col("q")[1] - F.col("q")[0]).alias("iqr")
    )
    spread = rows.groupBy(by).agg(F.stddev_samp("v").alias("sd"), F.count("*").alias("n"))
    iqr = F.col("iqr") / 1.349
    # A class whose middle half is one value has IQR 0; the sd alone then sets the bandwidth.
    width = F.when(iqr > 0, F.least("sd", iqr)).otherwise(F.col("sd"))
    h = F.lit(1.059) * width * F.pow(F.col("n").cast("double"), F.lit(-0.2))
    bands = broadcast_if_small(spread.join(q, by).select(by, "n", F.when(h > 0, h).alias("h")))
    # Offsets within a bin are at most a quarter of a bandwidth.
    bin_width = F.col("h") / 2
    placed = rows.join(bands, by).withColumn("bin", F.floor(F.col("v") / bin_width))
    placed = placed.withColumn("e", F.col("v") / F.col("h") - (F.col("bin") + 0.5) / 2)
    power, powers = F.lit(1.0), []
    for _ in range(SERIES):
        powers.append(power)
        power = power * F.col("e")
    bins = placed.groupBy(by, "n", "h", "bin").agg(*[F.sum(p).alias(f"m{k}") for k, p in enumerate(powers)])
    u = F.col("x") / F.col("h") - (F.col("bin") + 0.5) / 2
    here = bins.withColumn("x", F.explode(F.array(*[F.lit(x) for x in grid]))).withColumn("u", u)
    # Hermite polynomials by their recurrence, each a column of its own.
    for k in range(SERIES):
        he = F.lit(1.0) if k == 0 else F.col("u") if k == 1 else F.col("u") * F.col(f"he{k - 1}") - (k - 1) * F.col(f"he{k - 2}")
        here = here.withColumn(f"he{k}", he)
    series = sum((F.col(f"he{k}") * F.col(f"m{k}") / math.factorial(k) for k in range(1, SERIES)), F.col("m0") * F.col("he0"))
    total = F.sum(F.exp(-0.5 * F.col("u") * F.col("u")) * series)
    return here.groupBy(by, "n", "h", "x").agg(total.alias("total")).select(
        by, "x", (F.col("total") / (F.col("n") * F.col("h") * F.sqrt(F.lit(2.0) * F.pi()))).alias("density")
    )


def _pair(a: str, b: str, whole: set[str]) -> Column:
    """Pearson r over rows where both are present; NULL for a constant column."""

    def sd(x: str, other: str) -> Column:
        return F.stddev_samp(x if other in whole else F.when(F.col(other).isNotNull(), F.col(x)))

    return F.try_divide(F.covar_samp(a, b), sd(a, b) * sd(b, a))


def correlation_matrix(df: DataFrame, cols: Sequence[str] | None = None, places: int = 3) -> DataFrame:
    """(a, b, r) for every ordered pair, over rows where both are present.

    Two passes without a shuffle: means and counts, then one Gram matrix. Its columns are the centred
    values with 0 for a gap and, where there are gaps, the squares and the 0/1 presence marks, so that
    every pairwise sum is one of its entries. What reaches the driver grows with the columns only.
    """
    cols = list(cols or numeric_columns(df))
    df = nan_to_null(df.select(*[F.col(c).cast("double").alias(c) for c in cols]))
    d = len(cols)
    first = df.agg(
        F.count("*").alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)],
        *[F.count(c).alias(f"n{i}") for i, c in enumerate(cols)],
    ).first()
    schema = "a string, b string, r double"
    if not first["n"]:
        return df.sparkSession.createDataFrame([(a, b, None) for a in cols for b in cols], schema)
    gap = any(first[f"n{i}"] < first["n"] for i in range(d))
    centred = [F.coalesce(F.col(c) - F.lit(first[f"m{i}"]), F.lit(0.0)) for i, c in enumerate(cols)]
    marks = [F.col(c).isNotNull().cast("double") for c in cols] if gap else [F.lit(1.0)]
    parts = centred + ([x * x for x in centred] if gap else []) + marks
    vectors = MLUtils.convertVectorColumnsFromML(df.select(array_to_vector(F.array(*parts)).alias("v")), "v")
    gram = RowMatrix(vectors).computeGramianMatrix().toArray()
    if gap:
        cross, square, plain, n = gram[:d, :d], gram[d : 2 * d, 2 * d :], gram[:d, 2 * d :], gram[2 * d :, 2 * d :]
    else:
        cross, n = gram[:d, :d], np.full((d, d), float(first["n"]))
        square = np.repeat(np.diag(cross)[:, None], d, axis=1)
        plain = np.repeat(gram[:d, d][:, None], d, axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        cov = cross - plain * plain.T / n
        # What centring leaves of a constant column is rounding, not spread.
        spread = square - plain**2 / n
        spread = np.where(spread > 1e-13 * np.maximum(square, _scale(first, d, n)), spread, np.nan)
        r = cov / np.sqrt(spread * spread.T)
    r[np.diag_indices(d)] = np.where(np.isnan(np.diag(r)), np.nan, 1.0)
    rows = [
        (a, b, None if np.isnan(r[i, j]) else float(r[i, j])) for i, a in enumerate(cols) for j, b in enumerate(cols)
    ]
    return df.sparkSession.createDataFrame(rows, schema).withColumn("r", F.bround("r", places))


def _scale(first, d: int, n: np.ndarray) -> np.ndarray:
    """Size of the squared rounding error of a centred column: (mean * 1e-16)^2 per row, by 1e-13."""
    means = np.array([first[f"m{i}"] or 0.0 for i in range(d)])
    return (means[:, None] ** 2) * n * 1e-19


def target_correlation(df: DataFrame, label: str, cols: Sequence[str] | None = None) -> DataFrame:
    """(feature, r, direction) of each numeric column with the label, ascending."""
    cols = [c for c in (cols or numeric_columns(df)) if c != label]
    df = nan_to_null(df.select(label, *cols))
    gaps = missing_counts(df, [label, *cols]).first()
    whole = {c for c in [label, *cols] if not gaps[c]}
    casted = df.select(*[F.col(c).cast("double").alias(c) for c in [label, *cols]])
    wide = casted.agg(*[_pair(c, label, whole).alias(c) for c in cols])
    long = rows_of(wide, [F.struct(F.lit(c).alias("feature"), F.col(c).alias("r")) for c in cols])
    return long.withColumn(
        "direction", F.when(F.col("r") > 0, "raises").when(F.col("r") <= 0, "lowers")
    ).orderBy(F.asc_nulls_last("r"), "feature")

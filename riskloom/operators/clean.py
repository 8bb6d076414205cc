"""Cleaning: duplicates, target, missing values, numeric coercion, input limits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.columns import is_fractional, nan_to_null, number_or_null, ratio, require_columns
from riskloom.functions.session import Kept, cut_lineage
from riskloom.operators.quantiles import BUCKETS, exact_medians, modes

# Repeated digests that are sent to every task, of 16 bytes each.
SENT_DIGESTS = 500_000
# Rows that a task compares as a whole, and buckets of digests in which a row of many copies shows.
ROWS_PER_TASK = 100_000
DIGEST_BUCKETS = 4_096


def positive(c: Column) -> Column:
    """1 when above zero, else 0; a missing value is 0."""
    return F.coalesce((c > 0).cast("int"), F.lit(0))


def binarise(
    df: DataFrame, col: str, only_if_multiclass: bool = False, drop_missing_target: bool = False
) -> DataFrame:
    """Target above zero becomes 1. With `only_if_multiclass` a target of two values is left alone."""
    require_columns(df, col)
    df = nan_to_null(df, [col])
    if drop_missing_target:
        df = df.where(F.col(col).isNotNull())
    # Three groups are enough to know that there are more than two.
    if only_if_multiclass and df.where(F.col(col).isNotNull()).select(col).distinct().limit(3).count() <= 2:
        return df
    return df.withColumn(col, positive(F.col(col)))


def with_digest(df: DataFrame) -> DataFrame:
    """Adds _d1, _d2: 128 bits of hashes of the whole row, in which a gap counts as a value."""
    # A hash passes over gaps, so where they are is hashed too; -0.0 and 0.0 are one value.
    parts = [F.col(c) + 0.0 if is_fractional(df, c) else F.col(c) for c in df.columns]
    gaps = F.concat(*[F.when(F.col(c).isNull(), "1").otherwise("0") for c in df.columns])
    return df.withColumn("_d1", F.xxhash64(*parts, gaps)).withColumn("_d2", F.xxhash64(F.lit(1), gaps, *parts))


def repeated_digests(df: DataFrame) -> DataFrame:
    """(_d1, _d2) of the rows of a `with_digest` table that may have copies; what is shuffled is two numbers a row."""
    return df.groupBy("_d1", "_d2").agg(F.count("*").alias("_n")).where("_n > 1").select("_d1", "_d2")


def _merged(rows: DataFrame) -> DataFrame:
    """The distinct rows, dealt by digest to tasks of about ROWS_PER_TASK.

    A first pass counts the rows of each bucket of digests. A task never gathers the distinct rows of its input, which
    would grow with it; only in buckets of far more rows than others, where one row has many copies, are copies merged
    before the shuffle.
    """
    if rows.isStreaming or not rows.columns:
        return rows.dropDuplicates()
    hashed = with_digest(rows)
    bucket = F.pmod(F.col("_d1"), F.lit(DIGEST_BUCKETS))
    # A row for each bucket.
    sizes = {r["b"]: r["n"] for r in hashed.groupBy(bucket.alias("b")).agg(F.count("*").alias("n")).collect()}
    total = sum(sizes.values())
    heavy = [b for b, n in sizes.items() if n > ROWS_PER_TASK + 2 * total // DIGEST_BUCKETS]
    tasks = max(1, -(-total // ROWS_PER_TASK))
    light = hashed.where(~bucket.isin(heavy)) if heavy else hashed
    done = light.repartition(tasks, "_d1", "_d2").dropDuplicates().select(*rows.columns)
    return done.unionByName(hashed.where(bucket.isin(heavy)).select(*rows.columns).dropDuplicates()) if heavy else done


def deduplicate(df: DataFrame, by_digest: bool = False) -> DataFrame:
    """Remove copies of whole rows; missing equals missing. Rows are read twice, first to count them.

    With `by_digest`, for wide rows: digests are shuffled in their place, and rows are compared as a whole only where
    digests repeat; the others stay where they are. It reads the table three times. Where too many digests repeat to be
    sent to every task, whole rows are merged as without it.
    """
    rows = nan_to_null(df)
    if not by_digest:
        return _merged(rows)
    hashed = with_digest(rows)
    repeated = cut_lineage(repeated_digests(hashed))
    if repeated.limit(SENT_DIGESTS + 1).count() > SENT_DIGESTS:
        return _merged(rows)
    sent = F.broadcast(repeated)
    alone = hashed.join(sent, ["_d1", "_d2"], "left_anti").select(*rows.columns)
    return alone.unionByName(hashed.join(sent, ["_d1", "_d2"], "left_semi").select(*rows.columns).dropDuplicates())


def missing_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """One row: n_rows, and the number of missing values per column; one pass without a shuffle."""
    cols = list(cols or df.columns)
    return nan_to_null(df, cols).agg(
        F.count("*").alias("n_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in cols]
    )


def missing_fraction(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    cols = list(cols or df.columns)
    return missing_counts(df, cols).select(*[ratio(F.col(c), F.col("n_rows")).alias(c) for c in cols])


def select_by_missingness(
    df: DataFrame, features: Sequence[str], candidates: Sequence[str], threshold: float = 0.20
) -> list[str]:
    """Features that exist, without the candidates missing in more than `threshold` of the rows."""
    present = [c for c in features if c in df.columns]
    tested = [c for c in candidates if c in present]
    if not tested:
        return present
    share = missing_fraction(df, tested).first()
    return [c for c in present if c not in tested or (share[c] or 0.0) <= threshold]


def impute(df: DataFrame, strategies: Mapping[str, str], exact: bool = True, limit: int = BUCKETS) -> DataFrame:
    """Fill missing values with the column's "mode" or "median"."""
    return fill_with(df, fill_values(df, strategies, exact, limit))


def fill_values(
    df: DataFrame,
    strategies: Mapping[str, str],
    exact: bool = True,
    limit: int = BUCKETS,
    gaps: Mapping[str, int] | None = None,
) -> dict[str, object]:
    """Only columns with a missing value are read again for their median or mode.

    `gaps` is the row of `missing_counts`, when the caller has it.
    """
    require_columns(df, *strategies)
    unknown = set(strategies.values()) - {"mode", "median"}
    if unknown:
        raise ValueError(f"unknown strategy: {sorted(unknown)}")
    if not strategies:
        return {}
    gaps = gaps or missing_counts(df, list(strategies)).first().asDict()
    holed = [c for c in strategies if gaps[c]]
    by_mode = [c for c in holed if strategies[c] == "mode"]
    by_median = [c for c in holed if strategies[c] == "median"]
    numbers = df.select(*[number_or_null(F.col(c), df.schema[c].dataType).alias(c) for c in by_median])
    if not by_median:
        medians = {}
    elif exact:
        medians = exact_medians(numbers, by_median, limit)
    else:
        medians = numbers.agg(*[F.percentile_approx(c, 0.5).alias(c) for c in by_median]).first().asDict()
    found = modes(df, by_mode) | medians
    empty = [c for c in holed if found[c] is None]
    if empty and gaps["n_rows"]:
        raise ValueError(f"no value to fill from in: {', '.join(empty)}")
    return found


def fill_with(df: DataFrame, fills: Mapping[str, object]) -> DataFrame:
    df = nan_to_null(df, list(fills))
    return df.withColumns(
        {c: F.coalesce(F.col(c), F.lit(v).cast(df.schema[c].dataType)) for c, v in fills.items()}
    )


def coerce_numeric(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Columns as double; text that is no number becomes NULL."""
    require_columns(df, *cols)
    return df.withColumns({c: number_or_null(F.col(c), df.schema[c].dataType) for c in cols})


@dataclass
class Cleaned:
    df: DataFrame
    features: list[str]
    fills: dict[str, object]
    _kept: Kept

    def unpersist(self) -> None:
        self._kept.unpersist()


def clean(
    df: DataFrame,
    label: str,
    features: Sequence[str],
    codes: Sequence[str] = (),
    candidates: Sequence[str] = (),
    threshold: float = 0.20,
    carry: Sequence[str] = (),
    drop_missing_target: bool = False,
    limit: int = BUCKETS,
) -> Cleaned:
    """Deduplicate, binarise, choose features, impute, coerce, drop incomplete rows - in this order.

    `carry` columns (row keys) pass through unchanged. The deduplicated, pruned table is written once for
    the passes that follow, so that its shuffle runs once; call `unpersist` after the last use.
    """
    require_columns(df, label, *carry)
    rows = deduplicate(df)
    wanted = [c for c in features if c in df.columns]
    carry = [c for c in carry if c not in wanted and c != label]
    kept = Kept(rows.select(*carry, *wanted, label))
    named = binarise(kept.df, label, only_if_multiclass=True, drop_missing_target=drop_missing_target)
    gaps = missing_counts(named, [*wanted, label]).first().asDict()
    tested = [c for c in candidates if c in wanted]
    chosen = [c for c in wanted if c not in tested or gaps[c] / max(gaps["n_rows"], 1) <= threshold]
    named = named.select(*carry, *chosen, label)
    strategies = {c: "mode" if c in codes else "median" for c in [*chosen, label]}
    fills = fill_values(named, strategies, limit=limit, gaps=gaps)
    done = coerce_numeric(fill_with(named, fills), [*chosen, label])
    done = done.dropna("any", subset=[*chosen, label]).withColumn(label, F.col(label).cast("int"))
    return Cleaned(done, chosen, fills, kept)


def validate_domain(df: DataFrame, row_id: str, domains: Mapping) -> DataFrame:
    """(row_id, feature, value, rule) for each value outside its range, step grid or code list."""
    require_columns(df, row_id)
    names = [c for c in domains if c in df.columns]
    checks = []
    for c in names:
        d, x = domains[c], F.col(c).cast("double")
        if d.options is not None:
            rule = F.when(~x.isin([float(o) for o in d.options]), F.lit("option"))
        else:
            steps = (x - F.lit(float(d.low))) / F.lit(float(d.step))
            rule = (
                F.when(x < float(d.low), F.lit("below"))
                .when(x > float(d.high), F.lit("above"))
                .when(F.abs(steps - F.round(steps)) > 1e-6, F.lit("step"))
            )
        rule = F.when(x.isNull(), F.lit("missing")).otherwise(rule)
        checks.append(F.struct(F.lit(c).alias("feature"), x.alias("value"), rule.alias("rule")))
    # The failing checks are kept inside the row: a clean row leaves the scan without being exploded.
    failed = F.filter(F.array(*checks), lambda s: s["rule"].isNotNull())
    return nan_to_null(df, names).select(row_id, F.inline(failed))

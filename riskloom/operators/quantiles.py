"""Exact percentiles, medians and modes on tables of any size."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.columns import nan_to_null
from riskloom.functions.session import cut_lineage

# Buckets into which a range of values is cut in a round.
BUCKETS = 8192
# Ranges, of a few numbers each, that are held at hand and sent to every task; more are joined by shuffle over salts.
SENT_RANGES = 10_000
SALTS = 16


def _scale(value: Column) -> Column:
    """A number in the order of the values: logarithms of both signs, moved apart so that 0 lies between them."""
    size = F.least(F.log2(F.abs(value)), F.lit(1100.0)) + 1100.0
    return F.when(value == 0, F.lit(0.0)).when(value < 0, -size).otherwise(size)


def _bucket(value: Column, lo: Column, hi: Column, even: Column, first: Column, last: Column, buckets: int) -> Column:
    """Bucket of a value in lo..hi. Each step keeps the order, and lo and hi have different buckets."""
    at = F.when(even, (value - lo) / (hi - lo)).otherwise((_scale(value) - first) / (last - first))
    return F.least(F.floor(at * buckets), F.lit(buckets - 1)).cast("int")


def _settled(r: Column) -> Column:
    """Value of rank r in a range, if its ends tell it: the first and last rank, and any rank where the ends are equal."""
    lo, hi, below, count = (F.col(c) for c in ("lo", "hi", "below", "count"))
    return F.when((r == below) | (lo == hi), lo).when(r == below + count - 1, hi)


def exact_percentiles(
    df: DataFrame, cols: Sequence[str], probs: Sequence[float], by: Sequence[str] = (), limit: int = BUCKETS
) -> DataFrame:
    """Interpolated percentiles per group: columns (by..., feature, q array<double>).

    Selection by counting, for all cells (a group's values of one column) at the same time. A round cuts every open
    range of values into `limit` buckets, counts them with their least and greatest values, and goes on with the buckets
    in which a wanted rank lies. Any cut that keeps the order gives the exact value; a wide range is cut on a scale of
    logarithms and one within a factor of two evenly, so that the number of passes depends on the digits of the values,
    not on rows, groups or columns: codes take one, prices two, any doubles at most six. Counts are combined before
    their shuffle, so no value and no group loads one task, and what leaves a round is a few numbers per cell.
    """
    by, cols, probs, buckets = list(by), list(cols), [float(p) for p in probs], max(16, limit)
    group = F.struct(F.lit(0).alias("_"), *by).alias("_by")
    values = [f"_v{i}" for i in range(len(cols))]
    wide = nan_to_null(df.select(group, *[F.col(c).cast("double").alias(v) for c, v in zip(cols, values)]), values)
    measures = [f(v).alias(name + v) for v in values for name, f in (("n", F.count), ("lo", F.min), ("hi", F.max))]
    # A table without rows still has its one group when it is not grouped.
    ends = wide.groupBy("_by").agg(*measures) if by else wide.agg(*measures).withColumn("_by", F.struct(F.lit(0).alias("_")))
    each = F.array(*[F.struct(F.lit(i).alias("_c"), *[F.col(name + v).alias(name) for name in ("n", "lo", "hi")]) for i, v in enumerate(values)])
    cells, _ = _kept(ends.select("_by", F.inline(each)).withColumn("_cell", F.monotonically_increasing_id()))

    place = lambda p: F.lit(p) * (F.col("n") - 1)
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(place(p)).cast("long"), F.ceil(place(p)).cast("long")) for p in probs])))
    state = cells.where("n > 0").select("_cell", F.lit(0).cast("long").alias("below"), F.col("n").alias("count"), "lo", "hi", ranks.alias("ranks"))
    answers = None
    while True:
        pairs = F.transform("ranks", lambda r: F.struct(r.alias("rank"), _settled(r).alias("value")))
        done = state.select("_cell", F.inline(F.filter(pairs, lambda s: s["value"].isNotNull())))
        answers = done if answers is None else answers.unionByName(done)
        open_, count = _kept(state.withColumn("ranks", F.filter("ranks", lambda r: _settled(r).isNull())).where(F.size("ranks") > 0))
        if not count:
            break
        state, _ = _kept(_round(wide, values, cells, open_, buckets, count <= SENT_RANGES))

    mapped = answers.groupBy("_cell").agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("_at"))
    at = lambda r: F.element_at("_at", r.cast("long"))

    def answer(p: float) -> Column:
        first, last = at(F.floor(place(p))), at(F.ceil(place(p)))
        share = place(p) - F.floor(place(p))
        return F.when(share == 0, first).otherwise(first * (1 - share) + last * share)

    named = F.element_at(F.array(*map(F.lit, cols)), F.col("_c") + 1)
    q = F.when(F.col("n") > 0, F.array(*map(answer, probs)))
    return cells.join(mapped, "_cell", "left").select(*[F.col("_by")[b].alias(b) for b in by], named.alias("feature"), q.alias("q"))


def _kept(df: DataFrame) -> tuple[DataFrame, int]:
    """A table of a few numbers per cell, and its rows: at hand when they are few, else written once."""
    rows = df.limit(SENT_RANGES + 1).toArrow()
    if rows.num_rows <= SENT_RANGES:
        return df.sparkSession.createDataFrame(rows, df.schema), rows.num_rows
    written = cut_lineage(df)
    return written, written.count()


def _round(wide: DataFrame, values: Sequence[str], cells: DataFrame, open_: DataFrame, buckets: int, few: bool) -> DataFrame:
    """The buckets of the open ranges in which ranks lie."""
    lo, hi = F.col("lo"), F.col("hi")
    # Ends of the same sign within a factor of two.
    even = ((lo > 0) & (hi / 2 <= lo)) | ((hi < 0) & (lo / 2 >= hi))
    ranges = open_.select("_cell", "below", "lo", "hi", even.alias("even"), _scale(lo).alias("first"), _scale(hi).alias("last"))
    # One row per group, with the open ranges of its columns: a row of the table meets one row and unfolds into them.
    groups = (
        cells.select("_cell", "_by", "_c").join(ranges, "_cell").groupBy("_by")
        .agg(F.collect_list(F.struct("_c", "_cell", "below", "lo", "hi", "even", "first", "last")).alias("_open"))
    )
    if few:
        near = wide.join(F.broadcast(groups), "_by")
    else:
        spread = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        near = wide.withColumn("_salt", F.pmod(F.xxhash64(*values), F.lit(SALTS)).cast("int")).join(spread, ["_by", "_salt"])
    long = near.select(F.array(*values).alias("_all"), F.explode("_open").alias("_o"))
    long = long.select(F.element_at("_all", F.col("_o._c") + 1).alias("_v"), "_o.*").where(F.col("_v").between(lo, hi))
    bucket = _bucket(F.col("_v"), lo, hi, F.col("even"), F.col("first"), F.col("last"), buckets)
    counted = long.groupBy("_cell", "below", bucket.alias("bucket")).agg(F.count("*").alias("count"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    along = Window.partitionBy("_cell", "below").orderBy("bucket")
    counted = counted.withColumn("run", F.sum("count").over(along) - F.col("count"))
    here = counted.join(open_.select("_cell", "below", "ranks"), ["_cell", "below"]).withColumn("below", F.col("below") + F.col("run"))
    inside = F.filter("ranks", lambda r: (r >= F.col("below")) & (r < F.col("below") + F.col("count")))
    return here.withColumn("ranks", inside).where(F.size("ranks") > 0).select("_cell", "below", "count", "lo", "hi", "ranks")


def exact_medians(df: DataFrame, cols: Sequence[str], limit: int = BUCKETS) -> dict[str, float | None]:
    rows = exact_percentiles(df, cols, [0.5], limit=limit).collect()
    return {r["feature"]: (r["q"][0] if r["q"] else None) for r in rows}


def modes(df: DataFrame, cols: Sequence[str]) -> dict:
    """Most frequent value per column, the smallest among ties. Counts are combined before the
    shuffle, so neither a hot code nor many codes load one task."""
    out = {}
    by_type: dict[str, list[str]] = {}
    for c in cols:
        by_type.setdefault(df.schema[c].dataType.simpleString(), []).append(c)
    for same in by_type.values():
        counts = (
            nan_to_null(df.select(*same))
            .unpivot([], same, "feature", "value")
            .where(F.col("value").isNotNull())
            .groupBy("feature", "value")
            .count()
        )
        best = counts.groupBy("feature").agg(
            F.min_by("value", F.struct((-F.col("count")).alias("n"), F.col("value"))).alias("mode")
        )
        out.update({r["feature"]: r["mode"] for r in best.collect()})
    return {c: out.get(c) for c in cols}

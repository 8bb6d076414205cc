"""Exact stratified split that does not depend on how the rows are partitioned."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.columns import require_columns

# Leading digits counted per pass: 16^3 groups per class leave each task.
PREFIX_STEP = 3
LISTED_HASHES = 100_000


def row_hash(seed: int, keys: Sequence[str]) -> Column:
    """Text hash of the seed and the row key, the same in any engine that has md5."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]))


def test_counts(class_counts: Mapping, test_fraction: float) -> dict:
    """Test rows per class: ceil(fraction * n) in all; train shares by largest remainder."""
    total = sum(class_counts.values())
    n_train = total - math.ceil(test_fraction * total)
    shares = {c: n * n_train / total for c, n in class_counts.items()}
    train = {c: math.floor(s) for c, s in shares.items()}
    spare = n_train - sum(train.values())
    ranked = sorted(class_counts, key=lambda c: (-(shares[c] - train[c]), c))
    for c in ranked[:spare]:
        train[c] += 1
    return {c: n - train[c] for c, n in class_counts.items()}


def _thresholds(df: DataFrame, label: str, wanted: dict) -> dict:
    """Per class, the hash of its last test row.

    The hash is a uniform hexadecimal number, so counting rows per leading digits and going into the
    digits that hold the boundary finds it in two or three counting passes; no class is sorted.
    """
    found, prefix, taken = {}, {c: "" for c, k in wanted.items() if k > 0}, {c: 0 for c in wanted}
    while prefix:
        depth = len(next(iter(prefix.values()))) + PREFIX_STEP
        inside = F.lit(False)
        for c, p in prefix.items():
            inside = inside | ((F.col(label) == F.lit(c)) & F.col("_h").startswith(p))
        counts = df.where(inside).groupBy(label, F.substring("_h", 1, depth).alias("p")).agg(F.count("*").alias("n"))
        # At most 16^3 rows per class.
        order = Window.partitionBy(label).orderBy("p")
        need = F.lit(0)
        for c in prefix:
            need = F.when(F.col(label) == F.lit(c), F.lit(wanted[c] - taken[c])).otherwise(need)
        upto = counts.withColumn("upto", F.sum("n").over(order)).where(
            (F.col("upto") >= need) & (F.col("upto") - F.col("n") < need)
        )
        nxt, listed = {}, {}
        for r in upto.collect():
            c = r[label]
            taken[c] += r["upto"] - r["n"]
            if r["n"] <= LISTED_HASHES:
                listed[c] = r["p"]
            elif depth >= 32:
                raise ValueError(f"the split keys do not identify a row: {r['n']} rows share {r['p']}")
            else:
                nxt[c] = r["p"]
        if listed:
            inside = F.lit(False)
            for c, p in listed.items():
                inside = inside | ((F.col(label) == F.lit(c)) & F.col("_h").startswith(p))
            rows = df.where(inside).groupBy(label).agg(F.array_sort(F.collect_list("_h")).alias("hs")).collect()
            for r in rows:
                c, hs, k = r[label], r["hs"], wanted[r[label]] - taken[r[label]]
                if k < len(hs) and hs[k] == hs[k - 1]:
                    raise ValueError("the split keys do not identify a row; deduplicate or add key columns")
                found[c] = hs[k - 1]
        prefix = nxt
    return found


def stratified_split(
    df: DataFrame, label: str, keys: Sequence[str], test_fraction: float = 0.2, seed: int = 42
) -> DataFrame:
    """Adds `split` = 'test' or 'train'; class shares as exact as whole rows allow.

    `keys` must identify a row. What remains for the rows is a comparison of the row's own hash with
    its class's boundary: no shuffle, and the same answer on any cluster and after any retry.
    """
    require_columns(df, label, *keys)
    if not 0 < test_fraction < 1:
        raise ValueError("test_fraction must lie between 0 and 1")
    counts = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count("*").alias("n")).collect()}
    if None in counts:
        raise ValueError(f"{label} has missing values; clean the table first")
    if not counts:
        return df.withColumn("split", F.lit("train"))
    h = row_hash(seed, keys)
    bounds = _thresholds(df.select(label, h.alias("_h")), label, test_counts(counts, test_fraction))
    is_test = F.lit(False)
    for c, bound in bounds.items():
        is_test = is_test | ((F.col(label) == F.lit(c)) & (h <= F.lit(bound)))
    return df.withColumn("split", F.when(is_test, "test").otherwise("train"))


def class_quotas(class_counts: Mapping, most: int) -> dict:
    """`most` rows dealt over the classes by largest remainder, none of which is left without a row."""
    total = sum(class_counts.values())
    shares = {c: n * most / total for c, n in class_counts.items()}
    quotas = {c: math.floor(s) for c, s in shares.items()}
    spare = most - sum(quotas.values())
    for c in sorted(class_counts, key=lambda c: (-(shares[c] - quotas[c]), c))[:spare]:
        quotas[c] += 1
    return {c: min(class_counts[c], max(1, k)) for c, k in quotas.items()}


def first_rows(df: DataFrame, label: str, keys: Sequence[str], most: int, seed: int = 42) -> DataFrame:
    """The `most` rows that come first by the hash of their key, each class with its share and at least one row.

    Exact for any number of rows: the boundary hash of a class is found by counting, and rows are compared with it.
    """
    require_columns(df, label, *keys)
    counts = {r[label]: r["n"] for r in df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n")).collect()}
    if sum(counts.values()) <= most:
        return df
    # Not the hash of the split, whose train rows all lie above its boundary.
    h = row_hash(seed, keys)
    h = F.md5(F.concat(h, F.lit("first")))
    bounds = _thresholds(df.select(label, h.alias("_h")), label, class_quotas(counts, most))
    keep = F.lit(False)
    for c, bound in bounds.items():
        keep = keep | ((F.col(label) == F.lit(c)) & (h <= F.lit(bound)))
    return df.where(keep)


def split_frames(df: DataFrame, *args, **kwargs) -> tuple[DataFrame, DataFrame]:
    marked = stratified_split(df, *args, **kwargs)
    part = {s: marked.where(F.col("split") == s).drop("split") for s in ("train", "test")}
    return part["train"], part["test"]

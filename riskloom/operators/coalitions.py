"""Attribution of any score by weighted least squares over coalitions of features (Lundberg and Lee, 2017)."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import combinations
from math import comb

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.columns import require_columns
from riskloom.functions.session import BROADCAST_ROWS

# With so many features all coalitions are asked; with more, this many.
ALL_FEATURES = 10
COALITIONS = 1024


def chosen_coalitions(d: int, most: int = COALITIONS, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """(coalitions as 0/1 rows, weights) besides the empty and the full one.

    The kernel gives small and large coalitions the most weight, so whole sizes are taken from both ends as long as they
    fit; the sizes between are drawn in pairs with their complements and share the weight that is left to them.
    """
    kernel = {s: (d - 1) / (s * (d - s)) for s in range(1, d)}
    rows, weights, size = [], [], 1
    room = (1 << d) if d <= ALL_FEATURES else most
    while size <= d - size:
        both = {size, d - size}
        if len(rows) + sum(comb(d, s) for s in both) > room:
            break
        for s in both:
            for members in combinations(range(d), s):
                rows.append([int(j in members) for j in range(d)])
                weights.append(kernel[s] / comb(d, s))
        size += 1
    between = list(range(size, d - size + 1))
    if between and len(rows) < room:
        rng, drawn = np.random.default_rng(seed), {}
        mass = np.array([kernel[s] for s in between])
        pairs = max(1, (room - len(rows)) // 2)
        for _ in range(pairs):
            inside = np.zeros(d, dtype=int)
            inside[rng.choice(d, rng.choice(between, p=mass / mass.sum()), replace=False)] = 1
            for z in (inside, 1 - inside):
                drawn[tuple(z.tolist())] = drawn.get(tuple(z.tolist()), 0) + 1
        for z, n in drawn.items():
            rows.append(list(z))
            weights.append(mass.sum() * n / (2 * pairs))
    return np.array(rows, dtype=int).reshape(-1, d), np.array(weights)


def solution(rows: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The least-squares solution as a matrix: attributions = matrix @ (values of the empty, the full, and the given coalitions).

    The attributions add up to the difference between the full and the empty coalition. All records share the
    coalitions, so the normal equations are the same for all and are solved once.
    """
    d = rows.shape[1]
    if d == 1:
        return np.array([[-1.0, 1.0]])
    scaled = rows.T * weights
    inverse = np.linalg.pinv(scaled @ rows)
    fit = inverse @ scaled
    share = inverse.sum(axis=1) / inverse.sum()
    fit = fit - np.outer(share, fit.sum(axis=0))
    return np.column_stack([-share - fit.sum(axis=1), share, fit])


def coalition_sums(
    df: DataFrame, row_id: str, features: Sequence[str], score_fn: Callable[[DataFrame], DataFrame], background: DataFrame,
    most: int = COALITIONS, seed: int = 42,
) -> DataFrame:
    """(row_id, _g0, _g1, ...): the base value and each feature's attribution.

    A coalition's value is the mean score of the record with the other features taken from each background row, by its
    weight: every background row weighs in, and the base is the weighted mean score of the background. `score_fn` adds
    `probability` to a table whose rows `_walk` names. A record's sums are combined before their only shuffle.
    """
    features = list(features)
    require_columns(df, row_id, *features)
    points = background.limit(BROADCAST_ROWS + 1).collect()
    if len(points) > BROADCAST_ROWS:
        raise ValueError("summarise the background first; see background_summary")
    if not points:
        raise ValueError("the background has no rows")
    d = len(features)
    rows, weights = chosen_coalitions(d, most, seed)
    matrix = solution(rows, weights)
    masks = [0, (1 << d) - 1, *[int(sum(int(b) << j for j, b in enumerate(z))) for z in rows]][: matrix.shape[1]]
    total = float(sum(p["weight"] for p in points))
    others = F.array(*[F.struct(F.lit(p["weight"] / total).alias("w"), *[F.lit(float(p[c])).alias(f"x{j}") for j, c in enumerate(features)]) for p in points])
    asked = F.array(*[
        F.struct(F.lit(m).alias("mask"), F.array(*[F.lit(float(a)) for a in matrix[:, i]]).alias("share")) for i, m in enumerate(masks)
    ])
    long = (
        df.select(row_id, *[F.col(c).cast("double").alias(c) for c in features])
        .select("*", F.posexplode(asked).alias("_at", "_c"))
        .select("*", F.posexplode(others).alias("_b", "_o"))
        .withColumn("_walk", F.concat_ws("|", F.col(row_id).cast("string"), "_at", "_b"))
    )
    mixed = long.withColumns({
        c: F.when(F.col("_c.mask").bitwiseAND(F.lit(1 << j)) != 0, F.col(c)).otherwise(F.col(f"_o.x{j}")) for j, c in enumerate(features)
    })
    gain = F.col("probability") * F.col("_o.w")
    return score_fn(mixed).groupBy(row_id).agg(
        F.sum(F.when(F.col("_c.mask") == 0, gain)).alias("_g0"),
        *[F.sum(gain * F.get("_c.share", F.lit(j))).alias(f"_g{j + 1}") for j in range(d)],
    )

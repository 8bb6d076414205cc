"""Attribution of a score to its features."""

from __future__ import annotations

import uuid
import warnings
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.columns import fixed, require_columns
from riskloom.functions.session import BROADCAST_ROWS, checkpoint_dir
from riskloom.operators.coalitions import COALITIONS, coalition_sums
from riskloom.operators.models import FEATURES, Fitted, assembled
from riskloom.operators.trees import LEAVES_PER_PART, Tree, with_attributions

# Leaves of an ensemble that travel with one function.
LEAVES_PER_CALL = LEAVES_PER_PART


def _long(
    df: DataFrame, row_id: str, features: Sequence[str], phis, base, space: str, top: int | None = None
) -> DataFrame:
    """(row_id, feature, phi, base_value, output_space), one row per feature.

    With `top` only the largest |phi| of each record leave it, ranked as by `top_contributions`:
    they are sorted inside the record, so nothing is shuffled.
    """
    structs = [
        F.struct(F.abs(p).alias("size"), F.lit(f).alias("feature"), p.alias("phi")) for f, p in zip(features, phis)
    ]
    items = F.array(*structs)
    if top is not None:
        larger_first = lambda a, b: (
            F.when(a["size"] > b["size"], -1).when(a["size"] < b["size"], 1)
            .when(a["feature"] < b["feature"], -1).when(a["feature"] > b["feature"], 1).otherwise(0)
        )
        items = F.slice(F.array_sort(items, larger_first), 1, top)
    ranked = df.select(row_id, base.alias("base_value"), F.posexplode(items).alias("_at", "_item"))
    out = ranked.select(
        row_id, "_item.feature", "_item.phi", "base_value", F.lit(space).alias("output_space"), "_at"
    )
    if top is None:
        return out.drop("_at")
    return _directed(out.withColumn("rank", F.col("_at") + 1).drop("_at"))


def _directed(df: DataFrame) -> DataFrame:
    return df.withColumn("direction", F.when(F.col("phi") > 0, "raises").otherwise("lowers")).withColumn(
        "text", fixed(F.col("phi"), 3, signed=True)
    )


def explain_linear(
    df: DataFrame,
    row_id: str,
    features: Sequence[str],
    weights: Sequence[float],
    means: Sequence[float],
    intercept: float = 0.0,
    top: int | None = None,
) -> DataFrame:
    """phi = weight * (value - training mean), in log-odds; with the base value they sum to the score."""
    require_columns(df, row_id, *features)
    phis = [F.lit(float(w)) * (F.col(c) - F.lit(float(m))) for c, w, m in zip(features, weights, means)]
    base = F.lit(float(intercept) + float(sum(w * m for w, m in zip(weights, means))))
    return _long(df, row_id, features, phis, base, "log_odds", top)


def trees_of(fitted: Fitted) -> tuple[list[Tree], str]:
    """The trees of a fitted tree model in arrays, their weights already in the leaves, and the space they add up in."""
    model, boosted = fitted.model.model, fitted.spec.kind == "gbt"
    spark = fitted.scaler.sparkSession
    path = f"{checkpoint_dir(spark)}/tree-{uuid.uuid4().hex}"
    model.write().save(path)
    data = spark.read.parquet(f"{path}/data")
    if "nodeData" in data.columns:
        data = data.select("treeID", "nodeData.*")
    else:
        data = data.withColumn("treeID", F.lit(0))
    # A regression node holds its count first; class counts add up.
    stats = F.col("impurityStats")
    cover = stats[0] if boosted else F.aggregate(stats, F.lit(0.0), lambda a, b: a + b)
    value = F.col("prediction") if boosted else stats[1] / cover
    rows = data.select(
        "treeID", "id", "split.featureIndex", "split.numCategories", "split.leftCategoriesOrThreshold",
        "leftChild", "rightChild", value.alias("value"), cover.alias("cover"),
    ).orderBy("treeID", "id")
    nodes: dict[int, list[tuple]] = {}
    for r in rows.toLocalIterator():
        leaf = r["leftChild"] < 0
        if not leaf and r["numCategories"] != -1:
            raise ValueError("a split on categories has no threshold; index such a column as numbers")
        cut = (-1, 0.0) if leaf else (r["featureIndex"], r["leftCategoriesOrThreshold"][0])
        nodes.setdefault(r["treeID"], []).append((*cut, r["leftChild"], r["rightChild"], r["value"], r["cover"]))
    trees = [Tree.of(nodes[t]) for t in sorted(nodes)]
    if boosted:
        # Twice the sum of the weighted trees is the log-odds of this loss.
        return [t.times(2.0 * w) for t, w in zip(trees, model.treeWeights)], "log_odds"
    return [t.times(1.0 / len(trees)) for t in trees], "probability"


def attribute_trees(
    df: DataFrame, row_id: str, features: Sequence[str], trees: Sequence[Tree], space: str, top: int | None = None
) -> DataFrame:
    """Exact path-dependent attribution of rows by any trees; the base value is their mean by cover."""
    require_columns(df, row_id, *features)
    rows = with_attributions(df, [row_id], features, trees, "_phi", LEAVES_PER_CALL)
    phis = [F.col("_phi")[i] for i in range(len(features))]
    return _long(rows, row_id, features, phis, F.lit(sum(t.expected() for t in trees)), space, top)


def explain_tree(df: DataFrame, row_id: str, fitted: Fitted, top: int | None = None) -> DataFrame:
    """Path-dependent attribution of scaled rows by a fitted tree, forest or boosted model."""
    trees, space = trees_of(fitted)
    return attribute_trees(df, row_id, fitted.features, trees, space, top)


def _neighbours(df: DataFrame, features: Sequence[str], centres: list[list[float]]) -> DataFrame:
    """(feature, centroid, below, above): the values next to each coordinate, in one pass over the rows."""

    def of_batch(batches):
        at = np.array(centres)
        for rows in batches:
            for j, c in enumerate(features):
                v = np.sort(rows[c].dropna().to_numpy(dtype=float))
                if len(v):
                    low, high = np.searchsorted(v, at[:, j], "right") - 1, np.searchsorted(v, at[:, j], "left")
                    yield pd.DataFrame({
                        "feature": j, "centroid": range(len(at)),
                        "below": np.where(low >= 0, v[np.maximum(low, 0)], -np.inf),
                        "above": np.where(high < len(v), v[np.minimum(high, len(v) - 1)], np.inf),
                    })

    found = df.select(*[F.col(c).cast("double").alias(c) for c in features]).mapInPandas(
        of_batch, "feature int, centroid int, below double, above double"
    )
    return found.groupBy("feature", "centroid").agg(F.max("below").alias("below"), F.min("above").alias("above"))


def background_summary(
    df: DataFrame, features: Sequence[str], k: int = 50, seed: int = 42, round_values: bool = True
) -> DataFrame:
    """(centroid, weight, features...): k-means centres weighted by cluster size.

    With `round_values` each coordinate moves to the nearest value that occurs in that column; the
    neighbours of all coordinates come from one pass without a shuffle of rows.
    """
    n = df.limit(k).count()
    if not n:
        raise ValueError("no rows to summarise")
    model = KMeans(k=n, seed=seed, featuresCol=FEATURES).fit(assembled(df, features))
    centres = [list(map(float, c)) for c in model.clusterCenters()]
    sizes = model.summary.clusterSizes
    if round_values:
        for r in _neighbours(df, features, centres).collect():
            x, j = centres[r["centroid"]], r["feature"]
            x[j] = min((v for v in (r["below"], r["above"]) if v is not None), key=lambda v: abs(v - x[j]))
    total = float(sum(sizes))
    rows = [(i, s / total, *c) for i, (s, c) in enumerate(zip(sizes, centres)) if s]
    columns = ", ".join(f"`{c}` double" for c in features)
    return df.sparkSession.createDataFrame(rows, f"centroid int, weight double, {columns}")


def summary_of(fitted: Fitted, seed: int = 42) -> DataFrame:
    """The background of a fitted model: summarised from its training rows, or as it was saved."""
    if fitted.background is None:
        raise ValueError("the fitted model carries no background table")
    if "weight" in fitted.background.columns:
        return fitted.background
    return background_summary(fitted.background, fitted.features, seed=seed)


def explain_sampled(
    df: DataFrame,
    row_id: str,
    features: Sequence[str],
    score_fn: Callable[[DataFrame], DataFrame],
    background: DataFrame,
    n_perm: int = 20,
    seed: int = 42,
    top: int | None = None,
    gains_of: Callable[[np.ndarray, np.ndarray], Column] | None = None,
) -> DataFrame:
    """Attribution of any model by random feature orders (Strumbelj and Kononenko, 2014).

    Each row is scored along `n_perm` orders in which its features replace those of a background row
    one by one. All rows walk the same orders from the same background rows, which lie evenly over the weights, so they
    share one base value: the mean score of those background rows. `score_fn` adds `probability` to a table whose rows `_walk` names. A step's gain is written as two signed
    entries, so neighbours need no window, and the sums are combined before their only shuffle. A model that can walk all
    orders inside a row gives `gains_of` (background points, orders), a column of the sums over walks of the first score and of
    each feature's gains; its steps are no rows then.
    """
    features = list(features)
    require_columns(df, row_id, *features)
    points = background.limit(BROADCAST_ROWS + 1).collect()
    if len(points) > BROADCAST_ROWS:
        raise ValueError("summarise the background first; see background_summary")
    points.sort(key=lambda p: [float(p[c]) for c in features])
    d, rng = len(features), np.random.default_rng(seed)
    upto = np.cumsum([p["weight"] for p in points])
    # Rounding may leave the last running weight a hair below the total.
    at = np.minimum(np.searchsorted(upto, (np.arange(n_perm) + 0.5) / n_perm * upto[-1], "right"), len(points) - 1)
    starts = [[float(points[i][c]) for c in features] for i in at]
    orders = [rng.permutation(d).tolist() for _ in at]
    phis = [F.col(f"_g{j + 1}") for j in range(d)]
    if gains_of is not None:
        walked = df.select(row_id, gains_of(np.array(starts), np.array(orders)).alias("_gains"))
        sums = walked.groupBy(row_id).agg(*[(F.sum(F.col("_gains")[j]) / n_perm).alias(f"_g{j}") for j in range(d + 1)])
        return _long(sums, row_id, features, phis, F.col("_g0"), "probability", top)
    plan = [
        F.struct(F.array(*map(F.lit, x)).alias("x"), F.array(*map(F.lit, turns)).alias("turns"))
        for x, turns in zip(starts, orders)
    ]
    walks = (
        df.select(row_id, *[F.col(c).cast("double").alias(c) for c in features])
        .select("*", F.posexplode(F.array(*plan)).alias("_perm", "_plan"))
        .withColumn("_other", F.col("_plan.x"))
        .withColumn("_turns", F.col("_plan.turns"))
        .drop("_plan")
        .withColumn("_step", F.explode(F.sequence(F.lit(0), F.lit(d))))
        .withColumn("_walk", F.concat_ws("|", F.col(row_id).cast("string"), "_perm", "_step"))
    )
    mixed = walks.withColumns(
        {
            c: F.when(F.array_position("_turns", F.lit(j)) <= F.col("_step"), F.col(c)).otherwise(F.col("_other")[j])
            for j, c in enumerate(features)
        }
    ).drop("_other")
    # A score is the end of one feature's step and the start of the next one's.
    p, step = F.col("probability"), F.col("_step")
    entry = lambda at, sign: F.struct(F.element_at("_turns", at).alias("j"), (sign * p).alias("gain"))
    start = F.struct(F.lit(-1).alias("j"), p.alias("gain"))
    signed = (
        F.when(step == 0, F.array(start, entry(F.lit(1), -1)))
        .when(step == d, F.array(entry(F.lit(d), 1)))
        .otherwise(F.array(entry(F.greatest(step, F.lit(1)), 1), entry(F.least(step + 1, F.lit(d)), -1)))
    )
    sums = (
        score_fn(mixed)
        .select(row_id, F.inline(signed))
        .groupBy(row_id)
        .agg(*[(F.sum(F.when(F.col("j") == j, F.col("gain"))) / n_perm).alias(f"_g{j + 1}") for j in range(-1, d)])
    )
    return _long(sums, row_id, features, phis, F.col("_g0"), "probability", top)


def explain_coalitions(
    df: DataFrame, row_id: str, features: Sequence[str], score_fn: Callable[[DataFrame], DataFrame], background: DataFrame,
    most: int = COALITIONS, seed: int = 42, top: int | None = None,
) -> DataFrame:
    """Attribution of any model by weighted least squares over coalitions, exact when all of them are asked.

    Costs a score per record, coalition and background row; `explain_sampled` asks far fewer.
    """
    sums = coalition_sums(df, row_id, features, score_fn, background, most, seed)
    phis = [F.col(f"_g{j + 1}") for j in range(len(features))]
    return _long(sums, row_id, list(features), phis, F.col("_g0"), "probability", top)


def explain(
    df: DataFrame, row_id: str, fitted: Fitted, n_perm: int = 20, seed: int = 42, top: int | None = None
) -> DataFrame:
    """Attribution of scaled rows by the way that suits the model; one it does not suit, or unknown, is sampled."""
    how = fitted.spec.explains
    if how == "linear":
        inner = fitted.model.model
        # The scaler centres every column on its training mean, so the mean of a scaled column is 0.
        return explain_linear(
            df, row_id, fitted.features, inner.coefficients.toArray(), [0.0] * len(fitted.features), inner.intercept, top
        )
    if how == "tree":
        try:
            return explain_tree(df, row_id, fitted, top)
        except Exception as e:
            warnings.warn(f"{fitted.spec.name}: {e}; its scores are attributed by sampling", stacklevel=2)
    summary = summary_of(fitted, seed)
    predict = fitted.model.predict
    if fitted.spec.kind == "knn":
        predict = lambda rows: fitted.model.predict(rows, "_walk")
    gains_of = fitted.model.walk_gains if fitted.spec.kind == "rbf_svc" else None
    return explain_sampled(df, row_id, fitted.features, predict, summary, n_perm, seed, top, gains_of)


def top_contributions(contrib: DataFrame, row_id: str, k: int = 10) -> DataFrame:
    """The k features with the largest |phi| per record, with direction and signed text.

    For a stored attribution table; `explain(..., top=k)` gives the same rows without a shuffle.
    """
    order = Window.partitionBy(row_id).orderBy(F.abs("phi").desc(), "feature")
    return _directed(contrib.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))


def global_importance(contrib: DataFrame) -> DataFrame:
    return (
        contrib.groupBy("feature").agg(F.avg(F.abs("phi")).alias("importance")).orderBy(F.desc("importance"), "feature")
    )

"""Gaussian-kernel margin classifier on landmark features, fitted by Newton steps that are one aggregate each.

The kernel is approximated on landmarks (Williams and Seeger, 2001): centres of k-means over the training rows, or the
distinct rows themselves where they are no more than the landmarks, which makes the kernel exact. In these features the
hinge loss is rounded at its corner over a width that shrinks from 2 to `CORNERS[-1]`; for each width Newton's method
runs until the decrement of the objective is below the tolerance. Margins and gradients are products with the kernel values
themselves; only rows in the corner, which alone have a curvature, are mapped to the features. A step sums gradients and curvatures of all fits (the
whole one and those without a fold) over the rows in the tasks, then by matrix row, so that the driver gets as many
numbers as the features have pairs, whatever the rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.session import reuse

# Widths over which the corner of the hinge is rounded, one after the other.
CORNERS = (2.0, 0.2, 0.03, 0.005)
# About so many rows give the fit of a larger table its starting point; its own steps take all rows.
START_ROWS = 100_000
# Halvings of a step that are tried together.
HALVINGS = 20


@dataclass
class Landmarks:
    """Places and the map from kernel values there to features whose products approximate the kernel."""

    places: np.ndarray
    lift: np.ndarray
    gamma: float

    @classmethod
    def of(cls, places: np.ndarray, gamma: float) -> Landmarks:
        size, axes = np.linalg.eigh(kernel(places, places, gamma))
        keep = size > 1e-10 * size[-1]
        return cls(places, axes[:, keep] / np.sqrt(size[keep]), gamma)

    def features(self, x: np.ndarray) -> np.ndarray:
        return kernel(x, self.places, self.gamma) @ self.lift


def kernel(a: np.ndarray, b: np.ndarray, gamma: float) -> np.ndarray:
    apart = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None]
    apart -= 2 * (a @ b.T)
    np.maximum(apart, 0, out=apart)
    apart *= -gamma
    return np.exp(apart, out=apart)


def choose_landmarks(train: DataFrame, features: Sequence[str], vector: str, count: int, seed: int) -> np.ndarray:
    """At most ``count`` places: the distinct rows when they are that few, else k-means centres."""
    few = train.select(*features).distinct().limit(count + 1).collect()
    if len(few) <= count:
        return np.array(sorted(tuple(r) for r in few), dtype=float)
    model = KMeans(k=count, seed=seed, featuresCol=vector, maxIter=20, initSteps=2).fit(train.select(vector))
    return np.array(model.clusterCenters())


def rounded_hinge(t: np.ndarray, corner: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Loss of margins, its slope and its curvature."""
    short = 1 - t
    bend = (short > 0) & (short < corner)
    loss = np.where(bend, short * short / (2 * corner), np.maximum(short - corner / 2, 0) * (short >= corner))
    return loss, np.where(bend, -short / corner, -(short >= corner).astype(float)), bend / corner


def step_sums(
    x: np.ndarray, y: np.ndarray, fold: np.ndarray, marks: Landmarks, at: Sequence[np.ndarray], without: Sequence[int], corner: float,
) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each fit the slopes by kernel value with those of the intercept and the sum of losses, and the curvatures by pairs of
    features with the intercept last. A fit leaves out the rows of its fold."""
    near = kernel(x, marks.places, marks.gamma)
    margins = near @ np.stack([marks.lift @ w[:-1] for w in at], axis=1) + np.array([w[-1] for w in at])
    loss, slope, curve = rounded_hinge(y[:, None] * margins, corner)
    mine = fold[:, None] != np.asarray(without)[None]
    slope *= y[:, None] * mine
    curve = curve * mine
    lines = np.vstack([near.T @ slope, slope.sum(axis=0), (loss * mine).sum(axis=0)])
    bent = curve.any(axis=1)
    phi = np.hstack([near[bent] @ marks.lift, np.ones((int(bent.sum()), 1))])
    return [(lines[:, j], (phi.T * c) @ phi) for j, c in enumerate(curve[bent].T)]


def _summed(rows: DataFrame, partial, width: int) -> dict[tuple[int, int], np.ndarray]:
    """Sums over all rows of the arrays that ``partial`` adds to, by (fit, line): first in the tasks, then by line."""
    schema = "fit int, line int, part array<double>"

    def out(sums):
        keys = sorted(sums)
        return pa.RecordBatch.from_pydict({
            "fit": pa.array([k[0] for k in keys], pa.int32()), "line": pa.array([k[1] for k in keys], pa.int32()),
            "part": pa.array([sums[k].tolist() for k in keys], pa.list_(pa.float64())),
        })

    def run(batches):
        sums: dict = {}
        for batch in batches:
            x = batch.column("_x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)
            y, fold = batch.column("_y").to_numpy(zero_copy_only=False), batch.column("_fold").to_numpy(zero_copy_only=False)
            # Pieces of a batch bound the kernel values held at once.
            for a in range(0, len(x), 2_048):
                partial(sums, x[a : a + 2_048], y[a : a + 2_048], fold[a : a + 2_048])
        if sums:
            yield out(sums)

    def merge(batches):
        sums: dict = {}
        for batch in batches:
            for f, i, p in zip(batch.column("fit").to_pylist(), batch.column("line").to_pylist(), batch.column("part")):
                sums[f, i] = sums.get((f, i), 0) + p.values.to_numpy()
        if sums:
            yield out(sums)

    done = rows.mapInArrow(run, schema).repartition("fit", "line").mapInArrow(merge, schema).collect()
    return {(r["fit"], r["line"]): np.array(r["part"]) for r in done}


def fit_from_start(
    rows: DataFrame, key: str, n: int, marks: Landmarks, cost: float, max_steps: int, tol: float, left_out: Sequence[int],
) -> tuple[list[np.ndarray], bool]:
    """As `fit_margins`. Of a table of many rows the steps at the wide corners are taken on about START_ROWS rows, by the hash
    of their key; from there Newton's method goes on over all rows, at the last corner and to the same tolerance."""
    share = n // START_ROWS
    if share < 2:
        return fit_margins(rows, marks, cost, max_steps, tol, left_out)
    few = reuse(rows.where(F.pmod(F.xxhash64(F.lit("start"), F.col(key)), F.lit(share)) == 0))
    held = few.count()
    if not held:
        return fit_margins(rows, marks, cost, max_steps, tol, left_out)
    start, _ = fit_margins(few, marks, cost * n / held, max_steps, tol, left_out)
    few.unpersist()
    return fit_margins(rows, marks, cost, max_steps, tol, left_out, start, CORNERS[-1:])


def fit_margins(
    rows: DataFrame, marks: Landmarks, cost: float, max_steps: int, tol: float, left_out: Sequence[int],
    start: Sequence[np.ndarray] | None = None, corners: Sequence[float] = CORNERS,
) -> tuple[list[np.ndarray], bool]:
    """Weights (the last is the intercept) of the whole fit and of those without each fold in ``left_out``; whether all converged.

    ``rows`` has _x array<double>, _y (1 or -1) and _fold. The objective is half the squared norm of the weights
    without the intercept, plus ``cost`` times the sum of losses.
    """
    width, size = marks.places.shape[1], marks.lift.shape[1] + 1
    without = [-1, *left_out]
    points = [np.zeros(size) for _ in without] if start is None else [w.copy() for w in start]
    ridge = np.append(np.ones(size - 1), 0.0)

    def slopes(at, corner, live):
        def partial(sums, x, y, fold):
            got = step_sums(x, y, fold, marks, [at[f] for f in live], [without[f] for f in live], corner)
            for f, (line, curves) in zip(live, got):
                for i, part in enumerate([line, *curves]):
                    sums[f, i] = sums.get((f, i), 0) + part

        got = _summed(rows, partial, width)
        out = {}
        for f in live:
            line = got.get((f, 0), np.zeros(len(marks.places) + 2)) * cost
            h = np.vstack([got.get((f, i), np.zeros(size)) for i in range(1, size + 1)]) * cost
            w = at[f] * ridge
            out[f] = (line[-1] + w @ at[f] / 2, np.append(marks.lift.T @ line[:-2], line[-2]) + w, h + np.diag(ridge))
        return out

    def losses(at, steps, corner):
        def partial(sums, x, y, fold):
            near = kernel(x, marks.places, marks.gamma)
            for f, d in steps.items():
                mine = fold != without[f]
                here, way = (y[mine] * (near[mine] @ (marks.lift @ w[:-1]) + w[-1]) for w in (at[f], d))
                line = np.array([rounded_hinge(here + way * 0.5**k, corner)[0].sum() for k in range(HALVINGS)])
                sums[f, 0] = sums.get((f, 0), 0) + line

        got = _summed(rows, partial, width)
        out = {}
        for f, d in steps.items():
            tried = [at[f] + d * 0.5**k for k in range(HALVINGS)]
            out[f] = got.get((f, 0), np.zeros(HALVINGS)) * cost + np.array([(w * ridge) @ w / 2 for w in tried])
        return out

    settled = True
    for corner in corners:
        live, before = list(range(len(without))), slopes(points, corner, range(len(without)))
        for _ in range(max_steps):
            steps = {}
            for f in live:
                _, g, h = before[f]
                # Where few rows lie in the corner the intercept has hardly a curvature of its own; its step stays bounded.
                own = abs(g[-1]) if h[-1, -1] < abs(g[-1]) else 0.0
                steps[f] = -np.linalg.solve(h + np.diag((1 - ridge) * (own + 1e-9)), g)
                if -g @ steps[f] <= 2 * tol * max(1.0, abs(before[f][0])):
                    del steps[f]
            live = list(steps)
            if not live:
                break
            far = {f: points[f] + d for f, d in steps.items()}
            after = slopes(far, corner, live)
            short = {f: steps[f] for f in live if not after[f][0] < before[f][0] + 1e-4 * (before[f][1] @ steps[f])}
            if short:
                tried = losses(points, short, corner)
                for f, d in short.items():
                    far[f] = points[f] + d * 0.5 ** int(np.argmin(tried[f])) if tried[f].min() < before[f][0] else points[f]
                stuck = [f for f in short if far[f] is points[f]]
                live = [f for f in live if f not in stuck]
                redone = [f for f in short if f not in stuck]
                # No shorter step helps: the objective's digits end here, or the fit is called unsettled.
                settled &= all(-before[f][1] @ short[f] <= 1e-4 * max(1.0, abs(before[f][0])) for f in stuck)
                if redone:
                    after |= slopes(far, corner, redone)
            for f in live:
                points[f], before[f] = far[f], after[f]
        else:
            settled = False
    return points, settled


def margin_of(x: Column, marks: Landmarks, weights: np.ndarray) -> Column:
    """The margin of a column of feature arrays: one sum over the landmarks for each row."""
    places, alpha, shift, gamma = marks.places, marks.lift @ weights[:-1], float(weights[-1]), marks.gamma
    return margin_at(x, places, alpha, shift, gamma)


def margin_at(x: Column, places: np.ndarray, alpha: np.ndarray, shift: float, gamma: float) -> Column:
    @F.pandas_udf("double")
    def at(xs: pd.Series) -> pd.Series:
        return pd.Series(kernel(np.stack(xs.to_numpy()), places, gamma) @ alpha + shift if len(xs) else [], dtype=float)

    return at(x)


def walk_gains(
    x: Column, points: np.ndarray, turns: np.ndarray, places: np.ndarray, alpha: np.ndarray, shift: float, gamma: float,
    curve: Sequence[float],
) -> Column:
    """Sums over walks of the score at their first step and of what each feature's turn adds, in an array of 1 + features.

    A walk goes from its background point to the row, taking over the row's features in the order of its turns. The kernel is a
    product over features, so that a step changes one factor for each landmark.
    """
    d = places.shape[1]
    factors = lambda v: np.exp(-gamma * (v[:, :, None] - places.T[None]) ** 2)
    theirs, (slope, level) = factors(points), curve
    # What is left of a point's factors after each number of its turns.
    rest = np.ones((len(points), d + 1, len(places)))
    for w, order in enumerate(turns):
        for s in range(d - 1, -1, -1):
            rest[w, s] = rest[w, s + 1] * theirs[w, order[s]]
    rest *= alpha

    def chance(margin):
        return 1.0 / (1.0 + np.exp(-((margin + shift) * slope + level)))

    @F.pandas_udf("array<double>")
    def gains(xs: pd.Series) -> pd.Series:
        out = np.zeros((len(xs), d + 1))
        for a in range(0, len(xs), 256):
            mine = factors(np.stack(xs.iloc[a : a + 256].to_numpy()))
            sums = out[a : a + 256]
            for w, order in enumerate(turns):
                so_far, last = np.ones((len(mine), len(places))), chance(rest[w, 0].sum())
                sums[:, 0] += last
                for s, j in enumerate(order):
                    so_far *= mine[:, j]
                    now = chance(so_far @ rest[w, s + 1])
                    sums[:, 1 + j] += now - last
                    last = now
        return pd.Series(list(out))

    return gains(x)

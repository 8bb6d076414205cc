"""Embedding whitening by spectrum slicing.

Vectors become integers x = floor(64 c) + 1,000,000. The fit list holds each distinct x vector once; Spark counts its
rows and sums, then the products of entries centred at the rounded mean. Both are sums of integers, exact and so equal
under any partitioning; the rest of the centring is exact too, and each entry of the covariance is rounded once.

Components come from the covariance by slicing its spectrum: the inertia of the LDL' factors of the covariance less a
shift counts the eigenvalues on either side of it, bisection on these counts encloses one leading eigenvalue alone,
Rayleigh quotient iteration converges to it, and two further counts, just below and just above, certify its number.
Eigenvalues that no shift can part are a cluster, whose vectors are found together and made orthogonal.

Rows whose vector is null or holds null or non-finite entries are dropped, as are vectors without entries. Rows whose
vector has another length than most vectors (the greater length among ties) cannot share its components and are dropped
as well. Equal vectors count once in the fit and each gets its rows. Components without variance are not returned: an
empty table, a single distinct vector and constant dimensions give fewer rows, not errors. Entries beyond 2**45 in size
are taken as 2**45. ``deviation`` is null where it exceeds a long. Other columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.session import cut_lineage

COMPONENTS = 16
# Distinct vectors whose sums one task makes.
ROWS_PER_TASK = 20_000
# Fixed values of the integer form.
SCALE, OFFSET = 64, 1_000_000
_LARGEST = 1 << 45
_EPS = float(np.finfo(float).eps)
_EXACT = 1 << 53
_LONG = (1 << 63) - 1


@dataclass(frozen=True)
class Whitener:
    """What whitens a row: ``vectors`` has a unit eigenvector in each column, ``values`` its eigenvalues in falling order."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float = 0.0

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact: 64-bit integers where they fit, else Python's."""
        largest = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) * self.n + max((abs(s) for s in self.sums), default=0)
        if largest < 1 << 62:
            return x * self.n - np.array(self.sums, dtype=np.int64)
        return x.astype(object) * self.n - np.array(self.sums, dtype=object)

    def whiten(self, deviations: np.ndarray) -> np.ndarray:
        return (deviations / self.n).astype(float) @ (self.vectors / np.sqrt(self.values))


# ---------------------------------------------------------------------------------------------- spectrum

def inertia(a: np.ndarray) -> tuple[int, int]:
    """Numbers of negative and of zero eigenvalues, off the LDL' factors with symmetric pivots of one or two rows."""
    a, bound = a.copy(), (1 + math.sqrt(17)) / 8
    negative = zero = 0
    while len(a):
        below = np.abs(a[1:, 0])
        most = below.max(initial=0.0)
        pair = False
        if abs(a[0, 0]) < bound * most:
            r = int(below.argmax()) + 1
            row = np.abs(a[r])
            row[r] = 0.0
            reach = row.max()
            if abs(a[0, 0]) * reach < bound * most * most:
                if abs(a[r, r]) >= bound * reach:
                    _swap(a, 0, r)
                else:
                    _swap(a, 1, r)
                    pair = True
        if pair:
            # A pivot of two rows has one eigenvalue of each sign.
            negative += 1
            c = a[2:, :2]
            a = a[2:, 2:] - c @ np.linalg.solve(a[:2, :2], c.T)
        else:
            d, c = a[0, 0], a[1:, 0]
            negative, zero = negative + (d < 0), zero + (d == 0)
            a = a[1:, 1:] - np.outer(c, c) / d if d else a[1:, 1:]
    return negative, zero


def _swap(a: np.ndarray, i: int, j: int) -> None:
    a[[i, j]] = a[[j, i]]
    a[:, [i, j]] = a[:, [j, i]]


def above(v: np.ndarray, shift: float) -> int:
    """How many eigenvalues lie above the shift."""
    shifted = v.copy()
    shifted[np.diag_indices(len(v))] -= shift
    negative, zero = inertia(shifted)
    return len(v) - negative - zero


def _solve(v: np.ndarray, shift: float, b: np.ndarray, size: float) -> np.ndarray:
    """Unit vector along (v - shift)^-1 b; a shift that is an eigenvalue is moved by a rounding error."""
    for k in range(4):
        try:
            z = np.linalg.solve(v - (shift + k * _EPS * size) * np.eye(len(v)), b)
        except np.linalg.LinAlgError:
            continue
        length = np.linalg.norm(z)
        if np.isfinite(length) and length > 0:
            return z / length
    raise ArithmeticError("no solution near this shift")


def _start(d: int, seed: int) -> np.ndarray:
    b = np.cos(np.arange(1, d + 1) * (seed + 1) * 0.7548776662466927) + 0.1
    return b / np.linalg.norm(b)


def _away_from(z: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    for _ in range(2):
        for u in others:
            z = z - (u @ z) * u
    return z / np.linalg.norm(z)


def leading(v: np.ndarray, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The leading eigenvalues above rounding, at most ``most``, in falling order, and their unit vectors in columns."""
    d, size = len(v), float(np.abs(v).sum(axis=1).max(initial=0.0))
    if not size:
        return np.zeros(0), np.zeros((d, 0))
    floor, tie = d * _EPS * size, 8 * d * _EPS * size
    counts = {size * (1 + 4 * _EPS): 0, floor: above(v, floor)}
    wanted = min(most, counts[floor])
    values, vectors = [], []

    def enclose(j: int, finer: float = math.inf) -> tuple[float, float]:
        """Shifts around eigenvalue j alone and not wider than ``finer``, or around the cluster that holds it."""
        while True:
            low = max(s for s, c in counts.items() if c >= j)
            high = min(s for s, c in counts.items() if c < j)
            alone = counts[low] == j and counts[high] == j - 1
            if high - low <= tie or (alone and high - low <= finer):
                return low, high
            middle = (low + high) / 2
            if not low < middle < high:
                return low, high
            counts[middle] = above(v, middle)

    while len(values) < wanted:
        j, width = len(values) + 1, math.inf
        low, high = enclose(j)
        found = None
        while found is None and counts[low] == j and counts[high] == j - 1 and high - low > tie:
            found = _quotients(v, low, high, j, size)
            if found is not None:
                value, z, error = found
                # Numbered for certain: j eigenvalues lie above a shift just below it, j - 1 above one just above it.
                slack = max(4 * error, tie)
                under, over = above(v, value - slack), above(v, value + slack)
                if under < j or over >= j:
                    found = None
            if found is None:
                width = (high - low) / 16
                low, high = enclose(j, width)
        if found is not None:
            near = [u for u, e in zip(vectors, values) if e - value < 1e-3 * size]
            values.append(value)
            vectors.append(_away_from(z, near))
            continue
        # A cluster: as many vectors as the enclosure has eigenvalues, by inverse iteration, each away from the others.
        for i in range(j, min(max(counts[low], j), wanted) + 1):
            z = _away_from(_start(d, i), vectors)
            for _ in range(4):
                z = _away_from(_solve(v, (low + high) / 2, z, size), vectors)
            values.append(float(z @ v @ z))
            vectors.append(z)
    order = sorted(range(len(values)), key=lambda i: -values[i])
    flip = [1.0 if vectors[i][int(np.abs(vectors[i]).argmax())] > 0 else -1.0 for i in order]
    return np.array([values[i] for i in order]), np.array([f * vectors[i] for f, i in zip(flip, order)]).T.reshape(d, len(order))


def _quotients(v: np.ndarray, low: float, high: float, j: int, size: float) -> tuple[float, np.ndarray, float] | None:
    """Rayleigh quotient iteration from the middle of an enclosure; None if it leaves the enclosure."""
    z = _solve(v, (low + high) / 2, _start(len(v), j), size)
    z = _solve(v, (low + high) / 2, z, size)
    best = None
    for _ in range(30):
        value = float(z @ v @ z)
        if not low <= value <= high:
            return None
        error = float(np.linalg.norm(v @ z - value * z))
        if best is not None and error >= best[2] / 2:
            break
        best = (value, z, error)
        z = _solve(v, value, z, size)
    return best if best is not None and best[2] <= 1e-11 * size else None


# ------------------------------------------------------------------------------------------------- Spark

def integer_vectors(rows: DataFrame, vector: str = "embedding", row_id: str = "vec_id") -> DataFrame:
    """(vec_id, x array<long>) of the rows that remain."""
    sound = rows.select(F.col(row_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).filter(F.col("v").isNotNull() & (F.size("v") > 0))
    sound = sound.filter(F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(math.inf))))
    common = sound.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    limit = float(_LARGEST)
    whole = F.transform("v", lambda c: F.floor(F.greatest(F.least(c * SCALE, F.lit(limit)), F.lit(-limit))).cast("long") + F.lit(OFFSET).cast("long"))
    return sound.filter(F.size("v") == (common[0]["d"] if common else 0)).select("vec_id", whole.alias("x"))


def _matrix(batch: pa.RecordBatch, column: str = "x") -> np.ndarray:
    lists = batch.column(column)
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(lists), -1)


def _totals(df: DataFrame, sums_of, kind: str) -> dict[int, object]:
    """Sums over all batches of what ``sums_of`` gives for one, entry by entry; a task sends one list."""
    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                part = sums_of(_matrix(batch))
                total = part if total is None else [a + b for a, b in zip(total, part)]
        if total is not None:
            column = pa.array([str(t) for t in total], pa.string()) if kind == "string" else pa.array(total, pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), column], ["k", "v"])

    value = F.col("v").cast("decimal(38,0)") if kind == "string" else F.col("v")
    found = df.mapInArrow(run, f"k int, v {kind}").groupBy("k").agg(F.sum(value).alias("v")).collect()
    return {r["k"]: int(r["v"]) if kind == "string" else r["v"] for r in found}


def _sums(x: np.ndarray) -> list[int]:
    # Entries are below 2**46, so a batch of under 2**16 rows cannot overflow.
    out = [0] * x.shape[1]
    for i in range(0, len(x), 1 << 16):
        out = [a + b for a, b in zip(out, x[i : i + (1 << 16)].sum(axis=0).tolist())]
    return [len(x), *out]


def _products(y: np.ndarray) -> list[int]:
    """Exact sums of products of all pairs of columns, upper triangle."""
    d = y.shape[1]
    upper = np.triu_indices(d)
    largest = max(1, abs(int(y.max(initial=0))), abs(int(y.min(initial=0))))
    rows = _EXACT // (largest * largest)
    if rows >= 1:
        # Every partial sum of a block is an integer below 2**53, which doubles hold exactly.
        out = [0] * len(upper[0])
        for i in range(0, len(y), min(rows, 1 << 20)):
            block = y[i : i + min(rows, 1 << 20)].astype(float)
            out = [a + int(b) for a, b in zip(out, (block.T @ block)[upper].tolist())]
        return out
    # Large entries go as two halves each: y = high * 2**24 + low.
    high, low = y >> 24, y & 0xFFFFFF
    parts = [_cross(high, high), _cross(high, low), _cross(low, low)]
    whole = [[(parts[0][i][j] << 48) + ((parts[1][i][j] + parts[1][j][i]) << 24) + parts[2][i][j] for j in range(d)] for i in range(d)]
    return [whole[i][j] for i, j in zip(*upper)]


def _cross(a: np.ndarray, b: np.ndarray) -> list[list[int]]:
    """Exact a'b for entries up to 2**24: blocks of 32 rows stay below 2**53."""
    out = np.zeros((a.shape[1], b.shape[1]), dtype=object)
    for i in range(0, len(a), 32):
        out += (a[i : i + 32].astype(float).T @ b[i : i + 32].astype(float)).astype(np.int64).astype(object)
    return out.tolist()


def fit(vectors: DataFrame, most: int = COMPONENTS) -> Whitener:
    """The whitening of (vec_id, x) rows, fitted on their distinct x."""
    distinct = cut_lineage(vectors.select("x").distinct())
    # A task's sums are as many as pairs of dimensions, so a task should have far more rows than that.
    distinct = distinct.coalesce(max(1, -(-distinct.count() // ROWS_PER_TASK)))
    first = _totals(distinct, _sums, "string")
    n, d = first.get(0, 0), len(first) - 1
    if n == 0:
        return Whitener(0, [], np.zeros(0), np.zeros((0, 0)), 0.0)
    sums = [first[i + 1] for i in range(d)]
    centre = [(2 * s + n) // (2 * n) for s in sums]
    second = _totals(distinct, lambda x: _products(x - np.array(centre, dtype=np.int64)), "string")
    rest = [s - n * c for s, c in zip(sums, centre)]
    v = np.zeros((d, d))
    for k, (i, j) in enumerate(zip(*np.triu_indices(d))):
        # Integers up to here; the quotient is rounded once.
        v[i, j] = v[j, i] = (n * second[k] - rest[i] * rest[j]) / (n * n)
    values, columns = leading(v, most)
    made = Whitener(n, sums, values, columns, float(np.trace(v)))
    return Whitener(n, sums, values, columns, made.trace, _identity_error(distinct, made))


def _identity_error(distinct: DataFrame, made: Whitener) -> float:
    """Largest absolute entry of the covariance of the whitened fit list less the identity."""
    k = len(made.values)
    if not k:
        return 0.0

    def sums(x):
        w = made.whiten(made.deviations(x))
        return np.concatenate([w.sum(axis=0), (w.T @ w).ravel()]).tolist()

    got = _totals(distinct, sums, "double")
    mean = np.array([got[i] for i in range(k)]) / made.n
    second = np.array([got[k + i] for i in range(k * k)]).reshape(k, k) / made.n
    return float(np.abs(second - np.outer(mean, mean) - np.eye(k)).max())


def transform(vectors: DataFrame, made: Whitener) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every (vec_id, x) row."""
    k = len(made.values)
    shares = made.values / made.trace if k else made.values

    def run(batches):
        for batch in batches:
            if not k or not batch.num_rows:
                continue
            off = made.deviations(_matrix(batch))
            widest = max(abs(int(off.max())), abs(int(off.min())))
            wide = off if widest * widest * off.shape[1] <= _LONG else off.astype(object)
            squares = (wide * wide).sum(axis=1).tolist()
            m = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(pa.array(np.repeat(np.arange(m), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, made.n, dtype=np.int64)),
                    pa.array([s if s <= _LONG else None for s in squares], pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                    pa.array(made.whiten(off).ravel()),
                    pa.array(np.tile(shares, m)),
                    pa.array(np.full(m * k, made.identity_error)),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return vectors.mapInArrow(run, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")


def whiten(rows: DataFrame, most: int = COMPONENTS, vector: str = "embedding", row_id: str = "vec_id") -> DataFrame:
    """The whitened components of every row that remains."""
    vectors = integer_vectors(rows, vector, row_id)
    return transform(vectors, fit(vectors, most))

"""Quality classifier: a byte-level convolutional network in NumPy.

A text is cut into chunks that overlap by a filter's width less one step, so that every byte of the document lies
under the filters. Filters are max-pooled inside a chunk; a document is the mean and the maximum of its chunks'
pools, combined by a small dense layer into one probability. Null and empty texts are one chunk of padding.
Without labelled rows of both classes the model answers the share of good rows, or 0.5 when there are none.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import map_chunks, texts_of

# Bytes of a step, steps of a filter, steps of a chunk.
STEP = 4
WIDTH = 4
CHUNK = 256
EMBED = 4
FILTERS = 48
HIDDEN = 24

# The fit reads at most this many labelled rows of each class, and only texts up to this many bytes. Scoring reads all.
FIT_ROWS = 1_500
FIT_BYTES = 1 << 16
EPOCHS = 8
BATCH = 32


@dataclass
class Net:
    """Weights by name; ``shift`` corrects the class shares of the fit to those of all labelled rows."""

    weights: dict[str, np.ndarray]
    shift: float = 0.0


def _start(seed: int = 7) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    flat = WIDTH * STEP * EMBED

    def normal(*shape):
        return (r.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

    return {
        "embed": r.standard_normal((256, EMBED)).astype(np.float32), "filter": normal(flat, FILTERS), "bias": np.zeros(FILTERS, np.float32),
        "hidden": normal(2 * FILTERS, HIDDEN), "hidden_bias": np.zeros(HIDDEN, np.float32), "out": normal(HIDDEN, 1), "out_bias": np.zeros(1, np.float32),
    }


def _chunked(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all chunks as rows, padded by zeros, and the first chunk of each text."""
    body, row = CHUNK * STEP, (CHUNK + WIDTH - 1) * STEP
    counts = np.array([max(1, -(-len(t) // body)) for t in texts], dtype=np.int64)
    raw = np.frombuffer(b"".join(t.ljust(n * body, b"\0") for t, n in zip(texts, counts)) + bytes(row), dtype=np.uint8)
    rows = np.lib.stride_tricks.as_strided(raw, (int(counts.sum()), row), (body, 1)).copy()
    # The overlap of a text's last chunk is padding, not the next text.
    last = np.cumsum(counts) - 1
    rows[last, body:] = 0
    return rows, last - counts + 1


def _pools(w: dict[str, np.ndarray], rows: np.ndarray, where: bool = False):
    """Per chunk and filter the largest activation, and with ``where`` the step that has it."""
    n, span = len(rows), rows.shape[1] // STEP
    steps = np.take(w["embed"], rows, axis=0).reshape(n * span, STEP * EMBED)
    part = STEP * EMBED
    act = np.zeros((n, CHUNK, FILTERS), dtype=np.float32)
    for i in range(WIDTH):
        act += (steps @ w["filter"][i * part : (i + 1) * part]).reshape(n, span, FILTERS)[:, i : i + CHUNK]
    if not where:
        return np.maximum(act.max(axis=1) + w["bias"], 0), None, None
    at = act.argmax(axis=1)
    best = np.take_along_axis(act, at[:, None], axis=1)[:, 0] + w["bias"]
    return np.maximum(best, 0), at, steps.reshape(n, span, part)


def _documents(w, pools: np.ndarray, first: np.ndarray):
    counts = np.diff(np.append(first, len(pools))).astype(np.float32)[:, None]
    x = np.concatenate([np.add.reduceat(pools, first, axis=0) / counts, np.maximum.reduceat(pools, first, axis=0)], axis=1)
    hidden = np.maximum(x @ w["hidden"] + w["hidden_bias"], 0)
    return x, hidden, (hidden @ w["out"] + w["out_bias"])[:, 0], counts


def logits(net: Net, texts: list[bytes]) -> np.ndarray:
    rows, first = _chunked(texts)
    pools = np.concatenate([_pools(net.weights, rows[a : a + 64])[0] for a in range(0, len(rows), 64)])
    return _documents(net.weights, pools, first)[2].astype(np.float64) + net.shift


def _gradients(w, texts: list[bytes], y: np.ndarray) -> dict[str, np.ndarray]:
    rows, first = _chunked(texts)
    pools, at, steps = _pools(w, rows, where=True)
    x, hidden, z, counts = _documents(w, pools, first)
    dz = ((1 / (1 + np.exp(-z)) - y) / len(y)).astype(np.float32)[:, None]
    dh = (dz @ w["out"].T) * (hidden > 0)
    dx = dh @ w["hidden"].T
    of = np.repeat(np.arange(len(first)), counts[:, 0].astype(np.int64))
    top = pools == x[of, FILTERS:]
    ties = np.add.reduceat(top, first, axis=0, dtype=np.float32)
    dp = (dx[:, :FILTERS] / counts)[of] + top * (dx[:, FILTERS:] / ties)[of]
    dp *= pools > 0
    # Only the step that won the pool carries a gradient.
    seen = np.concatenate([np.take_along_axis(steps, (at + i)[:, :, None], axis=1) for i in range(WIDTH)], axis=2)
    grad_filter = np.einsum("nf,nfk->kf", dp, seen, optimize=True)
    back = (dp[:, :, None] * w["filter"].T[None]).reshape(-1, EMBED)
    offsets = np.arange(WIDTH * STEP)
    values = rows[np.arange(len(rows))[:, None, None], (at * STEP)[:, :, None] + offsets].ravel()
    grad_embed = np.stack([np.bincount(values, weights=back[:, d], minlength=256) for d in range(EMBED)], axis=1)
    return {
        "embed": grad_embed.astype(np.float32), "filter": grad_filter, "bias": dp.sum(axis=0), "hidden": x.T @ dh,
        "hidden_bias": dh.sum(axis=0), "out": hidden.T @ dz, "out_bias": dz.sum(axis=0),
    }


def fit_texts(texts: list[bytes], y: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Net:
    """Adam over batches of like length; each epoch in another order."""
    w = _start(seed)
    m, v = ({k: np.zeros_like(x) for k, x in w.items()} for _ in range(2))
    r, step = np.random.default_rng(seed), 0
    total = epochs * -(-len(texts) // BATCH)
    for _ in range(epochs):
        order = r.permutation(len(texts))
        for a in range(0, len(order), BATCH):
            pick = order[a : a + BATCH]
            grads = _gradients(w, [texts[i] for i in pick], y[pick])
            step += 1
            rate = 0.004 * (1 - 0.9 * step / total)
            for k, g in grads.items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                w[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-7)
    return Net(w)


def held_out(folds: int = 3, fold: int = 1):
    """Whether crc32 of the id's text falls in the fold that is never learnt from; a row without an id is never learnt from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % folds == fold, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, fit_bytes: int = FIT_BYTES, epochs: int = EPOCHS) -> Net | float:
    """Fit on at most ``fit_rows`` labelled rows of each class outside the held-out fold, the first by a hash of the id.

    An id with labels of both kinds, or none, teaches nothing.
    """
    clear = (
        labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out())
        .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("low"), F.max("quality").alias("high")).filter("low = high")
    )
    shares = {r["low"]: r["n"] for r in clear.groupBy("low").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(shares) < 2:
        return float(next(iter(shares), 0.5))
    picked = [r for c in (0, 1) for r in clear.filter(F.col("low") == c).orderBy(F.xxhash64("doc_id"), "doc_id").select("doc_id", "low").limit(fit_rows).collect()]
    ids = F.broadcast(docs.sparkSession.createDataFrame([(r[0], r[1]) for r in picked], "doc_id long, low int"))
    rows = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).filter(F.octet_length("text") <= fit_bytes)
        .join(ids, "doc_id").groupBy("doc_id", "low").agg(F.min("text").alias("text")).collect()
    )
    rows.sort(key=lambda r: r["doc_id"])
    y = np.array([r["low"] for r in rows], dtype=np.float32)
    if not 0 < y.sum() < len(y):
        return shares.get(1, 0) / sum(shares.values())
    net = fit_texts([r["text"].encode() for r in rows], y, epochs)
    net.shift = float(np.log(shares[1] / shares[0]) - np.log(y.sum() / (len(y) - y.sum())))
    return net


def score(docs: DataFrame, net: Net | float) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def make():
        model = shared.value

        def work(chunk):
            texts = texts_of(chunk.column("text"))
            p = 1 / (1 + np.exp(-np.clip(logits(model, texts), -500, 500))) if not isinstance(model, float) else np.full(len(texts), model)
            return {"doc_id": chunk.column("doc_id"), "held_out": chunk.column("held_out"), "score": p, "predicted": (p >= 0.5).astype(np.int32)}

        return work

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return map_chunks(rows, "text", "doc_id long, held_out boolean, score double, predicted int", make)

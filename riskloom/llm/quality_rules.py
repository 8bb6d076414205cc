"""Quality rules: counts per document, and a hashed n-gram log-likelihood ratio of a trusted target against the raw corpus.

The cut between clean text and junk is fitted: every labelled text gets a ratio from the target texts of other folds,
as an unlabelled text would, and the cut is where trusted and untrusted ones part best. A language that is rarer in the
target than in the corpus only moves its trusted texts nearer to the cut, not beyond it.

Null texts count as empty. A document without an n-gram has ratio 0. Without any target n-gram every ratio is 0, so
that the base rules alone decide. Repeated rows are judged one by one and alike; other columns pass untouched.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import SPACE, checked_broadcast, chunks, map_chunks, texts_of

# Bytes of an n-gram, and hashed buckets of the two multinomials.
GRAM = 4
BUCKETS = 1 << 16
# Pseudo-count of the raw distribution inside the target's.
PRIOR = 10_000.0
# A document is kept when its mean log ratio per n-gram is at least this; for callers that have no fitted cut.
THRESHOLD = -0.25
# Folds of the target texts, and bins of the ratio in which labelled texts are counted.
FOLDS = 5
BINS = 100
# Target ids that are broadcast; more are joined by shuffle.
TARGET_ROWS = 2_000_000

# The characters counted as symbols.
SYMBOLS = b"#*$%&|<>"


def _grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the n-gram at every byte of the joined texts, and where each text's n-grams begin and end, in turn."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    raw = np.frombuffer(b"".join(texts) + bytes(GRAM), dtype=np.uint8)
    n = len(raw) - GRAM
    value = np.zeros(n, dtype=np.uint32)
    for i in range(GRAM):
        value |= raw[i : n + i].astype(np.uint32) << np.uint32(8 * i)
    ends = np.cumsum(sizes)
    bounds = np.stack([ends - sizes, np.maximum(ends - GRAM + 1, ends - sizes)], axis=1)
    return (value * np.uint32(2654435761)) >> np.uint32(16), bounds


def _own_grams(buckets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    inside = np.zeros(len(buckets) + 1, dtype=np.int8)
    np.add.at(inside, bounds[:, 0], 1)
    np.add.at(inside, bounds[:, 1], -1)
    return buckets[np.cumsum(inside[:-1]) > 0]


def _marked(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """(text, mark, fold) of the rows; equal texts are of one fold."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    joined = rows.join(checked_broadcast(ids, TARGET_ROWS), "doc_id", how)
    return joined.select("text", F.coalesce("mark", F.lit(False)).alias("mark"), F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int").alias("fold"))


def gram_counts(docs: DataFrame, target: DataFrame | None) -> DataFrame:
    """(bucket, part, n): n-grams of all texts (part -1) and of each fold of the target's, summed inside tasks before the shuffle."""
    if target is None:
        flagged = docs.select("text", F.lit(False).alias("mark"), F.lit(0).alias("fold"))
    else:
        flagged = _marked(docs, target.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(True).alias("mark")).distinct(), "left")

    def make():
        def work(chunk):
            texts = texts_of(chunk.column("text"))
            folds = [f if m else -1 for m, f in zip(chunk.column("mark").to_pylist(), chunk.column("fold").to_pylist())]
            counted = [(-1, np.bincount(_own_grams(*_grams(texts)), minlength=BUCKETS))]
            for k in sorted(set(folds) - {-1}):
                counted.append((k, np.bincount(_own_grams(*_grams([t for t, f in zip(texts, folds) if f == k])), minlength=BUCKETS)))
            seen = [np.flatnonzero(n) for _, n in counted]
            return {
                "bucket": np.concatenate(seen), "part": np.repeat([k for k, _ in counted], [len(x) for x in seen]),
                "n": np.concatenate([n[x] for (_, n), x in zip(counted, seen)]),
            }

        return work

    return map_chunks(flagged, "text", "bucket int, part int, n long", make).groupBy("bucket", "part").agg(F.sum("n").alias("n"))


def _counted(docs: DataFrame, target: DataFrame | None) -> tuple[np.ndarray, np.ndarray]:
    """Counts per bucket of all texts, and of each fold of the target's: whatever the size of the corpus."""
    raw, own = np.zeros(BUCKETS), np.zeros((FOLDS, BUCKETS))
    for r in gram_counts(docs, target).collect():
        (raw if r["part"] < 0 else own[r["part"]])[r["bucket"]] = r["n"]
    return raw, own


def _log_ratio(raw: np.ndarray, own: np.ndarray) -> np.ndarray:
    if not own.sum():
        return np.zeros(BUCKETS, dtype=np.float32)
    p = (raw + 1.0 / BUCKETS) / (raw.sum() + 1.0)
    q = (own + PRIOR * p) / (own.sum() + PRIOR)
    return np.log(q / p).astype(np.float32)


def fit_ratio(docs: DataFrame, target: DataFrame | None) -> np.ndarray:
    """Log ratio of target to raw per bucket."""
    raw, own = _counted(docs, target)
    return _log_ratio(raw, own.sum(axis=0))


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """Log ratio per bucket, and the cut that parts trusted from untrusted labelled texts by ratios from other folds."""
    target = trusted(labels)
    raw, own = _counted(docs, target)
    ratio = _log_ratio(raw, own.sum(axis=0))
    if not own.sum():
        return ratio, 0.0
    sent = docs.sparkSession.sparkContext.broadcast([_log_ratio(raw, own.sum(axis=0) - x) for x in own])

    def make():
        tables = [t.astype(np.float64) for t in sent.value]

        def work(chunk):
            texts, good = texts_of(chunk.column("text")), np.array(chunk.column("mark").to_pylist(), dtype=bool)
            folds = np.array(chunk.column("fold").to_pylist(), dtype=np.int64)
            passed = np.array([not _fails(t.split()) for t in texts], dtype=bool)
            bins = np.zeros(len(texts), dtype=np.int64)
            for k in range(FOLDS):
                mine = np.flatnonzero(folds == k)
                for a in range(0, len(mine), 256):
                    at = mine[a : a + 256]
                    bins[at] = np.floor(mean_ratio([texts[i] for i in at], tables[k]) * BINS)
            pairs, n = np.unique(np.stack([bins, good])[:, passed], axis=1, return_counts=True)
            return {"bin": pairs[0], "good": pairs[1].astype(bool), "n": n}

        return work

    known = labels.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    known = known.join(target.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(True).alias("mark")), "doc_id", "left")
    counts = map_chunks(_marked(docs, known, "inner"), "text", "bin int, good boolean, n long", make).groupBy("bin", "good").agg(F.sum("n").alias("n"))
    return ratio, best_cut({(r["bin"], r["good"]): r["n"] for r in counts.collect()})


def best_cut(counts: dict[tuple[int, bool], int]) -> float:
    """Where the share of trusted rows below and that of untrusted rows above are least together, in the middle of the widest such place.

    Without untrusted rows the cut is below the lowest trusted one; without trusted rows nothing is cut.
    """
    if not any(good for _, good in counts):
        return -np.inf
    if all(good for _, good in counts):
        return min(b for b, _ in counts) / BINS
    low = min(b for b, _ in counts)
    table = np.zeros((2, max(b for b, _ in counts) - low + 2))
    for (b, good), n in counts.items():
        table[int(good), b - low + 1] = n
    # Entry i is the cut below bin low + i.
    bad, good = np.cumsum(table, axis=1) / table.sum(axis=1, keepdims=True)
    loss = good + 1 - bad
    least = np.append(loss <= loss.min() + 1e-12, False)
    ends = np.flatnonzero(least[:-1] & ~least[1:])
    begins = np.flatnonzero(least & ~np.append(False, least[:-1]))
    k = int((ends - begins).argmax())
    return (low + (begins[k] + ends[k]) / 2) / BINS


def _repeat_words(words: list[bytes]) -> int:
    """Words inside 5-word windows that occur twice or more."""
    n = len(words)
    if n < 6:
        return 0
    ids: dict[bytes, int] = {}
    seq = np.fromiter((ids.setdefault(w, len(ids)) for w in words), dtype=np.uint64, count=n)
    h = np.zeros(n - 4, dtype=np.uint64)
    for i in range(5):
        h = (h + seq[i : n - 4 + i] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    ordered = np.sort(h)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    # Equal hashes only nominate; the words decide.
    places: dict[tuple, list[int]] = {}
    for p in np.flatnonzero(np.isin(h, twice)).tolist():
        places.setdefault(tuple(seq[p : p + 5].tolist()), []).append(p)
    starts = np.array([p for ps in places.values() if len(ps) > 1 for p in ps], dtype=np.int64)
    covered = np.zeros(n, dtype=bool)
    for i in range(5):
        covered[starts + i] = True
    return int(covered.sum())


def _fails(words: list[bytes]) -> bool:
    """The base rules."""
    return len(words) < 10 or 100 * _repeat_words(words) > 20 * len(words)


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text."""
    words = text.split()
    raw = np.frombuffer(text, dtype=np.uint8)
    chars = int(np.count_nonzero(((raw & 0xC0) != 0x80) & ~SPACE[raw]))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(words), chars, symbols, len(lines) - len(set(lines)), _repeat_words(words)


def judge(docs: DataFrame, ratio: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, the counts, base_failed, ratio, kept) of every row."""
    table = docs.sparkSession.sparkContext.broadcast(ratio)

    def make():
        values = table.value.astype(np.float64)

        def work(chunk):
            texts = texts_of(chunk.column("text"))
            counts = np.array([base_counts(t) for t in texts], dtype=np.int64).reshape(-1, 5)
            mean = mean_ratio(texts, values)
            failed = (counts[:, 0] < 10) | (100 * counts[:, 4] > 20 * counts[:, 0])
            names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
            return {"doc_id": chunk.column("doc_id"), **{k: counts[:, i] for i, k in enumerate(names)}, "base_failed": failed, "ratio": mean, "kept": ~failed & (mean >= threshold)}

        return work

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, ratio double, kept boolean"
    return map_chunks(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "text", schema, make)


def mean_ratio(texts: list[bytes], values: np.ndarray) -> np.ndarray:
    """Mean log ratio over each text's n-grams."""
    buckets, bounds = _grams(texts)
    sums = np.zeros(len(texts))
    some = bounds[:, 1] > bounds[:, 0]
    if some.any():
        gains = np.append(values[buckets], 0.0)
        sums[some] = np.add.reduceat(gains, bounds[some].ravel())[::2]
    return sums / np.maximum(bounds[:, 1] - bounds[:, 0], 1)


def trusted(labels: DataFrame) -> DataFrame:
    """Ids whose every quality label is 1."""
    return labels.filter("doc_id is not null").groupBy("doc_id").agg(F.min(F.coalesce(F.col("quality"), F.lit(0))).alias("q")).filter("q = 1").select("doc_id")


def keep(docs: DataFrame, ratio: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """The rows that the rules keep, with all their columns."""
    table = docs.sparkSession.sparkContext.broadcast(ratio)

    def run(batches):
        import pyarrow as pa

        values = table.value.astype(np.float64)
        for batch in (c for b in batches for c in chunks(b, "text")):
            texts = texts_of(batch.column("text"))
            kept = []
            for a in range(0, len(texts), 256):
                part = texts[a : a + 256]
                for text, mean in zip(part, mean_ratio(part, values)):
                    kept.append(mean >= threshold and not _fails(text.split()))
            yield batch.filter(pa.array(kept, type=pa.bool_()))

    return docs.mapInArrow(run, docs.schema)

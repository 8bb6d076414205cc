"""Substring dedup on a De Bruijn graph of tokens.

A window of ``window`` words is an edge of the graph from its first to its last ``window - 1`` words. Consecutive
windows that share their minimizer, the least hash among the shorter k-mers inside a window, form a path without
branches; a path is one row (anchor k-mer, hash of its words, document, first word), so that the edges are compacted
about fifteen to one before anything is shuffled. Equal windows have equal anchors, hence:

* an anchor that only one document has carries no repeat and is dropped;
* an anchor with a single path is a nonbranching stretch of the graph, and all its windows repeat together;
* where paths with one anchor differ the graph branches, and only there paths are opened into windows, once per
  distinct path, at the source coordinates of its first document, and joined window by window.

What repeats in a document of smaller id comes back as word spans at each document's own coordinates. Paths and
windows are named by the pair (anchor hash, word hash), 128 bits.

Null texts have no words. A null id counts as greater than every other, so that such a row is no source for rows with
ids. Rows with equal ids are no sources for each other; repeated rows have equal results.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.session import cut_lineage, reuse
from riskloom.llm.common import Memory, checked_broadcast, chunks, id_key, map_chunks, texts_of

WINDOW = 50
# Words of a k-mer that can be an anchor.
ANCHOR = 20
# Repeated anchors that are broadcast; more are joined by shuffle.
SENT_ANCHORS = 1_000_000
# Word hashes kept in each of a memory's two generations.
WORDS = 100_000
# Paths that so many rows have that their join is spread.
HOT_PATHS = 2_000

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Hashed:
    """Word hashes of a text, and the hash of any run of its words."""

    def __init__(self, words: list[bytes], digests: Memory):
        import xxhash

        digest = xxhash.xxh3_64_intdigest
        new = digests.missing(set(words))
        known = digests.young
        known.update((w, digest(w)) for w in new)
        h = np.fromiter((known[w] for w in words), dtype=np.uint64, count=len(words))
        powers = np.full(len(words) + 1, _BASE, dtype=np.uint64)
        powers[0] = 1
        self.back = np.full(len(words) + 1, _INVERSE, dtype=np.uint64)
        self.back[0] = 1
        self.back = np.cumprod(self.back, dtype=np.uint64)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * np.cumprod(powers, dtype=np.uint64)[:-1], dtype=np.uint64)])

    def runs(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the words begin..end (exclusive), with their number."""
        return _mix((self.sums[end] - self.sums[begin]) * self.back[begin] + (end - begin).astype(np.uint64))


def _paths(hashed: Hashed, n: int, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows, anchor hash and word hash of every path of a text of n >= window words."""
    starts = np.arange(n - anchor + 1)
    kmers = hashed.runs(starts, starts + anchor)
    span = window - anchor + 1
    place = np.lib.stride_tricks.sliding_window_view(kmers, span).argmin(axis=1) + np.arange(n - window + 1)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    count = np.diff(np.append(first, len(place)))
    return first, count, kmers[place[first]], hashed.runs(first, first + count + window - 1)


def paths(keyed: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(id, sign, first, windows, anchor, path) of every path of every keyed row; sign names the text among rows of one id."""
    def make():
        digests = Memory(WORDS)

        def work(chunk):
            ids, signs, out = [], [], []
            for i, s, text in zip(chunk.column("id").to_pylist(), chunk.column("sign").to_pylist(), texts_of(chunk.column("text"))):
                words = text.split()
                if len(words) >= window:
                    found = _paths(Hashed(words, digests), len(words), window, anchor)
                    ids.append((i, len(found[0])))
                    signs.append(s)
                    out.append(found)
            if not out:
                return {k: pa.array([], pa.int64()) for k in ("id", "sign", "first", "windows", "anchor", "path")}
            sizes = [n for _, n in ids]
            first, count, kmer, path = (np.concatenate(c) for c in zip(*out))
            return {
                "id": np.repeat(np.array([i for i, _ in ids], dtype=np.int64), sizes), "sign": np.repeat(np.array(signs, dtype=np.int64), sizes),
                "first": first, "windows": count, "anchor": kmer.view(np.int64), "path": path.view(np.int64),
            }

        return work

    return map_chunks(keyed.select(F.col("__id").alias("id"), F.col("__sign").alias("sign"), "text"), "text", "id long, sign long, first long, windows long, anchor long, path long", make)


def _keyed(docs: DataFrame) -> DataFrame:
    """The rows with the key that their spans are joined by."""
    return docs.withColumns({"__id": id_key(), "__sign": F.xxhash64("text")})


def _opened(keyed: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """(anchor, path, high, at, hash, source): the windows of each wanted path, read at its source coordinates."""
    listed = wanted.groupBy(F.col("id").alias("__i"), F.col("sign").alias("__s")).agg(F.collect_list(F.struct("first", "windows", "anchor", "path", "high")).alias("__paths"))
    # All columns go along, so that this join and that of the spans can share one exchange of the rows.
    rows = keyed.join(listed, (F.col("__id") == F.col("__i")) & (F.col("__sign") == F.col("__s")))

    def make():
        digests = Memory(WORDS)

        def work(chunk):
            found = {k: [] for k in ("anchor", "path", "high", "at", "hash", "source")}
            for i, text, own in zip(chunk.column("__id").to_pylist(), texts_of(chunk.column("text")), chunk.column("__paths").to_pylist()):
                hashed = Hashed(text.split(), digests)
                for p in own:
                    at = np.arange(p["windows"])
                    found["hash"].append(hashed.runs(at + p["first"], at + p["first"] + window).view(np.int64))
                    found["at"].append(at)
                    for k, v in (("anchor", p["anchor"]), ("path", p["path"]), ("high", p["high"]), ("source", i)):
                        found[k].append(np.full(len(at), v, dtype=np.int64))
            return {k: np.concatenate(v) if v else np.zeros(0, dtype=np.int64) for k, v in found.items()}

        return work

    return map_chunks(rows, "text", "anchor long, path long, high long, at long, hash long, source long", make)


def repeated_spans(keyed: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(__i, __s, __spans): word spans (begin, end) of each keyed row that lie under windows found in rows of smaller id."""
    every = reuse(paths(keyed, window, anchor))
    anchors = (
        every.groupBy("anchor").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.min("path").alias("p0"), F.max("path").alias("p1"))
        .filter("low < high").select("anchor", "low", (F.col("p0") != F.col("p1")).alias("branches"))
    )
    anchors = cut_lineage(anchors)
    hits = reuse(every.join(checked_broadcast(anchors, SENT_ANCHORS), "anchor"))
    straight = hits.filter("not branches and low < id").select(
        "id", "sign", F.col("first").alias("begin"), (F.col("first") + F.col("windows") + window - 1).alias("end"),
    )
    branching = hits.filter("branches")
    sources = (
        branching.groupBy("anchor", "path").agg(F.min(F.struct("id", "sign", "first", "windows")).alias("s"), F.max("id").alias("high"), F.count(F.lit(1)).alias("times"))
        .select("anchor", "path", "s.*", "high", "times")
    )
    # At most HOT_PATHS paths have more than this share of the rows; theirs are spread over salts.
    share = branching.count() // HOT_PATHS + 1
    hot = F.broadcast(sources.filter(F.col("times") > share).select("anchor", "path", F.ceil(F.col("times") / share).cast("int").alias("salts")))
    salts = F.coalesce("salts", F.lit(1))
    opened = _opened(keyed, sources, window)
    least = opened.groupBy("anchor", "hash").agg(F.min("source").alias("low"))
    # A path's own window tells nothing to a path that only its source has.
    by_path = (
        opened.join(least, ["anchor", "hash"]).filter("low < high")
        .groupBy("anchor", "path").agg(F.collect_set(F.struct("at", "low")).alias("lows"))
        .join(hot, ["anchor", "path"], "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
    )
    bent = (
        branching.drop("low").join(hot, ["anchor", "path"], "left").withColumn("salt", F.pmod(F.hash("id", "first"), salts))
        .join(by_path, ["anchor", "path", "salt"])
        .withColumn("lows", F.expr("filter(lows, w -> w.low < id)")).filter("size(lows) > 0")
        .select("id", "sign", F.explode("lows").alias("w"), "first")
        .select("id", "sign", (F.col("first") + F.col("w.at")).alias("begin"), (F.col("first") + F.col("w.at") + window).alias("end"))
    )
    spans = cut_lineage(straight.union(bent).groupBy(F.col("id").alias("__i"), F.col("sign").alias("__s")).agg(F.collect_set(F.struct("begin", "end")).alias("__spans")))
    hits.unpersist()
    every.unpersist()
    return spans


def _with_spans(keyed: DataFrame, window: int, anchor: int) -> DataFrame:
    spans = repeated_spans(keyed, window, anchor)
    return keyed.join(spans, (F.col("__id") == F.col("__i")) & (F.col("__sign") == F.col("__s")), "left")


def removed_words(n: int, spans: list | None) -> np.ndarray:
    """Mask of the words that lie in a span."""
    edges = np.zeros(n + 1, dtype=np.int64)
    if spans:
        np.add.at(edges, [s["begin"] for s in spans], 1)
        np.add.at(edges, [min(s["end"], n) for s in spans], -1)
    return np.cumsum(edges[:-1]) > 0


def dedup_report(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row."""
    keyed = _keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    rows = _with_spans(keyed, window, anchor)

    def make():
        def work(chunk):
            n_words, n_removed, digest = [], [], []
            for text, own in zip(texts_of(chunk.column("text")), chunk.column("__spans").to_pylist()):
                words = text.split()
                n_words.append(len(words))
                if own:
                    gone = removed_words(len(words), own)
                    words = [w for w, g in zip(words, gone.tolist()) if not g]
                n_removed.append(n_words[-1] - len(words))
                digest.append(hashlib.sha256(b" ".join(words)).hexdigest())
            return {"doc_id": chunk.column("doc_id"), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array(digest, pa.string())}

        return work

    return map_chunks(rows, "text", "doc_id long, n_words long, n_removed long, kept_sha256 string", make)


def without_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """The rows with all their columns; a text that loses words is its kept words joined by one space, others stay as they are.

    A column n_chars, where there is one, counts the characters of the new text.
    """
    joined = _with_spans(_keyed(docs), window, anchor)
    names = docs.columns

    def run(batches):
        for batch in (c for b in batches for c in chunks(b, "text")):
            texts, lengths = [], []
            column = batch.column("text")
            for old, text, own in zip(column.to_pylist(), texts_of(column), batch.column("__spans").to_pylist()):
                if own:
                    words = text.split()
                    gone = removed_words(len(words), own)
                    old = b" ".join([w for w, g in zip(words, gone.tolist()) if not g]).decode()
                texts.append(old)
                lengths.append(len(old) if own else None)
            out = {n: batch.column(n) for n in names}
            out["text"] = pa.array(texts, column.type)
            if "n_chars" in out and pa.types.is_integer(out["n_chars"].type):
                out["n_chars"] = pa.array([o if c is None else c for c, o in zip(lengths, out["n_chars"].to_pylist())], out["n_chars"].type)
            yield pa.RecordBatch.from_arrays([out[n] for n in names], names=names)

    return joined.mapInArrow(run, docs.schema)

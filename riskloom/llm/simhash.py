"""SimHash near-duplicates: fingerprints compared tile by tile with exclusive-or and bit counts.

Equal fingerprints are one class, however many documents have them. Classes lie in tiles by the bit counts of the
fingerprint's four 16-bit parts. Two fingerprints differ in at least as many bits as the counts of their parts
differ in sum, so that a pair of tiles whose counts differ by more than the radius is skipped; every other pair is
compared whole, in blocks, and hands on a spanning forest of its links. Components are those of the links.

Null and empty texts have fingerprint 0. A null id is no name: it is linked like any other, and a component of null
ids alone has a null component_id. Repeated rows have equal fingerprints and are returned each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.session import cut_lineage, reuse
from riskloom.llm.common import map_chunks, texts_of
from riskloom.llm.components import components

SHINGLE = 3
RADIUS = 2
SEED = 42
PARTS = 4
# Fingerprints of a block; a tile of more is several blocks.
BLOCK = 2_048

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprints(texts: list[bytes], shingle: int = SHINGLE) -> np.ndarray:
    """64-bit SimHash of each text's word shingles, repeats included."""
    import xxhash

    digest, out = xxhash.xxh64_intdigest, np.zeros(len(texts), dtype=np.uint64)
    for i, text in enumerate(texts):
        words = text.translate(_LOWER).split()
        if not words:
            continue
        if len(words) <= shingle:
            h = [digest(b" ".join(words), SEED)]
        else:
            joined = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
            starts = (ends - [len(w) + 1 for w in words])[: len(words) - shingle + 1].tolist()
            h = [digest(joined[a:b], SEED) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist())]
        ones = np.zeros(64, dtype=np.int64)
        values = np.array(h, dtype=np.uint64)
        for a in range(0, len(values), 1 << 16):
            ones += np.unpackbits(values[a : a + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[i] = np.packbits(2 * ones > len(values), bitorder="little").view(np.uint64)[0]
    return out


def with_fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of every row; fp holds the 64 bits as a signed long."""
    def make():
        return lambda chunk: {"doc_id": chunk.column("doc_id"), "fp": fingerprints(texts_of(chunk.column("text")), shingle).view(np.int64)}

    return map_chunks(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "text", "doc_id long, fp long", make)


def _part_counts():
    return [F.bit_count(F.shiftright(F.col("fp"), 16 * i).bitwiseAND(F.lit(0xFFFF))).cast("int") for i in range(PARTS)]


def _code(counts):
    code = F.lit(0)
    for c in counts:
        code = code * 17 + c
    return code.cast("int")


def _steps(radius: int) -> list[tuple[int, ...]]:
    """Differences of part counts that sum up to the radius at most, each pair of opposite ones once."""
    out = [()]
    for _ in range(PARTS):
        out = [(*s, d) for s in out for d in range(-radius, radius + 1) if sum(map(abs, s)) + abs(d) <= radius]
    return [s for s in out if s >= (0,) * PARTS]


def _forest(a: np.ndarray, b: np.ndarray, radius: int, same: bool) -> list[tuple[int, int]]:
    """A spanning forest of the links between two blocks."""
    values = np.concatenate([a, b]) if not same else a
    shift, parent = (0 if same else len(a)), list(range(len(values)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links = []
    rows = max(1, (1 << 20) // max(1, len(b)))
    for s in range(0, len(a), rows):
        near = np.bitwise_count(a[s : s + rows, None] ^ b[None]) <= radius
        for i, j in zip(*np.nonzero(near)):
            x, y = find(int(i) + s), find(int(j) + shift)
            if x != y:
                parent[max(x, y)] = min(x, y)
                links.append((int(values[int(i) + s].astype(np.int64)), int(values[int(j) + shift].astype(np.int64))))
    return links


def links(classes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): links that connect all fingerprints of ``classes`` (distinct fp) within the radius, transitively."""
    tiled = classes.select("fp", _code(_part_counts()).alias("tile"))
    # One row a tile: at most 17 ** 4 tiles, whatever the corpus.
    sizes = F.broadcast(tiled.groupBy("tile").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("__blocks")))
    blocks = (
        tiled.join(sizes, "tile").withColumn("block", F.pmod(F.xxhash64("fp"), F.col("__blocks")).cast("int"))
        .groupBy("tile", "block", "__blocks").agg(F.collect_list("fp").alias("fps"))
    )
    blocks = reuse(blocks)
    parts = [(F.floor(F.col("tile") / 17 ** (PARTS - 1 - i)) % 17).cast("int") for i in range(PARTS)]
    steps = F.array(*[F.struct(*[F.lit(d).alias(f"d{i}") for i, d in enumerate(s)]) for s in _steps(radius)])
    moved = [parts[i] + F.col(f"__s.d{i}") for i in range(PARTS)]
    inside = F.lit(True)
    for m in moved:
        inside = inside & m.between(0, 16)
    left = (
        blocks.withColumn("__s", F.explode(steps)).filter(inside)
        .select(F.col("tile").alias("tile_a"), F.col("block").alias("block_a"), F.col("fps").alias("fps_a"), _code(moved).alias("tile"))
    )
    pairs = left.join(blocks, "tile").filter((F.col("tile_a") != F.col("tile")) | (F.col("block_a") <= F.col("block"))).select(
        "fps_a", F.col("fps").alias("fps_b"), ((F.col("tile_a") == F.col("tile")) & (F.col("block_a") == F.col("block"))).alias("same"),
    )

    def compare(batches):
        for batch in batches:
            found: list[tuple[int, int]] = []
            left_lists, right_lists = batch.column("fps_a"), batch.column("fps_b")
            for i, same in enumerate(batch.column("same").to_pylist()):
                a = left_lists[i].values.to_numpy(zero_copy_only=False).view(np.uint64)
                b = right_lists[i].values.to_numpy(zero_copy_only=False).view(np.uint64)
                found += _forest(a, b, radius, same)
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], names=["a", "b"])

    found = cut_lineage(pairs.mapInArrow(compare, "a long, b long"))
    blocks.unpersist()
    return found


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row."""
    prints = cut_lineage(with_fingerprints(docs, shingle))
    classes = cut_lineage(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(links(classes.select("fp"), radius))
    named = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    names = named.select("fp", "root").join(least, "root").select("fp", "component_id")
    return prints.join(names, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """The rows whose id names their component, one row an id; rows without an id stay only where no row of theirs has one.

    Of rows without any id in the component one copy of each text stays.
    """
    found = cut_lineage(near_duplicates(docs, shingle, radius).filter("doc_id = component_id or component_id is null"))
    counted = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("__n"))
    key = F.col("doc_id").cast("long")
    single = counted.filter("__n = 1 and doc_id is not null").select(F.col("doc_id").alias("__id"))
    several = counted.filter("__n > 1 or doc_id is null").select(F.col("doc_id").alias("__id"))
    alone = docs.join(single, key == F.col("__id"), "left_semi")
    # Rows that share an id: the one whose fingerprint is in the id's component, and of those one.
    prints = found.join(several, F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi").select(F.col("doc_id").alias("__id"), F.col("fingerprint").alias("__fp")).distinct()
    shared = docs.join(several, key.eqNullSafe(F.col("__id")), "left_semi")
    chosen = _pick(shared, prints, shingle)
    return alone.unionByName(chosen)


def _pick(shared: DataFrame, prints: DataFrame, shingle: int) -> DataFrame:
    """Of rows that share an id, the first by text whose fingerprint is among ``prints``; without an id, the first of each fingerprint."""
    def run(series):
        import pandas as pd

        for texts in series:
            yield pd.Series([f"{int(x):016x}" for x in fingerprints([(t or "").encode() for t in texts], shingle)])

    from collections.abc import Iterator

    import pandas as pd

    run.__annotations__ = {"series": Iterator[pd.Series], "return": Iterator[pd.Series]}
    fingerprint = F.pandas_udf(run, "string")
    rows = shared.withColumn("__fp", fingerprint("text")).join(
        prints.select("__id", F.col("__fp").alias("__fp2")),
        F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.col("__fp") == F.col("__fp2")), "left_semi",
    )
    first = F.min_by(F.struct(*[F.col(c) for c in shared.columns]), F.coalesce("text", F.lit(""))).alias("__first")
    with_id = rows.filter("doc_id is not null").groupBy("doc_id").agg(first)
    without = rows.filter("doc_id is null").groupBy("__fp").agg(first)
    return with_id.select("__first.*").unionByName(without.select("__first.*"))

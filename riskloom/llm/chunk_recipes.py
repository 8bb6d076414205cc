"""Exact dedup by chunk recipes.

A text is cut into chunks where its own bytes say so: a 32-byte rolling hash that falls below a threshold ends a chunk,
so equal stretches are cut alike wherever they stand. Chunks are numbered by a hash, and a document becomes its recipe,
the ordered list of its chunks' numbers. Recipes that differ prove that texts differ. Where recipes agree their chunks
are deduplicated in Spark with their bytes, and that store is asked whether any number names two different byte
strings. If one does, all numbers are made again with twice the bits, so that the identifiers in use are verified, not
assumed, and equal texts are equal lists. Long texts do not move: what is grouped and joined are lists, and of the bytes
only chunks of texts that have a copy, once each.

Groups are joined back over salts, so that no task holds a whole group of copies.

A null text is the empty text, whose recipe is empty; all such rows are one group. A null id is smaller than any other.
Rows that repeat both id and text count one by one, and exactly one of them stays. An empty table gives no rows. Other
columns are not read, so their names cannot clash. Texts have no length limit: the hash walks them in blocks.
"""

from __future__ import annotations

import bisect
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.session import cut_lineage
from riskloom.llm.common import checked_broadcast, map_chunks

LEAST_CHUNK = 256
LONGEST_CHUNK = 8192
# A chunk ends where the rolling hash is below this: once in 1,024 bytes.
BELOW = 1 << 22
# Bytes that the rolling hash sees, and bytes hashed at once.
SEEN = 32
BLOCK = 1 << 20
# Rows of one group that meet in one task, and the most salts that spread them.
ROWS_PER_SALT = 500
SALTS = 4096
# Numbers, of 16 bytes, that are broadcast; more are joined by shuffle.
SENT_NUMBERS = 500_000


def _gear() -> np.ndarray:
    """A 32-bit number for each byte value, by the splitmix rule."""
    with np.errstate(over="ignore"):
        z = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (z >> np.uint64(32)).astype(np.uint32)


GEAR = _gear()


def edges(data: np.ndarray) -> np.ndarray:
    """Places behind which the rolling hash would end a chunk, in ascending order."""
    found = []
    for begin in range(0, len(data), BLOCK):
        first = max(0, begin - SEEN + 1)
        h = GEAR[data[first : begin + BLOCK]]
        step = 1
        while step < SEEN:
            # The hash of 2 * step bytes from that of step bytes.
            h[step:] += h[:-step] << np.uint32(step)
            step *= 2
        hits = np.flatnonzero(h < BELOW) + first + 1
        found.append(hits[hits > begin])
    return np.concatenate(found) if found else np.zeros(0, dtype=np.int64)


def cuts(begin: int, end: int, places: list[int]) -> list[int]:
    """Ends of the chunks of the text at begin..end: the next place that leaves a chunk neither too short nor too long."""
    out, at = [], begin
    while end - at > LEAST_CHUNK:
        i = bisect.bisect_left(places, at + LEAST_CHUNK)
        stop = min(at + LONGEST_CHUNK, end)
        at = places[i] if i < len(places) and places[i] < stop else stop
        out.append(at)
    if at < end:
        out.append(end)
    return out


def _texts(column: pa.Array) -> tuple[np.ndarray, list[int]]:
    """The bytes of all texts, one after the other, and where each begins."""
    filled = pa.compute.fill_null(column.cast(pa.large_binary()), b"")
    if isinstance(filled, pa.ChunkedArray):
        filled = filled.combine_chunks()
    offsets = np.frombuffer(filled.buffers()[1], dtype=np.int64)[filled.offset : filled.offset + len(filled) + 1]
    buffer = filled.buffers()[2]
    data = np.frombuffer(buffer, dtype=np.uint8) if buffer is not None else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], (offsets - offsets[0]).tolist()


def _numbers(bits: int):
    """Chunk bytes -> (number, number) of ``bits`` bits in all."""
    import xxhash

    def signed(n: int) -> int:
        return n - (1 << 64) if n >> 63 else n

    if bits <= 64:
        mask, digest = (1 << bits) - 1, xxhash.xxh3_64_intdigest
        return lambda b: (signed(digest(b) & mask), 0)

    wide = xxhash.xxh3_128_intdigest

    def both(b):
        n = wide(b)
        return signed(n >> 64), signed(n & 0xFFFFFFFFFFFFFFFF)

    return both


def chunk_store(docs: DataFrame, bits: int = 64, text: str = "text", among: DataFrame | None = None) -> DataFrame:
    """(c1, c2, bytes): every distinct chunk of the corpus with its number, or those of the numbers in ``among`` (c1, c2)."""
    def make():
        number = _numbers(bits)

        def work(chunk):
            data, starts = _texts(chunk.column("text"))
            places, view, seen = edges(data).tolist(), data.tobytes(), set()
            for a, b in zip(starts, starts[1:]):
                for end in cuts(a, b, places):
                    seen.add(view[a:end])
                    a = end
            pairs = [number(b) for b in seen]
            return {"c1": [p for p, _ in pairs], "c2": [p for _, p in pairs], "bytes": list(seen)}

        return work

    found = map_chunks(docs.select(F.col(text).cast("string").alias("text")), "text", "c1 long, c2 long, bytes binary", make)
    return (found if among is None else found.join(checked_broadcast(among, SENT_NUMBERS), ["c1", "c2"], "left_semi")).distinct()


def clashes(docs: DataFrame, found: DataFrame, bits: int, text: str = "text") -> bool:
    """Whether a number in a recipe that several rows of ``found`` have names different chunks."""
    shared = found.groupBy("recipe").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    if bits > 64:
        pairs = F.transform(F.sequence(F.lit(0), F.size("recipe") - 2, F.lit(2)), lambda i: F.struct(F.get("recipe", i).alias("c1"), F.get("recipe", i + 1).alias("c2")))
    else:
        pairs = F.transform("recipe", lambda c: F.struct(c.alias("c1"), F.lit(0).cast("long").alias("c2")))
    numbers = cut_lineage(shared.filter(F.size("recipe") > 0).select(F.inline(pairs)).distinct())
    if numbers.isEmpty():
        return False
    return not chunk_store(docs, bits, text, numbers).groupBy("c1", "c2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty()


def verified_recipes(docs: DataFrame, bits: int = 64, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """(doc_id, recipe, text_sha256) with as many bits as it takes until equal recipes mean equal texts."""
    while True:
        found = cut_lineage(recipes(docs, bits, text, row_id))
        if bits >= 128 or not clashes(docs, found, bits, text):
            return found
        bits *= 2


def recipes(docs: DataFrame, bits: int, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """(doc_id, recipe, text_sha256) of every row; a recipe lists the numbers of its chunks in order."""
    def make():
        number = _numbers(bits)

        def work(chunk):
            data, starts = _texts(chunk.column("text"))
            places, view, lists, digests = edges(data).tolist(), memoryview(data.tobytes()), [], []
            for a, b in zip(starts, starts[1:]):
                digests.append(hashlib.sha256(view[a:b]).hexdigest())
                recipe = []
                for end in cuts(a, b, places):
                    recipe += number(view[a:end])
                    a = end
                lists.append(recipe if bits > 64 else recipe[::2])
            return {"doc_id": chunk.column("doc_id"), "recipe": lists, "text_sha256": digests}

        return work

    slim = docs.select(F.col(row_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return map_chunks(slim, "text", "doc_id long, recipe array<long>, text_sha256 string", make)


def exact_duplicates(docs: DataFrame, text: str = "text", row_id: str = "doc_id", bits: int = 64) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row; of equal texts the row with the largest id stays."""
    found = verified_recipes(docs, bits, text, row_id)
    salts = max(1, min(SALTS, -(-found.count() // ROWS_PER_SALT)))
    # The written rows have fixed places, which tell repeated rows apart.
    rows = found.withColumn("at", F.monotonically_increasing_id()).withColumn("salt", F.pmod("at", F.lit(salts)))
    groups = (
        rows.groupBy("recipe")
        .agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("doc_id", (-F.col("at")).alias("back"))).alias("top"), F.collect_set("salt").alias("salts"))
        .filter("n > 1")
        .select(F.col("recipe").alias("r"), "n", "top", F.explode("salts").alias("s"))
    )
    joined = rows.join(groups, (F.col("recipe") == F.col("r")) & (F.col("salt") == F.col("s")), "left")
    return joined.select(
        "doc_id",
        F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("top.doc_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("top.back") == -F.col("at"), F.lit(True)).alias("kept"),
        "text_sha256",
    )


def without_duplicates(docs: DataFrame, text: str = "text", row_id: str = "doc_id", bits: int = 64) -> DataFrame:
    """The rows that stay, with all their columns. A row is found again by its id and its text's digest."""
    taken = set(docs.columns)
    free = lambda name: next(n for n in (name + "_" * k for k in range(len(taken) + 1)) if n not in taken)
    key, digest, place = free("kept_key"), free("kept_digest"), free("kept_place")
    stay = exact_duplicates(docs, text, row_id, bits).filter("kept").select(F.col("doc_id").alias(key), F.col("text_sha256").alias(digest))
    named = docs.withColumn(place, F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary"), 256))
    same = F.col(row_id).cast("long").eqNullSafe(F.col(key)) & (F.col(place) == F.col(digest))
    kept = named.join(stay, same, "left_semi")
    # Rows that repeat id and text are numbered; the order among them does not matter, they differ in other columns at most.
    nth = F.row_number().over(Window.partitionBy(F.col(row_id), F.col(place)).orderBy(*[F.col(c) for c, t in docs.dtypes if not t.startswith(("map", "variant"))]))
    return kept.withColumn(digest, nth).filter(F.col(digest) == 1).select(*docs.columns)

"""Benchmark decontamination by the q-gram lemma.

Texts are lower-cased (A-Z) and runs of ASCII white space are one space. A passage of a text that lies within the edit
budget e of a benchmark item of m characters shares at least m + 1 - q - q * e of its character q-grams with it, on
diagonals that differ by e at most. So shared q-grams are counted in overlapping bands of diagonals, a band at least
twice as wide as the budget; bands that reach the bound are kept and decided by a banded alignment.

Items shorter than ``min_chars`` characters name no passage, or with ``short`` those places that hold them without an
edit and between word edges. Null and empty texts have none; repeated rows and null ids are judged like any other.
Items are read in blocks of a bounded size, each against all rows before the next is read; a driver and a task hold one.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.session import cut_lineage
from riskloom.llm.common import chunks, id_key, map_chunks, texts_of

Q = 10
# Edits allowed per character of an item, and the shortest item that counts.
BUDGET = 0.06
MIN_CHARS = 32
# Characters of items held by a task at once; more are further blocks.
BLOCK_CHARS = 4_000_000

# Fixed value: code points of scripts that write no spaces between words (Thai to Khmer, kana, Chinese characters).
UNSPACED = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_BASE = np.uint64(0x9E3779B97F4A7C15)
_TABLE_BITS = 22


def normal(text: bytes) -> np.ndarray:
    """Code points of the normalised text."""
    clean = b" ".join(text.translate(_LOWER).split())
    return np.frombuffer(clean.decode().encode("utf-32-le"), dtype=np.uint32)


def _grams(codes: np.ndarray, q: int = Q) -> np.ndarray:
    """Hash of the q-gram at every position, by doubling."""
    n = len(codes) - q + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    have, size = codes.astype(np.uint64) + np.uint64(1), 1
    out, done, rest = None, 0, q
    while rest:
        if rest & 1:
            part = have[: len(codes) - size + 1]
            out = part if out is None else _joined(part, out, size, done)
            done += size
        rest >>= 1
        if rest:
            have = have[: len(have) - size] * _power(size) + have[size:]
            size *= 2
    mixed = out[:n] ^ (out[:n] >> np.uint64(31))
    return mixed * np.uint64(0xBF58476D1CE4E5B9)


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_BASE), n, 1 << 64))


def _joined(first: np.ndarray, then: np.ndarray | None, size: int, done: int) -> np.ndarray:
    """Hash of ``size`` characters followed by ``done`` characters."""
    n = min(len(first), len(then) - size)
    return first[:n] * _power(done) + then[size : size + n]


def edit_budget(chars: int, share: float = BUDGET, q: int = Q) -> int:
    """Largest allowed number of edits at which the lemma still asks for a shared q-gram."""
    return max(0, min(int(share * chars), (chars - q) // q))


@dataclass
class Items:
    """Benchmark items of a block, and the postings of their q-grams."""

    ids: list
    texts: list[np.ndarray]
    hashes: np.ndarray
    begins: np.ndarray
    item: np.ndarray
    place: np.ndarray
    table: np.ndarray
    needs: np.ndarray
    share: float
    # Items that are matched as they are, by length and characters: their places in ids, behind those of texts.
    exact: dict[int, dict[bytes, list[int]]]

    @classmethod
    def of(cls, rows: list[tuple], share: float, min_chars: int, short: bool = False) -> Items:
        ids, texts, exact, few = [], [], {}, []
        for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0], r[1])):
            codes = normal((t or "").encode())
            if len(codes) >= max(min_chars, Q):
                ids.append(i)
                texts.append(codes)
            elif short and len(codes):
                few.append((i, codes))
        for i, codes in few:
            exact.setdefault(len(codes), {}).setdefault(codes.tobytes(), []).append(len(ids))
            ids.append(i)
        grams = [_grams(t) for t in texts]
        flat = np.concatenate(grams) if grams else np.zeros(0, dtype=np.uint64)
        item = np.repeat(np.arange(len(texts)), [len(g) for g in grams]).astype(np.int64)
        place = np.concatenate([np.arange(len(g)) for g in grams]).astype(np.int64) if grams else np.zeros(0, dtype=np.int64)
        order = np.argsort(flat, kind="stable")
        hashes, begins = np.unique(flat[order], return_index=True)
        table = np.zeros(1 << _TABLE_BITS, dtype=bool)
        table[hashes >> np.uint64(64 - _TABLE_BITS)] = True
        needs = np.array([len(t) + 1 - Q - Q * edit_budget(len(t), share) for t in texts], dtype=np.int64)
        return cls(ids, texts, hashes, np.append(begins, len(flat)), item[order], place[order], table, needs, share, exact)


def align(pattern: np.ndarray, text: np.ndarray, low: int, high: int, budget: int) -> tuple[int, int, int] | None:
    """(edits, begin, end) of the best place of the pattern in the text whose alignment stays on diagonals low..high.

    A diagonal is a text position less a pattern position. None when every place takes more edits than the budget.
    """
    width = high - low + 1
    steps = np.arange(width)
    far = budget + 1
    valid = (low + steps >= 0) & (low + steps <= len(text))
    cost = np.where(valid, 0, far + width).astype(np.int64)
    begin = low + steps
    for i in range(len(pattern)):
        # Cell d of row i + 1 is text position i + 1 + low + d.
        at = i + low + steps
        inside = (at >= 0) & (at < len(text))
        same = np.zeros(width, dtype=bool)
        same[inside] = text[at[inside]] == pattern[i]
        step = cost + ~same
        step[~inside] = far + width
        skip = np.append(cost[1:], far + width) + 1
        took = skip < step
        best = np.where(took, skip, step)
        origin = np.where(took, np.append(begin[1:], 0), begin)
        best[(at + 1 < 0) | (at + 1 > len(text))] = far + width
        # Text characters passed over: the least of cost minus position, carried along.
        lead = np.minimum.accumulate(best - steps) + steps
        source = np.maximum.accumulate(np.where(best - steps == np.minimum.accumulate(best - steps), steps, 0))
        cost, begin = lead, origin[source]
        if cost.min() > budget:
            return None
    d = int(cost.argmin())
    return int(cost[d]), int(begin[d]), int(len(pattern) + low + d)


def _unedited(pattern: np.ndarray, text: np.ndarray, diagonals: np.ndarray) -> tuple[int, int, int] | None:
    """The alignment without edits on the diagonal that shares most q-grams, if it is one."""
    if not len(diagonals):
        return None
    values, counts = np.unique(diagonals, return_counts=True)
    d = int(values[counts.argmax()])
    if d >= 0 and np.array_equal(text[d : d + len(pattern)], pattern):
        return 0, d, d + len(pattern)
    return None


def _edges(codes: np.ndarray) -> np.ndarray:
    """Whether each place of a normalised text, from before it to behind it, is a word edge.

    None is between two letters or digits, except beside a character of a script without spaces.
    """
    chars = codes.astype("<u4").tobytes().decode("utf-32-le", "replace")
    word = np.array([c.isalnum() or c == "_" or unicodedata.combining(c) > 0 for c in chars], dtype=bool)
    alone = np.zeros(len(codes), dtype=bool)
    for a, b in UNSPACED:
        alone |= (codes >= a) & (codes <= b)
    joined = word & ~alone
    return ~(np.append(False, joined) & np.append(joined, False))


def exact_passages(codes: np.ndarray, items: Items) -> list[tuple[int, int, int, int]]:
    """Places of the short items, each of which begins and ends at a word edge and not inside one before."""
    if not items.exact or not len(codes):
        return []
    edges, out = np.flatnonzero(_edges(codes)), []
    edge, raw = np.zeros(len(codes) + 1, dtype=bool), codes.astype("<u4").tobytes()
    edge[edges] = True
    for size, known in items.exact.items():
        begins = edges[edges + size <= len(codes)]
        begins = begins[edge[begins + size]]
        # After an item's place the next one may begin.
        free: dict[int, int] = {}
        for a in begins.tolist():
            for k in known.get(raw[4 * a : 4 * (a + size)], ()):
                if a >= free.get(k, 0):
                    out.append((k, a, a + size, 0))
                    free[k] = a + size
    return out


def passages(codes: np.ndarray, items: Items) -> list[tuple[int, int, int, int]]:
    """(item, begin, end, edits) of the items that the normalised text holds within the budget."""
    return near_passages(codes, items) + exact_passages(codes, items)


def near_passages(codes: np.ndarray, items: Items) -> list[tuple[int, int, int, int]]:
    """Places of the items that may be edited."""
    grams = _grams(codes)
    if not len(grams) or not len(items.hashes):
        return []
    at = np.flatnonzero(items.table[grams >> np.uint64(64 - _TABLE_BITS)])
    if not len(at):
        return []
    found = np.minimum(np.searchsorted(items.hashes, grams[at]), len(items.hashes) - 1)
    real = items.hashes[found] == grams[at]
    at, found = at[real], found[real]
    if not len(at):
        return []
    counts = items.begins[found + 1] - items.begins[found]
    first = np.repeat(items.begins[found] - np.append(0, np.cumsum(counts)[:-1]), counts) + np.arange(counts.sum())
    item, place, text_at = items.item[first], items.place[first], np.repeat(at, counts)
    out = []
    # An item that shares fewer q-grams than the lemma asks for has no band either.
    shared = np.bincount(item, minlength=len(items.texts))
    for k in np.flatnonzero(shared >= items.needs).tolist():
        pattern, need = items.texts[k], int(items.needs[k])
        budget = edit_budget(len(pattern), items.share)
        diagonal = (text_at - place)[item == k]
        half = 2 * budget + 1
        # Bands 2 * half wide, each over half of the next: any run of diagonals up to half lies in one.
        bands = np.floor_divide(diagonal, half)
        number, hits = np.unique(np.concatenate([bands, bands - 1]), return_counts=True)
        seen, last = -1, None
        for b in number[hits >= need].tolist():
            low, high = b * half - budget, (b + 2) * half + budget
            # A passage that the band before has found counts once.
            if last is not None and last >= b * half:
                continue
            if got := _unedited(pattern, codes, diagonal[(bands == b) | (bands == b + 1)]) or align(pattern, codes, low, high, budget):
                edits, begin, end = got
                if begin >= seen:
                    out.append((k, begin, end, edits))
                    seen, last = end, begin
    return out


def _blocks(benchmark: DataFrame, block_chars: int) -> list[DataFrame]:
    chars = benchmark.agg(F.sum(F.length("text"))).collect()[0][0] or 0
    n = -(-chars // block_chars) or 1
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    return [rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i) for i in range(n)]


def _sent(docs: DataFrame, block: DataFrame, share: float, min_chars: int, short: bool):
    return docs.sparkSession.sparkContext.broadcast(Items.of([tuple(r) for r in block.collect()], share, min_chars, short))


def find(docs: DataFrame, benchmark: DataFrame, share: float = BUDGET, min_chars: int = MIN_CHARS, block_chars: int = BLOCK_CHARS, short: bool = False) -> DataFrame:
    """(doc_id, item_id, begin, end, edits): every passage of every row, in characters of the normalised text."""
    schema = "doc_id long, item_id long, begin long, end long, edits int"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _over_blocks(rows, benchmark, share, min_chars, block_chars, short, schema, lambda chunk, items, _: [
        (doc, items.ids[k], b, e, d)
        for doc, text in zip(chunk.column("doc_id").to_pylist(), texts_of(chunk.column("text"))) for k, b, e, d in passages(normal(text), items)
    ])


def _over_blocks(rows: DataFrame, benchmark: DataFrame, share: float, min_chars: int, block_chars: int, short: bool, schema: str, found) -> DataFrame:
    """What ``found`` lists of each chunk and each block of items. A block is done and released before the next is read."""
    from pyspark.sql.types import StructType

    blocks, out = _blocks(benchmark, block_chars), None
    names = StructType.fromDDL(schema).names
    for k, block in enumerate(blocks):
        sent = _sent(rows, block, share, min_chars, short)

        def make(sent=sent, k=k):
            items = sent.value

            def work(chunk):
                columns = list(zip(*found(chunk, items, k))) or [[]] * len(names)
                return {n: list(c) for n, c in zip(names, columns)}

            return work

        part = map_chunks(rows, "text", schema, make)
        if len(blocks) > 1:
            part = cut_lineage(part)
            sent.destroy()
        out = part if out is None else out.union(part)
    return out


def mark(docs: DataFrame, benchmark: DataFrame, share: float = BUDGET, min_chars: int = MIN_CHARS, block_chars: int = BLOCK_CHARS, keep_rows: bool = False, short: bool = False) -> DataFrame:
    """One row for each row: doc_id, contaminated, n_passages, items (sorted ids); with ``keep_rows`` the clean rows themselves."""
    blocks = _blocks(benchmark, block_chars)
    if len(blocks) > 1:
        return _mark_by_blocks(docs, benchmark, share, min_chars, block_chars, keep_rows, short)
    sent = _sent(docs, blocks[0], share, min_chars, short)

    def clean(batches):
        items = sent.value
        for batch in (c for b in batches for c in chunks(b, "text")):
            found = [not passages(normal(text), items) for text in texts_of(batch.column("text"))]
            yield batch.filter(pa.array(found, type=pa.bool_()))

    if keep_rows:
        return docs.mapInArrow(clean, docs.schema)

    def make():
        items = sent.value

        def work(chunk):
            hits = [[items.ids[k] for k, *_ in passages(normal(text), items)] for text in texts_of(chunk.column("text"))]
            return {
                "doc_id": chunk.column("doc_id"), "contaminated": np.array([bool(h) for h in hits], dtype=bool),
                "n_passages": np.array([len(h) for h in hits], dtype=np.int64),
                "items": pa.array([sorted({i for i in h if i is not None}) for h in hits], pa.list_(pa.int64())),
            }

        return work

    return map_chunks(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "text", "doc_id long, contaminated boolean, n_passages long, items array<long>", make)


def _mark_by_blocks(docs: DataFrame, benchmark: DataFrame, share: float, min_chars: int, block_chars: int, keep_rows: bool, short: bool) -> DataFrame:
    """The same from one pass for each block: the hits of a row, named by its id and text, meet it in a join."""
    names = ["__id", "__h", "__n"]
    key = [id_key().alias("__id"), F.xxhash64("text").alias("__h"), F.coalesce(F.length("text"), F.lit(-1)).alias("__n")]
    schema = "__id long, __h long, __n int, block int, item long, times long"

    def found(chunk, items, block):
        keys = zip(*(chunk.column(c).to_pylist() for c in names))
        counted = (Counter(items.ids[k] for k, *_ in passages(normal(t), items)) for t in texts_of(chunk.column("text")))
        return [(*k, block, i, n) for k, c in zip(keys, counted) for i, n in c.items()]

    # Equal rows have equal hits, which count once.
    hits = _over_blocks(docs.select(*key, "text"), benchmark, share, min_chars, block_chars, short, schema, found).distinct()
    by_row = hits.groupBy(*names).agg(F.sum("times").alias("__p"), F.sort_array(F.collect_set("item")).alias("__i"))
    if keep_rows:
        return docs.select("*", *key).join(by_row, names, "left_anti").select(*docs.columns)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *key).join(by_row, names, "left")
    return rows.select("doc_id", F.col("__p").isNotNull().alias("contaminated"), F.coalesce("__p", F.lit(0)).alias("n_passages"), F.coalesce("__i", F.array().cast("array<long>")).alias("items"))

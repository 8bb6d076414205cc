"""Harmonic packing: pieces of 1/k of a sequence, k to a sequence.

A document's tokens are cut, from the front, into the largest lengths of the form ``capacity // k`` that remain, so
that every piece of class k fills exactly its share and k of them fill a sequence up to ``capacity % k`` places.
Pieces of a class are numbered apart in every cell of a hash and filled k by k, so that classes and cells do not wait
for each other. What is left of each class, fewer than k pieces, is a bounded list whose counts alone are planned
into the last sequences, largest first.

Null texts count as empty and have only the end token. Repeated rows and null ids are packed like any other.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.session import cut_lineage
from riskloom.llm.common import map_chunks, number_rows
from riskloom.llm.subwords import TOGETHER, WORD_MODEL, word_ids

CAPACITY = 4096
END_ID = 2
# Pieces that are numbered together.
ROWS_PER_CELL = 5_000


def classes(capacity: int = CAPACITY) -> dict[int, int]:
    """Length of a piece -> pieces of that length in a sequence, longest first: 1/1, 1/2, ... and every short length."""
    short = int(capacity**0.5)
    return {n: capacity // n for n in sorted({*(capacity // k for k in range(1, short + 1)), *range(1, short)}, reverse=True)}


def cut_lengths(length: int, capacity: int = CAPACITY) -> list[int]:
    """Greedy cut of a length into class lengths."""
    out, rest = [capacity] * (length // capacity), length % capacity
    for n in classes(capacity):
        while rest >= n:
            out.append(n)
            rest -= n
    return out


def pieces(docs: DataFrame, capacity: int = CAPACITY, model: str = WORD_MODEL, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens[, ids]) of every piece of every row."""
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + (", ids binary" if keep_ids else "")

    def make():
        encoder, end = word_ids(model), np.array([end_id], dtype="<u4").tobytes()
        rests = {n: cut_lengths(n, capacity) for n in range(capacity)}

        def work(chunk):
            rows, ids = [], []
            for doc, raw in zip(chunk.column("doc_id").to_pylist(), encoder.ids(chunk.column("text"))):
                raw += end
                total, start = len(raw) // 4, 0
                for n in [capacity] * (total // capacity) + rests[total % capacity]:
                    part = raw[4 * start : 4 * (start + n)]
                    rows.append((doc, start, n, zlib.crc32(part), total))
                    if keep_ids:
                        ids.append(part)
                    start += n
            columns = list(zip(*rows)) if rows else [[]] * 5
            out = {k: pa.array(v, pa.int64()) for k, v in zip(("doc_id", "start", "length", "ids_crc32", "doc_tokens"), columns)}
            return out | ({"ids": pa.array(ids, pa.binary())} if keep_ids else {})

        return work

    return map_chunks(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "text", schema, make, TOGETHER)


def plan_rest(left: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int]]:
    """(length, which of its class, sequence, offset) for the pieces left of each class, largest first into the first gap."""
    gaps: list[int] = []
    out = []
    for n in sorted(left, reverse=True):
        at = 0
        for i in range(left[n]):
            while at < len(gaps) and gaps[at] < n:
                at += 1
            if at == len(gaps):
                gaps.append(capacity)
            out.append((n, i, at, capacity - gaps[at]))
            gaps[at] -= n
    return out


def pack(docs: DataFrame, capacity: int = CAPACITY, model: str = WORD_MODEL, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``: gapless sequences of at most ``capacity`` tokens."""
    spark = docs.sparkSession
    numbered = number_rows(cut_lineage(pieces(docs, capacity, model, end_id, keep_ids)), ["length"], [F.col("doc_id"), F.col("start"), F.col("ids_crc32")], [F.col("doc_id"), F.col("start"), F.col("ids_crc32")], "__i", ROWS_PER_CELL)
    # A row per class: some hundred at most.
    counts = {r["length"]: r["n"] for r in numbered.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    per, plan, first, left = classes(capacity), [], 0, {}
    for n in sorted(counts, reverse=True):
        full = counts[n] // per[n]
        plan.append((n, per[n], first, full * per[n]))
        first, left[n] = first + full, counts[n] % per[n]
    rest = [(n, i, first + s, o) for n, i, s, o in plan_rest(left, capacity)]
    # Both tables are bounded by the classes: fewer than k rows for each.
    plans = F.broadcast(spark.createDataFrame(plan, "length long, __k long, __first long, __full long"))
    rests = F.broadcast(spark.createDataFrame(rest, "length long, __j long, __sequence long, __offset long"))
    placed = numbered.join(plans, "length", "left").withColumn("__j", F.col("__i") - F.col("__full")).join(rests, ["length", "__j"], "left")
    in_full = F.col("__i") < F.col("__full")
    return placed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if keep_ids else []),
        F.when(in_full, F.col("__first") + F.floor(F.col("__i") / F.col("__k"))).otherwise(F.col("__sequence")).cast("long").alias("sequence_id"),
        F.when(in_full, F.col("__i") % F.col("__k") * F.col("length")).otherwise(F.col("__offset")).cast("long").alias("offset"),
    )

"""Sharding by bytes: the minimax contiguous partition of texts in hash order.

Rows with equal texts are one atomic group. A group heavier than an equal share has a shard of its own and comes first
in the order, so that it does not leave other shards empty; the rest follow by a 128-bit hash of the text. The smallest
capacity that lets a greedy walk over the group sizes make at most ``shards`` shards is found by binary search, and
the cuts lie where the walk cuts. The walk reads a table of prefix sums over ranges of the hash: 65,536 ranges at
first, and only those in which a cut can lie are divided further, until each holds one group or no cut. The driver
sees these sums alone, whose number does not grow with the corpus.

A null text is a group of its own of size 8 a row. Repeated rows are of one group. An empty table has no shards.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.session import cut_lineage
from riskloom.llm.common import number_rows

FIRST_BITS = 16
MORE_BITS = 8
# Bytes that a row weighs besides its text.
ROW_BYTES = 8


@dataclass(frozen=True, order=True)
class Range:
    """Groups whose 128-bit hash begins with ``head`` in its first ``bits`` bits."""

    begin: tuple[int, int]
    bits: int
    size: int
    groups: int


def with_hashes(docs: DataFrame) -> DataFrame:
    """Adds __h1, __h2 (the text's hash) and __size."""
    return docs.withColumns({
        "__h1": F.xxhash64("text"), "__h2": F.xxhash64(F.lit(1), F.col("text")),
        "__size": F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + ROW_BYTES,
    })


def _begin(bits: int) -> tuple[Column, Column]:
    """Least hash pair of the range that a row lies in."""
    def low(c: str, n: int) -> Column:
        return F.shiftleft(F.shiftright(F.col(c), 64 - n), 64 - n)

    if bits <= 64:
        return low("__h1", bits), F.lit(-(1 << 63))
    return F.col("__h1"), low("__h2", bits - 64)


def _ranges(groups: DataFrame, bits: int) -> list[Range]:
    a, b = _begin(bits)
    rows = groups.groupBy(a.alias("a"), b.alias("b")).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()
    return sorted(Range((r["a"], r["b"]), bits, r["size"], r["n"]) for r in rows)


def _walk(ranges: list[Range], capacity: int, fluid: bool) -> list[int] | None:
    """Bytes before each cut of the greedy walk; None if a piece does not fit. ``fluid``: ranges of many groups may be cut anywhere."""
    cuts, filled, at = [], 0, 0
    for r in ranges:
        size = r.size
        if filled + size > capacity:
            if fluid and r.groups > 1:
                size -= capacity - filled
                at += capacity - filled
                cuts.append(at)
                while size > capacity:
                    size -= capacity
                    at += capacity
                    cuts.append(at)
            else:
                if size > capacity:
                    return None
                cuts.append(at)
            filled = 0
        filled += size
        at += size
    return cuts


def _capacity(ranges: list[Range], shards: int, fluid: bool) -> int:
    low, high = 1, max(1, sum(r.size for r in ranges))
    while low < high:
        mid = (low + high) // 2
        cuts = _walk(ranges, mid, fluid)
        low, high = (low, mid) if cuts is not None and len(cuts) < shards else (mid + 1, high)
    return low


def _open_ranges(ranges: list[Range], shards: int) -> list[Range]:
    """Ranges of several groups in which a cut of the walk at the smallest capacity can lie."""
    low, high = _capacity(ranges, shards, True), _capacity(ranges, shards, False)
    # The i-th cut lies behind i steps of the least capacity that each give up their last range, and before i full
    # steps; no cut lies inside a range of one group.
    edges = [0]
    for r in ranges:
        edges.append(edges[-1] + r.size)
    out, begin, end = set(), 0, 0
    for _ in range(shards - 1):
        begin = edges[bisect_right(edges, begin + low) - 1]
        end += high
        i = bisect_right(edges, end) - 1
        if i < len(ranges) and ranges[i].groups == 1:
            end = edges[i]
        out.update(r for r in ranges[bisect_right(edges, begin) - 1 : bisect_left(edges, end)] if r.groups > 1)
    return sorted(out)


def find_cuts(groups: DataFrame, shards: int) -> tuple[list[tuple[int, int]], int]:
    """Least hash pair of every shard but the first, and the capacity. ``groups`` has __h1, __h2, size, one row a group."""
    spark = groups.sparkSession
    ranges = _ranges(groups, FIRST_BITS)
    while ranges and (opened := _open_ranges(ranges, shards)):
        inner = set(opened)
        kept, parts = [r for r in ranges if r not in inner], []
        for bits in sorted({r.bits for r in opened}):
            a, b = _begin(bits)
            # A few hundred ranges at most: those around the cuts.
            chosen = F.broadcast(spark.createDataFrame([r.begin for r in opened if r.bits == bits], "__a long, __b long"))
            inside = groups.join(chosen, (a == F.col("__a")) & (b == F.col("__b")), "left_semi")
            parts += _ranges(inside, min(128, bits + MORE_BITS))
        ranges = sorted(kept + parts)
    capacity = _capacity(ranges, shards, False) if ranges else 0
    marks, at, cuts = set(_walk(ranges, capacity, False) or []), 0, []
    for r in ranges:
        if at in marks:
            cuts.append(r.begin)
        at += r.size
    return cuts, capacity


def assign(docs: DataFrame, shards: int = 24) -> DataFrame:
    """The rows, with all their columns and __h1, __h2, __size, and their ``shard``."""
    hashed = with_hashes(docs)
    groups = cut_lineage(hashed.groupBy("__h1", "__h2").agg(F.sum("__size").alias("size")))
    large = giants(groups, shards)

    def among(pairs):
        return _any([(F.col("__h1") == a) & (F.col("__h2") == b) for a, b in pairs])

    rest = groups.filter(~among(large)) if large else groups
    cuts, _ = find_cuts(rest, shards - len(large))
    shard = F.lit(len(large))
    for a, b in cuts:
        shard = shard + ((F.col("__h1") > a) | ((F.col("__h1") == a) & (F.col("__h2") >= b))).cast("int")
    for i, pair in enumerate(large):
        shard = F.when(among([pair]), F.lit(i)).otherwise(shard)
    return hashed.withColumn("shard", shard.cast("int"))


def giants(groups: DataFrame, shards: int) -> list[tuple[int, int]]:
    """Groups that outweigh an equal share of what smaller groups leave to the other shards; fewer than ``shards``."""
    total = groups.agg(F.sum("size")).collect()[0][0] or 0
    out = []
    for r in groups.orderBy(F.col("size").desc(), "__h1", "__h2").limit(shards - 1).collect():
        if r["size"] * (shards - len(out)) <= total:
            break
        out.append((r["__h1"], r["__h2"]))
        total -= r["size"]
    return out


def _any(conditions: list[Column]) -> Column:
    result = F.lit(False)
    for c in conditions:
        result = result | c
    return result


def shard_rows(docs: DataFrame, shards: int = 24) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row."""
    slim = assign(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), shards).select(
        "doc_id", F.col("__size").alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), "shard", "__h1", "__h2",
    )
    order = [F.col("doc_id"), F.col("__h1"), F.col("__h2")]
    numbered = number_rows(cut_lineage(slim), ["shard"], order, order, "slot")
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

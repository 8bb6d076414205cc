"""What the text operators share: Arrow batches of whole texts, worker-wide caches, row numbers, checked broadcasts."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator, Sequence
from itertools import compress, count, repeat
from operator import is_, is_not

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Text bytes that a worker holds as Python objects at once; a longer text is a chunk of its own.
CHUNK_BYTES = 2 << 20

# A null id takes the last place in every order over ids.
NO_ID = (1 << 63) - 1

# Bytes that are ASCII white space.
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null is the empty text."""
    return [b"" if t is None else t for t in column.cast(pa.large_binary()).to_pylist()]


def chunks(batch: pa.RecordBatch, text: str, size: int | None = None) -> Iterator[pa.RecordBatch]:
    """Slices of the batch that hold about ``size`` bytes of text each, by default CHUNK_BYTES."""
    sizes = np.array([0 if n is None else n for n in pa.compute.binary_length(batch.column(text).cast(pa.large_binary())).to_pylist()], dtype=np.int64)
    if not len(sizes):
        return
    cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(sizes) // (size or CHUNK_BYTES))) + 1), len(sizes)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def map_chunks(df: DataFrame, text: str, schema: str | T.StructType, make: Callable[[], Callable[[pa.RecordBatch], dict]], size: int | None = None) -> DataFrame:
    """Map chunks of rows to columns of new rows. ``make`` runs once per task and returns the function of a chunk of about ``size`` bytes."""
    struct = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        forget_unused()
        arrow, work = to_arrow_schema(struct), make()
        for batch in batches:
            for chunk in chunks(batch, text, size):
                out = work(chunk)
                columns = [out[f.name] if isinstance(out[f.name], (pa.Array, pa.ChunkedArray)) else pa.array(out[f.name], type=f.type) for f in arrow]
                table = pa.Table.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)
                yield from table.to_batches(max_chunksize=100_000)

    return df.mapInArrow(run, struct)


def _worker_store() -> dict:
    return sys.modules.setdefault("_text_worker_cache", types.ModuleType("_text_worker_cache")).__dict__


def worker_cache(key: object, make: Callable[[], object]) -> object:
    """An object kept in the Python worker from task to task; only what can be made again at any time belongs here."""
    store = _worker_store().setdefault("kept", {})
    _worker_store().setdefault("used", set()).add(key)
    if key not in store:
        store[key] = make()
    return store[key]


def forget_unused() -> None:
    """Drop what the worker's last task did not ask for: workers outlive the stage whose tables they hold."""
    kept, used = _worker_store().setdefault("kept", {}), _worker_store().setdefault("used", set())
    if not kept:
        return
    for key in kept.keys() - used:
        del kept[key]
    used.clear()
    pa.default_memory_pool().release_unused()


class Memory:
    """Values by key in two generations: what is asked again moves to the young one, and the old one is dropped when that is full."""

    def __init__(self, size: int):
        self.size, self.young, self.old = size, {}, {}

    def missing(self, keys: set) -> list:
        """Keys without a value; every other one is in ``young`` until the next call."""
        if len(self.young) + len(keys) > self.size:
            self.young, self.old = {}, self.young
        # Key by key: the difference of a set and a dictionary's keys walks the whole dictionary.
        asked = list(compress(keys, map(is_, map(self.young.get, keys), repeat(None))))
        aged = list(map(self.old.get, asked))
        self.young.update(compress(zip(asked, aged), map(is_not, aged, repeat(None))))
        return list(compress(asked, map(is_, aged, repeat(None))))

    def values(self, lists: list[list], learn: Callable[[list], dict]) -> list[list]:
        """The value of every key of every list; ``learn`` gives those of keys without one, all lists' together."""
        out = [list(map(self.young.get, keys)) for keys in lists]
        unknown: set = set()
        for keys, own in zip(lists, out):
            unknown.update(compress(keys, map(is_, own, repeat(None))))
        if unknown:
            new = self.missing(unknown)
            if new:
                self.young.update(learn(new))
            young = self.young
            for keys, own in zip(lists, out):
                for i in compress(count(), list(map(is_, own, repeat(None)))):
                    own[i] = young[keys[i]]
        return out


def id_key(column: str = "doc_id") -> Column:
    return F.coalesce(F.col(column).cast("long"), F.lit(NO_ID))


def checked_broadcast(df: DataFrame, max_rows: int) -> DataFrame:
    """Hint a broadcast only when a count shows at most ``max_rows`` rows; else the join shuffles."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def number_rows(df: DataFrame, group: Sequence[str], order: Sequence[Column], spread: Sequence[Column], out: str, rows_per_task: int = 50_000) -> DataFrame:
    """Number the rows of each group from 0 without gaps, without gathering a group in one task.

    Rows are dealt over cells by a hash of ``spread``; a cell is numbered by itself and begins where the cells
    before it end. The numbers follow (cell, ``order``).
    """
    total = df.count()
    cells = max(1, min(1 << 20, -(-total // rows_per_task)))
    placed = df.withColumn("__cell", F.pmod(F.xxhash64(*spread), F.lit(cells)).cast("int"))
    counts = placed.groupBy(*group, "__cell").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*group).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)], F.col("__cell").alias("__c"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy(*group, "__cell").orderBy(*order)
    numbered = placed.withColumn("__rank", F.row_number().over(inside))
    same = [F.col(g).eqNullSafe(F.col(f"__g{i}")) for i, g in enumerate(group)] + [F.col("__cell") == F.col("__c")]
    joined = numbered.join(checked_broadcast(starts, 200_000), _all(same))
    return joined.withColumn(out, (F.col("__before") + F.col("__rank") - 1).cast("long")).drop("__cell", "__c", "__before", "__rank", "__n", *[f"__g{i}" for i in range(len(group))])


def _all(conditions: Sequence[Column]) -> Column:
    result = conditions[0]
    for c in conditions[1:]:
        result = result & c
    return result

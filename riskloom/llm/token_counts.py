"""Token counts by prefix: exact counts at the end of every unit of a text, and at every character inside a unit.

The count of a prefix is the count of the units before its end plus that of the part of the one unit it cuts. Units have
tables of their own prefixes, remembered by unit, so that truncation and budget questions never encode a text again. Null texts count as empty: no bytes, no tokens, an empty table.
Rows are answered one by one, repeated rows alike.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import map_chunks, texts_of
from riskloom.llm.subwords import PIECE_MODEL, PieceCounts, piece_counts


def prefix_table(units: list[str], counts: list[int], by_unit: bool) -> tuple[np.ndarray, np.ndarray]:
    """Character offsets at which units end, and the tokens of the text up to each of them.

    Every unit but a last one of spaces alone stands behind one space that it owns; the first one's is the model's.
    """
    if not by_unit:
        return np.array([len(u) for u in units], dtype=np.int64), np.array(counts, dtype=np.int64)
    sizes = [len(u) + 1 if u.strip(" ") else len(u) for u in units]
    return np.cumsum(np.array(sizes, dtype=np.int64)) - 1, np.cumsum(np.array(counts, dtype=np.int64))


def tokens_of_prefix(model: PieceCounts, text: str, ends: np.ndarray, tokens: np.ndarray, chars: int) -> int:
    """Tokens of ``text[:chars]``, from the table and the one unit that the prefix cuts."""
    if chars <= 0 or not len(ends):
        return 0
    if not model.by_unit:
        return int(model.prefix_counts(text)[min(chars, len(text)) - 1])
    chars = min(chars, len(text))
    i = bisect_right(ends, chars) - 1
    if i >= 0 and ends[i] == chars:
        return int(tokens[i])
    begin = int(ends[i]) + 1 if i >= 0 else 0
    before = int(tokens[i]) if i >= 0 else 0
    # The rest begins with the space that its unit owns, which the model puts there by itself.
    rest = min(chars, len(text)) - begin
    return before + (int(model.prefix_counts(text[begin : int(ends[i + 1])])[rest - 1]) if rest > 0 else 1)


def all_prefixes(model: PieceCounts, text: str, ends: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Tokens of ``text[:1]``, ``text[:2]`` and so on to the whole text."""
    if not model.by_unit:
        return model.prefix_counts(text) if text else np.zeros(0, dtype=np.int64)
    parts, at, before = [], 0, 0
    for i, (end, total) in enumerate(zip(ends.tolist(), tokens.tolist())):
        if i:
            parts.append([before + 1])
            at += 1
        if end > at:
            parts.append(before + model.prefix_counts(text[at:end]))
            # A unit's own count is the table's last.
            parts[-1][-1] = total
        elif i:
            parts[-1] = [total]
        at, before = end, total
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)


def longest_prefix(model: PieceCounts, text: str, ends: np.ndarray, tokens: np.ndarray, budget: int) -> int:
    """Characters of the longest prefix that has at most ``budget`` tokens."""
    i = int(np.searchsorted(tokens, budget, side="right"))
    if i == len(ends):
        return len(text)
    # Prefixes that end behind the first unit which is too much have its tokens, and more.
    end, before, begin = (int(ends[i - 1]), int(tokens[i - 1]), int(ends[i - 1]) + 1) if i and model.by_unit else (0, 0, 0)
    inside = np.flatnonzero(model.prefix_counts(text[begin : int(ends[i])]) <= budget - before)
    if len(inside):
        return begin + int(inside[-1]) + 1
    return begin if begin > end and before + 1 <= budget else end


def count_tokens(docs: DataFrame, budget: int = 4096, model: str = PIECE_MODEL, tables: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit, fit_chars) of every row; with ``tables`` also prefix_ends, prefix_tokens.

    ``fit_chars`` is the length of the longest prefix of at most ``budget`` tokens. ``prefix_tokens`` has the count of the
    prefix that ends at each of ``prefix_ends``: every character of the text.
    """
    schema = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fit_chars long"
    if tables:
        schema += ", prefix_ends array<long>, prefix_tokens array<long>"

    def make():
        encoder = piece_counts(model)

        def work(chunk):
            raw = texts_of(chunk.column("text"))
            texts = [t.decode() for t in raw]
            found = [prefix_table(encoder.units(t), c, encoder.by_unit) for t, c in zip(texts, encoder.counts(texts))]
            total = np.array([int(k[-1]) if len(k) else 0 for _, k in found], dtype=np.int64)
            out = {
                "doc_id": chunk.column("doc_id"), "n_bytes": np.array([len(t) for t in raw], dtype=np.int64), "n_tokens": total,
                "over_limit": total > budget, "fit_chars": np.array([longest_prefix(encoder, t, e, k, budget) for t, (e, k) in zip(texts, found)], dtype=np.int64),
            }
            if tables:
                out["prefix_ends"] = pa.array([np.arange(1, len(t) + 1) for t in texts], pa.list_(pa.int64()))
                out["prefix_tokens"] = pa.array([all_prefixes(encoder, t, e, k) for t, (e, k) in zip(texts, found)], pa.list_(pa.int64()))
            return out

        return work

    return map_chunks(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "text", schema, make)

"""Spelling variants: words one edit apart, found on a bit-sliced position index, and the form that each word leads to.

The index of a set of words has one bitset over the words for every (position, letter): bit w is set if word w has that
letter there. A query walks its letters once and holds three bitsets, for all words at a time: those that agree so far,
those that agree but for one replaced letter, and those that agree but for one letter more, whose letters are read one
position further on. Words of a length and of the next are searched with queries of the former; a near pair is told to
both its words, so that a missing letter needs no set of its own. Many queries walk side by side as rows of one matrix.

Spark deals the vocabulary to such indexes. Two near words agree, beside the one edit, on a whole half of the shorter
one, so every word is dealt under its first and under its last half, as long as the half of its own length and of the
length below. Parts that stay larger than ``PART`` words are dealt again: the edit lies between what the words are
known to share, so the same argument holds for what lies between. A part of a third of the vocabulary is thereby split
into ever smaller ones instead of being searched in one task or pair by pair. Small parts share an index.

Null texts have no words; a null id is written as the empty text in the hash. Runs of any length count. Repeated rows
count as often as they stand. A word without near words has ``n_near`` 0 and null forms. Empty tables give no rows. Other columns
are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.session import cut_lineage
from riskloom.llm.common import chunks, texts_of

# What a run is, which runs lose a letter, and the least length and number of a word.
RUN = r"[A-Za-zÀ-ÿ]"
LOSES = 31
LEAST_LENGTH = 7
LEAST_COUNT = 2
# A near word is a form if it occurs so many times as often.
FORM_FACTOR = 10
# Words counted in a task before they are sent on.
COUNTED = 300_000
# A part of more words is dealt again; an index has about so many words.
PART = 4_096
INDEX = 2_048
# Queries that walk side by side.
SIDE = 512
# Bytes of a table that may be broadcast.
SENT_BYTES = 8 << 20


# ------------------------------------------------------------------------------------------------ words

def word_counts(docs: DataFrame, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """(word, n): every word of the corpus, letters lost as the hash of id and run says, and how often it occurs."""
    slim = docs.select(F.coalesce(F.col(row_id).cast("long").cast("string"), F.lit("")).alias("id"), F.col(text).cast("string").alias("text"))

    def run(batches):
        # No run becomes longer, so that shorter ones are no words.
        runs, crc, found = re.compile(f"{RUN}{{{LEAST_LENGTH},}}"), zlib.crc32, Counter()

        def sent():
            out = pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], ["word", "n"])
            found.clear()
            return out

        for batch in batches:
            for chunk in chunks(batch, "text"):
                for i, body in zip(chunk.column("id").to_pylist(), texts_of(chunk.column("text"))):
                    seed = crc(f"{i}:".encode())
                    # bytes.lower() lowers A-Z alone.
                    for word, n in Counter(runs.findall(body.lower().decode())).items():
                        h = crc(word.encode(), seed)
                        if h % LOSES == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                            if len(word) < LEAST_LENGTH:
                                continue
                        found[word] += n
                    if len(found) > COUNTED:
                        yield sent()
        if found:
            yield sent()

    return slim.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


# ---------------------------------------------------------------------------------------------- the index

class PositionIndex:
    """Bitsets over words, one for every (position, letter) that occurs; bit w of a set is bit w % 64 of its word w // 64."""

    def __init__(self, letters: np.ndarray, lengths: np.ndarray, alphabet: int):
        """``letters`` has a row of letter numbers (below ``alphabet``) for each word, -1 behind its end."""
        self.words, self.alphabet = -(-len(letters) // 64), alphabet
        w, p = np.nonzero(letters >= 0)
        codes = p * alphabet + letters[w, p]
        self.codes, row = np.unique(codes, return_inverse=True)
        # The last row is that of letters that no word has there.
        self.sets = np.zeros((len(self.codes) + 1, self.words), dtype=np.uint64)
        np.bitwise_or.at(self.sets, (row, w >> 6), np.uint64(1) << (w & 63).astype(np.uint64))
        self.lengths = lengths

    def of_length(self, n: int) -> np.ndarray:
        bits = np.zeros(self.words * 64, dtype=np.uint8)
        bits[: len(self.lengths)] = self.lengths == n
        return np.packbits(bits, bitorder="little").view(np.uint64)

    def at(self, position: int, letters: np.ndarray) -> np.ndarray:
        """For each letter the words that have it at the position."""
        codes = position * self.alphabet + letters
        row = np.minimum(np.searchsorted(self.codes, codes), max(0, len(self.codes) - 1))
        return self.sets[np.where(self.codes[row] == codes, row, len(self.codes))] if len(self.codes) else self.sets[np.zeros(len(letters), dtype=np.int64)]

    def near(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, word): the word has one letter replaced, or one letter more. All queries have the same length."""
        length = queries.shape[1]
        agree = np.broadcast_to(~np.uint64(0), (len(queries), self.words)).copy()
        replaced, longer = np.zeros_like(agree), np.zeros_like(agree)
        here = self.at(0, queries[:, 0])
        for p in range(length):
            ahead = self.at(p + 1, queries[:, p])
            # A word has one more letter if it had before, or if all agreed up to here, and it goes on one position further.
            longer |= agree
            longer &= ahead
            replaced &= here
            replaced |= agree & ~here
            agree &= here
            if p + 1 < length:
                here = self.at(p + 1, queries[:, p + 1])
        # All agreed and the one letter more is the last.
        longer |= agree
        found = (replaced & self.of_length(length)) | (longer & self.of_length(length + 1))
        q, word = np.nonzero(found)
        bits = np.unpackbits(found[q, word].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        k, bit = np.nonzero(bits)
        return q[k], word[k] * 64 + bit


def near_pairs(words: list[str], lengths: np.ndarray, wanted: set[int]) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of distinct words at one edit from each other, one direction each: j is as long as i or one longer.

    Only pairs whose shorter word has a length in ``wanted`` are looked for.
    """
    from_, to = [], []
    for m in sorted(wanted):
        short, all_ = np.flatnonzero(lengths == m), np.flatnonzero((lengths == m) | (lengths == m + 1))
        if not len(short) or len(all_) < 2:
            continue
        points = np.frombuffer("".join(words[i] for i in all_).encode("utf-32-le"), dtype=np.uint32)
        alphabet, numbers = np.unique(points, return_inverse=True)
        size = lengths[all_]
        letters = np.full((len(all_), m + 1), -1, dtype=np.int64)
        letters[np.arange(m + 1) < size[:, None]] = numbers
        index = PositionIndex(letters, size, len(alphabet))
        asked = np.flatnonzero(size == m)
        for i in range(0, len(asked), SIDE):
            q, w = index.near(letters[asked[i : i + SIDE], :m])
            q = asked[i : i + SIDE][q]
            # A replaced letter is found from either word.
            once = (size[w] > m) | (q < w)
            from_.append(all_[q[once]])
            to.append(all_[w[once]])
    if not from_:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.concatenate(from_), np.concatenate(to)


# ------------------------------------------------------------------------------------------------- Spark

def _keyed(words: DataFrame) -> DataFrame:
    """Adds ``part``, which names the shorter length and what is shared at either end; equal hashes only join parts."""
    head, tail = F.substring(F.col("word"), F.lit(1), F.col("a")), F.when(F.col("b") > 0, F.expr("right(word, b)")).otherwise("")
    return words.withColumn("part", F.xxhash64("m", "a", "b", head, tail))


def _halved(words: DataFrame) -> DataFrame:
    """Each row under the first and under the last half of what lies between the ``a`` first and ``b`` last letters."""
    half = F.floor((F.col("m") - F.col("a") - F.col("b")) / 2).cast("int")
    ways: Column = F.array(F.struct((F.col("a") + half).alias("a"), F.col("b").alias("b")), F.struct(F.col("a").alias("a"), (F.col("b") + half).alias("b")))
    dealt = words.select("word", "n", "m", F.explode(ways).alias("way")).select("word", "n", "m", "way.a", "way.b")
    return _keyed(dealt)


def _small(df: DataFrame, *texts: str) -> DataFrame:
    """Broadcast when its rows, counted with their texts, take at most SENT_BYTES."""
    size = F.sum(F.lit(64) + sum((F.coalesce(F.octet_length(t), F.lit(0)) for t in texts), F.lit(0)))
    return F.broadcast(df) if (df.agg(size).collect()[0][0] or 0) <= SENT_BYTES else df


def parts(words: DataFrame, most: int = PART) -> DataFrame:
    """(word, n, m, part) rows such that near words meet in a part, whose size is at most ``most`` wherever it can be split."""
    length = F.length("word")
    # The shorter word of a pair has this word's length or the one below; words have LEAST_LENGTH letters at least.
    start = words.select("word", "n", F.explode(F.filter(F.array(length, length - 1), lambda m: m >= LEAST_LENGTH)).alias("m"), F.lit(0).alias("a"), F.lit(0).alias("b"))
    rows, settled = _halved(start), None
    while True:
        large = rows.filter(F.col("m") - F.col("a") - F.col("b") >= 2).groupBy("part").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > most)
        large = cut_lineage(large.select("part"))
        if large.isEmpty():
            return rows.select("word", "n", "m", "part") if settled is None else settled.union(rows.select("word", "n", "m", "part"))
        sent = _small(large)
        done = rows.join(sent, "part", "left_anti").select("word", "n", "m", "part")
        settled = done if settled is None else settled.union(done)
        rows = _halved(rows.join(sent, "part", "left_semi"))


def near_words(words: DataFrame, most: int = PART, index: int = INDEX) -> DataFrame:
    """(word, other, other_n): every pair of (word, n) rows one edit apart, in both directions, once or more often."""
    dealt = parts(words, most)
    # Every word is in two parts or more of each of its lengths.
    total = words.count() * 4
    indexes = max(1, -(-total // index))

    def search(table: pa.Table) -> pa.Table:
        first = dict(zip(zip(table.column("word").to_pylist(), table.column("m").to_pylist()), table.column("n").to_pylist()))
        counts = {w: n for (w, _), n in first.items()}
        at = list(counts)
        lengths = np.array([len(w) for w in at], dtype=np.int64)
        i, j = near_pairs(at, lengths, {m for _, m in first})
        strings, numbers = pa.array(at, pa.string()), pa.array([counts[w] for w in at], pa.int64())
        both, other = pa.array(np.concatenate([i, j])), pa.array(np.concatenate([j, i]))
        return pa.table({"word": strings.take(both), "other": strings.take(other), "other_n": numbers.take(other)})

    spread = dealt.withColumn("index", F.pmod(F.xxhash64("part"), F.lit(indexes)))
    return spread.groupBy("index").applyInArrow(search, "word string, other string, other_n long")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form) rows: every round doubles the steps that a word has gone. Forms cannot go in a circle."""
    now = cut_lineage(forms.select("word", F.col("form").alias("root")))
    while True:
        steps = now.select(F.col("word").alias("w"), F.col("root").alias("r"))
        # Words that have a form themselves and are the root of others.
        more = now.join(_small(steps, "w", "r"), F.col("root") == F.col("w"), "left")
        now = cut_lineage(more.select("word", F.coalesce("r", "root").alias("root"), F.col("r").isNotNull().alias("moved")))
        if now.filter("moved").isEmpty():
            return now.select("word", "root")


def group_words(words: DataFrame, factor: int = FORM_FACTOR) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of (word, n) rows."""
    words = cut_lineage(words.select("word", "n"))
    # A word has few near words, as many as letters and places allow, so all of them meet in one task.
    once = near_words(words).repartition("word").dropDuplicates(["word", "other"])
    # Strings compare by UTF-8 bytes, which is the order of code points.
    best = once.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("n"), "other")).alias("top"))
    joined = words.join(best, "word", "left")
    far = -F.col("top.n") >= F.col("n") * factor
    formed = cut_lineage(joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(far, F.col("top.other")).alias("form"), F.when(far, -F.col("top.n")).alias("form_n"),
    ))
    roots = _roots(formed.filter("form is not null"))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """The words of a corpus with LEAST_COUNT occurrences and their forms."""
    return group_words(word_counts(docs, text, row_id).filter(F.col("n") >= LEAST_COUNT))

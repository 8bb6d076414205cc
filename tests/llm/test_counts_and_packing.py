"""Token counts, packing and sharding against the libraries and against brute force."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from riskloom.llm import packing, sharding, subwords, token_counts

ODD = [None, "", " ", "  ", "a ", "a  ", "  a", "▁", " ▁", "\n", "<s> </s>", "<|endoftext|>x", "don't DON'T", "ǅ Σας İi", "x" * 300, "tab\tand\x0bmore", "é é", "日本語 テスト", "🙂🙂"]


def _fuzz(n, seed=1):
    r = random.Random(seed)
    parts = list("abTH es ' ''s  \t\n ▁éÉßİΣσ漢字🙂0189!?.,*&́‍ﬁÅ\x1c\x85ŉ") + ["<|endoftext|>", "<s>", "  ", " a", " the", "'re", "THE", "▁▁"]
    return ["".join(r.choice(parts) for _ in range(r.randint(0, 30))) for _ in range(n)]


def _docs(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def test_piece_counts_equal_the_library():
    texts = [t for t in ODD if t is not None] + _fuzz(3000)
    model = subwords.PieceCounts(subwords.PIECE_MODEL)
    assert [sum(c) for c in model.counts(texts)] == [len(x) for x in model.model.encode(texts)]


def test_word_ids_equal_the_library():
    texts = [t for t in ODD if t is not None] + _fuzz(3000, 2)
    model = subwords.WordIds(subwords.WORD_MODEL)
    got = [np.frombuffer(b, "<u4").tolist() for b in model.ids([t.encode() for t in texts])]
    assert got == [e.ids for e in model.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_memory_that_is_full_is_emptied(monkeypatch):
    monkeypatch.setattr(subwords, "REMEMBERED", 20)
    texts = _fuzz(300, 3)
    model = subwords.WordIds(subwords.WORD_MODEL)
    for a in range(0, len(texts), 7):
        part = texts[a : a + 7]
        assert [np.frombuffer(b, "<u4").tolist() for b in model.ids([t.encode() for t in part])] == [e.ids for e in model.tokenizer.encode_batch(part, add_special_tokens=False)]


def test_every_prefix_has_its_count():
    model = subwords.PieceCounts(subwords.PIECE_MODEL)
    for text in ["the quick  brown fox ", "  a b", "été   là\nfin", "x", *_fuzz(150, 4)]:
        ends, tokens = token_counts.prefix_table(model.units(text), model.counts([text])[0], model.by_unit)
        for k in range(len(text) + 1):
            assert token_counts.tokens_of_prefix(model, text, ends, tokens, k) == len(model.model.encode(text[:k])), (text, k)


def test_token_counts_of_rows(spark):
    texts = ODD + ["word " * 5000]
    rows = {r["doc_id"]: r for r in token_counts.count_tokens(_docs(spark, texts), tables=True).collect()}
    library = subwords.PieceCounts(subwords.PIECE_MODEL).model
    for i, t in enumerate(texts):
        assert rows[i]["n_tokens"] == len(library.encode(t or "")) and rows[i]["n_bytes"] == len((t or "").encode())
        assert rows[i]["over_limit"] == (rows[i]["n_tokens"] > 4096)
    cut = texts[-1][: rows[len(texts) - 1]["fit_chars"]]
    assert len(library.encode(cut)) <= 4096 < len(library.encode(cut + "word word"))
    assert token_counts.count_tokens(_docs(spark, []), 10).count() == 0


@pytest.mark.parametrize("texts", [ODD, ODD * 3 + ["long word " * 9000], ["same text here"] * 700, []])
def test_packing_round_trip(spark, texts):
    docs = _docs(spark, texts).selectExpr("if(doc_id = 3, null, doc_id) as doc_id", "text", "'x' as length", "1 as start")
    rows = packing.pack(docs, keep_ids=True).collect()
    library = subwords.WordIds(subwords.WORD_MODEL).tokenizer
    by_doc, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        assert len(r["ids"]) == 4 * r["length"] and zlib.crc32(r["ids"]) == r["ids_crc32"]
        by_doc[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, t in enumerate(texts):
        pieces = sorted(by_doc[None if i == 3 else i], key=lambda r: r["start"])
        want = np.array(library.encode(t or "", add_special_tokens=False).ids + [2], "<u4").tobytes()
        assert b"".join(bytes(p["ids"]) for p in pieces) == want
        assert {p["doc_tokens"] for p in pieces} == {len(want) // 4}
    assert sorted(sequences) == list(range(len(sequences)))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 4096
    total = sum(r["length"] for r in rows)
    assert len(sequences) * 4096 - total <= 4096 + 0.03 * total


def _greedy(sizes, capacity):
    shards, filled = 1, 0
    for s in sizes:
        if filled + s > capacity:
            shards, filled = shards + 1, 0
        filled += s
    return shards


@pytest.mark.parametrize("n,copies,shards", [(400, 1, 7), (300, 40, 5), (3, 1, 24), (2000, 1, 24), (50, 600, 4)])
def test_shards_are_minimax(spark, n, copies, shards, monkeypatch):
    monkeypatch.setattr(sharding, "FIRST_BITS", 4)
    monkeypatch.setattr(sharding, "MORE_BITS", 3)
    r = random.Random(n)
    texts = ["t" * r.randint(0, 400) + str(k) for k in range(n)] + ["copied " * 20] * copies + [None, None, ""]
    docs = _docs(spark, texts).withColumnRenamed("doc_id", "doc_id")
    rows = sharding.shard_rows(docs, shards).collect()
    assert len(rows) == len(texts)
    slots, shard_of, loads = defaultdict(list), {}, defaultdict(int)
    for row in rows:
        t = texts[row["doc_id"]]
        assert row["size"] == len((t or "").encode()) + 8 and row["text_crc32"] == zlib.crc32((t or "").encode())
        assert shard_of.setdefault(t, row["shard"]) == row["shard"] and 0 <= row["shard"] < shards
        slots[row["shard"]].append(row["slot"])
        loads[row["shard"]] += row["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    hashed = sharding.with_hashes(docs).groupBy("__h1", "__h2").agg({"__size": "sum"}).orderBy("__h1", "__h2").collect()
    sizes = {(h[0], h[1]): h[2] for h in hashed}
    large = sharding.giants(sharding.with_hashes(docs).groupBy("__h1", "__h2").agg(_sum()), shards)
    rest = [s for k, s in sorted(sizes.items()) if k not in set(large)]
    best = next(c for c in range(max(rest, default=0), sum(rest) + 1) if _greedy(rest, c) <= shards - len(large)) if rest else 0
    assert max(loads.values()) == max([best, *(sizes[k] for k in large)])


def _sum():
    from pyspark.sql import functions as F

    return F.sum("__size").alias("size")


def test_no_rows_no_shards(spark):
    assert sharding.shard_rows(_docs(spark, []), 24).count() == 0


def test_words_of_every_plain_character_equal_the_library():
    r = random.Random(9)
    model = subwords.WordIds(subwords.WORD_MODEL)
    plain = [chr(i) for i in [*range(0x21, 0x7F), *range(0xA1, 0x130), *range(0x131, 0x180)]]
    texts = [" ".join("".join(r.choice(plain) for _ in range(r.randint(1, 70))) for _ in range(40)) for _ in range(200)] + [" ".join(a + "b" + a for a in plain)]
    got = [np.frombuffer(b, "<u4").tolist() for b in model.ids([t.encode() for t in texts])]
    assert got == [e.ids for e in model.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_parts_without_an_end_are_encoded_one_by_one():
    model = subwords.WordIds(subwords.WORD_MODEL)
    model.ends[:] = False
    assert np.frombuffer(model.ids([b"several words, here"])[0], "<u4").tolist() == model.tokenizer.encode("several words, here", add_special_tokens=False).ids


def test_memory_never_walks_its_values():
    from riskloom.llm.common import Memory

    class Values(dict):
        def keys(self):
            raise AssertionError("walks every key")

        __iter__ = items = keys

    memory = Memory(10)
    memory.young, memory.old = Values(a=1), Values(b=2)
    assert memory.missing({"a", "b", "c"}) == ["c"]
    assert memory.young["a"] == 1 and memory.young["b"] == 2


def test_known_words_are_asked_once_and_new_ones_learnt_together():
    from riskloom.llm.common import Memory

    asked, memory = [], Memory(5)

    def learn(new):
        asked.append(sorted(new))
        return {k: k.encode() if k else b"" for k in new}

    assert memory.values([["a", "b", "a"], [], ["", "c", "b"]], learn) == [[b"a", b"b", b"a"], [], [b"", b"c", b"b"]]
    assert memory.values([["a", "", "d"]], learn) == [[b"a", b"", b"d"]]
    # The young generation is full with the next key; values found before it turned old stay.
    assert memory.values([["a", "e"], ["b", "f"]], learn) == [[b"a", b"e"], [b"b", b"f"]]
    assert memory.values([["a", "e"]], learn) == [[b"a", b"e"]]
    assert asked == [["", "a", "b", "c"], ["d"], ["e", "f"]]


def test_a_worker_forgets_what_its_last_task_did_not_use():
    from riskloom.llm import common

    made = []
    ask = lambda key: common.worker_cache(key, lambda: made.append(key) or key)
    common._worker_store().clear()
    ask("tables")
    common.forget_unused()
    ask("tables")
    common.forget_unused()
    assert made == ["tables"]
    common.forget_unused()
    ask("tables")
    assert made == ["tables", "tables"]
    common._worker_store().clear()


def test_ids_of_texts_are_the_ids_of_their_words():
    model = subwords.WordIds(subwords.WORD_MODEL)
    texts = [b"", b" ", b"one two\tone", b"\x0bin\x0c\x0c out \n", "naïve café x\x1cy".encode(), b"z" * 200 + b" one", b"two"] * 2
    for some in ([], texts, [b""], texts[::-1]):
        want = [model.tokenizer.encode(t.decode(), add_special_tokens=False).ids for t in some]
        assert [np.frombuffer(x, "<u4").tolist() for x in model.ids(some)] == want
        assert [np.frombuffer(b"".join(x), "<u4").tolist() for x in model.by_word(some)] == want


def test_parts_need_no_pattern_and_words_without_ids_keep_their_place():
    import pyarrow as pa

    from riskloom.llm import common

    model = subwords.WordIds(subwords.WORD_MODEL)
    assert model.bare is not model.tokenizer
    parts = ["don", "'t", "straße", "7", "½", "***", "ŉ"]
    assert model._encode_parts(parts) == model._encode(parts)
    texts = [" x\x85 \x85 y", None, "", "\x85", "z " * 3]
    ids, ends, begins = model.placed(pa.array(texts))
    assert begins.tolist() == [0, 3, 3, 3, 4, 7] and np.diff(ends).tolist() == [len(w) for w in ids.to_pylist()]
    assert [[len(w) // 4 for w in ws] for ws in model.by_word([(t or "").encode() for t in texts])] == [[1, 0, 1], [], [], [0], [1, 1, 1]]
    # Slices begin where their batch does not.
    assert model.ids(pa.array(texts)[2:]) == model.ids([(t or "").encode() for t in texts[2:]])
    batch = pa.RecordBatch.from_pydict({"text": ["a" * 10] * 9})
    assert [c.num_rows for c in common.chunks(batch, "text", 30)] == [2, 3, 3, 1]

"""Exact dedup by chunk recipes against plain grouping of texts."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from riskloom.llm import chunk_recipes as cr


def _rows():
    r, out = random.Random(1), []
    base = ["".join(r.choice("abcdef ghij\n") for _ in range(n)) for n in (0, 1, 5, 31, 256, 257, 300, 3000, 20000, 90000)]
    for t in base:
        out += [t] * r.randint(1, 4)
    # One byte more, less or other, at either end and inside; the same chunks in another order.
    long = base[-2]
    out += [long + "x", long[:-1], "x" + long, long[:10000] + "#" + long[10001:], long[10000:] + long[:10000], long + long, long + " ", long.upper()]
    out += ["é" * 400, "é" * 400, None, "", None, "copy of a page"] + ["copy of a page"] * 400
    r.shuffle(out)
    return list(enumerate(out))


def _docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as recipe", "'s' as salt", "3 as at", "4 as n", "5 as bytes")


def _brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(-1 if i is None else i)
    return {t: (max(ids), len(ids)) for t, ids in groups.items()}


@pytest.mark.parametrize("bits", [64, 4, 128])
def test_groups_are_those_of_equal_texts(spark, bits):
    rows = _rows()
    want = _brute(rows)
    got = cr.exact_duplicates(_docs(spark, rows).repartition(5), bits=bits).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    for g in got:
        t = texts[g["doc_id"]] or ""
        assert (g["keep_id"], g["group_size"]) == want[t]
        assert g["kept"] == (g["doc_id"] == g["keep_id"])
        assert g["text_sha256"] == hashlib.sha256(t.encode()).hexdigest()


def test_numbers_grow_until_equal_recipes_mean_equal_texts(spark):
    rows = _rows()
    docs = _docs(spark, rows)
    store = cr.chunk_store(docs, 64).collect()
    assert len({(r["c1"], r["c2"]) for r in store}) == len(store) == len({bytes(r["bytes"]) for r in store})
    # Texts of one short chunk whose numbers must clash at two bits.
    few = _docs(spark, [(i, f"text {i}") for i in range(40)] + [(40, "text 1")])
    assert cr.clashes(few, cr.recipes(few, 2), 2) and not cr.clashes(few, cr.recipes(few, 64), 64) and not cr.clashes(few, cr.recipes(few, 128), 128)
    assert cr.verified_recipes(few, 2).select("recipe").distinct().count() == 40
    assert cr.chunk_store(few, 64, among=spark.createDataFrame([], "c1 long, c2 long")).collect() == []


def test_a_hundred_and_twenty_eight_bits(spark):
    rows = _rows()[:40]
    a = cr.recipes(_docs(spark, rows), 128).collect()
    b = cr.recipes(_docs(spark, rows), 64).collect()
    same = lambda found: sorted(tuple(sorted(x["doc_id"] for x in found if x["recipe"] == y["recipe"])) for y in found)
    assert same(a) == same(b)


def test_chunks_join_to_the_text_and_follow_the_content(spark):
    r = np.random.default_rng(3)
    data = r.integers(97, 123, 3_000_000).astype(np.uint8)
    places = cr.edges(data).tolist()
    ending = set(places)
    # Plain rolling hash at some places, over the edge of the blocks too.
    for at in [*r.integers(64, len(data), 200).tolist(), cr.BLOCK - 1, cr.BLOCK, cr.BLOCK + 1, cr.BLOCK + 31]:
        h = 0
        for k in range(cr.SEEN):
            h += int(cr.GEAR[data[at - 1 - k]]) << k
        assert (h % (1 << 32) < cr.BELOW) == (at in ending)
    ends = cr.cuts(0, len(data), places)
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(data) and sizes.max() <= cr.LONGEST_CHUNK and sizes[:-1].min() >= cr.LEAST_CHUNK
    moved = np.concatenate([np.full(1000, 65, dtype=np.uint8), data])
    other = cr.cuts(0, len(moved), cr.edges(moved).tolist())
    assert len({e - 1000 for e in other} & set(ends)) > 0.99 * len(ends)


def test_edges_agree_with_a_plain_walk():
    data = np.random.default_rng(5).integers(0, 256, 5000).astype(np.uint8)
    want, h = [], 0
    for i, b in enumerate(data.tolist()):
        h = ((h << 1) + int(cr.GEAR[b])) % (1 << 32)
        if h < cr.BELOW and i >= cr.SEEN - 1:
            want.append(i + 1)
    assert [p for p in cr.edges(data).tolist() if p >= cr.SEEN] == want


def test_repeated_rows_null_ids_and_empty_tables(spark):
    rows = [(1, "a"), (1, "a"), (None, "a"), (None, "b"), (None, "b"), (2, None), (3, ""), (3, "c")]
    got = cr.exact_duplicates(_docs(spark, rows)).collect()
    by = defaultdict(list)
    for g in got:
        by[g["text_sha256"]].append(g)
    of = lambda t: by[hashlib.sha256(t.encode()).hexdigest()]
    assert [sum(g["kept"] for g in of(t)) for t in ("a", "b", "", "c")] == [1, 1, 1, 1]
    assert {g["keep_id"] for g in of("a")} == {1} and {g["group_size"] for g in of("a")} == {3}
    assert {g["keep_id"] for g in of("b")} == {None} and {g["keep_id"] for g in of("")} == {3}
    assert all(g["doc_id"] == 1 for g in of("a") if g["kept"])
    assert cr.exact_duplicates(_docs(spark, [])).collect() == []


def test_rows_that_stay_keep_their_columns(spark):
    rows = [(1, "a"), (1, "a"), (2, "b"), (3, "b"), (4, None), (None, "d"), (None, "d")]
    docs = _docs(spark, rows)
    got = cr.without_duplicates(docs)
    assert got.columns == docs.columns
    assert sorted((str(r["doc_id"]), r["text"] or "") for r in got.collect()) == [("1", "a"), ("3", "b"), ("4", ""), ("None", "d")]

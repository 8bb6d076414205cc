"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from riskloom.llm import spelling_variants as sv


def _near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def _words(seed, count, letters="abé", longest=12):
    r, out = random.Random(seed), set()
    while len(out) < count:
        w = "".join(r.choice(letters) for _ in range(r.randint(7, longest)))
        out.add(w)
        for _ in range(r.randint(0, 3)):
            i, kind = r.randrange(len(w)), r.randrange(3)
            w = w[:i] + (r.choice(letters) if kind else "") + w[i + (kind < 2) :]
            if len(w) >= 7:
                out.add(w)
    return sorted(out)


@pytest.mark.parametrize("seed,letters", [(1, "ab"), (2, "abcdefghijklmnopqrstuvwxyzé÷"), (3, "a"), (4, "abcß")])
def test_index_finds_all_pairs(seed, letters):
    words = sorted({"a" * n for n in range(7, 90)}) if letters == "a" else _words(seed, 400, letters)
    lengths = np.array([len(w) for w in words])
    i, j = sv.near_pairs(words, lengths, set(lengths.tolist()))
    got = [tuple(sorted(p)) for p in zip(i.tolist(), j.tolist())]
    assert len(got) == len(set(got))
    assert set(got) == {(x, y) for x in range(len(words)) for y in range(x + 1, len(words)) if _near(words[x], words[y])}


def test_index_of_one_word_and_of_long_words():
    assert len(sv.near_pairs(["abcdefg"], np.array([7]), {7})[0]) == 0
    long = "ab" * 50_000
    words = [long, long + "a", long[1:], long[:40_000] + "z" + long[40_001:], "x" + long]
    i, j = sv.near_pairs(words, np.array([len(w) for w in words]), {len(w) for w in words})
    got = {tuple(sorted(p)) for p in zip(i.tolist(), j.tolist())}
    assert got == {(x, y) for x in range(5) for y in range(x + 1, 5) if _near(words[x], words[y])}


@pytest.mark.parametrize("most,index", [(4096, 2048), (20, 50), (3, 2048)])
def test_near_words_in_any_parts(spark, most, index):
    words = _words(5, 300, "abc")
    table = spark.createDataFrame([(w, k + 2) for k, w in enumerate(words)], "word string, n long").repartition(3)
    got = sv.near_words(table, most, index).distinct().collect()
    place = {w: k + 2 for k, w in enumerate(words)}
    assert {(g["word"], g["other"]) for g in got} == {(a, b) for a in words for b in words if a != b and _near(a, b)}
    assert all(g["other_n"] == place[g["other"]] for g in got)
    # A part that can be split further holds no more than asked for.
    if most == 20:
        sizes = sv.parts(table, most).groupBy("part").count().agg({"count": "max"}).collect()[0][0]
        assert sizes <= 2 * most


def _brute(rows):
    counts = Counter()
    for i, t in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        for w in re.findall("[A-Za-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 7:
                counts[w] += 1
    counts = {w: n for w, n in counts.items() if n >= 2}
    near = {w: [v for v in counts if v != w and _near(v, w)] for w in counts}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-counts[v], v.encode()), default=None)
        form[w] = best if best is not None and counts[best] >= 10 * counts[w] else None
    out = {}
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), counts.get(form[w]))
    return out


def _docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n", "'w' as word", "2 as part", "3 as m", "'i' as id")


def _got(df):
    rows = df.collect()
    out = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}
    assert len(out) == len(rows)
    return out


def test_whole_texts_against_brute_force(spark):
    r = random.Random(9)
    stems = _words(11, 12, "abcdefgh") + ["ÀÉÎÕÜßÿ", "Rhythmus", "spelling", "spellings", "speling", "splling"]
    rows = []
    for i in range(500):
        ws = [stems[min(int(r.expovariate(0.7)), len(stems) - 1)] for _ in range(r.randint(0, 60))]
        ws = [w.upper() if r.random() < 0.1 else w for w in ws]
        rows.append((i * 37, r.choice([" ", ", ", "-", "7", "\n", "×", "Ā"]).join(ws)))
    # Two chains of forms, each ten times as frequent as the last.
    for k, w in enumerate(["abcdefgh", "abcdefghi", "abcdefghij", "abcdefghijk"]):
        rows.append((None, " ".join([w] * (2 * 10**k))))
    rows += [(1, None), (2, ""), (3, "short words only here"), (3, "spelling " * 3)] + [(4, "the same spelling again")] * 40
    got, want = _got(sv.spelling_variants(_docs(spark, rows).repartition(4))), _brute(rows)
    assert got == want
    assert any(v[0] is not None and v[1] != v[0] for v in want.values())


def test_empty_tables(spark):
    assert sv.spelling_variants(_docs(spark, [])).collect() == []
    assert sv.spelling_variants(_docs(spark, [(1, None), (None, "abcdefgh")])).collect() == []
    assert _got(sv.spelling_variants(_docs(spark, [(1, "zzzzzzzz zzzzzzzz")]))) == _brute([(1, "zzzzzzzz zzzzzzzz")])

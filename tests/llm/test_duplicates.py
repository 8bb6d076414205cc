"""SimHash, substring dedup and decontamination against brute force."""

import hashlib
import random

import numpy as np
import pytest
import xxhash

from riskloom.llm import components, decontaminate, simhash, substring_dedup

WORDS = [a + b for a in ("ka", "lo", "mi", "ne", "ru", "ta", "vo") for b in ("ra", "si", "po", "du", "n", "")]


def _text(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n))


def _docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'a' as id", "2 as path", "'b' as sign", "3 as anchor")


def _fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [b" ".join(words)]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _near_rows():
    r, rows = random.Random(4), []
    for _ in range(60):
        t = _text(r, r.randint(30, 160)).split()
        rows.append(" ".join(t))
        for _ in range(r.randint(0, 4)):
            t[r.randrange(len(t))] = r.choice(WORDS)
            rows.append(" ".join(t).upper() if r.random() < 0.2 else " ".join(t))
    rows += [None, "", " \n", "ka", "KA", "ka lo", "same copy of it"] + ["same copy of it"] * 30
    r.shuffle(rows)
    return list(enumerate(rows))


def test_simhash_components(spark):
    rows = _near_rows()
    got = {x["doc_id"]: (x["fingerprint"], x["component_id"]) for x in simhash.near_duplicates(_docs(spark, rows).repartition(3)).collect()}
    prints = [_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert got == {i: (f"{prints[i]:016x}", find(i)) for i, _ in rows}
    assert len({c for _, c in got.values()}) < len(rows) - 30


def test_simhash_blocks_do_not_change_links(spark, monkeypatch):
    rows = _near_rows()
    want = sorted(map(tuple, simhash.near_duplicates(_docs(spark, rows)).collect()))
    monkeypatch.setattr(simhash, "BLOCK", 3)
    assert sorted(map(tuple, simhash.near_duplicates(_docs(spark, rows)).collect())) == want


def test_one_of_each_group(spark):
    rows = _near_rows()
    docs = _docs(spark, rows)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    named = {x["component_id"] for x in simhash.near_duplicates(docs).collect()}
    assert sorted(x["doc_id"] for x in kept.collect()) == sorted(named)
    odd = spark.createDataFrame([(1, "x y z w"), (1, "x y z w"), (None, "x y z w"), (None, "q r s t"), (None, "q r s t"), (2, None), (3, "")], "doc_id long, text string")
    assert sorted(map(tuple, simhash.one_of_each(odd).collect()), key=str) == sorted([(1, "x y z w"), (None, "q r s t"), (2, None)], key=str)
    assert simhash.one_of_each(docs.limit(0)).count() == 0


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(10, 90)] + [(200, 100), (3, 3)], "a long, b long")
    got = dict(map(tuple, components.components(links).collect()))
    assert got == {i: 10 for i in range(11, 91)} | {200: 100}


def _brute(rows, window):
    best = {}
    for i, t in rows:
        w = (t or "").encode().split()
        for p in range(len(w) - window + 1):
            k = tuple(w[p : p + window])
            best[k] = min(best.get(k, 1 << 62), 1 << 62 if i is None else i)
    out = []
    for i, t in rows:
        w = (t or "").encode().split()
        gone = set()
        for p in range(len(w) - window + 1):
            if best[tuple(w[p : p + window])] < (1 << 62 if i is None else i):
                gone.update(range(p, p + window))
        kept = [x for p, x in enumerate(w) if p not in gone]
        out.append((i, len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=str)


def _span_rows():
    r = random.Random(8)
    base, rows = [_text(r, r.randint(20, 220)) for _ in range(25)], []
    for k in range(120):
        a, b = r.choice(base).split(), r.choice(base).split()
        w = a[r.randint(0, len(a)) :] + b[: r.randint(0, 150)] + r.choice(base).split()[-70:]
        for _ in range(r.randint(0, 3)):
            if w:
                w[r.randrange(len(w))] = f"zz{k}"
        rows.append((900 - k, " ".join(w)))
    rows += list(enumerate(base)) + [(1000, "ka " * 300), (1001, "ka " * 200), (1002, None), (1003, ""), (None, base[0]), (None, base[0]), (5, base[0] + " " + base[7])]
    return rows + [(2000, base[3])] * 5


def test_substrings_equal_brute_force(spark):
    rows = _span_rows()
    got = sorted(map(tuple, substring_dedup.dedup_report(_docs(spark, rows).repartition(4)).collect()), key=str)
    assert got == _brute(rows, 50)
    assert sum(x[2] > 0 for x in got) > 20


def test_substrings_with_few_hot_paths(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "HOT_PATHS", 200)
    monkeypatch.setattr(substring_dedup, "SENT_ANCHORS", 1)
    rows = _span_rows()
    assert sorted(map(tuple, substring_dedup.dedup_report(_docs(spark, rows)).collect()), key=str) == _brute(rows, 50)


def test_kept_words_are_the_new_texts(spark):
    rows = _span_rows()
    docs = _docs(spark, rows).selectExpr("*", "cast(length(text) as int) as n_chars")
    out = substring_dedup.without_repeats(docs)
    assert out.columns == docs.columns
    digests = {(i, h): n for i, _, n, h in _brute(rows, 50)}
    for x in out.collect():
        n = digests[(x["doc_id"], hashlib.sha256(b" ".join((x["text"] or "").encode().split())).hexdigest())]
        assert x["n_chars"] == (None if x["text"] is None else len(x["text"]))
        assert n or (x["doc_id"], x["text"]) in set(rows)
    assert substring_dedup.dedup_report(docs.limit(0)).count() == 0


def _edit_distance_inside(p, x):
    last = np.zeros(len(x) + 1, dtype=int)
    for i, c in enumerate(p):
        now = [i + 1]
        for j, d in enumerate(x):
            now.append(min(last[j] + (c != d), last[j + 1] + 1, now[j] + 1))
        last = np.array(now)
    return int(last.min())


@pytest.mark.parametrize("seed", range(4))
def test_passages_within_the_budget(seed):
    r = random.Random(seed)
    for _ in range(25):
        item = _text(r, r.randint(8, 24))
        items = decontaminate.Items.of([(1, item)], 0.06, 32)
        if not items.texts:
            continue
        s = list(item)
        for _ in range(r.randint(0, 9)):
            j = r.randrange(len(s))
            s[j : j + 1] = r.choice([["x"], [s[j], "y"], []])
        text = decontaminate.normal((_text(r, r.randint(0, 9)) + " " + "".join(s) + "\n " + _text(r, r.randint(0, 9))).encode())
        want = _edit_distance_inside(items.texts[0].tolist(), text.tolist()) <= decontaminate.edit_budget(len(items.texts[0]), 0.06)
        got = decontaminate.passages(text, items)
        assert want == bool(got)
        for _, begin, end, edits in got:
            assert _edit_distance_inside(items.texts[0].tolist(), text[begin:end].tolist()) <= edits


def test_decontamination_of_rows(spark):
    r = random.Random(1)
    items = [_text(r, 30) for _ in range(5)]
    bench = spark.createDataFrame([*enumerate(items), (9, "short"), (10, None), (None, items[0])], "item_id long, text string")
    rows = [(0, _text(r, 80)), (1, _text(r, 30) + "\n" + items[2].upper() + " " + _text(r, 9)), (2, None), (3, ""), (4, items[1]), (4, items[1]), (None, items[3]), (5, items[4][:90]), (6, "short")]
    docs = _docs(spark, rows)
    got = sorted((x["doc_id"] is None, x["doc_id"], x["contaminated"], x["items"]) for x in decontaminate.mark(docs, bench, block_chars=200).collect())
    assert got == [
        (False, 0, False, []), (False, 1, True, [2]), (False, 2, False, []), (False, 3, False, []), (False, 4, True, [1]), (False, 4, True, [1]),
        (False, 5, False, []), (False, 6, False, []), (True, None, True, [3]),
    ]
    clean = decontaminate.mark(docs, bench, keep_rows=True)
    assert clean.columns == docs.columns and sorted(x["doc_id"] for x in clean.collect()) == [0, 2, 3, 5, 6]
    spans = {(x["doc_id"], x["item_id"]): x["edits"] for x in decontaminate.find(docs, bench).collect()}
    assert spans[(1, 2)] == 0 and spans[(4, 1)] == 0
    assert decontaminate.mark(docs, bench.limit(0)).filter("contaminated").count() == 0


def test_no_table_stays_in_memory_behind_the_duplicate_stages(spark):
    text = " ".join(f"w{i}" for i in range(80))
    docs = spark.createDataFrame([(1, text), (2, text + " more"), (3, "other words")], "doc_id long, text string")
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    cached = spark._jsparkSession.sharedState().cacheManager().isEmpty()
    assert substring_dedup.without_repeats(docs).count() == 3 and simhash.one_of_each(docs).count() >= 1
    assert spark.sparkContext._jsc.getPersistentRDDs().size() <= before
    assert spark._jsparkSession.sharedState().cacheManager().isEmpty() == cached

"""Benchmark items in several blocks, and items too short for the lemma."""

import random

from riskloom.llm import decontaminate

WORDS = [a + b for a in ("ka", "lo", "mi", "ne", "ru") for b in ("ra", "si", "po", "du", "n")]


def _rows(frame):
    return sorted((str(x["doc_id"]), x["contaminated"], x["n_passages"], x["items"]) for x in frame.collect())


def test_blocks_do_not_change_the_marks(spark, monkeypatch):
    r = random.Random(4)
    items = [" ".join(r.choice(WORDS) for _ in range(20)) for _ in range(12)]
    bench = spark.createDataFrame([*enumerate(items), (3, items[7] + " more"), (None, items[2]), (20, "ka lo"), (21, None)], "item_id long, text string")
    rows = [(i, f"start {items[i % 12]} and {items[(i * 5) % 12]}") for i in range(20)] + [(1, "start " + items[1])] * 3 + [(None, items[4]), (None, items[4]), (None, None), (40, ""), (41, "none of it")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    held = []
    plain = decontaminate.Items.of.__func__
    monkeypatch.setattr(decontaminate.Items, "of", classmethod(lambda cls, rows, *a: held.append(len(rows)) or plain(cls, rows, *a)))
    for short in (False, True):
        one = decontaminate.mark(docs, bench, short=short)
        held.clear()
        many = decontaminate.mark(docs, bench, block_chars=300, short=short)
        assert len(held) > 4 and many.columns == one.columns and _rows(many) == _rows(one)
        kept = [decontaminate.mark(docs, bench, block_chars=n, keep_rows=True, short=short) for n in (300, 10**6)]
        assert sorted(map(str, kept[0].collect())) == sorted(map(str, kept[1].collect())) and kept[0].columns == docs.columns


def test_a_block_is_released_before_the_next_is_read(spark, monkeypatch):
    events, send = [], decontaminate._sent

    def sent(*a):
        events.append("read")
        out = send(*a)
        destroy = out.destroy
        out.destroy = lambda: events.append("released") or destroy()
        return out

    monkeypatch.setattr(decontaminate, "_sent", sent)
    bench = spark.createDataFrame([(i, f"item number {i} " * 9) for i in range(9)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "item number 3 " * 9)], "doc_id long, text string")
    assert decontaminate.mark(docs, bench, block_chars=300).collect()[0]["contaminated"]
    assert len(events) > 3 and events == ["read", "released"] * (len(events) // 2)


def test_short_items_are_found_between_word_edges(spark):
    bench = spark.createDataFrame([(1, "Who is it?"), (2, "東京はどこですか"), (3, "cat"), (4, "")], "item_id long, text string")
    rows = [(1, "x who  IS it? y"), (2, "問い。東京はどこですか答え"), (3, "concatenate cats"), (4, "a cat, a cat"), (5, "who is it"), (6, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x["doc_id"]: (x["n_passages"], x["items"]) for x in decontaminate.mark(docs, bench, short=True).collect()}
    assert got == {1: (1, [1]), 2: (1, [2]), 3: (0, []), 4: (2, [3]), 5: (0, []), 6: (0, [])}
    assert not decontaminate.mark(docs, bench).filter("contaminated").count()

"""Copies by digest, and rows that a bounded fit takes."""

import numpy as np
import pandas as pd

from riskloom.operators import clean as cl
from riskloom.operators import profile as pr
from riskloom.operators import split as sp


def _frame(spark):
    rows = [(None, 1, 0.0, "x"), (1, None, 0.0, "x"), (1, None, -0.0, "x"), (1, None, float("nan"), "x"), (1, None, None, "x"), (None, None, None, None)] * 2
    rows += [(i % 40, i % 7, float(i % 3), "t") for i in range(2000)] + [(7, 7, 7.0, "hot")] * 900 + [(5, 5, 0.5, "once")]
    return spark.createDataFrame(rows, "a int, b int, c double, d string").repartition(5)


def test_copies_are_found_by_digest(spark, monkeypatch):
    df = _frame(spark)
    want = {tuple(None if isinstance(v, float) and np.isnan(v) else v for v in r) for r in df.collect()}
    for sent in (500_000, 3):
        monkeypatch.setattr(cl, "SENT_DIGESTS", sent)
        got = [tuple(r) for r in cl.deduplicate(df, by_digest=True).collect()]
        assert len(got) == len(set(got)) == len(want) and set(got) == want
    s = pr.quality_summary(df).first()
    assert (s["total_rows"], s["total_cols"], s["duplicates"]) == (df.count(), 4, df.count() - len(want))
    assert s["missing_total"] == 2 * (1 + 1 + 1 + 2 + 2 + 4)
    empty = pr.quality_summary(df.limit(0)).first()
    assert tuple(empty) == (0, 4, 0, 0) and cl.deduplicate(df.limit(0), by_digest=True).count() == 0


def test_no_whole_rows_are_shuffled_for_the_count(spark):
    df = spark.createDataFrame(pd.DataFrame({"a": range(500), "b": ["wide"] * 500}))
    plan = cl.repeated_digests(cl.with_digest(df))._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange" in line]
    assert exchanges and all("_d1" in line and "a#" not in line for line in exchanges)


def test_first_rows_are_exact_and_stratified(spark):
    rows = [(i, int(i % 500 == 0)) for i in range(5000)]
    df = spark.createDataFrame(rows, "id long, y int")
    first = sp.first_rows(df, "y", ["id"], 100).collect()
    assert len(first) == 100 or len(first) == 101
    assert sum(r["y"] for r in first) == 1
    again = sp.first_rows(df.repartition(7), "y", ["id"], 100).collect()
    assert {r["id"] for r in again} == {r["id"] for r in first}
    assert sp.first_rows(df, "y", ["id"], 5000).count() == 5000
    assert sp.class_quotas({0: 10**10, 1: 3}, 2000) == {0: 2000, 1: 1}
    assert sp.class_quotas({0: 60, 1: 40}, 10) == {0: 6, 1: 4}


def test_rows_are_dealt_before_they_are_compared(spark, monkeypatch):
    df = _frame(spark)
    want = {tuple(None if isinstance(v, float) and np.isnan(v) else v for v in r) for r in df.collect()}
    monkeypatch.setattr(cl, "ROWS_PER_TASK", 1_500)
    plan = cl.deduplicate(df)._jdf.queryExecution().executedPlan().toString()
    assert "_d1" in plan and "Aggregate" not in plan[plan.index("Exchange hashpartitioning(_d1"):]
    # Tasks follow the rows, and the row with 900 copies is merged before its shuffle.
    monkeypatch.setattr(cl, "ROWS_PER_TASK", 500)
    done = cl.deduplicate(df)
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert f"{-(-df.count() // 500)})" in plan.replace(", REPARTITION_BY_NUM", ")") and "Union" in plan
    got = [tuple(r) for r in done.collect()]
    assert len(got) == len(set(got)) == len(want) and set(got) == want

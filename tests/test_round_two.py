"""Cases that earlier results got wrong."""

import pytest
from pyspark.sql import functions as F

from riskloom.functions.columns import plain_number
from riskloom.operators.models import KnnModel
from riskloom.operators.profile import dataset_card, histogram
from riskloom.plans.clinical import ROW_ID, with_row_id


def test_a_nan_label_is_no_class(spark):
    df = spark.createDataFrame([(1.0, 1), (0.0, 2), (float("nan"), 3), (None, 4)], "y double, x int")
    assert dataset_card(df, "y").first()["positive_pct"] == 50


def test_a_class_without_values_has_empty_bins(spark):
    df = spark.createDataFrame([(1.0, 0), (2.0, 0), (3.0, 0), (None, 1)], "v double, k int")
    rows = histogram(df, "v", "k", 4).collect()
    assert sorted((r["k"], r["bin"]) for r in rows) == [(k, b) for k in (0, 1) for b in range(4)]
    assert sum(r["count"] for r in rows if r["k"] == 0) == 3 and sum(r["count"] for r in rows if r["k"] == 1) == 0


@pytest.mark.parametrize("value,text", [
    (0.0005, "0.0005"), (12000000.0, "12000000.0"), (0.1, "0.1"), (-0.00025, "-0.00025"), (5.0, "5.0"), (0.0, "0.0"),
    (123456789.25, "123456789.25"), (None, None),
])
def test_numbers_are_written_plainly(spark, value, text):
    assert spark.createDataFrame([(value,)], "v double").select(plain_number("v")).first()[0] == text


def test_rows_that_differ_by_nan_or_signed_zero_are_copies(spark):
    df = spark.createDataFrame([(1.0, None), (1.0, float("nan")), (0.0, 2.0), (-0.0, 2.0)], "a double, b double")
    out = with_row_id(df).collect()
    assert len(out) == 2 and len({r[ROW_ID] for r in out}) == 2
    mixed = spark.createDataFrame([("a|?", None), ("a", "?"), (None, "a|?")], "a string, b string")
    assert with_row_id(mixed).select(ROW_ID).distinct().count() == 3


def test_neighbours_score_rows_by_their_vector(spark):
    train = spark.createDataFrame([(str(i), i % 2, float(i % 2), float(i % 5) / 10) for i in range(40)], "rid string, y int, a double, b double")
    model = KnnModel(train, ["a", "b"], "y", "rid", 3)
    asked = spark.createDataFrame([(7, 1.0, 0.1), (7, 0.0, 0.1), (None, 1.0, 0.1), (8, 0.0, 0.1)], "patient int, a double, b double")
    got = sorted((r["patient"] is None, r["patient"], r["a"], r["probability"]) for r in model.predict(asked).collect())
    assert got == [(False, 7, 0.0, 0.0), (False, 7, 1.0, 1.0), (False, 8, 0.0, 0.0), (True, None, 1.0, 1.0)]

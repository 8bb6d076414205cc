import math

import pytest
from pyspark.sql import functions as F

from riskloom.operators import split as sp
from riskloom.operators.scale import apply_scaler, fit_scaler


def table(spark, n=1000):
    return spark.range(n).select("id", (F.col("id") % 3 == 0).cast("int").alias("y"), (F.col("id") * 0.5).alias("x"))


def test_counts_and_independence_of_partitions(spark):
    df = table(spark)
    seen = []
    for parts in (1, 3, 11):
        marked = sp.stratified_split(df.repartition(parts), "y", ["id"], 0.2, 7)
        counts = {(r.y, r.split): r["count"] for r in marked.groupBy("y", "split").count().collect()}
        assert sum(n for (_, s), n in counts.items() if s == "test") == 200
        assert {c: counts[c, "test"] for c in (0, 1)} == sp.test_counts({0: 666, 1: 334}, 0.2)
        seen.append({r.id for r in marked.where("split = 'test'").collect()})
    assert seen[0] == seen[1] == seen[2]
    other = sp.stratified_split(df, "y", ["id"], 0.2, 8).where("split = 'test'")
    assert {r.id for r in other.collect()} != seen[0]


def test_deep_boundary(spark, monkeypatch):
    df = table(spark)
    want = {r.id for r in sp.stratified_split(df, "y", ["id"], 0.3).where("split = 'test'").collect()}
    monkeypatch.setattr(sp, "LISTED_HASHES", 1)
    monkeypatch.setattr(sp, "PREFIX_STEP", 1)
    got = {r.id for r in sp.stratified_split(df, "y", ["id"], 0.3).where("split = 'test'").collect()}
    assert got == want


def test_shares():
    assert sp.test_counts({0: 10}, 0.25) == {0: 3}
    for counts in ({0: 54, 1: 46}, {"a": 7, "b": 5, "c": 3}):
        got = sp.test_counts(counts, 0.15)
        assert sum(got.values()) == math.ceil(0.15 * sum(counts.values()))


def test_refusals(spark):
    df = spark.createDataFrame([(1, 0)] * 10 + [(2, 1)] * 10, "id int, y int")
    with pytest.raises(ValueError, match="identify"):
        sp.stratified_split(df, "y", ["id"])
    with pytest.raises(ValueError, match="missing"):
        sp.stratified_split(spark.createDataFrame([(1, None)], "id int, y int"), "y", ["id"])
    with pytest.raises(ValueError, match="between"):
        sp.stratified_split(df, "y", ["id"], 1.5)


def test_one_class(spark):
    train, test = sp.split_frames(spark.range(50).withColumn("y", F.lit(1)), "y", ["id"])
    assert (train.count(), test.count()) == (40, 10)


def test_scaler(spark):
    train = spark.createDataFrame([(1.0, 3.0), (2.0, 3.0), (6.0, 3.0)], "a double, flat double")
    scaler = fit_scaler(train, ["a", "flat"])
    done = apply_scaler(train, scaler)
    row = done.agg(F.avg("a"), F.stddev_pop("a"), F.max("flat")).first()
    assert row[0] == pytest.approx(0) and row[1] == pytest.approx(1) and row[2] == 0.0
    unseen = apply_scaler(spark.createDataFrame([(2.0, 5.0)], "a double, flat double"), scaler).first()
    assert unseen.flat == 2.0

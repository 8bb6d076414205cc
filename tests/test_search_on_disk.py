"""A neighbour search lays little on disk and takes it away again."""

import os

import numpy as np
import pandas as pd

from riskloom.functions.session import checkpoint_dir, cut_lineage
from riskloom.operators import knn
from riskloom.operators import models as md


def _folders(spark) -> set[str]:
    top = "/" + checkpoint_dir(spark).split(":", 1)[-1].lstrip("/")
    return {f for f in os.listdir(top) if f.startswith("kept-")}


def _rows(n=700):
    r = np.random.default_rng(8)
    return pd.DataFrame({"id": range(n), "a": r.standard_normal(n), "b": r.integers(0, 3, n).astype(float), "c": r.exponential(size=n), "y": r.integers(0, 2, n)})


def test_leaves_found_in_a_task_are_those_found_level_by_level(spark, monkeypatch):
    rows = _rows()
    train, asked = spark.createDataFrame(rows[:500]), spark.createDataFrame(rows[400:])
    x = knn.vector_of(["a", "b", "c"])
    index = knn.NeighbourIndex.build(train, x, "y", "id", 60, leaf=70)
    assert index.levels > 0 and index.rows.count() == 500
    boxes = knn._boxes(index.nodes)
    assert boxes["many"].sum() == len(boxes["name"]) - 1 and boxes["count"][boxes["leaf"]].sum() == 500
    near = []
    for k in (3, 60):
        found = index.search(asked, x, "id", k).toPandas()
        monkeypatch.setattr(knn, "SENT_BOXES", 0)
        by_level = index.search(asked, x, "id", k).toPandas()
        monkeypatch.undo()
        near = [f.sort_values(["_q", "_rank"])[["_q", "_s", "_d", "_y"]].reset_index(drop=True) for f in (found, by_level)]
        assert near[0].equals(near[1]) and len(near[0]) == 300 * k
    p, q = rows[["a", "b", "c"]].to_numpy()[:500], rows[["a", "b", "c"]].to_numpy()[400:]
    d = ((q[:, None] - p[None]) ** 2).sum(axis=2)
    want = [(400 + i, int(s)) for i in range(300) for s in np.lexsort((np.arange(500), d[i]))[:60]]
    assert list(zip(near[0]["_q"], near[0]["_s"])) == want


def test_queries_are_asked_in_slices_and_leave_only_their_scores(spark, monkeypatch):
    rows = _rows()
    monkeypatch.setattr(knn, "TRAIN_BLOCK", 50)
    train, test = spark.createDataFrame(rows[:500]), spark.createDataFrame(rows[400:])
    model = md.KnnModel(train, ["a", "b", "c"], "y", "id", 7)
    model.index()
    before = _folders(spark)
    whole = model.predict(test).orderBy("id").toPandas()
    assert len(_folders(spark) - before) == 1
    monkeypatch.setattr(md, "QUERY_SLICE", 100)
    before = _folders(spark)
    sliced = model.predict(test).orderBy("id").toPandas()
    assert len(_folders(spark) - before) == 3 and len(whole) == 300
    assert whole.equals(sliced)


def test_tasks_grow_with_the_blocks_of_a_search(spark, monkeypatch):
    rows = spark.createDataFrame(_rows())
    x = knn.vector_of(["a", "b", "c"])
    index = knn.NeighbourIndex.build(rows, x, "y", "id", 3, leaf=20)
    monkeypatch.setattr(knn, "TASK_BLOCKS", 2)
    asked = cut_lineage(index.rows.select(knn.F.col("_s").alias("_q"), "_x", "node"))
    plan = knn._meet(asked, index.rows, knn._block_top_k(3), "_q long, _s long, _d double, _y double", 20)
    leaves = index.nodes.where("leaf").count()
    assert plan.rdd.getNumPartitions() >= leaves / 2 > 8

"""The partition tree of the neighbour search: bounded leaves, all rows, exact results."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators import knn


def _rows(rng, n):
    """Clusters, ties along a side, a point that many rows share and a far one."""
    x = rng.normal(size=(n, 3)) * [1.0, 20.0, 0.01]
    x[: n // 3, 1] = 5.0
    x[n // 3 : n // 2] = [0.5, 5.0, 0.0]
    x[-1] = [1e9, -1e9, 0.0]
    return [(i, int(i % 3 == 0), [float(v) for v in p]) for i, p in enumerate(x)]


def _frame(spark, rows):
    return spark.createDataFrame(rows, "id long, y int, x array<double>").selectExpr("*", "1 as node", "2 as count", "3 as leaf")


@pytest.mark.parametrize("n", [400, 4000])
def test_no_leaf_exceeds_its_bound(spark, n):
    rows = _rows(np.random.default_rng(n), n)
    index = knn.NeighbourIndex.build(_frame(spark, rows), knn.vector_of("x"), "y", "id", 5, leaf=40)
    sizes = index.rows.groupBy("node").count()
    assert sizes.agg(F.max("count")).first()[0] <= 40
    # Every row has its leaf, but for copies of a vector beyond the k smallest ids; boxes hold their rows.
    assert index.rows.count() == n - (n // 2 - n // 3) + 5
    leaves = index.nodes.where("leaf")
    assert leaves.agg(F.sum("count")).first()[0] == index.rows.count() and leaves.count() == sizes.count()
    inside = index.rows.join(leaves, "node").where(F.forall(F.arrays_zip("_x", "lo", "hi"), lambda s: (s["_x"] >= s["lo"]) & (s["_x"] <= s["hi"])))
    assert inside.count() == index.rows.count()
    # A child's parent is a node that is no leaf.
    parents = index.nodes.where("level > 0").select(F.col("parent").alias("node")).distinct()
    assert parents.join(index.nodes.where("not leaf"), "node").count() == parents.count()


def _brute(rows, queries, k):
    x, ids = np.array([r[2] for r in rows]), np.array([r[0] for r in rows])
    out = {}
    for i, _, v in queries:
        d = ((x - np.array(v)) ** 2).sum(axis=1)
        out[i] = ids[np.lexsort((ids, d))[:k]].tolist()
    return out


@pytest.mark.parametrize("leaf,block,sent", [(40, 30, 50_000), (15, 1000, 2), (5000, 50, 50_000)])
def test_search_equals_brute_force(spark, tmp_path, monkeypatch, leaf, block, sent):
    monkeypatch.setattr(knn, "SENT_NODES", sent)
    rng = np.random.default_rng(3)
    rows, queries = _rows(rng, 600), [(9000 + i, y, v) for i, y, v in _rows(rng, 150)]
    queries += [(9900 + i, 0, [0.5, 5.0, 0.0]) for i in range(100)] + [(9800, 0, [-1e12, 0.0, 3.0])]
    index = knn.NeighbourIndex.build(_frame(spark, rows), knn.vector_of("x"), "y", "id", 5, leaf=leaf)
    if leaf == 40:
        index.save(str(tmp_path / "index"))
        index = knn.NeighbourIndex.load(spark, str(tmp_path / "index"))
    got = index.search(_frame(spark, queries), knn.vector_of("x"), "id", 5, block).toPandas()
    found = got.sort_values(["_q", "_d", "_s"]).groupby("_q")["_s"].apply(list).to_dict()
    assert found == _brute(rows, queries, 5)


def test_more_neighbours_than_a_leaf_holds(spark):
    rng = np.random.default_rng(4)
    rows = _rows(rng, 200)
    got = knn.nearest_neighbours(_frame(spark, rows), _frame(spark, rows), "x", "y", "id", "id", 60, train_block=3).toPandas()
    # Copies of one vector count up to k times.
    assert got.sort_values(["_q", "_d", "_s"]).groupby("_q")["_s"].apply(list).to_dict() == _brute(rows, rows, 60)


def test_no_queries(spark):
    rows = _rows(np.random.default_rng(5), 100)
    for leaf in (10, 1000):
        assert knn.nearest_neighbours(_frame(spark, rows), _frame(spark, []), "x", "y", "id", "id", 5, train_block=leaf).collect() == []

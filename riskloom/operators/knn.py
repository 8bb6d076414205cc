"""Exact k nearest neighbours on a partition tree: no pair of rows is ever emitted as a row."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.functions.columns import require_columns
from riskloom.functions.session import Kept, cut_lineage

# Training rows of a leaf, and queries that meet a leaf in one task.
TRAIN_BLOCK = 4_096
QUERY_BLOCK = 4_096
# Blocks of a node's queries, with the rows they meet, that a task sorts at most.
TASK_BLOCKS = 16
# Parts into which a node is cut at once.
FAN = 16
# Rows of a table of nodes that may be broadcast.
SENT_NODES = 50_000
# Bytes of the boxes of a tree that may travel with one function.
SENT_BOXES = 1 << 25
# Queries whose distances to a block are held at once.
CHUNK = 256
# Queries whose visits lie on disk at once.
QUERY_SLICE = 1_000_000


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances from differences; the expanded product form would lose digits."""
    out = np.zeros((len(x), len(y)))
    for j in range(x.shape[1]):
        out += (x[:, j, None] - y[None, :, j]) ** 2
    return out


def _near(x: np.ndarray, y: np.ndarray, kept: int, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of x, row of y, squared distance) of all pairs that may be among the ``kept`` nearest within ``bound``.

    The expanded product form picks the pairs, with a margin above its rounding; their distances are those of differences.
    """
    middle = y.mean(axis=0)
    a, b = x - middle, y - middle
    aa, bb = (a * a).sum(axis=1), (b * b).sum(axis=1)
    d = aa[:, None] + bb[None] - 2 * (a @ b.T)
    # Far above the rounding of three sums of products, and of the shift to the middle.
    size = (x * x).sum(axis=1) + (middle * middle).sum() + (y * y).sum(axis=1).max()
    slack = 64 * (x.shape[1] + 8) * np.finfo(float).eps * size
    kth = np.partition(d, kept - 1, axis=1)[:, kept - 1]
    far = np.minimum(kth + 2 * slack, bound * (1 + 1e-9) + slack)
    # What is no finite number is judged by the differences alone.
    q, s = np.nonzero((d <= far[:, None]) | ~np.isfinite(far + aa)[:, None])
    exact = np.zeros(len(q))
    for j in range(x.shape[1]):
        exact += (x[q, j] - y[s, j]) ** 2
    return q, s, exact


def _sent(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(SENT_NODES + 1).count() <= SENT_NODES else df


def _meet(queries: DataFrame, rows: DataFrame, work: Callable, schema: str, block: int) -> DataFrame:
    """`work` on the queries and the rows of each node. A node's queries, however many, are cut into blocks of about
    `block`, each of which meets all rows of the node; these are few."""
    cuts = cut_lineage(queries.groupBy("node").agg(F.ceil(F.count("*") / block).cast("int").alias("_cuts")))
    spark = queries.sparkSession
    wanted = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    blocks = cuts.agg(F.sum("_cuts")).first()[0] or 0
    n = max(1, min(max(wanted, -(-blocks // TASK_BLOCKS)), blocks))
    sent = _sent(cuts)
    left = queries.join(sent, "node").withColumn("_t", F.pmod(F.xxhash64("_q"), F.col("_cuts")).cast("int")).drop("_cuts")
    right = rows.join(sent, "node").withColumn("_t", F.explode(F.sequence(F.lit(0), F.col("_cuts") - 1))).drop("_cuts")
    # A task sorts the rows of a bounded number of blocks in memory.
    left, right = (side.repartition(n, "node", "_t") for side in (left, right))
    return left.groupBy("node", "_t").cogroup(right.groupBy("node", "_t")).applyInPandas(work, schema)


def _block_top_k(k: int):
    def top_k(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"_q": queries["_q"].iloc[:0], "_s": rows["_s"].iloc[:0], "_d": [], "_y": []})
        if queries.empty or rows.empty:
            return empty
        rows = rows.sort_values("_s")
        x, ids, ys = np.stack(rows["_x"].to_numpy()), rows["_s"].to_numpy(), rows["_y"].to_numpy()
        kept = min(k, len(ids))
        out = []
        for start in range(0, len(queries), CHUNK):
            part = queries.iloc[start : start + CHUNK]
            bound = part["bound"].to_numpy(dtype=float) if "bound" in part else np.full(len(part), np.inf)
            q, s, d = _near(np.stack(part["_x"].to_numpy()), x, kept, bound)
            order = np.lexsort((s, d, q))
            q, s, d = q[order], s[order], d[order]
            # What lies beyond the bound has k rows before it elsewhere. Rounding must not hide a row at the bound itself.
            place = np.arange(len(q)) - np.searchsorted(q, q)
            ok = (place < kept) & (d <= (bound * (1 + 1e-9) + 1e-300)[q])
            q, s, d = q[ok], s[ok], d[ok]
            out.append(pd.DataFrame({"_q": part["_q"].to_numpy()[q], "_s": ids[s], "_d": d, "_y": ys[s]}))
        return pd.concat(out)

    return top_k


def _in_reach(k: int):
    """The children of a node that may hold one of the k nearest rows of a query, and what is known of their distance."""

    def work(queries: pd.DataFrame, children: pd.DataFrame) -> pd.DataFrame:
        out = {c: [] for c in ("node", "leaf", "_q", "_x", "home", "bound")}
        if not queries.empty and not children.empty:
            lo, hi = np.stack(children["lo"].to_numpy()), np.stack(children["hi"].to_numpy())
            names, leaf, count = children["child"].to_numpy(), children["leaf"].to_numpy(), children["count"].to_numpy()
            for start in range(0, len(queries), CHUNK):
                part = queries.iloc[start : start + CHUNK]
                x = np.stack(part["_x"].to_numpy())
                least, most = np.zeros((len(x), len(lo))), np.zeros((len(x), len(lo)))
                for j in range(x.shape[1]):
                    v = x[:, j, None]
                    least += np.maximum(np.maximum(lo[:, j] - v, v - hi[:, j]), 0.0) ** 2
                    most += np.maximum(np.abs(v - lo[:, j]), np.abs(v - hi[:, j])) ** 2
                # The nearest boxes that hold k rows between them bound the k-th distance from above.
                order = most.argsort(axis=1)
                held = np.cumsum(count[order], axis=1) >= k
                at = np.where(held.any(axis=1), held.argmax(axis=1), 0)
                outer = np.where(held.any(axis=1), np.take_along_axis(most, np.take_along_axis(order, at[:, None], 1), 1)[:, 0], np.inf)
                bound = np.minimum(part["bound"].to_numpy(dtype=float), outer)
                # Rounding of either sum must not hide a row at the bound itself.
                q, c = np.nonzero(least <= (bound * (1 + 1e-9) + 1e-300)[:, None])
                out["node"] += names[c].tolist()
                out["leaf"] += leaf[c].tolist()
                for name in ("_q", "_x", "home"):
                    out[name] += part[name].iloc[q].tolist()
                out["bound"] += bound[q].tolist()
        return pd.DataFrame(out)

    return work


def _boxes(nodes: DataFrame) -> dict[str, np.ndarray]:
    """The nodes of a small tree in arrays, the children of each one after the other."""
    rows = sorted(nodes.collect(), key=lambda r: (r["level"], r["parent"] or "", r["node"]))
    names = [r["node"] for r in rows]
    place = {name: i for i, name in enumerate(names)}
    first, many = np.zeros(len(rows), dtype=np.int64), np.zeros(len(rows), dtype=np.int64)
    for i, r in enumerate(rows[1:], 1):
        up = place[r["parent"]]
        first[up] = first[up] if many[up] else i
        many[up] += 1
    arrays = {c: np.array([r[c] for r in rows]) for c in ("leaf", "count", "lo", "hi")}
    return arrays | {"name": np.array(names, dtype=object), "first": first, "many": many}


def _leaves_in_reach(tree: dict[str, np.ndarray], k: int):
    """The leaves beside its own that may hold one of the k nearest rows of a query, found from the root inside a task."""

    def gaps(x: np.ndarray, at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for j in range(x.shape[1]):
            v = x[:, j]
            out += np.maximum(np.maximum(tree["lo"][at, j] - v, v - tree["hi"][at, j]), 0.0) ** 2
        return out

    def outer(x: np.ndarray) -> float:
        # The nearest leaves that hold k rows between them bound the k-th distance from above.
        leaf = np.flatnonzero(tree["leaf"])
        most = np.zeros(len(leaf))
        for j, v in enumerate(x):
            most += np.maximum(np.abs(v - tree["lo"][leaf, j]), np.abs(v - tree["hi"][leaf, j])) ** 2
        order = most.argsort()
        held = np.cumsum(tree["count"][leaf][order]) >= k
        return float(most[order[held.argmax()]]) if held.any() else np.inf

    def work(batches):
        for queries in batches:
            for start in range(0, len(queries), CHUNK):
                part = queries.iloc[start : start + CHUNK]
                x, bound = np.stack(part["_x"].to_numpy()), part["bound"].to_numpy(dtype=float).copy()
                for i in np.flatnonzero(~np.isfinite(bound)):
                    bound[i] = outer(x[i])
                far = bound * (1 + 1e-9) + 1e-300
                q, at, out = np.arange(len(x)), np.zeros(len(x), dtype=np.int64), []
                while len(q):
                    many = tree["many"][at]
                    at = np.repeat(tree["first"][at], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                    q = np.repeat(q, many)
                    near = gaps(x[q], at) <= far[q]
                    q, at = q[near], at[near]
                    leaf = tree["leaf"][at]
                    out.append((q[leaf], at[leaf]))
                    q, at = q[~leaf], at[~leaf]
                q, at = (np.concatenate(c) for c in zip(*out))
                names = tree["name"][at]
                other = names != part["home"].to_numpy(dtype=object)[q]
                # A query's visits follow each other.
                q, names = q[other], names[other]
                order = q.argsort(kind="stable")
                mine = part.iloc[q[order]]
                yield pd.DataFrame({"node": names[order], "_q": mine["_q"].to_numpy(), "_x": mine["_x"].to_numpy(), "bound": bound[q[order]]})

    return work


@dataclass
class NeighbourIndex:
    """Training rows in the leaves of a partition tree.

    `rows` (node, _s, _y, _x) has every row under its leaf, `nodes` (node, parent, level, leaf, count, lo, hi) the box
    around the rows of each node, `splits` (node, level, dim, cuts) how a node's rows are dealt to its children. A node
    is named by the path to it. All three are tables: the tree grows with the rows, and no task or driver holds it.
    """

    rows: DataFrame
    nodes: DataFrame
    splits: DataFrame
    levels: int
    total: int

    @classmethod
    def build(cls, train: DataFrame, x, label: str, train_id: str, k: int, leaf: int = TRAIN_BLOCK) -> NeighbourIndex:
        """Cuts every node of more than `leaf` rows along its widest side into up to FAN parts of like size."""
        rows = train.select(F.col(train_id).alias("_s"), F.col(label).cast("double").alias("_y"), x.alias("_x"))
        total = rows.count()
        if total < k:
            raise ValueError(f"{k} neighbours asked of {total} training rows")
        # Of equal vectors only the k smallest ids can be neighbours. The limit is applied before the
        # shuffle too, so a vector that a third of the rows share leaves each task as k rows.
        copy = F.row_number().over(Window.partitionBy("_x").orderBy("_s"))
        base = Kept(rows.withColumn("_copy", copy).where(F.col("_copy") <= k).drop("_copy").withColumn("node", F.lit("r")))
        rows = base.df
        leaf, d = max(leaf, k), len(rows.select("_x").first()["_x"])
        share = [i / FAN for i in range(1, FAN)]
        nodes, splits, level, made = None, None, 0, []
        while True:
            # Rows that have not found their leaf, dealt anew by the cuts so far: no level is written.
            fresh = rows
            for cut in made:
                fresh = _step(fresh, cut, "inner")
            found = cut_lineage(
                fresh.groupBy("node").agg(
                    F.count("*").alias("count"), F.array(*[F.min(F.col("_x")[j]) for j in range(d)]).alias("lo"),
                    F.array(*[F.max(F.col("_x")[j]) for j in range(d)]).alias("hi"),
                ).withColumn("leaf", F.col("count") <= leaf)
            )
            parent = F.when(F.lit(level > 0), F.substring_index("node", "/", level))
            named = found.select("node", parent.alias("parent"), F.lit(level).alias("level"), "leaf", "count", "lo", "hi")
            nodes = named if nodes is None else nodes.unionByName(named)
            wide = found.where("not leaf")
            if wide.isEmpty():
                break
            sides = F.zip_with("hi", "lo", lambda a, b: a - b)
            wide = wide.withColumn("dim", (F.array_position(sides, F.array_max(sides)) - 1).cast("int"))
            # Every part-th quantile, so that a node a little above the limit is halved and not cut into crumbs.
            parts = F.least(F.lit(FAN), F.pow(F.lit(2), F.ceil(F.log2(F.col("count") / leaf)))).cast("int")
            wide = _sent(wide.select("node", "dim", parts.alias("parts"), F.get("hi", F.col("dim")).alias("to")))
            inside = fresh.select("node", "_x").join(wide, "node")
            side = F.get("_x", F.col("dim"))
            cuts = inside.groupBy("node", "dim", "parts", "to").agg(
                F.percentile_approx(side, share, F.lit(1000)).alias("all"), F.max(F.when(side < F.col("to"), side)).alias("below")
            )
            chosen = F.array_distinct(F.filter("all", lambda v, i: ((i + 1) % (F.lit(FAN) / F.col("parts")).cast("int") == 0) & (v < F.col("to"))))
            # Where most rows lie at the upper end, they are cut off from all others.
            some = F.when(F.size(chosen) > 0, chosen).otherwise(F.array("below"))
            made.append(cut_lineage(cuts.select("node", F.lit(level).alias("level"), "dim", some.alias("cuts"))))
            splits = made[-1] if splits is None else splits.unionByName(made[-1])
            level += 1
        settled = base.df
        for cut in made:
            settled = _step(settled, cut)
        if made:
            settled = Kept(settled).df
            base.unpersist()
        empty = "node string, level int, dim int, cuts array<double>"
        return cls(settled, nodes, rows.sparkSession.createDataFrame([], empty) if splits is None else splits, level, total)

    def save(self, path: str) -> None:
        """Rows by leaf, and the tree; the tree is written last."""
        self.rows.write.mode("overwrite").parquet(f"{path}/rows")
        self.splits.write.mode("overwrite").parquet(f"{path}/splits")
        self.nodes.withColumn("levels", F.lit(self.levels)).withColumn("total", F.lit(self.total)).write.mode("overwrite").parquet(f"{path}/nodes")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> NeighbourIndex:
        nodes = spark.read.parquet(f"{path}/nodes")
        top = nodes.select("levels", "total").first()
        return cls(spark.read.parquet(f"{path}/rows"), nodes.drop("levels", "total"), spark.read.parquet(f"{path}/splits"), top["levels"], top["total"])

    def search(self, queries: DataFrame, x, query_id: str, k: int, query_block: int = QUERY_BLOCK) -> DataFrame:
        """(_q, _s, _d, _y): each query's k nearest rows by distance, then by id.

        A query goes down to its own leaf, whose k-th distance bounds the search; from the root it then visits the
        nodes whose box comes nearer than the bound and meets the rows of the leaves it reaches. Boxes of a tree that
        can be sent are visited inside the task, those of a larger one level by level.
        """
        return self.search_kept(queries, x, query_id, k, query_block)[0]

    def search_kept(self, queries: DataFrame, x, query_id: str, k: int, query_block: int = QUERY_BLOCK) -> tuple[DataFrame, list[Kept]]:
        """As `search`, and the tables on disk that its result is read from."""
        if self.total < k:
            raise ValueError(f"{k} neighbours asked of {self.total} training rows")
        require_columns(queries, query_id)
        asked = queries.select(F.col(query_id).alias("_q"), x.alias("_x"), F.lit("r").alias("node"))
        for level in range(self.levels):
            asked = _step(asked, self.splits.where(F.col("level") == level))
        kept = [Kept(asked)]
        asked = kept[0].df
        types = {c: df.schema[c].dataType.simpleString() for df, c in ((asked, "_q"), (self.rows, "_s"))}
        schema = f"_q {types['_q']}, _s {types['_s']}, _d double, _y double"
        best = Window.partitionBy("_q").orderBy("_d", "_s")
        top = lambda df: df.withColumn("_rank", F.row_number().over(best)).where(F.col("_rank") <= k)
        # Down the cuts a query may come to a leaf without rows, as the cuts are those of the rows.
        first = _meet(asked, self.rows, _block_top_k(k), schema, query_block)
        if not self.levels:
            return top(first), kept
        kept.append(Kept(first))
        first = kept[-1].df
        # A query has met one leaf, so that its k-th distance there is the greatest of k.
        kth = first.groupBy("_q").agg(F.max("_d").alias("bound"), F.count("*").alias("_n")).where(F.col("_n") >= k).drop("_n")
        frontier = asked.join(kth, "_q", "left").select(
            F.lit("r").alias("node"), "_q", "_x", F.col("node").alias("home"), F.coalesce("bound", F.lit(float("inf"))).alias("bound")
        )
        if self.nodes.count() * len(self.nodes.first()["lo"]) * 16 <= SENT_BOXES:
            reach = _leaves_in_reach(_boxes(self.nodes), k)
            found = frontier.drop("node").mapInPandas(reach, f"node string, _q {types['_q']}, _x array<double>, bound double")
        else:
            found = self._leaves_by_level(frontier, k, types["_q"], query_block)
        kept.append(Kept(found))
        return top(first.unionByName(_meet(kept[-1].df, self.rows, _block_top_k(k), schema, query_block))), kept

    def _leaves_by_level(self, frontier: DataFrame, k: int, id_type: str, query_block: int) -> DataFrame:
        found, step = None, f"node string, leaf boolean, _q {id_type}, _x array<double>, home string, bound double"
        for level in range(1, self.levels + 1):
            children = self.nodes.where(F.col("level") == level).select(F.col("parent").alias("node"), F.col("node").alias("child"), "leaf", "count", "lo", "hi")
            reached = cut_lineage(_meet(frontier, children, _in_reach(k), step, query_block))
            leaves = reached.where("leaf and node <> home").select("node", "_q", "_x", "bound")
            found = leaves if found is None else found.unionByName(leaves)
            frontier = reached.where("not leaf").drop("leaf")
        return found


def _step(df: DataFrame, splits: DataFrame, how: str = "left") -> DataFrame:
    """The rows one level further down, where their node is cut: a value up to the first cut goes to part 0. An inner
    step leaves out the rows of other nodes."""
    cut = _sent(splits.select(F.col("node").alias("_at"), "dim", "cuts"))
    part = F.size(F.filter("cuts", lambda c: c < F.get("_x", F.col("dim"))))
    moved = F.when(F.col("_at").isNotNull(), F.concat_ws("/", "node", part.cast("string"))).otherwise(F.col("node"))
    return df.join(cut, F.col("node") == F.col("_at"), how).withColumn("node", moved).drop("_at", "dim", "cuts")


def vector_of(features: str | Sequence[str]):
    """The features as one array of doubles: an array column, or several columns."""
    if isinstance(features, str):
        return F.transform(features, lambda v: v.cast("double"))
    return F.array(*[F.col(c).cast("double") for c in features])


def nearest_neighbours(
    train: DataFrame,
    queries: DataFrame,
    features: str | Sequence[str],
    label: str,
    train_id: str,
    query_id: str,
    k: int = 7,
    train_block: int = TRAIN_BLOCK,
    query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """(_q, _s, _d, _y): each query's k nearest training rows by distance, then by training id.

    Both ids must be unique. Every row takes part; the tree only steers the work.
    """
    require_columns(train, label, train_id)
    x = vector_of(features)
    return NeighbourIndex.build(train, x, label, train_id, k, train_block).search(queries, x, query_id, k, query_block)


def share_of_positive(near: DataFrame, query_id: str) -> DataFrame:
    """(query_id, probability, prediction): share of the positive label among the neighbours found."""
    return (
        near.groupBy("_q")
        .agg(F.avg("_y").alias("probability"))
        .select(F.col("_q").alias(query_id), "probability", (F.col("probability") > 0.5).cast("int").alias("prediction"))
    )


def knn_score(train, queries, features, label, train_id, query_id, k: int = 7, **blocks) -> DataFrame:
    """(query_id, probability, prediction): share of the positive label among the k nearest."""
    return share_of_positive(nearest_neighbours(train, queries, features, label, train_id, query_id, k, **blocks), query_id)

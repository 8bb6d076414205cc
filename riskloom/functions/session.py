"""Helpers around the session: lineage cuts and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 10_000
# Spark gives back the shuffle files of a query when it has ended.
_END_SHUFFLE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder named by the cluster; a local one only when the session has none and is local."""
    named = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
        named = tempfile.mkdtemp(prefix="riskloom-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows once to the shared folder and go on from there."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(checkpoint_dir(spark))
    return df.checkpoint()


def reuse(df: DataFrame) -> DataFrame:
    """Keep for several passes; lost blocks are computed again from lineage."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


class Kept:
    """A whole table written once to the shared folder, in columns, and read from there by every pass.

    Executors hold none of it, and a pass reads the columns it asks for. `unpersist` removes the files, after which tables
    that derive from `df` cannot be read any more.
    """

    def __init__(self, df: DataFrame):
        spark = self._spark = df.sparkSession
        self.path = f"{checkpoint_dir(spark)}/kept-{uuid.uuid4().hex}"
        # A column without a type holds nothing that could be written.
        written = df.drop(*[f.name for f in df.schema if f.dataType.typeName() == "void"])
        before = spark.conf.get(_END_SHUFFLE, None)
        spark.conf.set(_END_SHUFFLE, "true")
        try:
            written.write.parquet(self.path, compression="zstd")
        finally:
            spark.conf.unset(_END_SHUFFLE) if before is None else spark.conf.set(_END_SHUFFLE, before)
        read = spark.read.schema(written.schema).parquet(self.path)
        self.df = read.select(*[F.col(f"`{c}`") if c in written.columns else F.lit(None).alias(c) for c in df.columns])

    def unpersist(self) -> None:
        path = self._spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self._spark._jsc.hadoopConfiguration()).delete(path, True)


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a summary table after checking its size; a larger one is joined by shuffle."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))

"""Scoring a stream of records."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame

from riskloom.config import RISK_CUTS
from riskloom.operators.models import Fitted
from riskloom.operators.score import score


def score_stream(
    stream: DataFrame, fitted: Fitted, defaults: Mapping[str, float] | None = None, cuts: Sequence[float] = RISK_CUTS
) -> DataFrame:
    """The batch scoring on a stream: each record alone, so no state and no watermark."""
    if fitted.spec.kind == "knn":
        raise ValueError("nearest neighbours need a batch join; score them with foreachBatch")
    return score(stream, fitted, defaults, cuts)


def write_scores(stream: DataFrame, path: str, checkpoint: str):
    """Append scores to parquet, once per available record; ends when the input is used up."""
    return (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def write_batches(stream: DataFrame, score_batch: Callable[[DataFrame], DataFrame], path: str, checkpoint: str):
    """Score each micro-batch as a table, for models that need a join: nearest neighbours, or any other.

    A batch has a folder named by its id and replaces it as a whole, so a batch that is run again after a failure, or
    after a restart from the checkpoint, stands there once. Ends when the input is used up.
    """

    def write(rows: DataFrame, batch: int) -> None:
        score_batch(rows).write.mode("overwrite").parquet(f"{path}/batch_id={batch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def write_fitted(
    stream: DataFrame, fitted: Fitted, path: str, checkpoint: str, defaults: Mapping[str, float] | None = None, cuts: Sequence[float] = RISK_CUTS
):
    """Scores of a stream by any fitted model, batch by batch."""
    return write_batches(stream, lambda rows: score(rows, fitted, defaults, cuts), path, checkpoint)

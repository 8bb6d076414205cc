"""Neighbour scores of a stream: equal to the batch, and once each after a restart."""

import os

from riskloom.operators import score as sc
from riskloom.operators.models import Fitted, fit_model, spec_of
from riskloom.operators.scale import apply_scaler, fit_scaler
from riskloom.streaming.score import write_fitted


def test_stream_of_neighbours_equals_the_batch_after_a_restart(spark, tmp_path):
    rows = [(i, float(i % 17), float(i % 23), int(i % 17 > 8)) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, age double, chol double, y int")
    features = ["age", "chol"]
    scaler = fit_scaler(df, features)
    model = fit_model(spec_of("knn"), apply_scaler(df, scaler), features, "y", "id")
    fitted = Fitted(spec_of("knn"), model, scaler, features)
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    records = df.select("id", *features)
    records.repartition(3).write.parquet(source)

    def run():
        stream = spark.readStream.schema(records.schema).option("maxFilesPerTrigger", 1).parquet(source)
        write_fitted(stream, fitted, out, state).awaitTermination(300)
        return spark.read.parquet(out).drop("batch_id")

    want = sc.score(records, fitted)
    got = run()
    assert got.columns == want.columns and got.count() == 300
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    # The last batch was written, but the stream ended before it was noted as done: it runs again.
    last = max(int(n) for n in os.listdir(f"{state}/commits") if n.isdigit())
    for name in (f"{last}", f".{last}.crc"):
        if os.path.exists(f"{state}/commits/{name}"):
            os.remove(f"{state}/commits/{name}")
    again = run()
    assert again.count() == 300 and again.exceptAll(want).count() == 0

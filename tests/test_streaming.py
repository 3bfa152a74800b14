import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidegauge.streaming import pipelines as P

SCHEMA = "symbol string, ts timestamp, close double"


@pytest.fixture()
def files(spark, tmp_path):
    p = pd.DataFrame({"symbol": ["a", "b"] * 30, "ts": pd.date_range("2024-01-01", periods=60, freq="min"), "close": 100 + np.cumsum(np.random.default_rng(0).normal(size=60))})
    for i in range(3):
        spark.createDataFrame(p[20 * i : 20 * (i + 1)]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return str(tmp_path / "in"), p


def _run(df, tmp_path, spark, name):
    q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"c_{name}")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).toPandas()


@pytest.mark.parametrize("kernel", [P.IncrementalRSI(5), P.IncrementalMACD(3, 6, 4), P.RingBuffer(4), P.StreamingForest(20, 10)])
def test_state_equals_one_pass(spark, files, tmp_path, kernel):
    path, p = files
    got = _run(P.stateful(P.file_stream(spark, path, SCHEMA), ["symbol"], "ts", "close", kernel), tmp_path, spark, "s_" + type(kernel).__name__)
    for s, g in p.groupby("symbol"):
        state, want = kernel.start(), []
        for v in g["close"]:
            want.append(kernel.step(state, v))
        mine = got[got["symbol"] == s].sort_values("ts")[kernel.outputs].to_numpy(float)
        if not isinstance(kernel, P.StreamingForest):
            assert np.allclose(mine, np.array(want, float), equal_nan=True)
        assert len(mine) == 30


def test_batches_and_windows(spark, files, tmp_path):
    path, _ = files
    seen = []
    steps = [lambda b: b.filter("close > 0")]
    q = P.run_steps(P.file_stream(spark, path, SCHEMA, files_per_batch=1), steps, lambda b, n: seen.append(b.count()), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert sum(seen) == 60 and len(seen) == 3
    bars = _run(P.event_time_bars(P.file_stream(spark, path, SCHEMA), ["symbol"], "ts", "close", "10 minutes", "5 minutes"), tmp_path, spark, "bars")
    assert (bars["low"] <= bars["open"]).all() and bars["n"].sum() <= 60
    assert P.sessions(spark.read.schema(SCHEMA).parquet(path), ["symbol"], "ts", "5 minutes").count() == 2


def test_validation_of_batches(spark):
    step = P.validate_batches(lambda b: ["bad"] if b.filter("id > 5").count() else [], rate=0.5)
    assert step(spark.range(10), 1).count() == 10
    with pytest.raises(ValueError):
        step(spark.range(10), 2)
    assert step(spark.range(3), 2).agg(F.count("*")).first()[0] == 3
